"""Sources, snapshots and cleaning."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from bondmarts import storage
from bondmarts.functions import numeric, text
from bondmarts.operators import filters, issuers
from bondmarts.plans import build, serving
from bondmarts.plans.issuer_store import IssuerStore
from bondmarts.plans.mart_store import MartStore
from bondmarts.sources import export, snapshots, staging
from parity import projection as P
from parity.base import query
from parity.slices import NETWORK


def _new_folder(spark) -> str:
    return f"{storage.shared_dir(spark)}/{uuid.uuid4().hex}"


@query(
    "scan_snapshot",
    "SELECT security_code, issuer, province, issue_amount, level_rank, '20230216' AS snapshot_date FROM bond",
)
def _(spark, sf):
    return snapshots.bond(spark, P.warehouse(spark, sf), P.ACTIVE).select(
        "security_code", "issuer", "province", "issue_amount", "level_rank", "snapshot_date"
    )


@query("scan_fiscal", "SELECT city, revenue, province, fiscal_year FROM fiscal")
def _(spark, sf):
    return P.fiscal(spark, sf)


@query(
    "resolve_headers",
    """SELECT security_code, issuer, bond_class, coupon, total_assets, controller,
        CASE WHEN o_orderkey % 7 <> 0 AND c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY')
             THEN admin_level ELSE left(admin_level, length(admin_level) - 1) END AS admin_level
    FROM bond JOIN orders ON security_code = CAST(o_orderkey AS VARCHAR) JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, sf):
    return staging.resolve_headers(P.raw_bond(spark, sf)).select(
        "security_code", "issuer", "admin_level", "bond_class", "coupon", "total_assets", "controller"
    )


@query(
    "fiscal_headers",
    'SELECT city, revenue, city AS "城市备注", province AS "省份" FROM fiscal',
)
def _(spark, sf):
    return staging.coerce_numeric(staging.resolve_fiscal_headers(P.raw_fiscal(spark, sf)), ["revenue"])


@query(
    "snapshot_id",
    """SELECT '20230216' AS snapshot_date, count(*) AS bonds FROM bond
    UNION ALL SELECT '20000101', count(*) FROM bond WHERE report_date < '2000-01-01'""",
)
def _(spark, sf):
    """The date in the name of the raw file that a row comes from."""
    folder = P.raw_files(spark, sf)
    raw = spark.read.parquet(*[f"{folder}/bond/{name}" for name in storage.list_names(spark, f"{folder}/bond")])
    return raw.groupBy(staging.snapshot_date_of(staging.source_label()).alias("snapshot_date")).agg(F.count("*").alias("bonds"))


@query("province_from_file", "SELECT province, count(*) AS cities FROM fiscal GROUP BY province")
def _(spark, sf):
    """The province in the name of the fiscal file that a row comes from."""
    staged = snapshots.read_fiscal_files(spark, f"{P.raw_files(spark, sf)}/fiscal", P.FISCAL_YEAR)
    return staged.groupBy("province").agg(F.count("*").alias("cities"))


@query(
    "other_columns",
    "SELECT security_code, o_orderstatus AS \"备注\" FROM bond JOIN orders ON security_code = CAST(o_orderkey AS VARCHAR)",
)
def _(spark, sf):
    """A source column that the schema does not know, read back from the snapshot."""
    return snapshots.bond(spark, P.warehouse(spark, sf), P.ACTIVE, other="`备注` string").select("security_code", "备注")


_KPI_SQL = """SELECT province AS "省份", count(DISTINCT issuer) AS "总发行主体_家",
        count(DISTINCT CASE WHEN rating IS NOT NULL AND trim(rating) <> '' THEN issuer END) AS "已评级主体_家",
        count(*) AS "债项总数_条", round(sum(issue_amount), 2) AS "发行总额_亿", round(avg(coupon), 4) AS "平均票面利率_pct",
        count(DISTINCT city) AS "覆盖城市_个", count(DISTINCT issuer_agency) AS "评级机构数_家"
    FROM bond"""


@query("build", f"{_KPI_SQL} GROUP BY province")
def _(spark, sf):
    """From raw files to a served view: the newest bond file is the one that counts."""
    root, folder = _new_folder(spark), P.raw_files(spark, sf)
    build.build(spark, root, f"{folder}/bond", f"{folder}/fiscal", P.FISCAL_YEAR)
    return spark.table("v_province_kpi")


@query(
    "build_late_fiscal",
    """SELECT province, count(*) AS issuers, count(city_fiscal) AS with_revenue, round(sum(city_fiscal), 2) AS revenue,
        CAST(count(DISTINCT fiscal_band) AS BIGINT) AS bands, province = 'EUROPE' AS written_again
    FROM enriched GROUP BY province""",
)
def _(spark, sf):
    """A province whose fiscal file comes late has its revenue after the second build; the others stay as they were written."""
    root, folder, bonds = _new_folder(spark), P.raw_files(spark, sf), f"{P.raw_files(spark, sf)}/bond"
    late = f"{P.FISCAL_YEAR}年EUROPE财力.csv"
    with P.folder_without(spark, f"{folder}/fiscal", late) as early:
        date = build.build(spark, root, bonds, early, P.FISCAL_YEAR)
    first = MartStore(spark, root, date, P.FISCAL_YEAR)
    before = first.manifest(first.write(serving.marts))["int_v_issuer_enriched"].parts
    build.build(spark, root, bonds, f"{folder}/fiscal", P.FISCAL_YEAR)
    after = first.manifest(first.write(serving.marts))["int_v_issuer_enriched"]
    again = [first.table(after, [part]).select("province").first().province for part, key in after.parts.items() if before.get(part) != key]
    return spark.table("int_v_issuer_enriched").groupBy(F.col("省份").alias("province")).agg(
        F.count("*").alias("issuers"), F.count("城市财力_亿元").alias("with_revenue"), numeric.round_to(F.sum("城市财力_亿元"), 2).alias("revenue"),
        F.count_distinct("城市财力区间").alias("bands"), F.first(F.col("省份").isin(again)).alias("written_again"),
    )


@query("issuers_next_snapshot", "SELECT * FROM enriched")
def _(spark, sf):
    """Issuers of the second snapshot, of which only buckets with other bonds than in the first are computed."""
    root = P.warehouse(spark, sf)
    kept = IssuerStore(spark, root, _new_folder(spark))
    kept.write(P.EARLIER)
    kept.write(P.ACTIVE)
    return kept.enriched(P.ACTIVE, P.fiscal(spark, sf))


@query(
    "active_snapshot",
    "SELECT '20000101' AS snapshot_date, '2021' AS fiscal_year, count(*) AS bonds FROM bond WHERE report_date < '2000-01-01'",
)
def _(spark, sf):
    """What a new session finds active after a roll-back."""
    root = P.warehouse(spark, sf)
    serving.activate(spark, root, P.ACTIVE, P.FISCAL_YEAR)
    serving.activate(spark, root, P.EARLIER, P.FISCAL_YEAR)
    date, year = snapshots.active(spark, root)
    bonds = snapshots.bond(spark, root, date).groupBy("snapshot_date").agg(F.count("*").alias("bonds"))
    return bonds.select("snapshot_date", F.lit(year).alias("fiscal_year"), "bonds")


@query(
    "lineage_columns",
    """SELECT _snapshot_date AS snapshot_date, _snapshot_source AS snapshot_source, province, count(*) AS bonds, round(sum(issue_amount), 2) AS amount
    FROM (SELECT * FROM bond UNION ALL SELECT * REPLACE ('20000101' AS _snapshot_date, replace(_snapshot_source, '20230216', '20000101') AS _snapshot_source)
        FROM bond WHERE report_date < '2000-01-01') GROUP BY ALL""",
)
def _(spark, sf):
    """Date and file that the rows of two snapshots, built from their raw files, carry back from the lake."""
    root, files = _new_folder(spark), P.raw_files(spark, sf)
    for source in storage.list_names(spark, f"{files}/bond"):
        raw = spark.read.parquet(f"{files}/bond/{source}").withColumn("_file", staging.source_label())
        staged = staging.stage_bond(raw, staging.snapshot_date_of(F.col("_file")), F.col("_file"))
        snapshots.build_snapshot(staged, root, staged.select("_snapshot_date").first()[0])
    read = [snapshots.bond(spark, root, date) for date in snapshots.list_snapshots(spark, root)]
    return read[0].unionByName(read[1]).groupBy(
        F.col("_snapshot_date").alias("snapshot_date"), F.col("_snapshot_source").alias("snapshot_source"), "province"
    ).agg(F.count("*").alias("bonds"), numeric.round_to(F.sum("issue_amount"), 2).alias("amount"))


@query(
    "write_snapshot",
    """SELECT province, count(*) AS bonds, round(sum(issue_amount), 2) AS amount, true AS written, false AS written_again
    FROM bond GROUP BY province""",
)
def _(spark, sf):
    root, bonds = _new_folder(spark), P.bond(spark, sf)
    written = snapshots.write_snapshot(bonds, root, P.ACTIVE)
    again = snapshots.write_snapshot(bonds, root, P.ACTIVE)
    stored = snapshots.bond(spark, root, P.ACTIVE)
    return stored.groupBy("province").agg(
        F.count("*").alias("bonds"),
        numeric.round_to(F.sum("issue_amount"), 2).alias("amount"),
        F.lit(written).alias("written"),
        F.lit(again).alias("written_again"),
    )


@query("write_fiscal", "SELECT city, revenue, province, fiscal_year FROM fiscal WHERE province <> 'EUROPE'")
def _(spark, sf):
    """One province lists its cities twice, fails its check and is left out."""
    root, staged = _new_folder(spark), P.staged_fiscal(spark, sf)
    snapshots.write_fiscal(staged.unionByName(staged.filter("province = 'EUROPE'")), root)
    return snapshots.fiscal(spark, root)


@query(
    "list_snapshots",
    """SELECT '20230216' AS snapshot_date, count(*) AS bonds FROM bond
    UNION ALL SELECT '20000101', count(*) FROM bond WHERE report_date < '2000-01-01'""",
)
def _(spark, sf):
    root = P.warehouse(spark, sf)
    dates = snapshots.list_snapshots(spark, root)
    lake = snapshots.bond(spark, root, dates[0])
    for date in dates[1:]:
        lake = lake.unionByName(snapshots.bond(spark, root, date))
    return lake.groupBy("snapshot_date").agg(F.count("*").alias("bonds"))


@query("latest_snapshot", "SELECT '20230216' AS snapshot_date, count(DISTINCT issuer) AS issuers FROM bond")
def _(spark, sf):
    root = P.warehouse(spark, sf)
    latest = snapshots.bond(spark, root, snapshots.latest_snapshot(spark, root))
    return latest.groupBy("snapshot_date").agg(F.count_distinct("issuer").alias("issuers"))


@query("activate_snapshot", f"{_KPI_SQL} WHERE report_date < '2000-01-01' GROUP BY province")
def _(spark, sf):
    """Roll back to the older snapshot and ask a served view by its published columns."""
    serving.activate(spark, P.warehouse(spark, sf), P.EARLIER, P.FISCAL_YEAR)
    return spark.sql("SELECT * FROM v_province_kpi")


@query(
    "province_analysis",
    """SELECT province, count(DISTINCT issuer) AS issuers, count(*) AS bonds, round(sum(issue_amount), 2) AS issue_amount,
        count(DISTINCT city) AS cities, count(city_fiscal) AS with_revenue
    FROM bond_fiscal WHERE province = 'ASIA' GROUP BY province""",
)
def _(spark, sf):
    """Figures and join of one province, which no other province takes part in."""
    found = serving.province_analysis(P.bond(spark, sf), P.fiscal(spark, sf), "ASIA省")
    figures = found["province_kpi"].select("province", "issuers", "bonds", "issue_amount", "cities")
    return figures.join(found["join_audit"].select("province", F.col("matched").alias("with_revenue")), "province")


_VIEW_ROWS = {
    "v_bond": "bond", "v_fiscal": "fiscal", "int_v_issuer_enriched": "enriched", "v_issuer_profile": "enriched",
    "v_agency_competitive_landscape": "enriched",
    "v_province_kpi": "(SELECT DISTINCT province FROM bond)",
    "v_agency_market_share": "(SELECT DISTINCT province, trim(issuer_agency) FROM rated WHERE trim(issuer_agency) <> '')",
    "v_city_credit_overview": "(SELECT DISTINCT province, city, rating, admin_level FROM enriched)",
    "v_financial_bench": "(SELECT DISTINCT province, city, admin_level, rating FROM enriched)",
    "v_underwriter_stats": """(SELECT DISTINCT b.province, b.city, b.admin_level, b.rating, fiscal_band, underwriter FROM
        (SELECT *, trim(unnest(string_split(underwriters, ','))) AS underwriter FROM bond WHERE underwriters <> '') b
        LEFT JOIN enriched e ON b.issuer = e.issuer)""",
    "v_partner_network": """(SELECT DISTINCT u.province, underwriter, agency FROM uw u LEFT JOIN ag a ON u.province = a.province AND u.issuer = a.issuer
        QUALIFY agency IS NOT NULL OR count(agency) OVER (PARTITION BY u.province, underwriter) = 0)""",
}


@query("serve_views", " UNION ALL ".join(f"SELECT '{v}' AS view_name, count(*) AS view_rows FROM {t}" for v, t in _VIEW_ROWS.items()), NETWORK)
def _(spark, sf):
    """Rows of all served views, of written marts."""
    serving.write_marts(spark, P.warehouse(spark, sf), P.ACTIVE, P.FISCAL_YEAR)
    serving.activate(spark, P.warehouse(spark, sf), P.ACTIVE, P.FISCAL_YEAR)
    counts = [spark.table(v).agg(F.lit(v).alias("view_name"), F.count("*").alias("view_rows")) for v in serving.VIEW_LABELS]
    return reduce(DataFrame.unionByName, counts)


@query(
    "build_record",
    """SELECT '20230216' AS active_snapshot, '2021' AS fiscal_year, '20000101,20230216' AS snapshots,
        CAST((SELECT count(*) FROM (SELECT unnest([count(total_assets), count(net_assets), count(revenue), count(net_profit), count(leverage),
            count(report_date)]) AS n, count(*) AS all_rows FROM bond) WHERE n < all_rows * 0.2) AS INTEGER) AS notes""",
)
def _(spark, sf):
    return snapshots.builds(spark, P.warehouse(spark, sf)).select(
        "active_snapshot", "fiscal_year", F.array_join("snapshots", ",").alias("snapshots"), F.size("notes").alias("notes")
    )


@query(
    "export_cases",
    """SELECT province AS "省份",
        row_number() OVER (PARTITION BY province ORDER BY city_fiscal DESC NULLS LAST, level_rank DESC, rating_rank DESC,
            issue_amount DESC NULLS LAST, security_code) AS "序号",
        issuer AS "发行人中文名称", city AS "城市", city_fiscal AS "一般公共预算收入(亿元)", admin_level AS "行政级别",
        rating AS "主体评级", security_code AS "证券代码", security_name AS "证券简称", underwriters AS "主承销商",
        bond_class AS "Wind债券二级分类", issue_amount AS "发行总额(亿元)", coupon AS "票面利率(%)"
    FROM bond_fiscal WHERE contains(issuer_agency, '大公国际') AND rating = 'AA'""",
)
def _(spark, sf):
    with_fiscal = issuers.with_city_fiscal(P.bond(spark, sf), P.fiscal(spark, sf), ("province", "city"))
    cases = filters.case_list(with_fiscal, "大公国际", rating="AA")
    path = _new_folder(spark)
    export.export_cases(cases, path)
    return spark.read.schema(export.renamed_cases(cases).schema).options(**export.CSV_OPTIONS).csv(path)


# --- cleaning --------------------------------------------------------------------------------------


@query("agency_alias", "SELECT security_code, issuer_agency, bond_agency FROM bond")
def _(spark, sf):
    raw = staging.resolve_headers(P.raw_bond(spark, sf))
    return staging.normalize_agencies(raw).select("security_code", "issuer_agency", "bond_agency")


@query("level_suffix", "SELECT security_code, admin_level FROM bond")
def _(spark, sf):
    raw = staging.resolve_headers(P.raw_bond(spark, sf))
    return staging.add_level_suffix(raw).select("security_code", "admin_level")


@query("level_ordinal", "SELECT admin_level, level_rank, count(*) AS bonds FROM bond GROUP BY 1, 2")
def _(spark, sf):
    ranked = staging.add_ranks(P.bond(spark, sf).drop("level_rank", "rating_rank"))
    return ranked.groupBy("admin_level", "level_rank").agg(F.count("*").alias("bonds"))


@query(
    "rating_ordinal",
    "SELECT rating, CASE WHEN rating IS NULL THEN 0 ELSE rating_rank END AS rating_rank, count(*) AS bonds FROM bond GROUP BY 1, 2",
)
def _(spark, sf):
    ranked = staging.add_ranks(P.bond(spark, sf).drop("level_rank", "rating_rank"))
    return ranked.groupBy("rating", "rating_rank").agg(F.count("*").alias("bonds"))


@query("report_date_text", "SELECT security_code, report_date FROM bond")
def _(spark, sf):
    raw = staging.resolve_headers(P.raw_bond(spark, sf))
    return staging.report_date_text(raw).select("security_code", "report_date")


@query(
    "numeric_coercion",
    """SELECT l_returnflag, count(*) AS items, count(CASE WHEN l_returnflag <> 'A' THEN 1 END) AS numbers,
        sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity END) AS quantity
    FROM lineitem GROUP BY l_returnflag""",
)
def _(spark, sf):
    cell = F.when(F.col("l_returnflag") == "A", "-").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
    items = P.table(spark, sf, "lineitem").select("l_returnflag", cell.alias("quantity"))
    return staging.coerce_numeric(items, ["quantity"]).groupBy("l_returnflag").agg(
        F.count("*").alias("items"), F.count("quantity").alias("numbers"), F.sum("quantity").alias("quantity")
    )


@query(
    "agency_short_name",
    """SELECT issuer_agency, CASE issuer_agency WHEN '联合资信评估股份有限公司' THEN '联合资信'
            WHEN '中诚信国际信用评级有限责任公司' THEN '中诚信国际' WHEN '大公国际资信评估有限公司' THEN '大公国际'
            WHEN '鹏元资信评估有限公司' THEN '鹏元资信' ELSE left(issuer_agency, 4) END AS short_name, count(*) AS bonds
    FROM bond GROUP BY issuer_agency""",
)
def _(spark, sf):
    return P.bond(spark, sf).groupBy("issuer_agency", text.agency_short("issuer_agency").alias("short_name")).agg(
        F.count("*").alias("bonds")
    )


@query("city_short_name", "SELECT city, left(city, 2) AS short_name, count(*) AS bonds FROM bond GROUP BY city")
def _(spark, sf):
    return P.bond(spark, sf).groupBy("city", text.city_short("city").alias("short_name")).agg(F.count("*").alias("bonds"))


@query(
    "round_half_away",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS raw_value, round(l_extendedprice * l_discount, 2) AS rounded FROM lineitem",
)
def _(spark, sf):
    value = F.col("l_extendedprice") * F.col("l_discount")
    return P.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", value.alias("raw_value"), numeric.round_to(value, 2).alias("rounded")
    )


@query(
    "trim_unicode",
    """SELECT l_orderkey, l_linenumber, trim(padded) AS text, length(trim(padded)) AS n_chars FROM (SELECT l_orderkey, l_linenumber,
        repeat(chr(12288), l_linenumber % 3) || repeat(chr(160), l_suppkey % 4) || repeat(' ', l_partkey % 2) || l_returnflag || repeat(' ', l_linenumber % 2)
            || repeat(chr(8195), l_suppkey % 3) || l_linestatus || repeat(chr(9), l_linenumber % 2) || repeat(' ', l_suppkey % 5) || repeat(chr(12288), l_partkey % 3) AS padded FROM lineitem)""",
)
def _(spark, sf):
    """Spaces of several kinds around a text, as many as the row's numbers say; those within stay, and so do tabs."""

    def pad(space: str, column: str, kinds: int):
        return F.repeat(F.lit(space), (F.col(column) % kinds).cast("int"))

    padded = F.concat(
        pad("\u3000", "l_linenumber", 3), pad("\u00a0", "l_suppkey", 4), pad(" ", "l_partkey", 2), "l_returnflag", pad(" ", "l_linenumber", 2),
        pad("\u2003", "l_suppkey", 3), "l_linestatus", pad("\t", "l_linenumber", 2), pad(" ", "l_suppkey", 5), pad("\u3000", "l_partkey", 3),
    )
    rows = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.trim_spaces(padded).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
