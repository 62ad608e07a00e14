"""Marts and windows."""

from pyspark.sql import Window as W, functions as F

from bondmarts import constants as K
from bondmarts.functions.numeric import ratio
from bondmarts.operators import agency, bench, city, issuers, kpi, partner, ranking, underwriter
from bondmarts.storage import store
from parity import projection as P
from parity.base import query
from parity.slices import NETWORK, OWN, enriched, with_fiscal

_KPI = """SELECT province, count(DISTINCT issuer) AS issuers,
        count(DISTINCT CASE WHEN rating IS NOT NULL AND trim(rating) <> '' THEN issuer END) AS rated_issuers,
        count(*) AS bonds, round(sum(issue_amount), 2) AS issue_amount, round(avg(coupon), 4) AS avg_coupon,
        count(DISTINCT city) AS cities, count(DISTINCT issuer_agency) AS agencies
    FROM bond WHERE province IS NOT NULL GROUP BY province"""


@query("province_kpi", _KPI)
def province_kpi(spark, sf):
    return kpi.province_kpi(P.bond(spark, sf))


@query(
    "median_sized_province",
    """SELECT province, issuers FROM (SELECT province, count(DISTINCT issuer) AS issuers FROM bond GROUP BY province)
    QUALIFY row_number() OVER (ORDER BY issuers, province) = count(*) OVER () // 2 + 1""",
)
def _(spark, sf):
    return kpi.median_sized_province(P.bond(spark, sf))


def _share(source: str) -> str:
    return f"""SELECT agency, province, count(DISTINCT issuer) AS issuers, count(*) AS bonds,
        round(count(DISTINCT issuer) * 100.0 / nullif(sum(count(DISTINCT issuer)) OVER (PARTITION BY province), 0), 1) AS issuer_share_pct,
        round(CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT issuer), 0), 2) AS bonds_per_issuer
    FROM ({source}) GROUP BY agency, province"""


_NAMED = "FROM bond WHERE issuer_agency IS NOT NULL AND issuer_agency <> ''"


@query("agency_market_share", _share(f"SELECT province, issuer, trim(issuer_agency) AS agency {_NAMED}"))
def _(spark, sf):
    return agency.agency_market_share(P.bond(spark, sf))


@query(
    "agency_market_share_split",
    _share("SELECT province, issuer, trim(unnest(string_split(bond_agency, ','))) AS agency FROM bond WHERE bond_agency <> ''"),
)
def _(spark, sf):
    """Agency lists taken apart, shown on the bond agencies, which are lists."""
    bonds = P.bond(spark, sf).drop("issuer_agency").withColumnRenamed("bond_agency", "issuer_agency")
    return agency.agency_market_share(bonds, split=True)


@query(
    "kpi_listing",
    """SELECT province, issue_amount, row_number() OVER (ORDER BY issue_amount DESC NULLS LAST, province) AS place
    FROM (SELECT province, round(sum(issue_amount), 2) AS issue_amount FROM bond GROUP BY province)""",
)
def _(spark, sf):
    figures = kpi.province_kpi(P.bond(spark, sf)).select("province", "issue_amount")
    return ranking.numbered(figures, kpi.kpi_order(), name="place")


_SHARES = _share(f"SELECT province, issuer, trim(issuer_agency) AS agency {_NAMED}")


@query("view_sorts", f"SELECT *, row_number() OVER (ORDER BY province, issuers DESC, agency) AS place FROM ({_SHARES})")
def _(spark, sf):
    """The final order of the market share, as places."""
    return ranking.numbered(agency.agency_market_share(P.bond(spark, sf)), agency.share_order(), name="place")


@query(
    "share_of_total",
    f"""SELECT province, agency, count(*) AS bonds, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY province) AS bond_share
    FROM (SELECT province, trim(issuer_agency) AS agency {_NAMED}) GROUP BY province, agency""",
)
def _(spark, sf):
    share = agency.agency_market_share(P.bond(spark, sf)).select("province", "agency", "bonds")
    return share.withColumn("bond_share", ratio("bonds", F.sum("bonds").over(W.partitionBy("province"))))


@query(
    "agency_landscape",
    "SELECT issuer, province, city, admin_level, rating, issuer_agency, city_fiscal, fiscal_band FROM enriched",
)
def _(spark, sf):
    return agency.agency_landscape(enriched(spark, sf))


@query("served_agencies", "SELECT DISTINCT province, issuer_agency FROM enriched WHERE issuer_agency IS NOT NULL")
def _(spark, sf):
    return agency.served_agencies(enriched(spark, sf))


_AGENCY_LIST = """SELECT province, agency, CAST(sum(n) AS BIGINT) AS issuer_bonds FROM
    (SELECT province, trim(issuer_agency) AS agency, 1 AS n FROM bond WHERE trim(issuer_agency) <> ''
     UNION ALL SELECT province, trim(bond_agency), 0 FROM bond WHERE trim(bond_agency) <> '')
    GROUP BY province, agency"""


@query("agency_list", _AGENCY_LIST)
def _(spark, sf):
    return agency.agency_listing(agency.agency_list(P.bond(spark, sf)))


_BANDS = ["0-100亿", "100-200亿", "200-300亿", "300-500亿", "500-700亿", "700-1000亿", "1000亿以上"]
_CATEGORY = {
    "fiscal": "CASE WHEN city_fiscal < 0 THEN NULL WHEN city_fiscal < 100 THEN '0-100亿' WHEN city_fiscal < 200 THEN '100-200亿' "
    "WHEN city_fiscal < 300 THEN '200-300亿' WHEN city_fiscal < 500 THEN '300-500亿' "
    "WHEN city_fiscal < 700 THEN '500-700亿' WHEN city_fiscal < 1000 THEN '700-1000亿' "
    "WHEN city_fiscal IS NOT NULL THEN '1000亿以上' END",
    "level": "admin_level",
    "rating": "CASE WHEN rating IN ('AAA', 'AA+', 'AA', 'AA-', 'A+', 'A') THEN rating END",
    "city": "city",
}


_ORDERED = {"fiscal": _BANDS, "level": list(K.LEVEL_RANK), "rating": list(K.RATING_RANK), "city": []}


def _order_of(dimension: str) -> str:
    labels = _ORDERED[dimension]
    if not labels:
        return "0"
    listed = ", ".join(f"'{x}'" for x in labels)
    return f"CAST(coalesce(nullif(list_position([{listed}], c.category), 0), {len(labels) + 1}) AS INTEGER)"


def matrix_tables(dimension: str, own: str, bonds: str = "bond_fiscal") -> dict[str, str]:
    category = _CATEGORY[dimension]
    if dimension == "fiscal":
        bands = ", ".join(f"'{b}'" for b in _BANDS)
        categories = f"SELECT DISTINCT province, unnest([{bands}]) AS category FROM bond"
    else:
        categories = f"SELECT DISTINCT province, {category} AS category FROM {bonds} WHERE {category} IS NOT NULL"
    return {
        "one": f"""SELECT province, issuer, issuer_agency AS agency, {category} AS category FROM {bonds}
            QUALIFY row_number() OVER (PARTITION BY province, issuer ORDER BY level_rank DESC, security_code) = 1""",
        "counted": "SELECT province, agency, category, count(*) AS n FROM one WHERE category <> '' AND agency IS NOT NULL GROUP BY 1, 2, 3",
        "agencies": f"""SELECT province, agency, agency = '{own}' AS is_own, CAST(row_number() OVER (PARTITION BY province
            ORDER BY (agency = '{own}') DESC, issuer_bonds DESC, agency) AS INTEGER) AS agency_order FROM ({_AGENCY_LIST})""",
        "categories": categories,
        "matrix": f"""SELECT a.province, a.agency, c.category, coalesce(n, 0) AS issuers, is_own, agency_order, {_order_of(dimension)} AS category_order
            FROM agencies a JOIN categories c ON a.province = c.province
            LEFT JOIN counted k ON a.province = k.province AND a.agency = k.agency AND c.category = k.category""",
    }


def _matrix(dimension: str):
    @query(
        f"competition_matrix_{dimension}",
        "SELECT province, agency, category, issuers, is_own, agency_order, category_order FROM matrix",
        matrix_tables(dimension, OWN),
    )
    def run(spark, sf):
        return agency.competition_matrix(with_fiscal(spark, sf), dimension, OWN)


for _dimension in ("fiscal", "level", "rating", "city"):
    _matrix(_dimension)


@query(
    "competition_matrix_wide",
    "SELECT province, agency, is_own, agency_order, "
    + ", ".join(f"CAST(sum(CASE WHEN category = '{b}' THEN issuers ELSE 0 END) AS BIGINT) AS \"{b}\"" for b in _BANDS)
    + " FROM matrix GROUP BY ALL",
    matrix_tables("fiscal", OWN),
)
def _(spark, sf):
    return agency.competition_matrix(with_fiscal(spark, sf), "fiscal", OWN, wide=True)


_LEVELS = list(K.LEVEL_RANK)


@query(
    "competition_matrix_wide_level",
    "SELECT province, agency, is_own, agency_order, "
    + ", ".join(f"CAST(sum(CASE WHEN category = '{x}' THEN issuers ELSE 0 END) AS BIGINT) AS \"{x}\"" for x in _LEVELS)
    + f", CAST(sum(CASE WHEN category_order > {len(_LEVELS)} THEN issuers ELSE 0 END) AS BIGINT) AS \"{K.OTHER_CATEGORIES}\" FROM matrix GROUP BY ALL",
    {
        "towns": "SELECT * REPLACE (CASE WHEN CAST(security_code AS BIGINT) % 3 = 0 THEN '镇级' ELSE admin_level END AS admin_level) FROM bond_fiscal",
        **matrix_tables("level", OWN, "towns"),
    },
)
def _(spark, sf):
    """A third of the bonds with a level outside the fixed ones, which the last column counts."""
    town = F.col("security_code").cast("long") % 3 == 0
    bonds = with_fiscal(spark, sf).withColumn("admin_level", F.when(town, "镇级").otherwise(F.col("admin_level")))
    return agency.competition_matrix(bonds, "level", OWN, wide=True)


# --- cities ----------------------------------------------------------------------------------------

_CITY_RANK = """SELECT province, city, city_fiscal,
        dense_rank() OVER (PARTITION BY province ORDER BY city_fiscal DESC NULLS LAST) AS fiscal_rank,
        count(*) OVER (PARTITION BY province) AS cities
    FROM enriched GROUP BY province, city, city_fiscal"""
_OVERVIEW = {
    "city_rank": _CITY_RANK,
    "rating_summary": """SELECT province, city, rating, CAST(sum(count(*)) OVER (PARTITION BY province, city) AS BIGINT) AS city_issuers,
        count(*) AS rating_issuers FROM enriched GROUP BY province, city, rating""",
    "detail": "SELECT province, city, rating, admin_level, count(*) AS level_issuers FROM enriched GROUP BY ALL",
}


@query(
    "city_credit_overview",
    """SELECT d.province, d.city, city_fiscal, fiscal_rank, cities, city_issuers, d.rating, rating_issuers, admin_level, level_issuers
    FROM detail d JOIN city_rank r ON d.province = r.province AND d.city = r.city
    JOIN rating_summary s ON d.province = s.province AND d.city = s.city AND d.rating = s.rating""",
    _OVERVIEW,
)
def _(spark, sf):
    return city.city_overview_listing(city.city_credit_overview(enriched(spark, sf)))


@query("city_dense_rank", f"SELECT province, city, fiscal_rank FROM ({_CITY_RANK})")
def _(spark, sf):
    return city.city_ranks(city.rating_levels(enriched(spark, sf))).select("province", "city", "fiscal_rank")


@query("cities_in_province", f"SELECT DISTINCT province, cities FROM ({_CITY_RANK})")
def _(spark, sf):
    return city.city_ranks(city.rating_levels(enriched(spark, sf))).select("province", "cities").distinct()


@query("city_issuer_total", "SELECT DISTINCT province, city, city_issuers FROM rating_summary", _OVERVIEW)
def _(spark, sf):
    totals = city.rating_totals(city.rating_levels(enriched(spark, sf)))
    return totals.select("province", "city", "city_issuers").distinct()


_CITIES = """SELECT province, city, count(*) AS issuers, arg_max(rating, rating_rank) AS top_rating, max(city_fiscal) AS city_fiscal
    FROM enriched GROUP BY province, city"""
_RANKED_CITIES = f"""SELECT *, CASE WHEN city_fiscal IS NOT NULL THEN rank() OVER (PARTITION BY province ORDER BY city_fiscal DESC NULLS LAST) END AS fiscal_rank,
        count(city_fiscal) OVER (PARTITION BY province) AS ranked_cities FROM ({_CITIES})"""


@query("competition_rank", f"SELECT province, city, fiscal_rank, ranked_cities FROM ({_RANKED_CITIES}) JOIN coords USING (city)")
def _(spark, sf):
    bubbles = city.city_bubbles(enriched(spark, sf), P.coords(spark, sf))
    return bubbles.select("province", "city", "fiscal_rank", "ranked_cities")


@query(
    "city_bubbles",
    f"""SELECT province, city, lon, lat, issuers, top_rating, city_fiscal, fiscal_rank, ranked_cities,
        least(40.0::DOUBLE, greatest(8.0::DOUBLE, 8 + issuers * 3.5::DOUBLE)) AS marker_size, left(city, 2) AS label
    FROM ({_RANKED_CITIES}) JOIN coords USING (city)""",
)
def _(spark, sf):
    return city.city_bubbles(enriched(spark, sf), P.coords(spark, sf))


@query(
    "city_breakdown",
    """SELECT province, city, rating, admin_level, count(*) AS issuers, row_number() OVER (PARTITION BY province, city
        ORDER BY max(rating_rank) DESC, rating, max(level_rank) DESC, admin_level) AS seq
    FROM enriched GROUP BY province, city, rating, admin_level""",
)
def _(spark, sf):
    return city.city_breakdown(enriched(spark, sf))


@query(
    "map_centre",
    """SELECT round(coalesce(avg(lon), 104), 6) AS lon, round(coalesce(avg(lat), 30), 6) AS lat FROM
    (SELECT city FROM enriched UNION SELECT city FROM fiscal) JOIN coords USING (city)""",
)
def _(spark, sf):
    cities = enriched(spark, sf).select("city").unionByName(P.fiscal(spark, sf).select("city"))
    return city.map_centre(cities, P.coords(spark, sf))


@query("cities_by_fiscal", "SELECT province, city, coalesce(max(city_fiscal), 0) AS city_fiscal FROM enriched GROUP BY province, city")
def _(spark, sf):
    return city.cities_listing(city.cities_by_fiscal(enriched(spark, sf)))


# --- benchmarks ------------------------------------------------------------------------------------

_STATS = {
    "min": "min({m})", "q1": "quantile_cont({m}, 0.25)", "median": "median({m})", "mean": "avg({m})",
    "q3": "quantile_cont({m}, 0.75)", "max": "max({m})",
}
_WIDE = ", ".join(f"round({sql.format(m=m)}, 2) AS {m}_{s}" for m in K.METRICS for s, sql in _STATS.items())


def _label(c: str, unknown: str) -> str:
    return f"coalesce(nullif(trim({c}), ''), '{unknown}')"


_CLEAN = f"{_label('city', '未知城市')} AS city, {_label('admin_level', '未知级别')} AS admin_level, {_label('rating', '未知评级')} AS rating"


@query(
    "financial_bench",
    f"""SELECT province, {_CLEAN}, count(*) AS sample_size, {_WIDE} FROM enriched
    WHERE province IS NOT NULL AND province <> '' GROUP BY enriched.province, enriched.city, enriched.admin_level, enriched.rating""",
)
def _(spark, sf):
    return bench.financial_bench(enriched(spark, sf))


@query(
    "quantiles",
    """SELECT province, quantile_cont(total_assets, 0.25) AS q1, median(total_assets) AS median,
        quantile_cont(total_assets, 0.75) AS q3, count(*) AS n_rows, count(total_assets) AS n
    FROM bond GROUP BY province""",
)
def _(spark, sf):
    """Over all bonds, so that every province is a large group with many equal values."""
    found = ranking.quantiles(
        P.bond(spark, sf), ["province"], ["total_assets"], "security_code", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    return found.select("province", "q1", "median", "q3", "n_rows", "n")


@query("bench_slice", f"SELECT count(*) AS sample_size, {_WIDE} FROM enriched WHERE rating = 'AA' AND admin_level = '地市级'")
def _(spark, sf):
    return bench.bench_slice(enriched(spark, sf), city="", admin_level="地市级", rating="AA")


CUBE = """SELECT province,
        CASE WHEN grouping(city) = 1 THEN '全部' ELSE coalesce(nullif(trim(city), ''), '未知城市') END AS city,
        CASE WHEN grouping(admin_level) = 1 THEN '全部' ELSE coalesce(nullif(trim(admin_level), ''), '未知级别') END AS admin_level,
        CASE WHEN grouping(rating) = 1 THEN '全部' ELSE coalesce(nullif(trim(rating), ''), '未知评级') END AS rating,
        CAST(grouping(city, admin_level, rating) AS INTEGER) AS all_mask, metric, count(*) AS n_rows, count(v) AS n, round(min(v), 2) AS min,
        round(quantile_cont(v, 0.25), 2) AS q1, round(median(v), 2) AS median, round(avg(v), 2) AS mean,
        round(quantile_cont(v, 0.75), 2) AS q3, round(max(v), 2) AS max
    FROM (SELECT province, city, admin_level, rating, unnest(['total_assets', 'net_assets', 'revenue', 'net_profit', 'leverage']) AS metric,
        unnest([total_assets, net_assets, revenue, net_profit, leverage]) AS v FROM enriched)
    GROUP BY province, metric, CUBE (city, admin_level, rating)"""


@query("bench_cube", CUBE)
def bench_cube(spark, sf):
    return bench.bench_cube(enriched(spark, sf))


@query(
    "bench_slice_stored",
    f"""SELECT province, count(*) AS sample_size, {_WIDE} FROM enriched
    WHERE rating = 'AA' AND admin_level = '地市级' AND province <> '' GROUP BY province""",
)
def _(spark, sf):
    """The same filters as in bench_slice, per province and from the stored cube."""
    return bench.cube_slice(P.cube(spark, sf), city="", admin_level="地市级", rating="AA")


@query(
    "issuer_bench",
    """SELECT province, metric, count(*) AS n_rows, count(v) AS n, round(min(v), 2) AS min, round(quantile_cont(v, 0.25), 2) AS q1,
        round(median(v), 2) AS median, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.75), 2) AS q3, round(max(v), 2) AS max
    FROM (SELECT province, unnest(['total_assets', 'net_assets', 'revenue', 'net_profit', 'leverage']) AS metric,
        unnest([total_assets, net_assets, revenue, net_profit, leverage]) AS v FROM enriched) GROUP BY province, metric""",
)
def _(spark, sf):
    return bench.issuer_bench(enriched(spark, sf))


# --- underwriters and partners ---------------------------------------------------------------------

_UNDERWRITER = """SELECT coalesce(province, '未知') AS province, city, admin_level, rating, fiscal_band, underwriter,
        count(DISTINCT issuer) AS issuers, count(*) AS bonds, round(sum(issue_amount), 2) AS issue_amount
    FROM (SELECT trim(unnest(string_split(b.underwriters, ','))) AS underwriter, b.issuer, b.issue_amount, b.province, b.city,
            b.admin_level, b.rating, coalesce(e.fiscal_band, '财力未知') AS fiscal_band
        FROM bond b LEFT JOIN enriched e ON b.issuer = e.issuer WHERE b.underwriters IS NOT NULL AND b.underwriters <> '') x
    GROUP BY x.province, city, admin_level, rating, fiscal_band, underwriter"""


@query(
    "underwriter_stats",
    f"""SELECT *, round(CAST(bonds AS DOUBLE) / nullif(issuers, 0), 2) AS bonds_per_issuer,
        row_number() OVER (PARTITION BY province, city, admin_level, rating, fiscal_band ORDER BY bonds DESC, underwriter) AS seq
    FROM ({_UNDERWRITER})""",
)
def _(spark, sf):
    return underwriter.underwriter_stats(P.bond(spark, sf), enriched(spark, sf))


@query(
    "underwriter_rank",
    f"""SELECT province, city, admin_level, rating, fiscal_band, underwriter, bonds,
        row_number() OVER (PARTITION BY province, city, admin_level, rating, fiscal_band ORDER BY bonds DESC, underwriter) AS seq
    FROM ({_UNDERWRITER})""",
)
def _(spark, sf):
    by, order = ["province", "city", "admin_level", "rating", "fiscal_band"], [F.desc("bonds"), F.col("underwriter")]
    slices = underwriter.underwriter_slices(P.bond(spark, sf), enriched(spark, sf)).select(*by, "underwriter", "bonds")
    return ranking.numbered(slices, order, by=by)


_PROVINCE_UNDERWRITERS = """SELECT province, underwriter, count(DISTINCT issuer) AS issuers, count(*) AS bonds,
        round(sum(issue_amount), 2) AS issue_amount,
        round(CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT issuer), 0), 2) AS bonds_per_issuer
    FROM (SELECT province, issuer, issue_amount, trim(u) AS underwriter FROM bond, unnest(string_split(underwriters, ',')) AS t(u))
    WHERE underwriter <> '' GROUP BY province, underwriter"""


@query("underwriter_province_totals", _PROVINCE_UNDERWRITERS)
def _(spark, sf):
    return underwriter.underwriter_province_totals(P.bond(spark, sf))


@query(
    "sequence_number",
    f"SELECT *, row_number() OVER (PARTITION BY province ORDER BY bonds DESC, underwriter) AS seq FROM ({_PROVINCE_UNDERWRITERS})",
)
def _(spark, sf):
    return underwriter.underwriter_province_stats(P.bond(spark, sf))


def _grade(count: str, main_at: int = 3) -> str:
    return f"CASE WHEN {count} >= {main_at} THEN '主要合作伙伴' WHEN {count} >= 1 THEN '初步合作对象' ELSE '待开拓合作关系' END AS grade"


_TOTALS = """SELECT province, underwriter, count(DISTINCT issuer) AS total_issuers,
        string_agg(DISTINCT issuer, '、' ORDER BY issuer) AS total_list FROM uw GROUP BY province, underwriter"""
_SHARED = """SELECT province, agency, underwriter, count(DISTINCT issuer) AS shared_issuers,
        string_agg(DISTINCT issuer, '、' ORDER BY issuer) AS shared_list FROM uw JOIN ag USING (province, issuer)
        GROUP BY province, agency, underwriter"""
_NETWORK = {**NETWORK, "totals": _TOTALS, "shared": _SHARED}


@query(
    "partner_network",
    f"""SELECT t.province, coalesce(agency, '未知评级机构') AS agency, t.underwriter, total_issuers,
        coalesce(shared_issuers, 0) AS shared_issuers, {_grade('coalesce(shared_issuers, 0)')}
    FROM totals t LEFT JOIN shared s ON t.province = s.province AND t.underwriter = s.underwriter""",
    _NETWORK,
)
def _(spark, sf):
    return partner.partner_network(P.bond(spark, sf))


@query(
    "partner_counts",
    f"""SELECT t.province, coalesce(agency, '未知评级机构') AS agency, t.underwriter, total_issuers, coalesce(shared_issuers, 0) AS shared_issuers,
        {_grade('coalesce(shared_issuers, 0)')}, row_number() OVER (
            ORDER BY t.province, coalesce(shared_issuers, 0) DESC, total_issuers DESC, coalesce(agency, '未知评级机构'), t.underwriter) AS place
    FROM totals t LEFT JOIN shared s ON t.province = s.province AND t.underwriter = s.underwriter""",
    _NETWORK,
)
def _(spark, sf):
    network = partner.partner_network(P.bond(spark, sf))
    return ranking.numbered(network, partner.partner_order(), name="place")


@query("partner_names", "SELECT DISTINCT province, agency, underwriter, issuer FROM uw JOIN ag USING (province, issuer)", _NETWORK)
def _(spark, sf):
    """The client names behind the counts, as rows."""
    return partner.shared_clients(P.bond(spark, sf)).select("province", "agency", "underwriter", "issuer")


@query("client_names", "SELECT DISTINCT province, underwriter, issuer FROM uw", _NETWORK)
def _(spark, sf):
    """All clients of each underwriter, the names behind the total counts, as rows."""
    return partner.underwriter_issuers(partner.scope(P.bond(spark, sf))).select("province", "underwriter", "issuer")


@query(
    "name_pages",
    """SELECT province, underwriter, CAST((place - 1) // 20 + 1 AS BIGINT) AS page, string_agg(issuer, '、' ORDER BY issuer) AS names, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY province, underwriter ORDER BY issuer) AS place FROM (SELECT DISTINCT province, underwriter, issuer FROM uw))
    GROUP BY ALL""",
    _NETWORK,
)
def _(spark, sf):
    """All clients of each underwriter as texts of at most 20 names, in order."""
    clients = store(partner.underwriter_issuers(partner.scope(P.bond(spark, sf))))
    pages = partner.name_pages(clients, ["province", "underwriter"], page=20)
    return pages.select("province", "underwriter", "page", "names", F.size(F.split("names", "、")).cast("long").alias("n"))


@query("merged_names", "SELECT DISTINCT underwriter, issuer FROM uw JOIN ag USING (province, issuer)", _NETWORK)
def _(spark, sf):
    """The names behind the counts of merged_clients, as rows."""
    return partner.merged_names(partner.shared_clients(P.bond(spark, sf)))


def _partners(agency_name: str, condition: str = "true") -> str:
    return f"""SELECT province, underwriter, count(DISTINCT issuer) AS total_issuers,
        count(DISTINCT CASE WHEN mine THEN issuer END) AS shared_issuers,
        FROM (SELECT b.province, b.issuer, trim(unnest(string_split(underwriters, ','))) AS underwriter, c.issuer IS NOT NULL AS mine
        FROM bond b LEFT JOIN (SELECT DISTINCT province, issuer FROM bond WHERE {condition}
            AND (contains(issuer_agency, '{agency_name}') OR contains(bond_agency, '{agency_name}'))) c
        ON b.province = c.province AND b.issuer = c.issuer WHERE underwriters IS NOT NULL AND {condition})
    WHERE underwriter <> '' GROUP BY province, underwriter"""


@query(
    "agency_partners",
    f"SELECT *, {_grade('shared_issuers')} FROM ({_partners('大公国际', 'admin_level = ' + chr(39) + '省级' + chr(39))})",
)
def _(spark, sf):
    return partner.agency_partners(P.bond(spark, sf), "大公国际", admin_level="省级", city="")[0]


@query(
    "merged_clients",
    f"""SELECT underwriter, max(total_issuers) AS total_issuers, count(DISTINCT issuer) AS shared_issuers, {_grade('count(DISTINCT issuer)')}
    FROM totals t LEFT JOIN (SELECT province, underwriter, issuer FROM uw JOIN ag USING (province, issuer)) USING (province, underwriter)
    GROUP BY underwriter""",
    _NETWORK,
)
def _(spark, sf):
    bonds = P.bond(spark, sf)
    return partner.merged_clients(partner.partner_network(bonds), partner.shared_clients(bonds))


@query("partner_advice", f"SELECT province, grade, underwriter, total_issuers, shared_issuers FROM (SELECT *, {_grade('shared_issuers')} FROM ({_partners('大公国际')}))")
def _(spark, sf):
    found, _clients = partner.agency_partners(P.bond(spark, sf), "大公国际")
    return partner.advice(found)
