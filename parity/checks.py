"""Quality checks and decisions."""

from pyspark.sql import functions as F

from bondmarts import constants as K
from bondmarts.operators import agency, bench, decisions, issuers, kpi, quality
from bondmarts.storage import store
from parity import projection as P
from parity.base import query
from parity.marts import CUBE, matrix_tables
from parity.slices import OWN, enriched, with_fiscal


def _nulls(check: str, column: str, given: str, base: str, limit: float) -> str:
    kept = "issuer IS NOT NULL AND province IS NOT NULL AND city IS NOT NULL" if base == "kept" else "true"
    over = ">=" if check == "required" else ">"
    return f"""SELECT '{check}' AS "check", '{column}' AS column_name, count(*) FILTER (WHERE {given} AND {column} IS NULL) AS nulls,
        count(*) FILTER (WHERE {kept}) AS "rows",
        CAST(count(*) FILTER (WHERE {given} AND {column} IS NULL) AS DOUBLE) / count(*) FILTER (WHERE {kept}) AS null_rate,
        CAST(count(*) FILTER (WHERE {given} AND {column} IS NULL) AS DOUBLE) / count(*) FILTER (WHERE {kept}) {over} {limit} AS over_limit
    FROM bond"""


_KEPT = "issuer IS NOT NULL AND province IS NOT NULL AND city IS NOT NULL"
_REPORTS = {
    "required": [_nulls("required", c, "true", "all", 1.0) for c in K.REQUIRED_BOND_COLUMNS],
    "critical": [
        _nulls("critical", "issuer", "true", "all", 0.02),
        _nulls("critical", "province", "issuer IS NOT NULL", "all", 0.02),
        _nulls("critical", "city", "issuer IS NOT NULL AND province IS NOT NULL", "all", 0.02),
    ],
    "watched": [_nulls("watched", c, _KEPT, "kept", 0.80) for c in K.WATCHED_BOND_COLUMNS],
}


def _bond_check(name: str, check: str):
    @query(name, " UNION ALL ".join(_REPORTS[check]))
    def run(spark, sf):
        return quality.bond_null_report(P.bond(spark, sf)).filter(F.col("check") == check)


_bond_check("required_columns", "required")
_bond_check("critical_nulls", "critical")
_bond_check("watched_nulls", "watched")


@query(
    "drop_critical_nulls",
    """SELECT security_code, issuer, bond_rating AS city FROM bond WHERE bond_rating IS NOT NULL""",
)
def _(spark, sf):
    """Bond rating stands in for a key column with nulls."""
    bonds = P.bond(spark, sf).withColumn("city", F.col("bond_rating"))
    return quality.drop_critical_nulls(bonds).select("security_code", "issuer", "city")


@query(
    "fiscal_checks",
    """SELECT r_name AS province, '2021' AS fiscal_year, 'city repeated' AS problem, n_name AS detail, count(*) AS hits
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name HAVING count(*) > 1""",
)
def _(spark, sf):
    """One fiscal row per supplier: cities with several suppliers are repeated."""
    staged = P.staged_fiscal(spark, sf)
    suppliers = P.table(spark, sf, "supplier").join(
        P.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return quality.fiscal_problems(staged.join(suppliers.select(F.col("n_name").alias("city")), "city"))


@query(
    "join_audit",
    """SELECT province, count(*) AS rows_before, count(*) AS rows_after, count(city_fiscal) AS matched, 1.0::DOUBLE AS growth,
        CAST(count(city_fiscal) AS DOUBLE) / count(*) AS match_rate, false AS grew,
        CAST(count(city_fiscal) AS DOUBLE) / count(*) < 0.8 AS poor_match,
        count(DISTINCT CASE WHEN city_fiscal IS NULL THEN city END) AS unmatched_cities
    FROM bond_fiscal GROUP BY province""",
)
def _(spark, sf):
    return quality.join_audit(P.bond(spark, sf), with_fiscal(spark, sf))


@query("unmatched_cities", "SELECT province, city, count(*) AS bonds FROM bond_fiscal WHERE city_fiscal IS NULL GROUP BY province, city")
def _(spark, sf):
    return quality.unmatched_cities(with_fiscal(spark, sf)).select("province", "city", F.col("rows").alias("bonds"))


_MISMATCH = """SELECT issuer, e.province, e.city, admin_level, city_fiscal, limit_fiscal, fiscal_rank, total_cities,
        '主体：' || issuer || ' | 平台行政级别：' || admin_level || ' | 城市：' || e.city || ' | 财力：' || city_fiscal || '亿 | 排名：' || fiscal_rank || '/' || total_cities AS message
    FROM enriched e JOIN (SELECT province, city, rank() OVER (PARTITION BY province ORDER BY f DESC) AS fiscal_rank FROM cities) r
        ON e.province = r.province AND e.city = r.city
    JOIN (SELECT province, median(f) AS limit_fiscal, count(*) AS total_cities FROM cities GROUP BY province) l ON e.province = l.province
    WHERE admin_level = '省级' AND city_fiscal < limit_fiscal"""
_RANKED = {"cities": "SELECT DISTINCT province, city, city_fiscal AS f FROM enriched WHERE city_fiscal IS NOT NULL"}


@query("platform_mismatch", _MISMATCH, _RANKED)
def _platform_mismatch(spark, sf):
    return quality.platform_mismatch(store(enriched(spark, sf)))


@query(
    "platform_notes",
    f"""SELECT province, count(DISTINCT issuer) AS platforms,
        province || '：' || count(DISTINCT issuer) || ' 个省级平台位于省内低财力城市（排名靠后的 50%）' AS note FROM ({_MISMATCH}) GROUP BY province""",
    _RANKED,
)
def _(spark, sf):
    return quality.platform_notes(_platform_mismatch(spark, sf))


_KPI_COLUMNS = ["issuers", "bonds", "cities"]
_OLD = "SELECT province, count(DISTINCT issuer) AS issuers, count(*) AS bonds, count(DISTINCT city) AS cities FROM bond"


@query(
    "table_diff",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(abs(a.{c} - b.{c})) AS compared, max(abs(a.{c} - b.{c})::DOUBLE) AS max_diff,
        arg_max(a.province, struct_pack(d := abs(a.{c} - b.{c}), k := a.province)) AS worst_key,
        count(*) FILTER (WHERE b.province IS NULL) AS only_a, count(*) FILTER (WHERE a.province IS NULL) AS only_b,
        CAST(0 AS BIGINT) AS repeated, max(abs(a.{c} - b.{c})) <= 0.1 AND count(a.province) = count(*) AND count(b.province) = count(*) AS within
    FROM ({_OLD} GROUP BY province) a FULL JOIN ({_OLD} WHERE report_date < '2000-01-01' GROUP BY province) b ON a.province = b.province"""
        for c in _KPI_COLUMNS
    ),
)
def _(spark, sf):
    """Province figures of all bonds against those of an older date."""
    bonds = P.bond(spark, sf)
    older = bonds.filter("report_date < '2000-01-01'")
    return quality.table_diff(kpi.province_kpi(bonds), kpi.province_kpi(older), "province", _KPI_COLUMNS)


@query(
    "snapshot_diff",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(abs(a.{c} - b.{c})) AS compared, max(abs(a.{c} - b.{c})::DOUBLE) AS max_diff,
        arg_max(a.security_code, struct_pack(d := abs(a.{c} - b.{c}), k := a.security_code)) FILTER (WHERE abs(a.{c} - b.{c}) IS NOT NULL) AS worst_key,
        count(*) FILTER (WHERE b.security_code IS NULL) AS only_a, count(*) FILTER (WHERE a.security_code IS NULL) AS only_b,
        CAST(0 AS BIGINT) AS repeated, max(abs(a.{c} - b.{c})) <= 0.1 AND count(a.security_code) = count(*) AND count(b.security_code) = count(*) AS within
    FROM bond a FULL JOIN (SELECT security_code, CASE WHEN report_date >= '1998-01-01' THEN issue_amount + 1 ELSE issue_amount END AS issue_amount,
        coupon FROM bond) b ON a.security_code = b.security_code"""
        for c in ("issue_amount", "coupon")
    ),
)
def _(spark, sf):
    """The bonds of a snapshot against a correction of the later ones."""
    bonds = P.bond(spark, sf)
    amount = F.when(F.col("report_date") >= "1998-01-01", F.col("issue_amount") + 1).otherwise(F.col("issue_amount"))
    return quality.table_diff(bonds, bonds.withColumn("issue_amount", amount), "security_code", ["issue_amount", "coupon"])


@query(
    "row_count_diff",
    """SELECT a.n AS rows_a, b.n AS rows_b, a.n = b.n AS equal FROM
    (SELECT CAST(count(*) AS BIGINT) AS n FROM bond) a, (SELECT CAST(count(*) AS BIGINT) AS n FROM enriched) b""",
)
def _(spark, sf):
    return quality.row_count_diff(P.bond(spark, sf), enriched(spark, sf))


@query(
    "key_diff",
    """SELECT DISTINCT issuer, 'a' AS side FROM bond WHERE issuer NOT IN (SELECT issuer FROM enriched)
    UNION ALL SELECT issuer, 'b' FROM enriched WHERE issuer NOT IN (SELECT issuer FROM bond)""",
)
def _(spark, sf):
    return quality.key_diff(P.bond(spark, sf), enriched(spark, sf), "issuer")


# --- decisions -------------------------------------------------------------------------------------

_POSITIONS = """SELECT province, category, category_order, sum(issuers) AS total, max(issuers) AS leader_issuers,
        arg_max(agency, struct_pack(n := issuers, o := -agency_order)) AS leader,
        max(CASE WHEN is_own THEN issuers END) AS own,
        count(*) FILTER (WHERE NOT is_own AND issuers > own_n) AS agencies_above
    FROM (SELECT *, coalesce(max(CASE WHEN is_own THEN issuers END) OVER (PARTITION BY province, category), 0) AS own_n FROM matrix)
    GROUP BY province, category, category_order"""


def _own_matrix(spark, sf):
    return agency.sparse_matrix(with_fiscal(spark, sf), "level", OWN)


@query(
    "rank_in_category",
    f"""SELECT province, category, CAST(total AS BIGINT) AS total, leader, leader_issuers, coalesce(own, 0) AS own_issuers,
        CASE WHEN own IS NOT NULL THEN agencies_above + 1 END AS own_rank,
        round(coalesce(own, 0) * 100.0 / total, 0) AS own_share_pct, category_order FROM ({_POSITIONS}) WHERE total > 0""",
    matrix_tables("level", OWN),
)
def _(spark, sf):
    return decisions.rank_in_category(_own_matrix(spark, sf))


@query(
    "classify_positions",
    f"""SELECT province, category, coalesce(own, 0) AS own_issuers, agencies_above,
        coalesce(own, 0) > 0 AND agencies_above = 0 AS strong, coalesce(own, 0) > 0 AND agencies_above >= 2 AS weak,
        coalesce(own, 0) = 0 AS blank, category_order FROM ({_POSITIONS})""",
    matrix_tables("level", OWN),
)
def _(spark, sf):
    return decisions.classify_positions(_own_matrix(spark, sf))


_LEVERAGE = "coalesce(leverage, round((total_assets - net_assets) / total_assets * 100, 1))"
_SCORES = {
    "inputs": f"""SELECT candidate_id, province, coalesce(nullif(trim(city), ''), '全部') AS city,
        coalesce(nullif(trim(admin_level), ''), '全部') AS admin_level, coalesce(nullif(trim(rating), ''), '全部') AS rating,
        unnest(['total_assets', 'net_assets', 'revenue', 'net_profit', 'leverage']) AS metric,
        unnest([total_assets, net_assets, revenue, net_profit, {_LEVERAGE}]) AS value FROM candidates""",
    "cube": CUBE,
    "scores": """SELECT candidate_id, metric, value, median AS market_median,
        CASE WHEN metric = 'leverage' THEN CASE WHEN value <= q1 THEN 3 WHEN value <= median THEN 2 WHEN value <= q3 THEN 1 ELSE 0 END
             ELSE CASE WHEN value >= q3 THEN 3 WHEN value >= median THEN 2 WHEN value >= q1 THEN 1 ELSE 0 END END AS score
        FROM inputs JOIN cube USING (province, city, admin_level, rating, metric) WHERE n > 0 AND value IS NOT NULL AND value <> 0""",
}


def _scores(spark, sf):
    return decisions.score_candidates(P.candidates(spark, sf), P.cube(spark, sf))


@query("derived_leverage", f"SELECT candidate_id, {_LEVERAGE} AS leverage FROM candidates")
def _(spark, sf):
    return decisions.with_leverage(P.candidates(spark, sf)).select("candidate_id", "leverage")


@query("score_candidates", "SELECT * FROM scores", _SCORES)
def _(spark, sf):
    return _scores(spark, sf)


@query(
    "verdict",
    """SELECT candidate_id, count(*) AS metrics, CAST(sum(score) AS DOUBLE) / (count(*) * 3) AS ratio,
        CAST(floor(CAST(sum(score) AS DOUBLE) / (count(*) * 3) * 100) AS BIGINT) AS score_pct,
        CASE WHEN CAST(sum(score) AS DOUBLE) / (count(*) * 3) >= 0.65 THEN '建议承做'
             WHEN CAST(sum(score) AS DOUBLE) / (count(*) * 3) >= 0.35 THEN '谨慎评估' ELSE '暂不建议' END AS verdict
    FROM scores GROUP BY candidate_id""",
    _SCORES,
)
def _(spark, sf):
    return decisions.verdict(_scores(spark, sf))
