"""Registry of queries, and the SQL form of the projection they run on."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Tables `bond`, `fiscal`, `enriched`, `coords` and `candidates` as DuckDB sees them.
TABLES = {
    "names": """
        SELECT l_orderkey, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey""",
    "bond": """
        SELECT CAST(o_orderkey AS VARCHAR) AS security_code,
            'B' || CAST(o_orderkey AS VARCHAR) AS security_name,
            c_name AS issuer, substr(c_name, 10, 20) AS issuer_short,
            r_name AS province, n_name AS city,
            CASE WHEN o_orderkey % 7 = 0 THEN '区县级'
                 WHEN c_mktsegment = 'AUTOMOBILE' THEN '省级'
                 WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN '地市级'
                 WHEN c_mktsegment = 'MACHINERY' THEN '区县(开发区)级'
                 ELSE '区县级' END AS admin_level,
            names AS underwriters, o_orderpriority AS bond_class,
            o_totalprice / 10000 AS issue_amount,
            CAST(o_orderkey % 50 + 200 AS DOUBLE) / 100 AS coupon,
            CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 500 THEN '  ' WHEN c_acctbal < 2000 THEN 'A+'
                 WHEN c_acctbal < 4000 THEN 'AA-' WHEN c_acctbal < 6500 THEN 'AA' WHEN c_acctbal < 8500 THEN 'AA+'
                 ELSE 'AAA' END AS rating,
            CASE c_custkey % 6 WHEN 0 THEN '联合资信评估股份有限公司' WHEN 1 THEN '中诚信国际信用评级有限责任公司'
                 WHEN 2 THEN '大公国际资信评估有限公司' WHEN 3 THEN '鹏元资信评估有限公司' WHEN 4 THEN '' END AS issuer_agency,
            CASE o_orderstatus WHEN 'F' THEN 'AAA' WHEN 'O' THEN 'AA+' END AS bond_rating,
            CASE o_orderkey % 5 WHEN 0 THEN '中诚信国际信用评级有限责任公司, 鹏元资信评估有限公司'
                 WHEN 1 THEN '远东资信评估有限公司' WHEN 2 THEN '' END AS bond_agency,
            CASE WHEN c_custkey % 10 <> 0 THEN CAST(floor(c_acctbal) AS DOUBLE) / 4 + 1000 END AS total_assets,
            CASE WHEN c_custkey % 9 <> 0 THEN CAST(floor(c_acctbal / 2) AS DOUBLE) / 4 + 400 END AS net_assets,
            CASE WHEN c_custkey % 8 <> 0 THEN CAST(c_custkey % 1000 AS DOUBLE) / 4 END AS revenue,
            CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 200 - 50 AS DOUBLE) / 4 END AS net_profit,
            CASE WHEN c_custkey % 12 <> 0 THEN CAST(c_custkey % 240 AS DOUBLE) / 4 + 20 END AS leverage,
            strftime(o_orderdate, '%Y-%m-%d') AS report_date,
            r_name || '/' || n_name AS controller,
            CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN c_mktsegment = 'AUTOMOBILE' THEN 7
                 WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 5 WHEN c_mktsegment = 'MACHINERY' THEN 2
                 ELSE 1 END AS level_rank,
            CASE WHEN c_acctbal < 500 THEN 0 WHEN c_acctbal < 2000 THEN 1 WHEN c_acctbal < 4000 THEN 2
                 WHEN c_acctbal < 6500 THEN 3 WHEN c_acctbal < 8500 THEN 4 ELSE 5 END AS rating_rank,
            '20230216' AS _snapshot_date, '全国城投债数据_截止20230216.parquet' AS _snapshot_source
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey LEFT JOIN names ON o_orderkey = l_orderkey""",
    "fiscal": """
        SELECT n_name AS city,
            CASE WHEN n_nationkey % 8 <> 7 THEN CAST(SUM(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) / 50 END AS revenue,
            r_name AS province, '2021' AS fiscal_year
        FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON n_nationkey = s_nationkey
        GROUP BY n_nationkey, n_name, r_name""",
    "rated": "SELECT * FROM bond WHERE rating IS NOT NULL AND trim(rating) <> ''",
    "city_fiscal": "SELECT city, MAX(revenue) AS city_fiscal FROM fiscal GROUP BY city",
    "deduped": """
        SELECT * FROM rated
        QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY level_rank DESC, security_code) = 1""",
    "enriched": """
        SELECT issuer, issuer_short, controller, province, d.city, admin_level, rating, issuer_agency, total_assets,
            net_assets, revenue, net_profit, leverage, report_date, level_rank, rating_rank, city_fiscal,
            CASE WHEN city_fiscal IS NULL THEN '财力未知' WHEN city_fiscal < 100 THEN '0-100亿'
                 WHEN city_fiscal < 200 THEN '100-200亿' WHEN city_fiscal < 300 THEN '200-300亿'
                 WHEN city_fiscal < 500 THEN '300-500亿' WHEN city_fiscal < 700 THEN '500-700亿'
                 WHEN city_fiscal < 1000 THEN '700-1000亿' ELSE '1000亿以上' END AS fiscal_band
        FROM deduped d LEFT JOIN city_fiscal f ON d.city = f.city""",
    "province_fiscal": "SELECT province, city, MAX(revenue) AS city_fiscal FROM fiscal GROUP BY province, city",
    "bond_fiscal": """
        SELECT b.*, f.city_fiscal FROM bond b
        LEFT JOIN province_fiscal f ON b.province = f.province AND b.city = f.city""",
    "coords": """
        SELECT n_name AS city, CAST(n_nationkey AS DOUBLE) / 2 + 100 AS lon, CAST(n_nationkey AS DOUBLE) / 4 + 20 AS lat
        FROM nation""",
    "candidates": """
        SELECT c_name AS candidate_id, r_name AS province,
            CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN n_name ELSE '' END AS city,
            CASE WHEN c_mktsegment = 'BUILDING' THEN '地市级' WHEN c_mktsegment = 'MACHINERY' THEN '区县级' END AS admin_level,
            CASE WHEN c_mktsegment = 'FURNITURE' THEN 'AA' ELSE '' END AS rating,
            CAST(floor(c_acctbal) AS DOUBLE) / 4 + 900 AS total_assets,
            CASE WHEN c_custkey % 3 <> 0 THEN CAST(floor(c_acctbal) AS DOUBLE) / 16 + 300 END AS net_assets,
            CAST(c_custkey % 900 AS DOUBLE) / 4 AS revenue,
            CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 150 - 20 AS DOUBLE) / 4 END AS net_profit,
            CASE WHEN c_custkey % 5 = 0 THEN 55.5 END AS leverage
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}
_WITH = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in TABLES.items())


def query(name: str, sql: str | None = None, more: dict[str, str] | None = None):
    """Register a Spark query, and the DuckDB SQL that gives the same rows.

    `sql` may use the tables above, and further named tables given in `more`.
    """

    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql:
            extra = "".join(f",\n{n} AS ({s})" for n, s in (more or {}).items())
            SQL[name] = f"{_WITH}{extra}\n{sql}"
        return run

    return register
