"""Quality checks of inputs, joins and marts, and the comparison of two tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bondmarts import constants as K, storage
from bondmarts.functions.numeric import ratio
from bondmarts.operators import digests
from bondmarts.operators.lists import key_sets
from bondmarts.storage import store


def _checks() -> dict:
    """Per check its columns, the rows that count for a column, the rows it is a share of, and the limit."""

    def earlier(column):
        before = K.CRITICAL_BOND_COLUMNS[: K.CRITICAL_BOND_COLUMNS.index(column)]
        return reduce(lambda a, c: a & F.col(c).isNotNull(), before, F.lit(True))

    kept = reduce(lambda a, c: a & F.col(c).isNotNull(), K.CRITICAL_BOND_COLUMNS, F.lit(True))
    return {
        "required": (K.REQUIRED_BOND_COLUMNS, lambda c: F.lit(True), "_all", 1.0),
        "critical": (K.CRITICAL_BOND_COLUMNS, earlier, "_all", K.CRITICAL_NULL_LIMIT),
        "watched": (K.WATCHED_BOND_COLUMNS, lambda c: kept, "_kept", K.WATCHED_NULL_LIMIT),
    }


def null_counts() -> list[Column]:
    """The aggregates that all bond checks need."""
    kept = reduce(lambda a, c: a & F.col(c).isNotNull(), K.CRITICAL_BOND_COLUMNS, F.lit(True))
    counts = [F.count("*").alias("_all"), F.count_if(kept).alias("_kept")]
    for check, (columns, given, _, _) in _checks().items():
        counts += [F.count_if(given(c) & F.col(c).isNull()).alias(f"{check}_{c}") for c in columns]
    return counts


def bond_null_report(bond: DataFrame) -> DataFrame:
    """All bond checks in one aggregation, one row per check and column.

    check 'required': nulls among all rows. check 'critical': nulls among the rows left after earlier
    critical columns were dropped, as a share of all rows. check 'watched': nulls among the rows that pass
    every critical column.
    """
    rows = []
    for check, (columns, _, base, limit) in _checks().items():
        for c in columns:
            name = f"{check}_{c}"
            rate = F.coalesce(ratio(name, base), F.lit(0.0))
            failed = (F.col("_all") > 0) & (rate >= limit if check == "required" else rate > limit)
            rows.append(
                F.struct(
                    F.lit(check).alias("check"),
                    F.lit(c).alias("column_name"),
                    F.col(name).alias("nulls"),
                    F.col(base).alias("rows"),
                    rate.alias("null_rate"),
                    failed.alias("over_limit"),
                )
            )
    return bond.agg(*null_counts()).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def require_columns(bond: DataFrame) -> None:
    missing = [c for c in K.REQUIRED_BOND_COLUMNS if c not in bond.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")


def notes_on_nulls(counts: dict[str, int]) -> list[str]:
    """Notes on the values of `null_counts`. Raises when a required column is empty, or a key column has more than 2 % nulls."""
    notes, empty, mostly = [], [], []
    for check, (columns, _, base, limit) in _checks().items():
        for c in columns:
            nulls, rows = counts[f"{check}_{c}"], counts[base]
            rate = nulls / rows if rows else 0.0
            if check == "required" and rows and rate >= limit:
                empty.append(c)
            elif check == "critical" and rows and rate > limit and not empty:
                raise ValueError(f"{c} is null in {rate:.1%} of the rows ({nulls} of {rows}), more than {limit:.0%}; see bond_null_report")
            elif check == "critical" and nulls:
                notes.append(f"{c}: {nulls} rows without value dropped ({rate:.1%})")
            elif check == "watched" and counts["_all"] and rate > limit:
                mostly.append(f"{c}: {rate:.1%} of the values are null")
        if empty:
            raise ValueError(f"required columns without any value: {empty}")
    return notes + mostly


def drop_critical_nulls(bond: DataFrame) -> DataFrame:
    return bond.na.drop(subset=K.CRITICAL_BOND_COLUMNS)


def check_bond(bond: DataFrame) -> tuple[DataFrame, list[str]]:
    """Cleaned bonds and notes. Raises when a required column is missing or empty, or a key column has
    more than 2 % nulls. Few nulls drop their rows; mostly empty columns are noted.
    """
    require_columns(bond)
    notes = notes_on_nulls(bond.agg(*null_counts()).first().asDict())
    return drop_critical_nulls(bond), notes


def fiscal_problems(staged: DataFrame) -> DataFrame:
    """Problems of staged fiscal data, one row each: province, fiscal_year, problem, detail, hits."""
    key = ["province", "fiscal_year"]
    cities = staged.groupBy(*key, "missing_columns", "city").agg(F.count("*").alias("hits"))
    problem = (
        F.when(F.col("missing_columns") != "", "column missing")
        .when(F.col("city").isNull(), "city missing")
        .when(F.col("hits") > 1, "city repeated")
    )
    detail = F.when(F.col("missing_columns") != "", F.col("missing_columns")).otherwise(F.col("city"))
    return (
        cities.select(*key, problem.alias("problem"), detail.alias("detail"), "hits")
        .filter(F.col("problem").isNotNull())
        .groupBy(*key, "problem", "detail")
        .agg(F.sum("hits").alias("hits"))
    )


def check_fiscal(staged: DataFrame) -> None:
    """Raises when a column is missing, a city is null or a city appears twice in one province file."""
    found = fiscal_problems(staged)
    kinds = found.groupBy("problem").agg(F.count("*").alias("n"), F.min(F.struct("province", "fiscal_year", "detail")).alias("one")).collect()  # three kinds
    if kinds:
        told = "; ".join(f"{r.problem} {r.one.detail} ({r.one.province} {r.one.fiscal_year}, {r.n} in all)" for r in sorted(kinds))
        raise ValueError(f"fiscal data: {told}; see fiscal_problems")


def unmatched_cities(after: DataFrame) -> DataFrame:
    """Cities that found no revenue, with their rows."""
    return after.filter("city_fiscal IS NULL").groupBy("province", "city").agg(F.count("*").alias("rows"))


def join_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Growth and match rate of the fiscal join per province, and how many cities found no revenue; see `unmatched_cities`."""
    key = "province"
    rows_before = before.groupBy(key).agg(F.count("*").alias("rows_before"))
    per_city = after.groupBy(key, "city").agg(
        F.count("*").alias("n"), F.count("city_fiscal").alias("matched")
    )
    rows_after = per_city.groupBy(key).agg(
        F.sum("n").alias("rows_after"),
        F.sum("matched").alias("matched"),
        F.count(F.when(F.col("matched") < F.col("n"), F.col("city"))).alias("unmatched_cities"),
    )
    growth, match = ratio("rows_after", "rows_before"), ratio("matched", "rows_after")
    return rows_before.join(rows_after, key).select(
        key, "rows_before", "rows_after", "matched",
        growth.alias("growth"), match.alias("match_rate"),
        (growth > K.JOIN_GROWTH_LIMIT).alias("grew"),
        (match < K.JOIN_MATCH_LIMIT).alias("poor_match"),
        "unmatched_cities",
    )


def audit_join(before: DataFrame, after: DataFrame) -> list[str]:
    """Raises when the join multiplied rows; returns warnings about poor matches."""
    found = join_audit(before, after).filter("grew or poor_match").collect()  # one row per province
    grown = [r for r in found if r["grew"]]
    if grown:
        raise ValueError("join multiplied rows: " + "; ".join(f"{r.province} x{r.growth:.2f}" for r in grown))
    return [f"{r.province}: only {r.match_rate:.1%} matched, {r.unmatched_cities} cities without revenue" for r in found]


def platform_mismatch(e: DataFrame, q: float = K.PLATFORM_QUANTILE) -> DataFrame:
    """Province-level issuers in cities whose revenue is below the province's q-quantile of cities.

    Ranks and quantiles run over one row per city; that table is written, so the planner knows its size
    when it joins. Pass stored issuers, they are read twice.
    """
    cities = e.filter("city_fiscal is not null and city is not null").groupBy("province", "city").agg(
        F.max("city_fiscal").alias("_fiscal")
    )
    province = W.partitionBy("province")
    ranked = cities.select(
        "province", "city",
        F.percentile("_fiscal", F.lit(float(q))).over(province).alias("limit_fiscal"),
        F.count("*").over(province).alias("total_cities"),
        F.rank().over(province.orderBy(F.desc("_fiscal"))).cast("bigint").alias("fiscal_rank"),
    )
    platforms = e.filter(F.col("admin_level") == K.PROVINCE_LEVEL)
    return (
        platforms.join(store(ranked), ["province", "city"])
        .filter(F.col("city_fiscal") < F.col("limit_fiscal"))
        .select(
            "issuer", "province", "city", "admin_level", "city_fiscal", "limit_fiscal", "fiscal_rank", "total_cities",
            F.concat_ws(
                " | ",
                F.concat(F.lit("主体："), "issuer"),
                F.concat(F.lit("平台行政级别："), "admin_level"),
                F.concat(F.lit("城市："), "city"),
                F.concat(F.lit("财力："), F.col("city_fiscal").cast("string"), F.lit("亿")),
                F.concat(F.lit("排名："), F.col("fiscal_rank").cast("string"), F.lit("/"), F.col("total_cities").cast("string")),
            ).alias("message"),
        )
    )


def platform_notes(mismatches: DataFrame, q: float = K.PLATFORM_QUANTILE) -> DataFrame:
    """One note per province with such issuers."""
    found = mismatches.groupBy("province").agg(F.count_distinct("issuer").alias("platforms"))
    text = f" 个省级平台位于省内低财力城市（排名靠后的 {q:.0%}）"
    return found.withColumn("note", F.concat("province", F.lit("："), F.col("platforms").cast("string"), F.lit(text)))


def table_diff(a: DataFrame, b: DataFrame, key: str, columns, atol: float = 0.1, buckets: int = digests.BUCKETS) -> DataFrame:
    """Column-wise comparison of two tables aligned on a key, one row per column.

    Only keys on both sides and pairs of two numbers are compared; keys of one side and repeated ones are counted. A column is
    within the tolerance if something was compared, no key is on one side only and none is repeated.

    Only buckets of keys whose digests differ are joined, if keys have one type; of the others one side is read, and equal tables
    start no join. Inputs that do not come straight from files are written first, as they are read more than once.
    """

    def numbers(df, side):
        # One row per key; the smallest value stands for a repeated one, which is counted.
        values = [F.min(F.col(c).cast("double")).alias(f"{side}_{c}") for c in columns]
        return df.groupBy(key).agg(F.count("*").alias(f"_{side}"), *values)

    if a.schema[key].dataType == b.schema[key].dataType:
        a, b = (storage.scanned(df.select(key, *[c for c in columns if c != key])) for df in (a, b))
        apart = digests.differing(a, b, key, [F.col(c).cast("double") for c in columns], buckets)
        inside = digests.bucket(key, buckets).isin(apart)
        alike = numbers(a.filter(~inside), "a")
        both = alike.select("*", F.col("_a").alias("_b"), *[F.col(f"a_{c}").alias(f"b_{c}") for c in columns])
        if apart:
            both = both.unionByName(numbers(a.filter(inside), "a").join(numbers(b.filter(inside), "b"), key, "full"))
    else:
        both = numbers(a, "a").join(numbers(b, "b"), key, "full")
    only_a, only_b = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    repeated = F.count_if((F.col("_a") > 1) | (F.col("_b") > 1))
    cells = []
    for c in columns:
        diff = F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
        worst = F.max(F.when(diff.isNotNull(), F.struct(diff.alias("diff"), F.col(key).alias("k"))))
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(diff).alias("compared"),
                F.max(diff).alias("max_diff"),
                worst["k"].alias("worst_key"),
                only_a.alias("only_a"),
                only_b.alias("only_b"),
                repeated.alias("repeated"),
                (F.coalesce(F.max(diff) <= F.lit(float(atol)), F.lit(False)) & (only_a == 0) & (only_b == 0) & (repeated == 0)).alias("within"),
            )
        )
    return both.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def row_count_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    one, none = F.lit(1), F.lit(0)
    sides = a.select(one.alias("a"), none.alias("b")).unionAll(b.select(none.alias("a"), one.alias("b")))
    counts = sides.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("rows_b")
    )
    return counts.withColumn("equal", F.col("rows_a") == F.col("rows_b"))


def key_diff(a: DataFrame, b: DataFrame, key: str, buckets: int = digests.BUCKETS) -> DataFrame:
    """Distinct keys found on one side only, with the side. Buckets that hold the same keys as often on both sides are not compared."""
    if a.schema[key].dataType == b.schema[key].dataType:
        a, b = (storage.scanned(df.select(key)) for df in (a, b))
        inside = digests.bucket(key, buckets).isin(digests.differing(a, b, key, buckets=buckets))
        a, b = a.filter(inside), b.filter(inside)
    return key_sets(a, b, key).filter(F.col(key).isNotNull() & (F.col("side") != "both"))
