"""Financial benchmarks of rated issuers."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bondmarts import constants as K
from bondmarts.functions.numeric import round_to
from bondmarts.functions.text import trim_spaces
from bondmarts.operators.filters import filter_eq, rated
from bondmarts.operators.histogram import counted_quantiles, counted_values
from bondmarts.operators.ranking import quantiles
from bondmarts.storage import store

STATS = ["min", "q1", "median", "mean", "q3", "max"]
_PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _rounded(found: DataFrame, by: Sequence[str]) -> DataFrame:
    return found.select(*by, "metric", "n_rows", "n", *[round_to(s, 2).alias(s) for s in STATS])


def bench_rows(e: DataFrame, by: Sequence[str], metrics: Sequence[str] = K.METRICS, stored: bool = True) -> DataFrame:
    """Long form: one row per group and metric with n_rows, n and the six rounded statistics."""
    return _rounded(quantiles(e, by, metrics, "issuer", _PROBS, stored), by)


def wide_bench(rows: DataFrame, by: Sequence[str], metrics: Sequence[str] = K.METRICS) -> DataFrame:
    """One row per group: sample_size and <metric>_<statistic>."""
    cells = [
        F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in metrics for s in STATS
    ]
    return rows.groupBy(*by).agg(F.max("n_rows").alias("sample_size"), *cells)


def _label(c: str, unknown: str):
    text = trim_spaces(c)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(unknown)).otherwise(text)


_LABELS = {"city": K.UNKNOWN_CITY, "admin_level": K.UNKNOWN_LEVEL, "rating": K.UNKNOWN_RATING}


def _benchmarked(e: DataFrame) -> DataFrame:
    return rated(e).filter("province is not null and province != ''")


def financial_bench(e: DataFrame, stored: bool = True) -> DataFrame:
    """Statistics per province, city, level and rating. Groups are the raw values, labels are cleaned after.

    Without `stored` a plan that runs only when queried.
    """
    by = ["province", "city", "admin_level", "rating"]
    wide = wide_bench(bench_rows(_benchmarked(e), by, stored=stored), by)
    return wide.withColumns({c: _label(c, unknown) for c, unknown in _LABELS.items()})


def bench_slice(e: DataFrame, **wanted) -> DataFrame:
    """Statistics of all issuers that match the filters, as one row."""
    wide = wide_bench(bench_rows(filter_eq(rated(e).filter("province is not null"), **wanted), []), [])
    return wide.withColumn("sample_size", F.coalesce("sample_size", F.lit(0)))


def issuer_bench(issuers: DataFrame, by: Sequence[str] = ("province",)) -> DataFrame:
    """Statistics per group of an issuer view, long form; metrics without any value are left out."""
    return bench_rows(issuers, list(by)).filter("n > 0")


def bench_cube(e: DataFrame, dims: Sequence[str] = ("city", "admin_level", "rating")) -> DataFrame:
    """Statistics for every combination of filters, long form; 全部 stands for "not filtered".

    Values are counted once, by province and all dimensions. The coarser combinations are merged from the cells of these counts.
    """
    dims = list(dims)
    finest = ["province", *dims]
    rolled = {dim: F.col("all_mask").bitwiseAND(F.lit(1 << bit)) != 0 for bit, dim in enumerate(reversed(dims))}

    def merged(rows: DataFrame) -> DataFrame:
        masks = F.explode(F.array(*[F.lit(i) for i in range(2 ** len(dims))])).alias("all_mask")
        return rows.select("*", masks).withColumns({dim: F.when(~out, F.col(dim)) for dim, out in rolled.items()})

    counted = store(counted_values(_benchmarked(e), finest, K.METRICS))
    by = [*finest, "all_mask"]
    rows = _rounded(counted_quantiles(counted, by, _PROBS, finest, merged), by)
    return rows.withColumns({dim: F.when(out, F.lit(K.ALL)).otherwise(_label(dim, _LABELS.get(dim, ""))) for dim, out in rolled.items()})


def cube_slice(cube: DataFrame, dims: Sequence[str] = ("city", "admin_level", "rating"), **wanted) -> DataFrame:
    """The statistics of one combination of filters from the cube, one row a province: sample_size and <metric>_<statistic>.

    `wanted` names label values as the cube has them, also the province; what is blank or not named is not filtered. Of a stored cube,
    only its rows of that combination are read, however many issuers they stand for.
    """
    label = {d: wanted.pop(d, None) or K.ALL for d in dims}
    rows = filter_eq(cube, **label, **wanted)
    return wide_bench(rows, ["province"])
