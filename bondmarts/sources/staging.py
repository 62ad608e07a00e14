"""Raw bond and fiscal tables to typed, cleaned ones."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from bondmarts.constants import BOND_HEADERS, CITY_HEADER_PARTS, REVENUE_HEADER_PARTS
from bondmarts.functions import text
from bondmarts.functions.numeric import nan_to_null, to_number
from bondmarts.schema import BOND_SOURCE


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_headers(
    df: DataFrame,
    headers: dict[str, list[str]] = BOND_HEADERS,
    schema: T.StructType = BOND_SOURCE,
    keep_other: bool = False,
) -> DataFrame:
    """Rename source headers to schema columns: the first spelling present wins, a missing one is null."""
    found = {name: next((h for h in headers.get(name, ()) if h in df.columns), None) for name in schema.names}
    chosen = [
        (_quoted(found[f.name]) if found[f.name] else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema
    ]
    others = [_quoted(c) for c in df.columns if c not in found.values()] if keep_other else []
    return df.select(*chosen, *others)


def resolve_fiscal_headers(df: DataFrame) -> DataFrame:
    """City and revenue columns by header part, first hit each; other columns keep their names."""

    def first_with(parts):
        return next((c for c in df.columns if any(p in c for p in parts)), None)

    names = {first_with(CITY_HEADER_PARTS): "city", first_with(REVENUE_HEADER_PARTS): "revenue"}
    names.pop(None, None)
    taken, chosen = set(), []
    for c in df.columns:
        name = names.get(c, c)
        if name not in taken:
            taken.add(name)
            chosen.append(_quoted(c).alias(name))
    return df.select(*chosen)


def normalize_agencies(df: DataFrame, columns=("issuer_agency", "bond_agency")) -> DataFrame:
    return df.withColumns({c: text.normalize_agency(c) for c in columns})


def add_level_suffix(df: DataFrame) -> DataFrame:
    return df.withColumn("admin_level", text.with_level_suffix("admin_level"))


def add_ranks(df: DataFrame) -> DataFrame:
    return df.withColumns({"level_rank": text.level_rank("admin_level"), "rating_rank": text.rating_rank("rating")})


def report_date_text(df: DataFrame) -> DataFrame:
    """Report date as yyyy-MM-dd text; unparseable text fails the job."""
    return df.withColumn("report_date", F.date_format(F.to_timestamp("report_date"), "yyyy-MM-dd"))


def typed_numbers(df: DataFrame, schema: T.StructType = BOND_SOURCE) -> DataFrame:
    """Double columns of the schema cast to double, NaN to null (NaN would sort above every number)."""
    doubles = [f.name for f in schema if f.dataType == T.DoubleType() and f.name in df.columns]
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in doubles})


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Text to number, bad text to null."""
    return df.withColumns({c: to_number(c) for c in columns})


def add_bond_lineage(df: DataFrame, snapshot_date: str | Column, source: str | Column) -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({"_snapshot_date": as_column(snapshot_date), "_snapshot_source": as_column(source)})


def drop_lineage(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def stage_bond(raw: DataFrame, snapshot_date: str | Column, source: str | Column) -> DataFrame:
    """The whole bond cleaning as one projection: no shuffle, all expressions stay in the JVM.

    Source columns that the schema does not know stay under their own names.
    """
    steps = [typed_numbers, add_level_suffix, normalize_agencies, add_ranks, report_date_text]
    staged = reduce(lambda df, step: step(df), steps, resolve_headers(raw, keep_other=True))
    return add_bond_lineage(staged, snapshot_date, source)


def file_name() -> Column:
    """Name of the file a row was read from, without folders and percent-encoding."""
    return F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/]*)$", 1)


def source_label() -> Column:
    """Name of the file or folder of files that a row was read from: the last part of the path that has a date or is a fiscal file."""
    return F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"^.*/((?!part-)[^/]*(?:20\d{6}|财力)[^/]*)", 1)


def snapshot_date_of(name: Column) -> Column:
    """The date 20YYMMDD in a file name; a name without one fails the job."""
    date = F.regexp_extract(name, r"20\d{6}", 0)
    problem = F.concat(F.lit("no snapshot date 20YYMMDD in file name "), name)
    return F.when(date != "", date).otherwise(F.raise_error(problem))


def province_of(name: Column, fiscal_year: str) -> Column:
    """Province in a file name such as 2021年四川省财力.csv."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.replace(F.replace(stem, F.lit(f"{fiscal_year}年"), F.lit("")), F.lit("财力"), F.lit(""))


def stage_fiscal(raw: DataFrame, province: str | Column, fiscal_year: str) -> DataFrame:
    """City and revenue with province and year, and the names of columns the source lacks.

    Revenue is still text, as the checks come before the conversion; see `to_fiscal`.
    """
    province = province if isinstance(province, Column) else F.lit(province)
    named = resolve_fiscal_headers(raw.withColumns({"_province": province, "_fiscal_year": F.lit(fiscal_year)}))
    missing = [c for c in ("city", "revenue") if c not in named.columns]
    return named.select(
        *[(F.lit(None) if c in missing else F.col(c)).cast("string").alias(c) for c in ("city", "revenue")],
        F.col("_province").alias("province"),
        F.col("_fiscal_year").alias("fiscal_year"),
        F.lit(", ".join(missing)).alias("missing_columns"),
    )


def to_fiscal(staged: DataFrame) -> DataFrame:
    return coerce_numeric(staged.drop("missing_columns"), ["revenue"])
