"""Numeric expressions whose results must not depend on the engine's defaults."""

from pyspark.sql import Column, functions as F

from bondmarts.constants import FISCAL_BANDS, TOP_FISCAL_BAND, UNKNOWN_FISCAL_BAND


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c, digits: int) -> Column:
    """Round the scaled double half away from zero, as the results to match do (0.285 -> 0.28).

    Spark's round(x, n) goes through the decimal text of x and gives 0.29.
    """
    scale = float(10**digits)
    return F.round(_col(c).cast("double") * scale) / scale


def ratio(part, whole) -> Column:
    """Double division, null for a zero denominator."""
    whole = _col(whole).cast("double")
    return _col(part).cast("double") / F.when(whole != 0, whole)


def nan_to_null(c) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_number(c) -> Column:
    """Text to double; anything that is no number becomes null."""
    return nan_to_null(_col(c).cast("string").try_cast("double"))


def fiscal_band(c) -> Column:
    c = _col(c)
    band = F.when(c.isNull(), F.lit(UNKNOWN_FISCAL_BAND))
    for label, upper in FISCAL_BANDS:
        band = band.when(c < upper, F.lit(label))
    return band.otherwise(F.lit(TOP_FISCAL_BAND))
