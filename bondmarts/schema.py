"""Table schemas. Columns are snake_case; label values keep their original spelling."""

from pyspark.sql import types as T

from bondmarts.constants import METRICS

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# One row per bond, before ordinals and lineage are added.
BOND_SOURCE = _struct(
    security_code=S, security_name=S, issuer=S, issuer_short=S, province=S, city=S, admin_level=S,
    underwriters=S, bond_class=S, issue_amount=D, coupon=D, rating=S, issuer_agency=S, bond_rating=S,
    bond_agency=S, total_assets=D, net_assets=D, revenue=D, net_profit=D, leverage=D, report_date=S,
    controller=S,
)
BOND = T.StructType(
    BOND_SOURCE.fields + _struct(level_rank=I, rating_rank=I, _snapshot_date=S, _snapshot_source=S).fields
)
FISCAL = _struct(city=S, revenue=D, province=S, fiscal_year=S)
CITY_COORDS = _struct(city=S, lon=D, lat=D)
CANDIDATE = _struct(candidate_id=S, province=S, city=S, admin_level=S, rating=S, **{m: D for m in METRICS})

# Columns of one rated issuer, taken from its representative bond.
ISSUER_COLUMNS = [
    "issuer", "issuer_short", "controller", "province", "city", "admin_level", "rating", "issuer_agency",
    *METRICS, "report_date", "level_rank", "rating_rank",
]
