"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

import parity
from parity.compare import connect, differences

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(parity.QUERIES))
def test_query(spark, name):
    df = parity.QUERIES[name](spark, SF_DIR)
    if name in parity.SQL:
        assert differences(df, connect(SF_DIR), parity.SQL[name]) == []
    else:
        assert df.count() > 0


def test_names():
    assert set(parity.SQL) <= set(parity.QUERIES)


def test_shares_sum_to_a_hundred(spark):
    shares = parity.QUERIES["agency_market_share"](spark, SF_DIR).groupBy("province").sum("issuer_share_pct")
    assert all(abs(r[1] - 100) < 0.5 for r in shares.collect())


def test_shared_clients_are_clients(spark):
    assert parity.QUERIES["partner_counts"](spark, SF_DIR).filter("shared_issuers > total_issuers").count() == 0
