import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bondmarts.schema import BOND, FISCAL  # noqa: E402
from bondmarts.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, name="tests")
    yield session
    session.stop()


@pytest.fixture
def bonds(spark):
    """Bond table from dicts; unnamed columns are null, ranks 0, codes count up."""

    def make(*rows):
        filled = []
        for i, row in enumerate(rows):
            row = {"security_code": f"{i:03d}", "level_rank": 0, "rating_rank": 0, **row}
            filled.append(tuple(row.get(name) for name in BOND.names))
        return spark.createDataFrame(filled, BOND)

    return make


@pytest.fixture
def fiscal(spark):
    return lambda *rows: spark.createDataFrame([(*r, "2021")[:4] for r in rows], FISCAL)


def rows(df, *columns):
    """Sorted tuples of a result."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
