import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from patchcraft.session import get_session

    s = get_session(master="local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples (order-free comparison)."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
