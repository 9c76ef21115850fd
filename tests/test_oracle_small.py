"""Registered queries against their DuckDB oracle on the smallest test tables (fast subset)."""

import math
import os

import pytest

import __spark_entry__ as E

from samples import SF_SMALL

FAST = ["commit_filter", "java_change_filter", "normalise_eof_newline", "collect_patches",
        "java_sections", "clean_patches", "strip_headers", "changed_lines", "synthetic_edits", "exact_dedup"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ["orders", "lineitem", "documents", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    srows = sorted(repr(tuple(_norm(r[c]) for c in dcols)) for r in sdf.collect())
    drows = sorted(repr(tuple(_norm(x) for x in r)) for r in res.fetchall())
    assert srows == drows
