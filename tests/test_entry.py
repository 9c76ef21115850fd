"""Driver contract: flagship query and registry consistency."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["repo", "verdict", "n_patches"]
    rows = df.collect()
    assert rows and {r["verdict"] for r in rows} <= {"y", "n", "skip"}


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_spawned_copies_relabel_on_test_data(spark):
    rows = E.queries()["spawn_relabel_check"](spark, E.FLAGSHIP_SF).collect()
    assert rows and all(r["relabel_ok"] and r["n_copies"] == 10 for r in rows)
