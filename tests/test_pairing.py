"""Pairs of lines in unequal and mixed runs, against all alignments there are."""

import random
from functools import lru_cache

import pytest

from patchcraft.functions import pairing as P
from patchcraft.operators import pairing as OP


def _likeness(a, b, least):
    shared = sum(min(a.count(w), b.count(w)) for w in set(a))
    s = 2000 * shared // max(len(a) + len(b), 1)
    return s if s >= least else 0


def _most(olds, news, least):
    @lru_cache(None)
    def best(i, j):
        if i == len(olds) or j == len(news):
            return 0
        return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + _likeness(olds[i], news[j], least))

    return best(0, 0)


@pytest.mark.parametrize("cells", [1 << 24, 6])
def test_best_pairs_against_all_alignments(monkeypatch, cells):
    monkeypatch.setattr(P, "CELLS", cells)  # with few cells every table is halved
    rnd = random.Random(4)
    for _ in range(300):
        olds, news = ([[rnd.choice("abcd") for _ in range(rnd.randint(0, 4))] for _ in range(rnd.randint(0, 7))] for _ in range(2))
        least = rnd.choice([1, 400, 500, 1000])
        got = P.best_pairs(olds, news, least)
        assert sum(s for _, _, s in got) == _most(olds, news, least)
        assert all(s == _likeness(olds[i], news[j], least) > 0 for i, j, s in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


RUNS = [
    ("mixed", "@@\n-int a = one;\n+int b = one;\n-use(a, 2);\n+log(text);\n+use(b, 2);\n", [("int a = one;", "int b = one;"), ("use(a, 2);", "use(b, 2);")]),
    ("unequal", "@@\n-first(x);\n-second(x, y);\n+second(x, z);\n", [("second(x, y);", "second(x, z);")]),
    ("addition first", "@@\n+call(me, now);\n-call(you, now);\n", [("call(you, now);", "call(me, now);")]),
    ("block", "@@\n-a;\n-b;\n+c;\n+d;\n", [("a;", "c;"), ("b;", "d;")]),
    ("turns", "@@\n-a;\n+c;\n-b;\n+d;\n", [("a;", "c;"), ("b;", "d;")]),
    ("nothing alike", "@@\n-alpha\n-beta\n+gamma\n", []),
    ("only blanks", "@@\n-\n-  \n+\t\n", []),
    ("crlf", "@@\r\n-f(x);\r\n-g\r\n+f(y);\r\n", [("f(x);", "f(y);")]),
]


def test_pair_similar(spark):
    df = spark.createDataFrame([("r", name, text, 1) for name, text, _ in RUNS] + [("r", "none", None, 1), ("r", "context", "@@\n x\n", 1)],
                               "repo string, patch_id string, text string, run long")
    got = {r["patch_id"]: [(p["old_line"], p["new_line"]) for p in r["pairs"]] for r in OP.pair_similar(df).collect()}
    assert got == {name: pairs for name, _, pairs in RUNS}


def test_repeated_patches_and_empty_input(spark):
    df = spark.createDataFrame([("r", "1", "@@\n-a\n\n-b c\n+b d\n+b\n")], "repo string, patch_id string, text string")
    rows = OP.pair_similar(df).orderBy("run_start").collect()
    assert [(r["n_removed"], r["n_added"], len(r["pairs"])) for r in rows] == [(1, 0, 0), (1, 2, 1)]
    assert OP.pair_similar(df.limit(0)).count() == 0
