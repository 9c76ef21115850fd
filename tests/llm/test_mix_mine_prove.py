"""Source mixing, hard negatives and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchcraft.llm import merkle, mixing, negatives, queries, ranks

SF = "/root/testdata/sf0.001"


# --- places in groups


def test_numbered_counts_from_zero_in_every_group(llm):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice([None, 1, 2, 3]), i) for i in range(400)]
    df = llm.createDataFrame(rows, "g string, k int, row long").repartition(7)
    got = ranks.numbered(df, ["g"], ["k", "row"]).collect()
    want = defaultdict(list)
    for g, k, i in rows:
        want[g].append((k is not None, k or 0, i))
    assert len(got) == len(rows)
    for r in got:
        assert sorted(want[r.g])[r.pos] == (r.k is not None, r.k or 0, r.row) and r.n == len(want[r.g])
    assert ranks.numbered(df.limit(0), ["g"], ["k"]).count() == 0


# --- op11


def level_of(sizes, weights, most):
    """Targets by handing the excess on until none is above its bound."""
    total, bound = sum(sizes), [most * s for s in sizes]
    full = {i for i, b in enumerate(bound) if not b}
    while True:
        rest, over = total - sum(bound[i] for i in full), [i for i in range(len(sizes)) if i not in full]
        if not over:
            return bound
        level = rest / sum(weights[i] for i in over)
        new = {i for i in over if level * weights[i] >= bound[i]}
        if not new:
            return [bound[i] if i in full else level * weights[i] for i in range(len(sizes))]
        full |= new


def tilt_of(sizes, target, most):
    """The tilt by halving."""
    taken = lambda t: sum(s * math.exp(min(math.log(most), t * s)) for s in sizes)
    low, high = -50.0, math.log(most) / min(sizes)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if taken(mid) < target else (low, mid)
    return high


MIX = "doc_id long, source string, text string, size string, rate string, source_key string, n string, row string, pos string"


def mix_rows():
    rng = random.Random(11)
    rows = []
    for source, docs, longest in (("b", 60, 40), ("long", 300, 90), ("a", 5, 9), (None, 40, 90), ("é", 30, 30), ("Z", 1, 500), ("empty", 3, 0), ("tiny", 2, 1)):
        for _ in range(docs):
            rows.append((len(rows), source, " ".join("w" * rng.randint(0, longest))))
    rows += [(901, "long", "w " * 20_000)]
    rows += [(None, "b", "one two\tthree\x0bfour five"), (None, "b", None), (7, "b", ""), (8, "b", " \n "), rows[0], rows[0], (900, "é", "long " * 300)]
    return [(*r, *["x"] * 6) for r in rows]


def test_mix_meets_targets_and_tilts_like_brute_force(llm):
    rows = mix_rows()
    df = llm.createDataFrame(rows, MIX).repartition(5)
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r.size) for r in got) == sorted((i is None, i or 0, s or "", size(t)) for i, s, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    totals = [sum(r.size for r in by[s]) for s in names]
    wanted = level_of(totals, [i % 3 + 1 for i in range(len(names))], 3)
    for name, total, target in zip(names, totals, wanted, strict=True):
        own = by[name]
        assert {r.source_size for r in own} == {total}
        assert all(abs(r.target - target) <= 1e-9 * max(1, target) for r in own)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in own)
        worded = [r for r in own if r.size]
        if not worded:
            continue
        least = min(r.size for r in worded)
        assert abs(sum(r.taken for r in own) - target) <= max(least, 0.01 * target)
        if target < 3 * total:
            tilt = tilt_of([r.size for r in worded], target, 3)
            assert all(abs(r.rate - min(3, math.exp(tilt * r.size))) < 1e-4 for r in worded)
        else:
            assert all(r.copies == 3 for r in worded)
    # Documents of one source and size differ by one copy at most.
    for name in names:
        for n in {r.size for r in by[name]}:
            same = [r.copies for r in by[name] if r.size == n]
            assert max(same) - min(same) <= 1


def test_mix_is_the_same_however_the_rows_lie(llm):
    rows = mix_rows()
    one = mixing.mix(llm.createDataFrame(rows, MIX).repartition(6)).collect()
    two = mixing.mix(llm.createDataFrame(rows[::-1], MIX).coalesce(1)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "", r.size, r.copies, r.rate)
    assert sorted(map(key, one)) == sorted(map(key, two))


def test_mix_of_nothing(llm):
    df = llm.createDataFrame([], MIX)
    assert mixing.mix(df).count() == 0
    none = llm.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.mix(none).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_whole_copies_end_near_the_target():
    rng = random.Random(5)
    for _ in range(200):
        rows = sorted(((rng.randint(1, 400), rng.randint(1, 5), rng.uniform(0, 3)) for _ in range(rng.randint(1, 30))), reverse=True)
        target = sum(s * n * r for s, n, r in rows)
        copies = mixing.whole_copies(rows, target, 3)
        assert all(0 <= c <= 3 * n for c, (_, n, _) in zip(copies, rows, strict=True))
        taken = sum(c * s for c, (s, _, _) in zip(copies, rows, strict=True))
        if len(rows) > 10:
            assert abs(taken - target) <= rows[0][0]


# --- op12


def mine(rows, is_anchor, p=5, n=5):
    """rows: (id, vector or None, label)."""
    live = []
    for row, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((row, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    by = lambda e: (-e[0], e[1] is None, e[1] or 0)
    out = []
    for row, i, v, label in live:
        if not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, m) for k, j, w, m in live if k != row]
        for s, j, _ in sorted((e for e in scored if e[2] == label), key=by)[:p]:
            near = sorted((e for e in scored if e[2] != label and 80 * s <= 100 * e[0] <= 100 * s), key=by)[:n]
            out += [(i, j, rank, e[1], s, e[0]) for rank, e in enumerate(near, 1)]
    return out


def vectors(n=260, dim=4, seed=2):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.1, 0.25, 0.5, 0.7]) for _ in range(dim)], rng.randint(0, 3)) for i in range(n)]
    rows += [rows[20], rows[21], rows[21], (None, rows[3][1], 1), (None, rows[3][1], 2), (300, None, 1), (310, [0.1, None, 0.2, 0.3], 1), (320, [float("nan"), 0.0, 0.0, 0.0], 1)]
    rows += [(330, [float("inf"), 0.0, 0.0, 0.0], 1), (340, [0.1, 0.2, 0.3, 0.4], None), (350, [], 2), (360, [0.5, 0.5], 1), (-20, [0.7] * 4, 1)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], i % 4) for i in range(120)]  # a large group of copies
    return rows


ROWS12 = "vec_id long, embedding array<float>, label int, cells string, row string, anchor string, pos string, is_anchor string"


@pytest.mark.parametrize("chunk", [negatives.CHUNK, 7 * 4])
def test_hard_negatives_against_brute_force(llm, chunk):
    rows = vectors()
    df = llm.createDataFrame([(*r, *["x"] * 5) for r in rows], ROWS12).repartition(5)
    got = [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, chunk_cells=chunk).collect()]
    key = lambda e: tuple((x is None, x or 0) for x in e)
    assert sorted(got, key=key) == sorted(mine(rows, lambda i: i is not None and i % 10 == 0), key=key)


def test_hard_negatives_of_nothing(llm):
    empty = llm.createDataFrame([], ROWS12)
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    alone = llm.createDataFrame([(10, [0.5], 1), (11, [0.5], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(alone, F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(alone, F.col("vec_id") == 5).count() == 0


def test_large_components_score_exactly(llm):
    rows = [(0, [3e6, -1e7, 2.5e6], 1), (1, [3e6, -1e7, 2.6e6], 1), (2, [3e6, -1e7, 2.4e6], 2), (3, [1e18, 1e18, 1e30], 2)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(df, F.col("vec_id") == 0).collect()
    cell = lambda v: [math.floor(256 * x) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(cell(rows[a][1]), cell(rows[b][1]), strict=True))
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, dot(0, 1), dot(0, 2))]


def test_keys_order_as_anchor_score_kind_id():
    rng = random.Random(4)
    made = [(rng.randint(0, 3), rng.randint(-5, 5) * 10**rng.randint(0, 18), rng.random() < 0.5, rng.choice([None, -3, 0, 7, 2**62])) for _ in range(300)]
    by = lambda e: (e[0], -e[1], e[2], e[3] is None, e[3] or 0)
    assert [negatives.unpack(k) for k in sorted(negatives.pack(*e) for e in made)] == sorted(made, key=by)


def test_windows_read_a_stream_once_and_hold_open_windows_only():
    keys = sorted([negatives.pack(0, 100, False, 1), negatives.pack(0, 90, False, 2)] + [negatives.pack(0, s, True, 10 + s) for s in (95, 90, 85, 80, 79, 72, 71)])
    got = list(negatives.windows(iter(keys), 80, 100, 3))
    assert got == [(0, 1, 1, 105, 100, 95), (0, 1, 2, 100, 100, 90), (0, 2, 1, 100, 90, 90), (0, 1, 3, 95, 100, 85), (0, 2, 2, 95, 90, 85), (0, 2, 3, 90, 90, 80)]


# --- op13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """Root, and for each leaf its (place in the run, the run's others) level by level."""
    paths, under = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, below = [], []
        for i in range(0, len(digests), 2):
            run = digests[i : i + 2]
            for k in range(len(run)):
                for leaf in under[i + k]:
                    paths[leaf].append((k, run[:k] + run[k + 1 :]))
            up.append(H(*run))
            below.append([leaf for members in under[i : i + 2] for leaf in members])
        digests, under = up, below
    return digests[0], paths


def leaf(r):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*[field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def proved(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    subs = {x: tree([leaf(r) for r in by[x]]) for x in langs}
    root, above = tree([subs[x][0] for x in langs]) if langs else (None, [])
    out = []
    for x, rest in zip(langs, above, strict=True):
        for r, own in zip(by[x], subs[x][1], strict=True):
            path, now = own + rest, leaf(r)
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                now = leaf(r | {"n_chars": r["n_chars"] + 1})
            for k, others in path:
                now = H(*others, now) if k else H(now, *others)
            out.append((r["doc_id"], leaf(r), subs[x][0], root, H(*[s for _, o in path for s in o]), now, now == root))
    return out


def docs13():
    rng = random.Random(9)
    rows = []
    for lang, n in (("en", 83), (None, 9), ("", 1), ("de", 64), ("é", 5), ("z", 2), *((f"x{i}", 1) for i in range(20))):
        for _ in range(n):
            text = rng.choice([None, "", "a", "é日本" * rng.randint(0, 9), "long " * 30_000])
            rows.append({"doc_id": len(rows), "source": rng.choice([None, "", "s"]), "lang": lang, "n_chars": rng.choice([None, len(text or ""), 2**63 - 1]), "text": text})
    rows += [rows[3], rows[3], rows[40] | {"text": "other"}, rows[7] | {"doc_id": None}, rows[7] | {"doc_id": None}]
    return rows


DOCS13 = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, n string, digest string, block string, path string, shown string, leaf string"


def manifest(df, levels):
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    shown = merkle.one_more(fields, "n_chars", F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return merkle.manifest(df, fields, shown=shown, levels=levels)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_against_brute_force(llm, levels):
    rows = docs13()
    df = llm.createDataFrame([(*r.values(), *["x"] * 8) for r in rows], DOCS13).repartition(5)
    found = manifest(df, levels).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found]
    key = lambda e: tuple((x is not None, x or 0) for x in e)
    assert sorted(got, key=key) == sorted(proved(rows), key=key)
    assert all(H(*r.proof) == r.proof_sha256 for r in found)
    assert any(not r.verified for r in found)


def test_manifest_of_one_row_and_of_none(llm):
    df = llm.createDataFrame([(1, "s", "en", 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = manifest(df, 10).collect()
    assert r.leaf == r.subroot == r.root and r.proof == [] and r.proof_sha256 == H()
    assert manifest(df.limit(0), 10).count() == 0


def test_sweeps_are_inverse_for_every_size():
    for n in range(1, 40):
        leaves = [H(str(i)) for i in range(n)]
        root, paths = tree(leaves)
        made = merkle.sweep_up(leaves, merkle.height(n))
        assert made[-1] == [root]
        for i, path in merkle.sweep_down(made, ""):
            assert merkle.fold(leaves[i], path) == root
            assert merkle.proof(path) == [s for _, o in paths[i] for s in o]
            assert merkle.fold(H("x"), path) != root


def test_queries_of_the_three_have_a_row_for_what_they_answer(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op11_mix_sources", "op13_merkle_manifest"):
        assert queries.QUERIES[name](llm, SF).count() == docs
