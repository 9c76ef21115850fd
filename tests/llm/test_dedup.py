import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from patchcraft.llm import components, exact, simhash, suffix


def key(x):
    return tuple((v is None, v) for v in x)


def test_exact_dedup_against_brute_force(docs, corpus):
    groups = defaultdict(list)
    for doc_id, text, *_ in corpus:
        text = text or ""
        groups[re.sub("[\x20\x09-\x0d]", "", text)].append((-len(text), doc_id is None, doc_id))
    want = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        keep = members[0][2]
        # Of rows that agree in length and id exactly one stays.
        want += [(i, keep, len(members), place == 0, hashlib.sha256(norm.encode()).hexdigest()) for place, (_, _, i) in enumerate(members)]
    got = [tuple(r) for r in exact.exact_dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_chunks_follow_content_and_stay_in_bounds():
    rng = random.Random(1)
    data = rng.randbytes(300_000)
    chunks = exact.chunks_of(data)
    assert b"".join(chunks) == data and max(map(len, chunks)) <= exact.MAX_CHUNK
    moved = exact.chunks_of(b"some bytes put before" + data)
    assert len(set(chunks) & set(moved)) > 0.9 * len(chunks)
    assert exact.chunks_of(b"") == [] and exact.chunks_of(b"abc") == [b"abc"]
    assert b"".join(exact.chunks_of(b"a" * 100_000)) == b"a" * 100_000


def test_chunks_are_stored_once_and_recipes_rebuild_texts(llm, docs, corpus, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK_BYTES", 4000)
    blocks = exact.written(exact.block_rows(docs), "test_blocks")
    chunks = exact.chunk_table(blocks)
    names = {r["chunk"]: (bytes(r["sha256"]), r["n_bytes"]) for r in chunks.collect()}
    assert len(names) == len(set(names.values())) == chunks.count()
    stored = {(hashlib.sha256(c).digest(), len(c)): c for _, t, *_ in corpus for c in exact.chunks_of(exact.normalised((t or "").encode()))}
    assert set(stored) == set(names.values())
    found = exact.recipes(blocks, chunks).collect()
    lists = {(r["block"], r["list"]): r["recipe"] for r in found if r["recipe"] is not None}
    texts = Counter(b"".join(stored[names[c]] for c in lists[r["block"], r["list"]]) for r in found)
    assert texts == Counter(exact.normalised((t or "").encode()) for _, t, *_ in corpus)
    assert blocks.select("block").distinct().count() > 3


def test_exact_dedup_of_hot_copies_and_rows_without_ids(llm):
    long = "word " * 30_000
    rows = [(None, "same  text")] * 3000 + [(i, "same text") for i in range(500)] + [(7, long), (8, long + "x"), (9, long.replace(" ", "\n"))]
    found = exact.exact_dedup(llm.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    hot = [r for r in found if r["group_size"] == 3500]
    assert len(hot) == 3500 and [r["doc_id"] for r in hot if r["kept"]] == [None]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in found if r["group_size"] < 3500} == {(7, 7, True), (9, 7, False), (8, 8, True)}


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, bits=2):
    """The least key reachable from each print over links of at most ``bits``."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    todo = list(prints)
    for i, p in enumerate(todo):
        for q in todo[:i]:
            if (p ^ q).bit_count() <= bits:
                root[find(p)] = find(q)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("pair_cell", [2, 32])
def test_simhash_against_brute_force(docs, corpus, pair_cell):
    prints = [(r[0], fingerprint(r[1])) for r in corpus]
    of = classes({p for _, p in prints})
    least = defaultdict(list)
    for i, p in prints:
        least[of[p]].append(i)
    want = [(i, f"{p:016x}", m := min(x for x in least[of[p]] if x is not None), i == m) for i, p in prints]
    got = [tuple(r) for r in simhash.simhash_near_dedup(docs, pair_cell=pair_cell).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("pair_cell", [1, 8, 10_000])
def test_links_have_the_components_of_all_pairs(llm, pair_cell):
    rng = random.Random(5)
    prints = set()
    for _ in range(30):  # dense balls and chains
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 25])):
            prints.add(p)
            p ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
    prints |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1}
    rows = llm.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    roots = components.connected_components(simhash.links(rows, pair_cell)).collect()
    got = defaultdict(set)
    for r in roots:
        got[r["root"]].add(r["node"] & (1 << 64) - 1)
    want = defaultdict(set)
    for p, c in classes(prints).items():
        want[c].add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def brute_repeats(rows, window=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + window] for _, b in texts for j in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        mark = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if seen[b[j : j + window]] > 1:
                mark[j : j + window] = b"\1" * window
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((i, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("light", [suffix.LIGHT, 3, 0])
def test_suffix_dedup_against_brute_force(docs, corpus, light):
    done = suffix.remove_repeats(docs, light=light, merge_size=100)
    got = [tuple(r) for r in done.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()]
    assert sorted(got, key=key) == sorted(brute_repeats([r[:2] for r in corpus]), key=key)
    assert sum(r[2] for r in got) > 10_000


def test_suffix_dedup_walks_long_texts_in_parts(llm, monkeypatch):
    rng = random.Random(2)
    body = "".join(rng.choice("abcd ") for _ in range(3000))
    rows = [(1, body), (2, body[700:2300] + "x"), (3, "y" + body[:500])]
    monkeypatch.setattr(suffix, "PART", 300)
    monkeypatch.setattr(suffix, "SLICE", 700)
    whole = {(r, int(i)) for rows_, lo, hi, _, _ in suffix.blocks([t.encode() for _, t in rows]) for r, a, z in zip(rows_, lo, hi) for i in range(a, z + 1)}
    assert whole == {(r, i) for r, (_, t) in enumerate(rows) for i in range(len(t) - 199)}


def test_loser_tree_merges_and_keeps_shared_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 8))}) for _ in range(rng.randint(0, 7))]
        out = list(suffix.merge_runs([suffix.front_code(r) for r in runs]))
        assert [o[0] for o in out] == sorted(s for r in runs for s in r)
        for a, b in zip(out, out[1:]):
            assert b[1] == suffix.common_prefix(a[0], b[0])


def test_empty_tables(empty):
    assert exact.exact_dedup(empty).count() == 0
    assert simhash.simhash_near_dedup(empty).count() == 0
    assert suffix.remove_repeats(empty, carry=("row", "kept")).count() == 0


def test_components_of_a_long_chain(llm):
    rows = [(i + 1, i) for i in range(400)] + [(1000, 1001), (1001, 1002), (5000, 5000)]
    found = components.connected_components(llm.createDataFrame(rows, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(401)} | {(i, 1000) for i in (1000, 1001, 1002)}


def test_no_table_of_near_dedup_is_broadcast(llm, docs, monkeypatch):
    plans = []

    def kept(df, name, write=simhash.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(simhash, "written", kept)
    monkeypatch.setattr(components, "written", kept)
    plans.append(simhash.simhash_near_dedup(docs)._jdf.queryExecution().executedPlan().toString())
    joins = sum(p.count("SortMergeJoin") for p in plans)
    assert joins >= 6 and not any("Broadcast" in p for p in plans)  # small as these are, Spark would broadcast each
