"""Removal of repeated byte strings by distributed suffix sorting (operator 4).

A byte goes if a ``window`` (200 bytes) that covers it also starts elsewhere.
Sorting every suffix would move each byte hundreds of times, so only suffixes
that can matter are sorted, and each stands for a block of windows:

1. *Anchors.*  The anchor of a window is the place of its least GRAM-byte hash
   (leftmost first), which depends on the window's bytes alone.  Neighbouring
   windows share an anchor; they form a block.  Equal windows have equal
   anchor grams, so a block whose gram occurs once in the corpus holds no
   repeated window.  This is the search for distinguishing prefixes that
   communication-efficient string sorting does before it exchanges anything.
2. *Runs.*  The block suffixes left, each cut where its last window ends, are
   sorted in the map task, equal ones collapse, and the sorted run is front
   coded: the length of the prefix shared with the suffix before, and the rest.
3. *Merge.*  Runs are exchanged by gram and merged by a loser tree that keeps,
   for each contender, the common prefix with the last winner, and so never
   compares a known prefix again.  Common prefixes of neighbours decide blocks
   and leading windows; the windows left are compared among the suffixes of the
   same gram, byte by byte.
4. A gram with more than LIGHT occurrences (a hot passage) must not meet in one
   task: its suffixes are exchanged by their whole string, so that each distinct
   one is a single row, and their windows are counted by 128-bit hash.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exchanged, written

WINDOW, GRAM = 200, 32
#: Occurrences of a gram up to which its suffixes are compared in one task.
LIGHT = 2000
#: Suffixes in a merge task, on average.
MERGE = 20_000
#: Windows of a text that are looked at together; longer texts are walked in parts that overlap by a window.
PART, SLICE = 1 << 20, 1 << 21
_POSITION = np.uint64(22)  # bits for a place in a slice
_MULTIPLIERS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number."""
    out = np.empty(len(data) - 7, np.uint64)
    for r in range(8):
        out[r::8] = np.frombuffer(data, "<u8", (len(data) - r) // 8, r)
    return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours, from each place on."""
    now, have = keys, 1
    while have * 2 <= width:
        now, have = np.minimum(now[:-have], now[have:]), have * 2
    rest = width - have
    return np.minimum(now[:-rest], now[rest:]) if rest else now


def _slice_blocks(parts: list[tuple[int, int, bytes]]):
    """Blocks of parts ``(row, offset in the text, bytes)``: row, first and last window, anchor (places in the text), gram hash."""
    sizes = np.array([len(p[2]) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    w = _words(data)
    n = len(data) - GRAM + 1
    hashes = np.zeros(n, np.uint64)
    for k, m in enumerate(_MULTIPLIERS):
        hashes = (hashes ^ (w[8 * k : 8 * k + n] * m)) * _MULTIPLIERS[k - 1]
        hashes ^= hashes >> np.uint64(29)
    keys = ((hashes >> _POSITION) << _POSITION) | np.arange(n, dtype=np.uint64)
    anchors = (_least(keys, WINDOW - GRAM + 1) & ((np.uint64(1) << _POSITION) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(anchors) + 1, bool)
    for s, size in zip(starts.tolist(), sizes.tolist()):
        valid[s : s + size - WINDOW + 1] = True
    same = np.zeros(len(anchors), bool)
    same[1:] = valid[:-2] & (anchors[1:] == anchors[:-1])
    first = np.flatnonzero(valid[:-1] & ~same)
    more = np.zeros(len(anchors), bool)
    more[:-1] = same[1:] & valid[1:-1]
    last = np.flatnonzero(valid[:-1] & ~more)
    part = np.searchsorted(starts, first, "right") - 1
    shift = np.array([p[1] for p in parts], np.int64)[part] - starts[part]
    rows = np.array([p[0] for p in parts], np.int64)[part]
    at = anchors[first]
    return rows, first + shift, last + shift, at + shift, hashes[at].view(np.int64)


def blocks(texts: list[bytes]):
    """Blocks of all texts, slice by slice; texts under a window have none."""
    parts, size = [], 0
    for row, text in enumerate(texts):
        for offset in range(0, len(text) - WINDOW + 1, PART):
            part = text[offset : offset + PART + WINDOW - 1]
            if parts and size + len(part) > SLICE:
                yield _slice_blocks(parts)
                parts, size = [], 0
            parts.append((row, offset, part))
            size += len(part)
    if parts:
        yield _slice_blocks(parts)


def anchors(rows: DataFrame) -> DataFrame:
    """``gram, key, lo`` of each block of ``rows(key, body)``."""

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy()
            for row, lo, _, _, gram in blocks(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(keys[row]), pa.array(lo.astype(np.int32))], names=["gram", "key", "lo"])

    return rows.mapInArrow(run, "gram long, key long, lo int")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are equal and not looked at."""
    end = min(len(a), len(b))
    step = 16
    while known < end:
        stop = min(known + step, end)
        if a[known:stop] == b[known:stop]:
            known, step = stop, step * 4
        elif stop - known == 1:
            return known
        else:
            step = (stop - known) // 2
            stop = known + step
            if a[known:stop] == b[known:stop]:
                known = stop
    return end


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: the prefix each shares with the one before, and the rest."""
    shared, rest, last = [], [], b""
    for s in strings:
        k = common_prefix(last, s)
        shared.append(k)
        rest.append(s[k:])
        last = s
    return shared, rest


def merge_runs(runs: list[tuple[list[int], list[bytes]]]):
    """``(string, prefix shared with the string before, run, place in the run)`` of front-coded runs, in order.

    A loser tree: each inner node keeps the loser of its last match with the
    prefix it shares with the winner.  Of two contenders that have been compared
    with the same winner, the one with the longer shared prefix is smaller; only
    if the prefixes are as long are bytes compared, from there on.
    """
    k = len(runs)
    if not k:
        return
    place = [0] * k
    heads: list[bytes | None] = [r[1][0] if r[1] else None for r in runs]
    shared = [0] * k
    tree = [-1] * k  # the loser at each inner node; node 0 holds the winner

    def play(node: int, player: int) -> int:
        """The winner of ``player`` against the loser at ``node``, which the other one becomes."""
        other = tree[node]
        a, b = heads[player], heads[other]
        if a is None:
            tree[node] = player
            return other
        if b is None:
            return player
        p, q = shared[player], shared[other]
        if p > q:
            return player
        if p < q:
            tree[node] = player
            return other
        c = common_prefix(a, b, p)
        if a[c : c + 1] <= b[c : c + 1]:
            shared[other] = c
            return player
        shared[player] = c
        tree[node] = player
        return other

    for leaf in range(k):
        node, winner = (leaf + k) // 2, leaf
        while node and tree[node] >= 0:
            winner = play(node, winner)
            node //= 2
        tree[node] = winner
    winner = tree[0]
    while heads[winner] is not None:
        text = heads[winner]
        yield text, shared[winner], winner, place[winner]
        place[winner] += 1
        lengths, rests = runs[winner]
        if place[winner] < len(rests):
            shared[winner] = lengths[place[winner]]
            heads[winner] = text[: shared[winner]] + rests[place[winner]]
        else:
            heads[winner] = None
        node = (winner + k) // 2
        while node:
            winner = play(node, winner)
            node //= 2


_RUN = "bucket long, heavy boolean, shared binary, sizes binary, rest binary, anchor binary, uses binary, keys binary, los binary"


def sorted_runs(rows: DataFrame, parts: int) -> DataFrame:
    """Front-coded runs of the block suffixes of ``rows(key, body, marks)``; ``marks`` are 2 * lo + (1 if the gram is heavy)."""

    def run(batches):
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            marks = [set(m) for m in b.column(2).to_pylist()]
            found: dict[tuple[int, bool], dict[bytes, list]] = defaultdict(dict)
            for row, lo, hi, at, gram in blocks(texts):
                rows_, los, grams = row.tolist(), lo.tolist(), gram.tolist()
                light = np.fromiter((2 * x in marks[r] for r, x in zip(rows_, los)), bool, len(los))
                heavy = np.fromiter((2 * x + 1 in marks[r] for r, x in zip(rows_, los)), bool, len(los))
                for i in np.flatnonzero(light | heavy).tolist():
                    a, z, r = los[i], int(hi[i]) + WINDOW, rows_[i]
                    s = texts[r][a:z]
                    bucket = xxhash.xxh64_intdigest(s) if heavy[i] else grams[i]
                    entry = found[(bucket % parts, bool(heavy[i]))].setdefault(s, [int(at[i]) - a])
                    entry.append((keys[r], a))
            out = []
            for (bucket, is_heavy), strings in sorted(found.items()):
                ordered = sorted(strings)
                shared, rest = front_code(ordered)
                uses = [strings[s][1:] for s in ordered]
                flat = [u for us in uses for u in us]
                out.append((
                    bucket, is_heavy, np.array(shared, np.int32).tobytes(), np.array([len(x) for x in rest], np.int32).tobytes(), zstandard.compress(b"".join(rest)),
                    np.array([strings[s][0] for s in ordered], np.int32).tobytes(), np.array([len(u) for u in uses], np.int32).tobytes(),
                    np.array([u[0] for u in flat], np.int64).tobytes(), np.array([u[1] for u in flat], np.int32).tobytes(),
                ))
            types = [pa.int64(), pa.bool_(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names=[f.split()[0] for f in _RUN.split(", ")])

    return rows.mapInArrow(run, _RUN)


def _ranges(flags: list[bool]) -> list[tuple[int, int]]:
    """Start and length of each stretch of true flags."""
    d = np.diff(np.concatenate([[0], np.array(flags, np.int8), [0]]))
    first, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return list(zip(first.tolist(), (end - first).tolist()))


def _resolve(strings: list[bytes], uses: list[int], prefix: list[int], anchor: list[int]) -> list[list[tuple[int, int]]]:
    """The repeated windows of each distinct suffix, as stretches; ``prefix`` is the prefix that each shares with the one before."""
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    by_gram: dict[bytes, list[int]] = defaultdict(list)
    for i, s in enumerate(strings):
        by_gram[s[anchor[i] : anchor[i] + GRAM]].append(i)
    for members in by_gram.values():
        open_ = []
        for i in members:
            windows = len(strings[i]) - WINDOW + 1
            after = prefix[i + 1] if i + 1 < len(strings) else 0
            known = windows if uses[i] > 1 else min(windows, max(0, max(prefix[i], after) - WINDOW + 1))
            if known:
                out[i] = [(0, known)]
            if known < windows:
                open_.append(i)
        if not open_ or len(members) == 1:
            continue
        seen: Counter = Counter()
        for i in members:
            s = strings[i]
            seen.update(s[j : j + WINDOW] for j in range(len(s) - WINDOW + 1))
        for i in open_:
            s = strings[i]
            out[i] = _ranges([seen[s[j : j + WINDOW]] > 1 for j in range(len(s) - WINDOW + 1)])
    return out


#: What a row of ``merge`` is.
REPEATED, SINGLE, COUNTED = range(3)
_FOUND = "kind int, key long, start int, n int, high long, low long, uses long"


def merge(runs: DataFrame) -> DataFrame:
    """Merges the runs of each bucket.

    REPEATED rows: n windows from ``start`` of text ``key`` on repeat.  A heavy
    suffix that occurs more than once is decided by that; one that occurs once
    gives a SINGLE row of n windows.  Each window of each distinct heavy
    suffix gives a COUNTED row with its 128-bit hash, the ``uses`` of the suffix
    and its place, which means something if there is one use.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        heavy = bool(frame["heavy"].iloc[0])
        coded, anchors_, used = [], [], []
        for r in frame.itertuples(index=False):
            sizes = np.frombuffer(r.sizes, np.int32)
            ends = np.cumsum(sizes).tolist()
            whole = zstandard.decompress(r.rest)
            rest = [whole[a:z] for a, z in zip([0, *ends[:-1]], ends)]
            coded.append((np.frombuffer(r.shared, np.int32).tolist(), rest))
            anchors_.append(np.frombuffer(r.anchor, np.int32).tolist())
            stops = np.cumsum(np.frombuffer(r.uses, np.int32)).tolist()
            used.append((np.frombuffer(r.keys, np.int64), np.frombuffer(r.los, np.int32), [0, *stops]))
        strings, prefix, anchor, places = [], [], [], []
        for s, shared, run, i in merge_runs(coded):
            if strings and shared >= len(s) and len(s) == len(strings[-1]):
                places[-1].append((run, i))
            else:
                strings.append(s)
                prefix.append(shared)
                anchor.append(anchors_[run][i])
                places.append([(run, i)])
        keys = [np.concatenate([used[r][0][used[r][2][i] : used[r][2][i + 1]] for r, i in p]) for p in places]
        los = [np.concatenate([used[r][1][used[r][2][i] : used[r][2][i + 1]] for r, i in p]) for p in places]
        key, start, n = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        windows = [len(s) - WINDOW + 1 for s in strings]
        uses = [len(k) for k in keys]
        found = [[(0, w)] if u > 1 else [] for u, w in zip(uses, windows)] if heavy else _resolve(strings, uses, prefix, anchor)
        for i, stretches in enumerate(found):
            for a, length in stretches:
                key.append(keys[i])
                start.append(los[i] + np.int32(a))
                n.append(np.full(uses[i], length, np.int32))
        key, start, n = np.concatenate(key), np.concatenate(start), np.concatenate(n)
        ranges = pd.DataFrame({"kind": REPEATED, "key": key, "start": start, "n": n, "high": 0, "low": 0, "uses": 0})
        if not heavy:
            return ranges
        first, at = np.array([k[0] for k in keys]), np.array([x[0] for x in los])
        sizes, uses = np.array(windows), np.array(uses)
        once = uses == 1
        single = pd.DataFrame({"kind": SINGLE, "key": first[once], "start": at[once], "n": sizes[once], "high": 0, "low": 0, "uses": 1})
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s[j : j + WINDOW]) for s, w in zip(strings, windows) for j in range(w)), "<i8").reshape(-1, 2)
        each = np.repeat(np.arange(len(sizes)), sizes)
        counted = pd.DataFrame({
            "kind": COUNTED, "key": first[each], "start": at[each], "n": np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes),
            "high": hashes[:, 0], "low": hashes[:, 1], "uses": uses[each],
        })
        return pd.concat([ranges, single, counted], ignore_index=True)


    return runs.groupBy("bucket", "heavy").applyInPandas(one, _FOUND)


def heavy_stretches(found: DataFrame) -> DataFrame:
    """``key, start, n`` of the repeated windows of heavy suffixes."""
    # A window that occurs once is in one row, which the group itself names; what is repeated never has to be joined back.
    windows = found.where(F.col("kind") == COUNTED)
    once = windows.groupBy("high", "low").agg(F.sum("uses").alias("uses"), F.min(F.struct("key", "start", "n")).alias("w")).where("uses = 1")
    single = once.groupBy(F.col("w.key").alias("key"), F.col("w.start").alias("start")).agg(F.collect_list("w.n").alias("single"))
    suffixes = found.where(F.col("kind") == SINGLE).select("key", "start", "n")

    def run(batches):
        for b in batches:
            out = []
            for key, start, size, alone in zip(*(c.to_pylist() for c in b.columns)):
                flags = np.ones(size, bool)
                flags[alone or []] = False
                out += [(key, start + a, length) for a, length in _ranges(flags)]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["key", "start", "n"])

    rows = suffixes.join(exchanged(single), ["key", "start"], "left")
    return rows.select("key", "start", "n", "single").mapInArrow(run, "key long, start int, n int")


def repeated_windows(rows: DataFrame, light: int = LIGHT, merge_size: int = MERGE) -> DataFrame:
    """``key, start, n``: the stretches of repeated windows of ``rows(key, body)``."""
    grams = written(anchors(rows).groupBy("gram").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"), "grams")
    total = grams.agg(F.sum("uses")).first()[0] or 0
    parts = max(1, -(-total // merge_size))
    mark = (F.col("lo").cast("long") * 2 + (F.col("uses") > light).cast("long")).alias("mark")
    marks = anchors(rows).join(exchanged(grams), "gram").select("key", mark).groupBy("key").agg(F.collect_set("mark").alias("marks"))
    runs = sorted_runs(rows.join(exchanged(marks), "key").select("key", "body", "marks"), parts)
    found = written(merge(runs), "merged")
    return found.where(F.col("kind") == REPEATED).select("key", "start", "n").union(heavy_stretches(found))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False, light: int = LIGHT, merge_size: int = MERGE) -> DataFrame:
    """One row for each input row: ``doc_id, row, n_bytes, n_removed, spans, kept``.

    ``spans`` are the maximal removed runs as ``start, stop`` bytes, ``kept`` the
    bytes left; ``as_text`` makes them a string, without the remains of
    characters that lost some of their bytes.  ``row`` is a struct of the ``carry`` columns, untouched.  Null
    counts as empty; texts under 200 bytes lose nothing.  A repeated row
    repeats all its windows, so both lose them.  Rows are told apart by a
    64-bit hash of id and text; null ids are allowed.  Empty input: no rows.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.xxhash64(F.col(id_col), body).alias("key")
    rows = docs.select(key, body.alias("body")).where(F.octet_length("body") >= WINDOW)
    stretches = repeated_windows(rows, light, merge_size).groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    whole = docs.select(key, F.col(id_col).alias("doc_id"), F.struct(*carry, F.lit(0).alias("_")).alias("row"), body.alias("body"))
    joined = whole.join(exchanged(stretches), "key", "left").drop("key")
    types = {f.name: f.dataType.simpleString() for f in joined.schema}

    def run(batches):
        for b in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            for body, starts, ns in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                cut: list[list[int]] = []
                for a, n in sorted(zip(starts or (), ns or ())):
                    z = a + n - 1 + WINDOW
                    if cut and a <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], z)
                    else:
                        cut.append([a, z])
                left, at = [], 0
                for a, z in cut:
                    left.append(body[at:a])
                    at = z
                left.append(body[at:])
                rest = b"".join(left)
                n_bytes.append(len(body))
                n_removed.append(len(body) - len(rest))
                spans.append([{"start": a, "stop": z} for a, z in cut])
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())],
                names=["doc_id", "row", "n_bytes", "n_removed", "spans", "kept"],
            )

    return joined.mapInArrow(run, f"doc_id {types['doc_id']}, row {types['row']}, n_bytes long, n_removed long, spans array<struct<start:bigint,stop:bigint>>, kept {'string' if as_text else 'binary'}")
