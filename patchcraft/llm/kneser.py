"""Quality classifier: interpolated modified Kneser-Ney n-grams (operator 3).

The model counts n-grams of characters, as they are, in trusted documents
(labelled of good quality and not toxic).  Texts are packed once into blocks of
about BLOCK_CHARS characters, in a table bucketed by block, and never move
after that: what is known of a block meets it in its bucket.  First come the
places of its trusted documents, and the block gives its distinct n-grams with
their counts in trusted text, packed into one row for each shard of the n-gram
space.  The counts, added up over blocks, are the model: tables sharded by
n-gram, as large as the corpus makes them, whose joins on n-grams and contexts
turn counts into probabilities.  Then each shard's probabilities are
sorted before the shard's packed rows of all blocks, which stream past them, and
the answers go back to the blocks, where each document's sum is added up.
Nothing is broadcast or collected but four counts of counts an order.  An order
below the highest counts in how many contexts an n-gram occurs.

A document's score is its cross entropy in bits a character.  Junk lies on
both sides of what trusted text has (symbols and capitals above, repetition
below), so documents pass between a low and a high threshold.  Thresholds come
from the trusted quantiles of the document's language and length, widened by
``slack`` times their spread.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_path
from .common import exchanged, type_of, written

ORDER = 4
#: Stands before a text's first character; a noncharacter.
BEFORE = 0x10FFFF
#: Code points there are: what the lowest order falls back on.
CODE_POINTS = 0x110000
#: Characters a block has, about; a longer document is a block of its own.
BLOCK_CHARS = 1 << 22
#: Shards of the n-gram space: a task holds the probabilities of one at a time.
SHARDS = 256
#: Quantiles of trusted documents and how many times their distance from the median a document may be away.
QUANTILES, SLACK = (0.01, 0.99), 3.0
#: Bits a character are counted in steps of 1/STEPS, so quantiles are exact over few distinct values.
STEPS = 200
#: Documents shorter than this many characters say too little and pass.
MIN_CHARS = 100
#: Bits a character that a threshold is away from the median at least.
LEAST_REACH = 0.3
#: A discount is at least this, so that no n-gram is impossible where counts leave nothing to give away.
LEAST_DISCOUNT = 0.01
#: Trusted documents a (language, length) group needs to have its own thresholds.
MIN_TRUSTED = 50


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts 1 to 4 (four numbers for the driver)."""
    row = counts.agg(*[F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(1, 5)]).first()
    n = [0.0, *[float(row[f"n{k}"] or 0) for k in range(1, 5)]]
    if not (n[1] and n[2]):
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], LEAST_DISCOUNT), float(k)) if n[k] else 0.5 * k for k in (1, 2, 3)]


def probabilities(counted: DataFrame, asked: DataFrame, order: int = ORDER, alphabet: int = CODE_POINTS) -> DataFrame:
    """``gram, bits``: minus the binary logarithm of the probability, after its context, of each n-gram of ``asked``.

    ``counted`` holds the counts of the trusted text.  Each order joins the
    n-grams asked for with their counts, with the totals of their contexts and
    with the probabilities of the order below.
    """
    suffix = lambda k: F.right("gram", F.lit(k)) if k else F.lit("")
    counts, wanted = {order: counted}, {order: asked.select("gram")}
    for k in range(order - 1, 0, -1):
        shorter = suffix(k).alias("gram")
        # In how many contexts an n-gram one character longer has it.
        counts[k] = written(counts[k + 1].select(shorter).groupBy("gram").agg(F.count(F.lit(1)).alias("c")), f"continuations{k}")
        wanted[k] = wanted[k + 1].select(shorter).distinct()
    below = None
    for k in range(1, order + 1):
        d = _discounts(counts[k])
        off = F.when(F.col("c") == 1, F.lit(d[0])).when(F.col("c") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        context = F.substring("gram", 1, k - 1).alias("context")
        contexts = counts[k].groupBy(context).agg(F.sum("c").alias("total"), F.sum(off).alias("spare"))
        rows = wanted[k].select("gram", context).join(exchanged(counts[k].withColumn("off", off)), "gram", "left").join(exchanged(contexts), "context", "left")
        rows = rows.withColumn("suffix", suffix(k - 1))
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / alphabet))
        else:
            rows = rows.join(exchanged(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))), "suffix")
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(
            (F.greatest(F.coalesce("c", F.lit(0)) - F.coalesce("off", F.lit(0.0)), F.lit(0.0)) + F.col("spare") * F.col("lower")) / F.col("total")
        )
        below = written(rows.select("gram", p.alias("p")), f"order{k}")
    return below.select("gram", (-F.log2("p")).alias("bits"))


def local_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all texts, ascending, a row of code points each; and for each character of the texts, one after the other, the place there of the n-gram that ends at it."""
    lead = order - 1
    start = chr(BEFORE) * lead
    points = np.frombuffer("".join([start + t for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
    present = np.zeros(CODE_POINTS, bool)
    present[points] = True
    letters = np.flatnonzero(present)
    now = (np.cumsum(present, dtype=np.int32) - 1)[points].astype(np.int64)
    key, span = now, max(1, len(letters))
    for _ in range(lead):
        if span * len(letters) >= 1 << 63:
            found, key = np.unique(key, return_inverse=True)
            span = len(found)
        longer = now.copy()
        longer[1:] += key[:-1] * len(letters)
        key, span = longer, span * len(letters)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + lead) - sizes
    own = np.ones(len(points), bool)
    for j in range(lead):
        own[starts - 1 - j] = False
    ends = np.flatnonzero(own)
    places, found = pd.factorize(key[ends])
    # Any place at which an n-gram ends shows its characters.
    last = np.empty(len(found), np.int64)
    last[places] = ends
    grams = points[last[:, None] + np.arange(-lead, 1)]
    order_of = np.lexsort(grams.T[::-1])
    rank = np.empty(len(found), np.int64)
    rank[order_of] = np.arange(len(found))
    return grams[order_of], rank[places]


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of code points."""
    mixed = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        mixed = (mixed ^ grams[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(shards)).astype(np.int64)


def _in_shards(grams: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts n-grams shard by shard, ascending in each, and where each shard begins there."""
    shard = shard_of(grams, shards)
    by_shard = np.argsort(shard, kind="stable")
    return by_shard, np.searchsorted(shard[by_shard], np.arange(shards + 1))


def _packed(grams: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Bytes of like weight together, which leaves little of the leading zeros and of what neighbours share."""
    return pack.compress(np.ascontiguousarray(grams.astype("<u4").view(np.uint8).reshape(len(grams), -1).T).tobytes())


def _unpacked(body: bytes, order: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4 * order, -1)
    return np.ascontiguousarray(planes.T).view("<u4")


def _words(grams: np.ndarray) -> np.ndarray:
    """Rows of code points as strings of fixed size, which numpy orders and searches."""
    return np.ascontiguousarray(grams.astype("<u4")).view(f"<U{grams.shape[1]}").ravel()


def blocks(docs: DataFrame, name: str, chars: int = BLOCK_CHARS) -> DataFrame:
    """``block, place, doc_id, key, lang, n_chars, body`` of ``docs(doc_id, key, lang, text)``: a table of that name in the shared folder, bucketed by block.

    A row for each document, with its place in its block, and one with
    ``body`` for each block: all its texts, compressed.
    """
    rows = docs.select("doc_id", "key", "lang", F.coalesce("text", F.lit("")).alias("text"))
    arrow = to_arrow_schema(rows.select("doc_id", "key", "lang").schema)
    kinds = {"block": pa.int64(), "place": pa.int32(), **{f.name: f.type for f in arrow}, "n_chars": pa.int64(), "body": pa.binary()}

    def batch(n: int, given: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(n, kind) for k, kind in kinds.items()], names=list(kinds))

    def block(number, texts, parts):
        fields, n = pa.Table.from_batches(parts).combine_chunks().to_batches()[0], len(texts)
        members = batch(n, {
            "block": pa.array(np.full(n, number)), "place": pa.array(np.arange(n, dtype=np.int32)), "n_chars": pa.array(list(map(len, texts)), pa.int64()),
            **{c: fields.column(c) for c in fields.schema.names},
        })
        for i in range(0, n, 1 << 13):
            yield members.slice(i, 1 << 13)
        body = zstandard.ZstdCompressor(3).compress("".join(texts).encode("utf-8", "surrogatepass"))
        yield batch(1, {"block": pa.array([number], pa.int64()), "body": pa.array([body], pa.binary())})

    def run(batches):
        number, texts, parts, total = TaskContext.get().partitionId() << 33, [], [], 0
        for b in batches:
            fields, start = b.select(["doc_id", "key", "lang"]), 0
            for i, t in enumerate(b.column("text").to_pylist()):
                texts.append(t)
                total += len(t) + 1
                if total >= chars:
                    parts.append(fields.slice(start, i + 1 - start))
                    yield from block(number, texts, parts)
                    number, texts, parts, total, start = number + 1, [], [], 0, i + 1
            if start < b.num_rows:
                parts.append(fields.slice(start))
        if texts:
            yield from block(number, texts, parts)

    schema = f"block long, place int, doc_id {type_of(rows, 'doc_id')}, key {type_of(rows, 'key')}, lang string, n_chars long, body binary"
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(run, schema).write.format("parquet").bucketBy(buckets, "block").option("path", shared_path(spark, "llm", name)).saveAsTable(name)
    return spark.table(name)


def _texts(block: pa.Table) -> tuple[pa.Table, list[str]]:
    """The documents of a block in their order, and their texts."""
    with_body = block.column("body").is_valid()
    (body,) = block.filter(with_body).column("body").to_pylist()
    members = block.filter(pc.invert(with_body)).sort_by("place")
    ends = np.cumsum(members.column("n_chars").to_numpy()).tolist()
    whole = zstandard.ZstdDecompressor().decompress(body).decode("utf-8", "surrogatepass")
    return members, [whole[a:b] for a, b in zip([0, *ends], ends)]


def packed_grams(found: DataFrame, trusted: DataFrame, order: int = ORDER, shards: int = SHARDS) -> DataFrame:
    """``block, shard, grams, counts``: the distinct n-grams of each of ``blocks()``, a row a shard, with their counts in ``trusted(of, at)``."""

    def run(block: pa.Table, flags: pa.Table) -> pa.Table:
        _, texts = _texts(block)
        grams, places = local_grams(texts, order)
        good = np.zeros(len(texts), bool)
        good[flags.column("at").to_numpy()] = True
        c = np.bincount(places[np.repeat(good, list(map(len, texts)))], minlength=len(grams))
        by_shard, cuts = _in_shards(grams, shards)
        pack, rows = zstandard.ZstdCompressor(3), []
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            at = by_shard[cuts[shard] : cuts[shard + 1]]
            rows.append((shard, _packed(grams[at], pack), pack.compress(c[at].astype("<u4").tobytes())))
        number = block.column("block")[0].as_py()
        return pa.table({
            "block": pa.array([number] * len(rows), pa.int64()), "shard": pa.array([r[0] for r in rows], pa.int32()),
            "grams": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary()),
        })

    return found.groupBy("block").cogroup(trusted.groupBy("of")).applyInArrow(run, "block long, shard int, grams binary, counts binary")


def counted_grams(packed: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, c``: every n-gram of ``packed_grams()``, its counts added up; in each task first, then over all."""

    def run(batches):
        for b in batches:
            for grams, counts in zip(b.column("grams").to_pylist(), b.column("counts").to_pylist()):
                whole = _unpacked(grams, order).tobytes().decode("utf-32-le", "surrogatepass")
                words = [whole[i : i + order] for i in range(0, len(whole), order)]
                c = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(c.astype(np.int64))], names=["gram", "c"])

    return packed.select("grams", "counts").mapInArrow(_in_batches(run, 1 << 14), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _in_batches(run, size: int):
    """Joins small batches to such of about ``size`` rows."""

    def joined(batches):
        parts, n = [], 0
        for b in run(batches):
            parts.append(b)
            n += b.num_rows
            if n >= size:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                parts, n = [], 0
        if n:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return joined


def answers(packed: DataFrame, table: DataFrame, order: int = ORDER, shards: int = SHARDS) -> DataFrame:
    """``block, shard, bits``: for each row of ``packed_grams()`` the bits of its n-grams from ``table(gram, bits)``.

    A task sorts its shards' part of the table before their rows and holds one
    shard of the table at a time.
    """

    def pack(batches):
        done = zstandard.ZstdCompressor(3)
        for b in batches:
            words = np.array(b.column("gram").to_pylist(), f"<U{order}")
            grams = words.view("<u4").reshape(len(words), order)
            bits = b.column("bits").to_numpy()
            by_shard, cuts = _in_shards(grams, shards)
            own = np.flatnonzero(np.diff(cuts)).tolist()
            parts = [by_shard[cuts[k] : cuts[k + 1]] for k in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.nulls(len(own), pa.int64()), pa.array([_packed(grams[at], done) for at in parts], pa.binary()),
                 pa.array([bits[at].tobytes() for at in parts], pa.binary())],
                names=["shard", "block", "grams", "bits"],
            )

    def look_up(batches):
        now, grams, bits, words, values = None, [], [], None, None
        for b in batches:
            out = []
            for shard, block, body, given in zip(*[b.column(c).to_pylist() for c in ("shard", "block", "grams", "bits")]):
                if shard != now:
                    now, grams, bits, words = shard, [], [], None
                if block is None:
                    grams.append(_unpacked(body, order))
                    bits.append(np.frombuffer(given, np.float64))
                    continue
                if words is None:
                    words, values = _words(np.concatenate(grams)), np.concatenate(bits)
                    by_word = np.argsort(words)
                    words, values, grams, bits = words[by_word], values[by_word], [], []
                asked = _words(_unpacked(body, order))
                at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                if not (words[at] == asked).all():
                    raise ValueError("an n-gram of a block is not in the table")
                out.append((block, shard, values[at].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "shard", "bits"]
            )

    model = table.select("gram", "bits").mapInArrow(pack, "shard int, block long, grams binary, bits binary")
    rows = model.unionByName(packed.select("shard", "block", "grams", F.lit(None).cast("binary").alias("bits")))
    return rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("block")).mapInArrow(look_up, "block long, shard int, bits binary")


def entropies(found: DataFrame, trusted: DataFrame, answered: DataFrame, order: int = ORDER, shards: int = SHARDS) -> DataFrame:
    """``doc_id, lang, trusted, n_chars, entropy`` (bits a character; null without any) of every document of ``blocks()``.

    What ``answers()`` and ``trusted(of, at)`` say of a block meets it in its bucket; ``doc_id`` is the key.
    """

    def run(block: pa.Table, said: pa.Table) -> pa.Table:
        members, texts = _texts(block)
        grams, places = local_grams(texts, order)
        flags = said.column("bits").is_null()
        good = np.zeros(len(texts), bool)
        good[said.filter(flags).column("at").to_numpy()] = True
        parts = said.filter(pc.invert(flags)).sort_by("at").column("bits").to_pylist()
        bits = np.empty(len(grams))
        if parts:
            bits[_in_shards(grams, shards)[0]] = np.frombuffer(b"".join(parts), np.float32)
        n = members.column("n_chars").to_numpy()
        total = np.add.reduceat(np.append(bits[places], 0.0), np.cumsum(n) - n)
        mean = pa.array(np.where(n > 0, total, 0.0) / np.maximum(n, 1), mask=n == 0)
        return pa.table([members.column("key"), members.column("lang"), pa.array(good), members.column("n_chars"), mean], names=["doc_id", "lang", "trusted", "n_chars", "entropy"])

    flags = trusted.select("of", "at", F.lit(None).cast("binary").alias("bits"))
    said = flags.unionByName(answered.select(F.col("block").alias("of"), F.col("shard").alias("at"), "bits"))
    fields = f"doc_id {type_of(found, 'key')}, lang string, trusted boolean, n_chars long, entropy double"
    return found.groupBy("block").cogroup(said.groupBy("of")).applyInArrow(run, fields)


def thresholds(trusted: DataFrame, by: list[str], quantiles: tuple[float, float] = QUANTILES, slack: float = SLACK) -> DataFrame:
    """``*by, low, high, n_trusted`` from ``trusted(*by, entropy)``: exact quantiles of the entropy in steps."""
    step = F.round(F.col("entropy") * STEPS).cast("long").alias("step")
    bins = trusted.groupBy(*by, step).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(*by).orderBy("step")  # a row for each step, not for each document
    ranks = bins.select(*by, "step", F.sum("n").over(window).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * F.lit(q), F.col("step"))) / F.lit(float(STEPS))
    found = ranks.groupBy(*by).agg(at(quantiles[0]).alias("lo"), at(0.5).alias("mid"), at(quantiles[1]).alias("hi"), F.max("all").alias("n_trusted"))
    reach = lambda side: F.greatest(F.lit(1.0 + slack) * side, F.lit(LEAST_REACH))
    return found.select(*by, (F.col("mid") - reach(F.col("mid") - F.col("lo"))).alias("low"), (F.col("mid") + reach(F.col("hi") - F.col("mid"))).alias("high"), "n_trusted")


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, key_col: str | None = None) -> DataFrame:
    """One row for each input row: ``doc_id, lang, n_chars, perplexity, low, high, trusted, kept``.

    Labels are found by ``id_col``; with ``key_col`` the result has that column as its ``doc_id``.

    ``labels(doc_id, quality, toxic)`` names the trusted rows: quality 1 and
    toxic not 1.  ``kept`` is false where the entropy lies outside the
    thresholds of the document's language and length, or of all trusted rows
    of its length, or of all, where fewer than MIN_TRUSTED are trusted; rows
    under MIN_CHARS characters, null and empty texts among them, and rows
    without any threshold (no trusted text at all) are kept.  A null language
    is a language of its own, "und".  A doc_id labelled more than once is
    trusted if every label trusts it.  Repeated rows get a row each, empty
    input none.
    """
    bad = ~(F.col("quality").eqNullSafe(1) & ~F.col("toxic").eqNullSafe(1))
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("doc_id")).agg((F.max(bad.cast("int")) == 0).alias("trusted")).where("trusted")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(key_col or id_col).alias("key"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    name = f"kneser_blocks_{uuid.uuid4().hex}"
    found = blocks(rows, name)
    members = found.where("body is null and doc_id is not null").select("doc_id", F.col("block").alias("of"), F.col("place").alias("at"))
    flags = written(members.join(exchanged(named), "doc_id", "left_semi").select("of", "at"), "trusted")
    packed = written(packed_grams(found, flags, order), "packed_grams")
    counted = written(counted_grams(packed, order), "grams")
    table = probabilities(counted.where("c > 0"), counted, order)
    found = entropies(found, flags, answers(packed, table, order), order)
    scored = written(found.withColumn("size", F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("int")), "scored")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    trusted = scored.where(F.col("trusted") & (F.col("n_chars") >= MIN_CHARS))
    levels = [["lang", "size"], ["size"], []]
    judged = scored
    for i, by in enumerate(levels):
        one = thresholds(trusted.withColumn("all_", F.lit(0)), by or ["all_"])
        if by:
            one = one.where(F.col("n_trusted") >= MIN_TRUSTED)
        one = one.select(*by, F.col("low").alias(f"low{i}"), F.col("high").alias(f"high{i}"))
        # Written first, so that its size is known: a few rows for each language.
        one = written(one, f"thresholds{i}")
        judged = judged.join(one, by, "left") if by else judged.join(F.broadcast(one), F.lit(True), "left")
    low, high = (F.coalesce(*[F.col(f"{x}{i}") for i in range(len(levels))]) for x in ("low", "high"))
    judged = judged.select("doc_id", "lang", "n_chars", F.pow(F.lit(2.0), "entropy").alias("perplexity"), "entropy", low.alias("low_bits"), high.alias("high_bits"), "trusted")
    passes = (F.col("n_chars") < MIN_CHARS) | F.col("low_bits").isNull() | F.col("entropy").between(F.col("low_bits"), F.col("high_bits"))
    return judged.select(
        "doc_id", "lang", "n_chars", "perplexity",
        F.pow(F.lit(2.0), "low_bits").alias("low"), F.pow(F.lit(2.0), "high_bits").alias("high"), "trusted", passes.alias("kept"),
    )
