"""Language identification (operator 9).

Sparse multinomial logistic regression on TF-IDF character n-grams, trained
with FTRL-proximal (elastic net: L1 for sparsity, L2 for size) and calibrated by
one temperature on rows left out of the training.

Features are the character 1- to 3-grams of the lower-cased letters of a text,
hashed into a fixed number of places, so a text of any length becomes one
vector and the document frequencies one array of fixed size.  Document
frequencies are counted over every labelled row that is not held out; the
weights are fitted on SAMPLE of these rows at most (the rows of least hash), a
bound that keeps the fit in one place; prediction covers every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import type_of

#: Hashed features (2**FEATURE_BITS) and n-gram lengths.
FEATURE_BITS, LENGTHS = 14, (1, 2, 3)
#: Rows that the weights are fitted on, for each language; one in CALIBRATE of them fits the temperature instead.
SAMPLE, CALIBRATE = 800, 5
#: FTRL-proximal: learning rate and its smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-5, 1e-6, 3
#: The parts of the rows by CRC-32 of the id, and the part held out.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_P = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


#: Whether a code point below 0x10000 is a letter.
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of anything but letters become one blank, one at each end."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    blank = ~_LETTER[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF).tolist():
        blank[i] = not chr(points[i]).isalpha()
    keep = np.ones(len(points), bool)
    np.logical_and(blank[1:], blank[:-1], out=keep[1:])
    np.logical_not(keep[1:], out=keep[1:])
    points = np.where(blank, np.uint32(32), points)[keep]
    return points if len(points) > 1 else points[:0]


#: Code points that are turned into features at once.
BLOCK = 1 << 18


def term_counts(text: str) -> np.ndarray | None:
    """How often each hashed feature occurs in the whole text; None without letters."""
    points = letters(text)
    if not len(points):
        return None
    counts = np.zeros(1 << FEATURE_BITS, np.int64)
    for i in range(0, len(points), BLOCK):
        part = points[i : i + BLOCK + max(LENGTHS) - 1]
        hashes = []
        for n in LENGTHS:
            m = min(BLOCK, len(part) - n + 1)
            if m > 0:
                h = np.full(m, n, np.uint32)
                for k in range(n):
                    h = (h ^ (part[k : k + m] * _P[k])) * np.uint32(0x27D4EB2F)
                    h ^= h >> np.uint32(15)
                hashes.append(h >> np.uint32(32 - FEATURE_BITS))
        counts += np.bincount(np.concatenate(hashes), minlength=len(counts))
    return counts


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and values of the TF-IDF vector of unit length (logarithmic term frequencies)."""
    counts = term_counts(text)
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    size = np.sqrt((values * values).sum())
    return at, values / size if size else values


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``feature, df`` over all rows; -1 counts the rows with letters.  Each task sends one number a feature at most."""

    def run(batches):
        df, rows = np.zeros(1 << FEATURE_BITS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                counts = term_counts(t)
                if counts is not None:
                    df += counts > 0
                    rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([[rows], df[at]]))], names=["feature", "df"])

    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return text.mapInArrow(run, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df"))


def inverse_frequencies(frequencies: DataFrame) -> np.ndarray:
    found = frequencies.toArrow()  # 2**FEATURE_BITS + 1 rows at most
    at, df = found.column("feature").to_numpy(), found.column("df").to_numpy()
    rows = int(df[at < 0].sum())
    out = np.zeros(1 << FEATURE_BITS)
    out[at[at >= 0]] = df[at >= 0]
    return np.log((1.0 + rows) / (1.0 + out)) + 1.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], y: list[int], classes: int) -> np.ndarray:
    """Weights (features + bias, classes) of the multinomial model; rows are met in the given order, EPOCHS times."""
    size = (1 << FEATURE_BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at):
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for (at, values), label in zip(vectors, y):
            at, values = np.append(at, size - 1), np.append(values, 1.0)
            w = weights(at)
            miss = softmax(values @ w)
            miss[label] -= 1.0
            g = np.outer(values, miss)
            now = n[at] + g * g
            z[at] += g - (np.sqrt(now) - np.sqrt(n[at])) / ALPHA * w
            n[at] = now
    return weights(np.arange(size))


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(col: str) -> Column:
    """True where the CRC-32 of the id, as text, falls into the held-out fold; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, lang_pred, score``.

    The model learns from the texts and languages of rows that are not held
    out.  ``lang_pred`` is a learned language and ``score`` its calibrated
    probability; a null text or one without letters, and every text where
    nothing could be learned, is ``und`` with score 0.  Repeated rows get a
    row each, empty input none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learn = rows.where(~held_out("doc_id") & F.col("lang").isNotNull())
    idf = inverse_frequencies(document_frequencies(learn))

    # Of each language the rows of least number: a share by its count of rows, cut to ``sample`` before anything is collected.
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    share = lambda lang: F.lit(min(1.0, 1.2 * sample / sizes[lang]) * (1 << 30))
    picked = []
    if languages:
        near = F.lit(False)
        for lang in languages:
            near |= (F.col("lang") == lang) & (F.col("number") < share(lang))
        picked = sorted(_least(_vectors(_numbered(learn).where(near), idf), sample).collect(), key=lambda r: (r["number"], r["lang"], r["at"]))
    order = {lang: i for i, lang in enumerate(languages)}
    data = [((np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)), order[r["lang"]]) for r in picked]
    fit = [d for i, d in enumerate(data) if i % CALIBRATE]
    rest = [d for i, d in enumerate(data) if not i % CALIBRATE]
    w = fit_ftrl([v for v, _ in fit], [y for _, y in fit], max(1, len(languages)))
    scores = np.array([v @ w[at] + w[-1] for (at, v), _ in rest]).reshape(len(rest), max(1, len(languages)))
    temperature = fit_temperature(scores, np.array([y for _, y in rest], np.int64))
    sent = spark.sparkContext.broadcast((idf, w, temperature, languages))

    def run(batches):
        idf, w, temperature, languages = sent.value
        for b in batches:
            lang, score = [], []
            for t in b.column(2).to_pylist():
                v = vector(t, idf) if t and languages else None
                if v is None:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = softmax((v[1] @ w[v[0]] + w[-1]) / temperature)
                k = int(p.argmax())
                lang.append(languages[k])
                score.append(min(1.0, float(p[k])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, f"doc_id {type_of(rows, 'doc_id')}, held_out boolean, lang_pred string, score double")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``, a hash of id, text and the row's own number, so that neither null nor repeated ids share one."""
    return rows.withColumn("number", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 30)))


def _least(rows: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` rows of least ``number`` of each language: of each task first, then of what the tasks have left."""

    def run(batches):
        left: dict[str, pa.Table] = {}
        for b in batches:
            whole = pa.Table.from_batches([b])
            for lang in pc.unique(whole.column("lang")).to_pylist():
                more = whole.filter(pc.equal(whole.column("lang"), lang))
                both = pa.concat_tables([left[lang], more]) if lang in left else more
                left[lang] = both.sort_by("number").slice(0, sample).combine_chunks()
        for one in left.values():
            yield from one.to_batches(max_chunksize=1 << 10)

    near = rows.mapInArrow(run, rows.schema)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("number", "at"))
    return near.withColumn("place_", place).where(F.col("place_") <= sample).drop("place_")


def _vectors(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """``number, lang, at, value`` of the rows with letters, the vector as int32 and float32 bytes."""

    def run(batches):
        for b in batches:
            found = [vector(t, idf) for t in b.column(2).to_pylist()]
            keep = pa.array([v is not None for v in found])
            at = pa.array([v[0].astype(np.int32).tobytes() for v in found if v is not None], pa.binary())
            value = pa.array([v[1].astype(np.float32).tobytes() for v in found if v is not None], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), at, value], names=["number", "lang", "at", "value"])

    return rows.select("number", "lang", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "number long, lang string, at binary, value binary")
