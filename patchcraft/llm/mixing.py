"""Mixing sources to target weights by entropy balancing.

Of all rates that give each source its target of tokens, the ones nearest to
keeping every document once (least relative entropy, no rate over ``most``) are
exponentially tilted in a document's size: min(most, exp(tilt * size)), with
one tilt a source.  The tilts solve the convex dual, here by Newton iterations
over all sources at once; each is one aggregation of the sizes' histogram by
source, joined with the tilts so far.  A step that leaves the interval known to
hold the solution halves that interval instead.

Rates become whole copies size by size, largest first, each size making up for
what those before it took too much or too little; what is left over at the end
changes a few documents by one copy more, so a source ends within about half of
its smallest documents' size of its target.  Documents of one size differ by
one copy at most; those with the least hashes get the larger number.

All sums are of decimals, exact in any order, so a rerun gives the same rates.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, type_of, written
from .ranks import numbered

#: A source's tokens match its target to this part of it before rounding.
CLOSE = 1e-9
#: Newton steps at most; the halved intervals end at a double's precision long before.
STEPS = 100

_SUM = "decimal(38, 9)"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sources(source_key, source_size)`` with ``target`` (double).

    Sources in the order of their keys weigh ``weights``, repeating, and share
    all sizes by weight; none gets over ``most`` times its size, and what it
    cannot take goes to the others by weight until none is above.  Each round
    finds the level (tokens for a unit of weight) of the sources still below
    their bound; two sums a round reach the driver.
    """
    placed = written(numbered(sources.withColumn("all", F.lit("")), ["all"], ["source_key"]).drop("all", "n"), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    placed = placed.select("source_key", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("bound"))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at = placed.select("bound", "weight", (F.col("bound") <= F.lit(level) * F.col("weight")).alias("at_bound")).agg(
            F.sum(F.when(F.col("at_bound"), F.col("bound"))), F.sum(F.when(~F.col("at_bound"), F.col("weight"))), F.count_if("at_bound")
        ).first()
        if at[2] == full or not at[1]:
            break
        level, full = (total - (at[0] or 0)) / at[1], at[2]
    share = F.least(F.col("bound").cast("double"), F.lit(float(level)) * F.col("weight"))
    return placed.select("source_key", "source_size", share.alias("target"))


def _exact(c: Column) -> Column:
    return F.sum(c.cast(_SUM)).cast("double")


def tilts(sizes: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """``source_key, tilt`` from ``sizes(source_key, size, n)`` and ``wanted(source_key, target)``; sizes are above zero.

    Tokens grow with the tilt, from none far below zero to ``most`` times the
    source's size, so there is one solution.  Newton's step is taken on the
    logarithm of the tokens; sizes are counted in the source's mean size.
    """
    log_most = math.log(most)
    bounds = sizes.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"), F.sum("n").alias("docs"), F.min("size").alias("least"))
    unit = F.col("tokens") / F.col("docs")
    # No x * exp(-t * x) is over 1 / (e * t): below -docs * unit / (e * target) the tokens fall short.
    state = wanted.join(bounds, "source_key").select(
        "source_key", "target", unit.alias("unit"), F.lit(0.0).alias("tilt"), F.lit(False).alias("done"),
        (-F.col("tokens") / (math.e * F.col("target"))).alias("low"), (F.lit(log_most) * unit / F.col("least")).alias("high"),
    )
    state = written(state, "tilts")
    for _ in range(STEPS):
        open_ = state.where("NOT done").select("source_key", "unit", "tilt")
        x = F.col("size") / F.col("unit")
        power = F.col("tilt") * x
        taken = F.col("n") * x * F.exp(F.least(power, F.lit(log_most)))
        slope = F.when(power < log_most, taken * x).otherwise(0.0)
        sums = sizes.join(open_, "source_key").groupBy("source_key").agg(_exact(taken).alias("taken"), _exact(slope).alias("slope"))
        goal = F.col("target") / F.col("unit")
        short = F.col("taken") < goal
        low, high = F.when(short, F.col("tilt")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") + F.when(F.col("slope") > 0, (F.log(goal) - F.log("taken")) * F.col("taken") / F.col("slope"))
        moved = state.join(sums, "source_key", "left").select(
            "source_key", "target", "unit", "tilt", "done", low.alias("low"), high.alias("high"), step.alias("step"),
            (F.abs(F.col("taken") - goal) <= F.lit(CLOSE) * goal).alias("near"),
        )
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        middle = (F.col("low") + F.col("high")) / 2
        # An interval without a double between its ends: the tokens jump there (or their sum ends in its last digit), and the upper end is taken.
        spent = (middle <= F.col("low")) | (middle >= F.col("high"))
        now = F.when(F.col("done") | F.col("near"), F.col("tilt")).when(spent, F.col("high")).when(inside, F.col("step")).otherwise(middle)
        state = written(moved.select("source_key", "target", "unit", now.alias("tilt"), (F.col("done") | F.col("near") | spent).alias("done"), "low", "high"), "tilts")
        if state.where("NOT done").isEmpty():
            break
    return state.select("source_key", (F.col("tilt") / F.col("unit")).alias("tilt"))


def whole_copies(rows: list[tuple[int, int, float]], target: float, most: int) -> list[int]:
    """Copies in all of each (size, documents, rate), sizes descending, adding up to about ``target`` tokens.

    A document first gets its rate rounded down or up, each size making up for
    those before it.  What is then still missing or over goes to the largest
    sizes that fit, a copy more or less for a document.
    """
    wanted = taken = 0.0
    total = sum(size * n * rate for size, n, rate in rows)
    scale = target / total if total else 1.0  # the last digits of the solution
    copies = []
    for size, n, rate in rows:
        wanted += size * n * rate * scale
        near = math.floor((wanted - taken) / size + 0.5)
        copies.append(min(n * math.ceil(rate), max(n * math.floor(rate), near)))
        taken += copies[-1] * size
    for i, (size, n, _) in enumerate(rows):
        off = math.floor((target - taken) / size + 0.5)
        change = min(n, most * n - copies[i], max(-n, -copies[i], off))
        copies[i] += change
        taken += change * size
    return copies


def _copies_of(source: pa.Table, most: int) -> pa.Table:
    source = source.sort_by([("size", "descending")])
    rows = list(zip(source["size"].to_pylist(), source["n"].to_pylist(), source["rate"].to_pylist(), strict=True))
    copies = pa.array(whole_copies(rows, source["target"][0].as_py(), most), pa.int64())
    return pa.table({"source_key": source["source_key"], "size": source["size"], "docs": source["n"], "rate": source["rate"], "copies": copies})


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` for each document.

    ``size`` is the number of words, ``rate`` the tilted rate, ``copies`` the
    whole number of times that the mix takes the document (0 to ``most``),
    ``taken`` copies times size.

    A null source is a source of its own, after all others.  Null, empty and
    blank texts have size 0: they are kept at rate 1, once, and take no words;
    a source of nothing else has target 0.  A very long text is one document
    among the others.  Rows with the same id, or none, count one by one; which
    of equal rows gets the larger number of copies is open, how many do is
    not.  Other columns play no part, whatever their names.  An empty table
    gives no rows.

    What meets in one task is a source's histogram of sizes, which has at most
    sqrt(2 * words) rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"), key.alias("source_key"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"), F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    sizes = written(rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = sizes.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted = written(targets(sources, weights, most), "targets")

    worded = sizes.where("size > 0")
    rated = worded.join(tilts(worded, wanted.where("target > 0"), most), "source_key").join(wanted, "source_key")
    rate = F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(most))))
    copies = (
        rated.select("source_key", "size", "n", "target", rate.alias("rate"))
        .groupBy("source_key")
        .applyInArrow(lambda source: _copies_of(source, most), "source_key string, size long, docs long, rate double, copies long")
    )
    copies = written(copies, "copies")

    placed = numbered(rows, ["source_key", "size"], ["draw", "doc_id", "row"]).join(copies, ["source_key", "size"], "left").join(wanted, "source_key")
    each, more = F.floor(F.col("copies") / F.col("docs")), F.col("copies") % F.col("docs")
    own = F.coalesce(each + (F.col("pos") < more).cast("long"), F.lit(1))
    source = F.when(F.col("source_key") != "~", F.substr("source_key", F.lit(2))).cast(type_of(docs, source_col))
    return placed.select(
        "doc_id", source.alias("source"), "size", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate"),
        own.cast("int").alias("copies"), (own * F.col("size")).cast("long").alias("taken"),
    )
