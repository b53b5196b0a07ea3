"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the copies of it that the mix expects.  Rates stay as close to one as possible (relative
entropy against uniform weights over documents, each rate at most ``most``) while the words of every source add up to
its target.  The convex dual has one multiplier per source and separates by source; its solution tilts documents
exponentially by length: ``rate = min(most, exp(multiplier * words / mean words))``.  Newton iterations solve all
sources' duals at once on the cluster: a round sums gradient and curvature of every source over a histogram (source, words,
documents), written once, and sends the next multipliers to all tasks.  No task holds a source.

Rates become copies by order sampling: a document has its rate's whole part for certain, and documents are given one
more in the order of ``u / fraction`` (u: a hash of the id) until the source's target is reached; inclusion
follows the fractions, reruns agree, and no random state is kept.  The cut is found in a histogram of that order, coarse bins
first and then the fine ones of the coarse bin at the cut: at most ``COARSE + 1`` rows of a source are ordered at once, and of
its documents only those in one of ``COARSE ** 2`` bins.  The document at the cut gives a part of a copy, so that the source meets its
target to the word.  Every document's words taken are at most ``most`` times its size.

Null or empty texts have size 0 and are taken 0 times.  Sources are ordered by code point, null last, and null is a
source of its own.  Targets above ``most`` times the size of their source stop there, the excess reshared by weight until
none is above; if all stop, the mix is smaller than the input's total share.  Rows with equal ids tie in the order; ties at
the cut share what is left in proportion.  Very long texts only count; an empty table gives an empty result.  Other columns are carried along
whatever their names, those with the names of results are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from floorloom.plans.recovery import settled

WEIGHTS, MOST = (5, 2, 1), 3
#: Bins of the order in each of two steps, as a power of two.
STEP = 10
COARSE = 1 << STEP
#: Sources up to which their plan is sent to all tasks; beyond, it is joined by key.
FEW = 4096


def words(column):
    """Number of ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float = MOST) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size, the excess reshared among the rest."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, full = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    while not full.all():
        left = max(0.0, total - (most * sizes[full]).sum())
        out[~full] = left * weights[~full] / weights[~full].sum()
        over = ~full & (out > most * sizes)
        if not over.any():
            break
        full |= over
        out[full] = most * sizes[full]
    return out


def multipliers(histogram: DataFrame, sources: pd.DataFrame, most: float = MOST, rounds: int = 200) -> np.ndarray:
    """Roots of the dual's gradient, words at the tilted rates minus the target, of all sources: Newton steps with bisection as guard.

    A round sums gradient and curvature of every source over the rows (_key, size, n) of ``histogram``, map-side first, and sends
    the next multipliers to all.  ``sources`` has _key, words, n and target.  Infinite where every rate is ``most`` or 0.  Words are summed
    as decimals, so that reruns agree whatever the order.
    """
    spark, cap = histogram.sparkSession, float(np.log(most))
    words, goal = sources["words"].to_numpy(float), sources["target"].to_numpy(float)
    mean = np.where(words > 0, words / np.maximum(1, sources["n"].to_numpy(float)), 1.0)
    at, low, high = np.zeros(len(words)), np.full(len(words), -np.inf), np.full(len(words), np.inf)
    at[goal >= most * words * (1 - 1e-12)] = np.inf
    at[goal <= 0] = -np.inf
    todo = np.isfinite(at)
    place = {k: i for i, k in enumerate(sources["_key"])}
    for _ in range(rounds):
        if not todo.any():
            break
        state = spark.createDataFrame([(k, float(at[i]), float(mean[i])) for k, i in place.items() if todo[i]], "_k string, _at double, _mean double")
        x = F.col("size") / F.col("_mean")
        tilt = F.exp(F.least(F.col("_at") * x, F.lit(cap)))
        weight = F.col("size") * F.col("n")
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        found = histogram.join(spread(state, len(words)), F.col("_key") == F.col("_k")).groupBy("_key").agg(
            exact(weight * tilt).alias("sum"), exact(F.when(F.col("_at") * x < cap, weight * x * tilt).otherwise(0.0)).alias("slope"))
        for r in found.collect():  # one row per source
            i = place[r["_key"]]
            off = r["sum"] - goal[i]
            if abs(off) <= 1e-9 * goal[i] + 1e-6:
                todo[i] = False
                continue
            low[i], high[i] = (at[i], high[i]) if off < 0 else (low[i], at[i])
            step = at[i] - off / r["slope"] if r["slope"] > 0 else np.nan
            if low[i] < step < high[i]:
                at[i] = step
            elif np.isfinite(low[i]) and np.isfinite(high[i]):
                at[i] = (low[i] + high[i]) / 2
            else:
                at[i] = 2 * at[i] + (1 if off < 0 else -1)
    return at


def spread(plan: DataFrame, sources: int) -> DataFrame:
    """A table of one row per source, broadcast if there are few of them."""
    return F.broadcast(plan) if sources <= FEW else plan


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """Rows of ``documents`` (needs doc_id, text, source) with size, source_size, target, rate, copies and taken.

    ``weights`` repeat over the ordered sources; the mix has ``share`` of all words.  ``copies`` are whole copies,
    ``taken`` the words with the part at the cut.
    """
    spark = documents.sparkSession
    made = ("size", "source_size", "target", "rate", "copies", "taken")
    rest = documents.drop(*made)
    # Carried columns go by their number, so that no name of theirs meets one of these.
    aside = [f"_column{k}" for k in range(len(rest.columns))]
    back = [F.col(a).alias(c) for a, c in zip(aside, rest.columns)]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))  # null sorts last and differs from every source
    unit = (F.xxhash64(F.col("doc_id").cast("string"), F.lit(97)).bitwiseAND(F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    rows = rest.select(*(F.col(c).alias(a) for a, c in zip(aside, rest.columns)), key.alias("_key"), words(F.col("text")).alias("size"), unit.alias("_unit"))
    # What decides, without the texts: three numbers a row, so that the texts are read for them once, and once more for the result.
    narrow = settled(rows.select("_key", "size", "_unit"))
    histogram = settled(narrow.groupBy("_key", "size").agg(F.count(F.lit(1)).alias("n")))
    # One row per source: the list of sources is the configuration of the mix, not its data.
    sources = histogram.groupBy("_key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).toPandas()
    sources = sources.sort_values("_key", key=lambda k: k.map(lambda x: [ord(c) for c in x])).reset_index(drop=True)
    sizes = sources["words"].to_numpy(float)
    weigh = np.array([weights[i % len(weights)] for i in range(len(sources))], float)
    sources["target"] = targets(sizes, weigh, share * sizes.sum(), most) if len(sources) else np.zeros(0)
    plan = spark.createDataFrame(
        [(k, int(s), float(t), float(a), s / n if s else 1.0) for (k, s, n, t), a in zip(sources[["_key", "words", "n", "target"]].itertuples(index=False), multipliers(histogram, sources, most))],
        "_key string, source_size long, target double, _at double, _mean double",
    )
    hint = lambda df: spread(df, len(sources))
    tilted = F.when(F.col("size") == 0, 0.0).when(F.col("_at") == float("inf"), float(most)).when(F.col("_at") == float("-inf"), 0.0)
    tilted = tilted.otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("_at") * F.col("size") / F.col("_mean"), F.lit(float(np.log(most)))))))

    def rated(part: DataFrame) -> DataFrame:
        return (
            part.join(hint(plan), "_key").withColumn("rate", tilted)
            .withColumns({"copies": F.floor("rate").cast("long"), "_part": F.col("rate") - F.floor("rate")})
            .withColumn("_order", F.when((F.col("_part") > 1e-12) & (F.col("size") > 0), F.col("_unit") / F.col("_part")))
            # u / fraction is mostly below 1, with a tail; this brings it into 0..1 and keeps the order.
            .withColumn("_bin", F.floor(F.col("_order") / (1 + F.col("_order")) * (COARSE * COARSE)).cast("long"))
        )

    numbers = rated(narrow)
    ordered = W.Window.partitionBy("_key").orderBy("_place").rowsBetween(W.Window.unboundedPreceding, -1)

    def passed(bins: DataFrame) -> DataFrame:
        """The place of every source at which the sum of the steps passes what is left, beyond all if it never does, and the sum before it."""
        step = F.when(F.col("_place").isNotNull(), F.col("step"))
        bins = bins.withColumn("_sum", F.col("_before") + F.coalesce(F.sum(step).over(ordered), F.lit(0)))
        at = F.max(F.when(F.col("_place").isNotNull() & (F.col("_sum") <= F.col("_left")), F.struct("_place", "_sum")))
        found = bins.groupBy("_key").agg(F.max("_left").alias("_left"), at.alias("_at"))
        return found.select("_key", "_left", F.col("_at._place").alias("_cut"), F.coalesce(F.col("_at._sum"), F.lit(0).cast("long")).alias("_before"))

    # Words that whole copies leave, and the coarse bins, summed map-side.
    bins = numbers.groupBy("_key", F.shiftright("_bin", STEP).alias("_place")).agg(F.sum(F.col("copies") * F.col("size")).alias("base"), F.sum("size").alias("step"), F.first("target").alias("target"))
    left = F.round("target").cast("long") - F.sum("base").over(W.Window.partitionBy("_key"))
    coarse = settled(passed(bins.withColumns({"_left": left, "_before": F.lit(0).cast("long")})))
    # The fine bins of the coarse one at the cut.
    fine = numbers.join(hint(coarse), "_key").where(F.shiftright("_bin", STEP) == F.col("_cut"))
    fine = fine.groupBy("_key", F.col("_bin").alias("_place")).agg(F.sum("size").alias("step"), F.first("_left").alias("_left"), F.first("_before").alias("_before"))
    cut = settled(coarse.select("_key", "_left").join(hint(passed(fine).drop("_left")), "_key", "left"))
    inside = numbers.join(hint(cut), "_key").where(F.col("_bin") == F.col("_cut"))
    ranked = inside.groupBy("_key", "_order").agg(F.sum("size").alias("step"), F.first("_left").alias("_left"), F.first("_before").alias("_before"))
    ranked = ranked.withColumn("_sum", F.col("_before") + F.coalesce(F.sum("step").over(W.Window.partitionBy("_key").orderBy("_order").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    # The last value of the order that still gets words, and how many of its step.
    last = ranked.where(F.col("_sum") < F.col("_left")).groupBy("_key").agg(F.max(F.struct("_order", F.least("step", F.col("_left") - F.col("_sum")).alias("give"), "step")).alias("_last"))
    out = rated(rows).join(hint(cut), "_key").join(hint(settled(last)), "_key", "left")
    edge = F.col("_last._order")
    more = (
        F.when(F.col("_bin").isNull() | F.col("_cut").isNull(), 0)
        .when(F.col("_bin") < F.col("_cut"), F.col("size"))
        .when((F.col("_bin") == F.col("_cut")) & (F.col("_order") < edge), F.col("size"))
        .when((F.col("_bin") == F.col("_cut")) & (F.col("_order") == edge), F.floor(F.col("_last.give") * F.col("size") / F.col("_last.step")))
        .otherwise(0)
    )
    out = out.withColumn("_more", F.when(F.col("size") > 0, more).otherwise(0).cast("long"))
    out = out.withColumns({"taken": F.col("copies") * F.col("size") + F.col("_more"), "copies": F.col("copies") + (F.col("_more") == F.col("size")).cast("long") * (F.col("size") > 0).cast("long")})
    return out.select(*back, *made)
