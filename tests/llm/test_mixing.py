"""Source mixing: targets, the dual and the rounding."""

import numpy as np
from pyspark.sql import functions as F

from floorloom.llm import mixing


def test_targets_are_reshared():
    assert mixing.targets([100, 10, 10], [1, 1, 1], 120).tolist() == [60, 30, 30]
    assert mixing.targets([10, 10], [5, 2], 100).tolist() == [30, 30]
    assert mixing.targets([0, 10], [5, 2], 10).tolist() == [0, 10]
    assert mixing.targets([], [], 0).tolist() == []


def root(size, goal, most=3):
    """The multiplier of one source, by bisection over its documents."""
    low, high = -1e4, 1e4
    for _ in range(300):
        at = (low + high) / 2
        low, high = (at, high) if (size * np.exp(np.minimum(at * size / size.mean(), np.log(most)))).sum() < goal else (low, at)
    return at


def test_rates_are_those_of_the_dual(spark):
    """All rates against bisection on the documents of each source, tight and loose targets."""
    df = documents(spark)
    out = mixing.mix(df, weights=(9, 1, 2, 0.001)).toPandas()
    some = 0
    for _, group in out.groupby(out["source"].fillna("~")):
        size, goal = group["size"].to_numpy(float), group["target"].iloc[0]
        if goal >= 3 * size.sum() * (1 - 1e-9):
            assert (group["rate"][size > 0] == 3).all()
        elif goal > 0:
            at = root(size, goal)
            want = np.where(size > 0, np.minimum(3, np.exp(np.minimum(at * size / size.mean(), np.log(3)))), 0)
            assert np.allclose(group["rate"], want, rtol=1e-6, atol=1e-9)
            some += 1
    assert some >= 3


def documents(spark, n=400):
    r = np.random.default_rng(5)
    rows = [(int(i), " ".join(["w"] * int(r.integers(1, 80))), str(r.choice(["a", "b", "c", "hot", "hot", "hot"]))) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, "x y z", None), (n + 3, "x " * 900, "b"), (n + 4, "only", "zz"), (n + 4, "only", "zz"), (None, "p q", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_sources_meet_their_targets(spark):
    df = documents(spark)
    out = mixing.mix(df).toPandas()
    assert len(out) == df.count()
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] >= 0).all()
    per = out.groupby(out["source"].fillna("~"), dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), said=("source_size", "first"))
    assert (per["size"] == per["said"]).all()
    assert ((per["taken"] - per["target"]).abs() <= 2).all()
    want = mixing.targets(per["size"], [mixing.WEIGHTS[i % 3] for i in range(len(per))], per["size"].sum())
    assert np.allclose(per["target"], want)
    parts = out[(out["size"] > 0) & (out["taken"] % out["size"].clip(lower=1) != 0)]
    assert len(parts) <= len(per) + 1  # whole copies but for the one at each cut


def test_words_are_those_of_the_order(spark):
    """All words taken against a plain walk along each source's order; the cut also falls into coarse bins with several fine ones."""
    df = documents(spark, 3000)
    unit = (F.xxhash64(F.col("doc_id").cast("string"), F.lit(97)).bitwiseAND(F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    out = mixing.mix(df).withColumn("unit", unit).toPandas()
    for _, group in out.groupby(out["source"].fillna("~")):
        whole = np.floor(group["rate"]).astype(int)
        part = group["rate"] - whole
        left = round(group["target"].iloc[0]) - (whole * group["size"]).sum()
        want = whole * group["size"]
        open_ = group[(part > 1e-12) & (group["size"] > 0)]
        order = open_["unit"] / part[open_.index]
        for at in np.sort(order.unique()):
            tied = open_[order == at]
            give = min(left, tied["size"].sum())
            if give <= 0:
                break
            want[tied.index] += give * tied["size"] // tied["size"].sum()
            left -= give
        assert (want == group["taken"]).all()


def test_reruns_agree(spark):
    a, b = (sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(documents(spark).repartition(k)).collect()) for k in (1, 5))
    assert a == b


def test_empty_table_and_clashing_names(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    df = spark.createDataFrame([(1, "a b", "s", "x", 5, "k", "o")], "doc_id long, text string, source string, size string, weight int, _key string, _order string")
    row = mixing.mix(df).first()
    assert row["size"] == 2 and row["weight"] == 5 and row["taken"] == 2 and row["_key"] == "k" and row["_order"] == "o"
