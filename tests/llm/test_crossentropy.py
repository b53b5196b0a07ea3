"""Losses against counts in dictionaries."""

import math
from collections import Counter

import numpy as np

from floorloom.llm import crossentropy as C
from floorloom.llm import text


def test_against_dictionaries(spark):
    rows = [(1, "the cat sat on the mat"), (2, "The cat sat; the cat ran"), (3, "zebra quark zebra"), (4, ""), (5, None), (6, "cat"), (6, "cat"), (None, "the mat")]
    got = C.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,), (2,), (2,), (None,), (99,)], "doc_id long")).collect()
    words = lambda t: [w for w in (t or "").lower().replace(";", " ").split()]

    def model(texts):
        uni, pair = Counter(w for t in texts for w in words(t)), Counter(p for t in texts for p in zip(words(t), words(t)[1:]))
        total = sum(uni.values()) + C.FLOOR * (1 << C.WORD_BITS)

        def loss(t):
            ws = words(t)
            out = 0.0
            for k, w in enumerate(ws):
                p = (uni[w] + C.FLOOR) / total
                if k:
                    p = (pair[ws[k - 1], w] + C.PULL * p) / (uni[ws[k - 1]] + C.PULL)
                out -= math.log(p)
            return out / len(ws)

        return loss

    target, background = model([rows[0][1], rows[1][1]]), model([t for _, t in rows])
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        if not words(text):
            assert (r["n_tokens"], r["target_loss"], r["score"]) == (0, None, 0.0)
        else:
            assert math.isclose(r["target_loss"], target(text), rel_tol=1e-5) and math.isclose(r["background_loss"], background(text), rel_tol=1e-5)
            assert math.isclose(r["score"], r["target_loss"] - r["background_loss"], abs_tol=1e-9)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[1] < score[3]


def test_no_documents_and_no_targets(spark):
    none = spark.createDataFrame([], "doc_id long")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert C.score(docs, none).first()["n_tokens"] == 2
    assert C.score(docs.limit(0), none).count() == 0


def test_more_pairs_than_any_fixed_table(spark, monkeypatch):
    """Counts stay those of each word and pair: an unseen pair never has the count of others."""
    monkeypatch.setattr(C, "BLOCK", 1 << 20)
    monkeypatch.setattr(C, "SHARD", 1 << 20)
    monkeypatch.setattr(text, "SLICE", 1 << 18)
    n = 2_000_000
    rows = [(k, " ".join(f"{x:x}" for x in np.random.default_rng(k).integers(0, 1 << 40, n // 20))) for k in range(20)]
    rows += [(20 + k, f"u{k} v{k}") for k in range(200)]
    got = {r["doc_id"]: r for r in C.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(0,)], "doc_id long")).collect()}
    assert len(got) == len(rows) and sum(r["n_tokens"] for r in got.values()) == n + 400
    words = Counter(w for _, t in rows for w in t.split())
    total = sum(words.values()) + C.FLOOR * max(1 << C.WORD_BITS, len(words))
    first = (1 + C.FLOOR) / total
    want = -(math.log(first) + math.log((1 + C.PULL * first) / (1 + C.PULL))) / 2
    assert all(math.isclose(got[20 + k]["background_loss"], want, rel_tol=1e-9) for k in range(200))
