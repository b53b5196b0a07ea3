"""The classifier: held-out accuracy and odd inputs."""

import math
import zlib

import numpy as np

from floorloom.llm import queries, text, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = queries.op9_toxicity_ftrl(spark, SF).join(queries.table(spark, SF, "labels").select("doc_id", "toxic"), "doc_id").toPandas()
    assert (scored["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored["doc_id"]]).all()
    out = scored[scored["held_out"]]
    y, s = out["toxic"].to_numpy() == 1, out["score"].to_numpy()
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable")
    auc = (order[y].mean() - (y.sum() - 1) / 2) / (~y).sum()
    hit = s >= toxicity.THRESHOLD
    assert auc > 0.93 and (hit & y).sum() / hit.sum() > 0.9 and (hit & y).sum() / y.sum() > 0.7


def test_odd_rows(spark):
    docs = spark.createDataFrame([(k, "you are an idiot " * (1 + k % 3) if k % 2 else f"nice words number{k % 7} here", "s") for k in range(80)] + [(100, None, "s"), (101, "", None), (102, "... !!", "s"), (None, "idiot", "s"), (1, "idiot again", "s")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (100, None), (101, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 85 and all(0 <= r["toxicity"] <= 1 for r in rows)
    by = {r["doc_id"]: r["toxicity"] for r in rows}
    assert by[3] > 0.5 > by[2] and by[100] == by[101] == by[102]
    assert len(model[0]) < 200


def plain(texts, labels, bits, epochs, seed=7):
    """FTRL-proximal one coordinate at a time, in dictionaries."""
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = {}, {}
    rate = min(max(sum(labels) / len(labels), 1e-3), 1 - 1e-3)
    bias, bias_n, order = math.log(rate / (1 - rate)), 0.0, np.random.default_rng(seed)

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((b + math.sqrt(ni)) / a + l2)

    for _ in range(epochs):
        for k in order.permutation(len(labels)):
            w = {int(i): weight(int(i)) for i in texts[k]}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - labels[k]
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / a * wi
                n[i] = old + g * g
            bias_n += g * g
            bias -= 0.1 * a / (b + math.sqrt(bias_n)) * g
    return {i: weight(i) for i in z if abs(z[i]) > l1}, bias


def test_training_against_a_plain_loop():
    r = np.random.default_rng(0)
    labels = r.integers(0, 2, 120).astype(float)
    texts = [np.unique(np.append(r.integers(0, 200, 12), 201 if y else 202)) for y in labels]
    at, w, bias = toxicity.train(texts, labels, bits=8, epochs=4)
    want, want_bias = plain(texts, labels, 8, 4)
    assert at.tolist() == sorted(want) and np.allclose(w, [want[i] for i in sorted(want)]) and abs(bias - want_bias) < 1e-9 and {201, 202} <= set(want)


def test_repeated_ids_do_not_exceed_the_sample(spark):
    docs = spark.createDataFrame([(1, f"idiot {k}") for k in range(500)] + [(2, "nice words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    again = docs.where("text < 'idiot 1' OR doc_id = 2")  # the smallest text of each id
    assert [x.tolist() if hasattr(x, "tolist") else x for x in toxicity.fit(docs, labels)] == [x.tolist() if hasattr(x, "tolist") else x for x in toxicity.fit(again, labels)]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).first()["toxicity"] == 0.5
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_words_never_cross_rows():
    data, off = np.frombuffer(b"ab cdef g", np.uint8), np.array([0, 4, 4, 9])
    words = text.Words(data, off, text.ALNUM)
    assert words.count.tolist() == [2, 0, 2]
    assert [bytes(data[a:b]) for a, b in zip(words.starts, words.ends)] == [b"ab", b"c", b"def", b"g"]
    assert words.hashes()[0] == text.Words(np.frombuffer(b"x AB", np.uint8), np.array([0, 4]), text.ALNUM).hashes()[1]
