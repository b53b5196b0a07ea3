"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, adjacent pairs and pairs with one word between them of the whole text,
hashed into ``2**bits`` coordinates.  Training visits a bounded sample of labelled rows (``max_rows``, taken
by a hash of the id) in one task: FTRL-proximal keeps a learning rate per coordinate and its L1 term leaves
most weights at exactly zero, so the model is a short list that is broadcast.  It never has more than
``2**bits`` entries.  Scoring is one map pass over all rows.

Nulls and texts without words have no features and get the score of the bias.  Rows whose label or id is
null are not trained on; of rows with one id the smallest text is.  Repeated rows get equal scores.  Very long texts are
scored whole.  Without any labelled row every score is 0.5
(no bias is learnt), and the rows are still returned.  Other columns of the input are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorloom.llm import text
from floorloom.llm.local import lean
from floorloom.plans.sampling import sampled

BITS = 20
MAX_ROWS = 16384
#: Rate of a coordinate: ALPHA / (BETA + sqrt(sum of squared gradients)); L1 and L2 penalties; passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 4.0, 1.0, 4.0, 0.1, 8
THRESHOLD = 0.3
_PAIR, _SKIP, _WORD = 0x51ED270B, 0x2545F491, 0x9E3779B9


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every feature occurrence of a slice."""
    words = text.Words(data, off, text.ALNUM)
    h = words.hashes()
    rows, at = [], []
    for steps, salt in (((0,), _WORD), ((0, 1), _PAIR), ((0, 2), _SKIP)):
        where = words.runs(steps[-1] + 1)
        rows.append(words.doc[where])
        at.append((text.together(h, where, steps, salt) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(at)


def train(texts: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero coordinates, their weights and the bias, from lists of distinct coordinates per row."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = bias_n = 0.0
    if len(labels):
        rate = min(max(float(np.mean(labels)), 1e-3), 1 - 1e-3)
        bias = float(np.log(rate / (1 - rate)))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(labels)):
            at = texts[i]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            g = 1.0 / (1.0 + np.exp(-min(max(bias + w.sum(), -35.0), 35.0))) - labels[i]
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - root) / alpha * w
            n[at] = grown
            bias_n += g * g
            bias -= 0.1 * alpha / (beta + bias_n**0.5) * g
    keep = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[keep]) * l1 - z[keep]) / ((beta + np.sqrt(n[keep])) / alpha + l2)
    return keep, w, bias


def fit(documents: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learnt from (doc_id, toxic) rows of ``labels``; at most ``max_rows`` of them, chosen by hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    chosen = sampled(known, max_rows, known.count(), "doc_id")
    # max_rows rows of 16 bytes: a proven bound, so the sample may be broadcast.
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One row per id, so that a repeated id does not exceed the bound.
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.text", "r.y", F.lit(1).alias("one"))

    def learn(table: pa.Table) -> pa.Table:
        # Large: together the texts may exceed the offsets of a string column.
        table = table.set_column(table.schema.get_field_index("text"), "text", table.column("text").cast(pa.large_string())).sort_by("doc_id")
        y = table.column("y").to_numpy()
        data, off = text.buffers(table.column("text"))
        del table
        coords = []
        for lo, hi, part, cut in text.slices(data, off):
            rows, at = features(part, cut, bits)
            pairs = np.unique(rows << bits | at)
            # All coordinates are held at once, in half the bytes.
            coords += np.split((pairs & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(pairs >> bits, np.arange(1, hi - lo)))
        at, w, bias = train(coords, y, bits)
        return pa.table({"at": np.append(at, -1), "w": np.append(w, bias)})

    model = sample.groupBy("one").applyInArrow(lean(learn), "at long, w double").toPandas()  # at most 2**bits + 1 rows
    at, w = model["at"].to_numpy(np.int64), model["w"].to_numpy(np.float64)
    bias = w[at < 0]
    return at[at >= 0], w[at >= 0], float(bias[0]) if len(bias) else 0.0


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """All rows and columns of ``documents`` and a column toxicity, 0 to 1."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(tuple(model))
    name = "toxicity"
    rest = documents.drop(name)
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        weights = np.zeros(1 << bits)
        weights[at] = w
        used = weights != 0
        for batch in batches:
            data, off = text.buffers(batch.column("text"))
            total = np.full(batch.num_rows, bias)
            for lo, hi, part, cut in text.slices(data, off):
                rows, where = features(part, cut, bits)
                hit = used[where]
                pairs = np.unique(rows[hit] << bits | where[hit])
                total[lo:hi] += np.bincount(pairs >> bits, weights[pairs & ((1 << bits) - 1)], hi - lo)
            out = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return rest.mapInArrow(lean(run), schema)
