"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``size`` consecutive words of a benchmark item (the whole item if it is shorter).  All its words must occur, so
the necessary prefix in the order of rarity is one word: the window's rarest, by counts over all documents.  Documents are
probed with these words only.  A probe must respect position and length (the window's start and end lie in the document); its
words are then compared one by one by their hashes, rarest first, and what is left by the words themselves.  Every word inside an
occurrence is hit.

The documents are read twice, once to count the benchmark's words and once to probe, and never shuffled.  The benchmark goes to
the executors in blocks of about ``block_words`` words (one item at least); each block is fetched, indexed and broadcast by itself,
and a task holds one block at a time, so its size does not bound what can be checked.  The driver holds one block at a time as well.

Null texts have no words.  Items without words have no windows.  A null item id reads as the empty text.  Equal windows of several items count for each
of them, repeated rows are judged alike.  With an empty benchmark nothing is hit.  Very long texts
are cut into no pieces and judged whole.  Columns with the names of results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorloom.llm import text
from floorloom.llm.local import lean

SIZE = 13
BLOCK_WORDS = 1 << 18
_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows(items: list[tuple[str, str | None]], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct windows as rows of word hashes (0-padded), their lengths, the pairs (window, item row) that have them, and their words."""
    data, off = text.buffers(pa.array([t for _, t in items], pa.large_string()))
    words = text.Words(data, off, text.ALNUM)
    h = words.hashes()
    full = words.runs(size)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    start = np.concatenate([full, words.first[short]])
    length = np.concatenate([np.full(len(full), size), words.count[short]]).astype(np.int64)
    at = start[:, None] + np.arange(size)
    rows = np.where(np.arange(size) < length[:, None], h[np.minimum(at, max(0, len(h) - 1))] if len(h) else np.zeros(at.shape, np.uint64), np.uint64(0))
    raw, place = words.spaced()
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(raw[place[a] : place[a + n] - 1], len(known)) for a, n in zip(start, length)], np.int64)
    first = np.unique(which, return_index=True)[1]
    pairs = np.unique(np.column_stack([which, words.doc[start]]), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
    return rows[first], length[first], pairs[:, 0], pairs[:, 1], list(known)


class Index:
    """Windows by their rarest word."""

    def __init__(self, items: list[tuple[str, str | None]], counts: dict[int, int], size: int = SIZE):
        self.names = [name for name, _ in items]
        rows, length, self.pair_window, self.pair_item, spelled = windows(items, size)
        rare = np.array([[counts.get(int(x), 0) for x in r] for r in rows], dtype=np.float64).reshape(rows.shape)
        rare[np.arange(rows.shape[1]) >= length[:, None]] = np.inf
        order = np.argsort(rare, axis=1, kind="stable")  # places of a window's words, rarest first
        probe = rows[np.arange(len(rows)), order[:, 0]] if len(rows) else np.zeros(0, np.uint64)
        by = np.argsort(probe, kind="stable")
        self.rows, self.length, self.order, self.spelled = rows[by], length[by], order[by], [spelled[k] for k in by]
        new = np.empty_like(by)
        new[by] = np.arange(len(by))
        self.pair_window = new[self.pair_window]
        sort = np.argsort(self.pair_window, kind="stable")
        self.pair_window, self.pair_item = self.pair_window[sort], self.pair_item[sort]
        self.keys, self.at = np.unique(probe[by], return_index=True)
        self.at = np.append(self.at, len(by))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def find(self, words: text.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start word and window of every occurrence in a slice."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        here = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[here])
        known = key < len(self.keys)
        known[known] = self.keys[key[known]] == h[here][known]
        here, key = here[known], key[known]
        many = self.at[key + 1] - self.at[key]
        window = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.at[key], many)
        place = np.repeat(here, many)
        start = place - self.order[window, 0]
        row = words.doc[place]
        fits = (start >= words.first[row]) & (start + self.length[window] <= words.first[row + 1])
        start, window = start[fits], window[fits]
        for k in range(1, self.rows.shape[1]):
            step = self.order[window, k]
            out = step >= self.length[window]
            same = out | (h[np.minimum(start + step, len(h) - 1)] == self.rows[window, step])
            start, window = start[same], window[same]
        if len(start):
            raw, place = words.spaced()
            same = np.array([raw[place[a] : place[a + n] - 1] == self.spelled[w] for a, n, w in zip(start, self.length[window], window)], bool)
            start, window = start[same], window[same]
        return start, window


def _one_at_a_time(shared) -> Iterator:
    """Values of broadcasts; of several, none is kept in memory."""
    for x in shared:
        yield x.value
        if len(shared) > 1:
            x.__dict__.pop("_value", None)


def judge(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``documents`` (needs text) with n_words, n_hit, items (ids, sorted as strings) and contaminated.

    Contaminated: some word is hit, and at least one in twenty.
    """
    spark = documents.sparkSession
    context = spark.sparkContext
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    total = bench.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(_PATTERN)), F.lit(0)))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))

    def fetch(k: int) -> list[tuple[str, str | None]]:
        return [tuple(r) for r in bench.where(block == k).collect()]

    vocabularies = []
    for k in range(blocks):
        rows, length, *_ = windows(fetch(k), size)
        vocabularies.append(context.broadcast(np.unique(rows[np.arange(size) < length[:, None]])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            data, off = text.buffers(batch.column(0))
            for k, known in enumerate(_one_at_a_time(vocabularies)):
                if not len(known):
                    continue
                held = sums.setdefault(k, np.zeros(len(known), np.int64))
                maybe = np.zeros(1 << 16, bool)
                maybe[(known >> np.uint64(48)).astype(np.int64)] = True
                for _, _, part, cut in text.slices(data, off):
                    h = text.Words(part, cut, text.ALNUM).hashes()
                    h = h[maybe[(h >> np.uint64(48)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    held += np.bincount(at[known[at] == h], minlength=len(known))
        for k, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(held[at])], names=["block", "at", "n"])

    counts = documents.select("text").mapInArrow(lean(count), "block long, at long, n long").groupBy("block", "at").agg(F.sum("n").alias("n"))
    if blocks > 1:
        counts = counts.checkpoint()
    shared = []
    for k in range(blocks):
        known = vocabularies[k].value
        found = counts.where(F.col("block") == k).collect() if len(known) else []  # at most one row per word of the block
        shared.append(context.broadcast(Index(fetch(k), {int(known[r["at"]]): r["n"] for r in found}, size)))

    made = ("n_words", "n_hit", "items", "contaminated")
    rest = documents.drop(*made)
    schema = T.StructType([*rest.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text.buffers(batch.column("text"))
            n = batch.num_rows
            n_words, n_hit, marks, items = np.zeros(n, np.int64), np.zeros(n, np.int64), {}, {}
            for index in _one_at_a_time(shared):
                for lo, hi, part, cut in text.slices(data, off):
                    words = text.Words(part, cut, text.ALNUM)
                    n_words[lo:hi] = words.count
                    start, window = index.find(words, words.hashes())
                    if not len(start):
                        continue
                    step = marks.setdefault(lo, np.zeros(len(words.doc) + 1, np.int64))
                    np.add.at(step, start, 1)
                    np.add.at(step, start + index.length[window], -1)
                    for row, w in np.unique(np.column_stack([words.doc[start], window]), axis=0):
                        a, b = np.searchsorted(index.pair_window, [w, w + 1])
                        items.setdefault(lo + int(row), set()).update(index.names[i] for i in index.pair_item[a:b])
            for lo, hi, part, cut in text.slices(data, off):
                if lo in marks:
                    words = text.Words(part, cut, text.ALNUM)
                    n_hit[lo:hi] = np.bincount(words.doc, np.cumsum(marks[lo][:-1]) > 0, hi - lo).astype(np.int64)
            lists = pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(n_hit), lists], names=[*batch.schema.names, *made[:3]])

    return rest.mapInArrow(lean(probe), schema).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB: all windows of all documents joined with all windows of the benchmark, by their words.
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_PATTERN}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_PATTERN}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {SIZE}) AS n, array_to_string(w[i:i + least(len(w), {SIZE}) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {SIZE} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, item, i, n FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
