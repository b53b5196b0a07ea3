"""Exact substring dedup with a distributed, sparse suffix array.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller id; strings are judged
on the input and never cross documents.

Not all suffixes are sorted.  In every string of ``length`` bytes, the smallest hash among its grams of ``GRAM`` bytes marks
one position, the same in every copy; equal strings therefore share a marked suffix, and only these (about one in fourteen) take
part.  Texts are dealt once into blocks by a hash of their id and stay there; what moves besides is small:

1. Each block sends its distinct marks, 5 bytes each, and learns which of them occur in two documents anywhere.
2. Marked suffixes that do go to range partitions, by their leading bytes.  The splitters are sampled from the texts.  Each has the
   bytes on both sides that a string through it could cover, and the smallest document of the block that has it: equal ones
   of a block are sent once, so that a group of copies weighs no more than the number of blocks in any range.
3. A range sorts its suffixes, and their mirrored left sides, by multikey quicksort on characters of eight bytes (ties only are
   partitioned by the next character).  Neighbours' common prefixes make runs; the smallest document of a run decides.
   Splitters are compared with whole leading grams, so suffixes with a string in common share a range, and those on both sides of a boundary
   agree in fewer than ``GRAM`` bytes: comparing across it can find nothing.
4. Every sender gets one bit per string back, in the order it sent them, and the blocks remove the bytes.

All comparisons that decide are on bytes.  Hashes only choose marks and what is not sent; a collision costs a useless record.

Null texts are empty.  Null ids count as larger than all others; rows with equal ids do not remove from each other.  Any other columns are carried.
Texts shorter than ``length`` lose nothing, an empty table gives an empty result.  Columns with the names of results are replaced; a very long text
makes a block of its own size, which has to fit into a worker.  Splitters grow with the corpus: 24 bytes for every ``BLOCK`` bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorloom.llm import text
from floorloom.llm.local import lean
from floorloom.plans.sampling import sampled

LENGTH, GRAM = 50, 24
#: Bytes of text per block and per range; splitter samples at least, of which every range has four until there are so many ranges, and two beyond.
BLOCK, SAMPLES = 8 << 20, 1 << 14
#: Rows of bytes that are worked on at once, where many arrays of their size would be made.
PIECE = 1 << 14
_KEY = "_suffix_block"
_LAST = np.iinfo(np.int64).max


def marks(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the marked grams of a slice, ascending, and their 64-bit hashes."""
    n, grams = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = text.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(text._BYTES[data] * up[:n], out=total[1:])
    g = text.mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    least = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    step = 1
    while 2 * step <= grams:  # smallest of step neighbours, doubling
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < grams:
        least = np.minimum(least[: len(least) - (grams - step)], least[grams - step :])
    whole = np.ones(n - length + 1, bool)  # strings that lie in one row
    for cut in off[1:-1]:
        whole[max(0, cut - length + 1) : cut] = False
    at = (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, g[at]


def multikey(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows (n, w): sorted by the first 8 bytes as one character, ties by the next, and so on."""
    n, width = rows.shape

    def char(of: np.ndarray | slice, k: int) -> np.ndarray:
        out = np.zeros((len(rows) if isinstance(of, slice) else len(of), 8), np.uint8)
        some = rows[of, 8 * k : 8 * k + 8]
        out[:, : some.shape[1]] = some
        return out.view(">u8").reshape(-1).astype(np.uint64)

    order = np.argsort(char(slice(None), 0), kind="stable")
    ties = np.arange(n)  # places in the order that are not decided
    part = np.zeros(n, np.int64)
    for k in range(-(-width // 8)):
        if k:
            sub = np.lexsort((char(order[ties], k), part))
            order[ties] = order[ties][sub]
        key = char(order[ties], k)
        new = np.append(True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])) if len(ties) else np.zeros(0, bool)
        part = np.cumsum(new)
        tied = np.append(~new[1:], False) | ~new if len(ties) else new
        ties, part = ties[tied], part[tied]
        if not len(ties):
            break
    return order


def common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each byte row with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), PIECE):
        hi = min(len(rows), lo + PIECE)
        differ = rows[lo:hi] != rows[lo - 1 : hi - 1]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated(context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bit o of each record: the string that starts o bytes before its mark also starts in a smaller document.

    ``context`` has ``length - GRAM`` bytes before the mark and ``length`` from it, of which ``left`` and ``right`` are real.
    """
    before, n = length - GRAM, len(doc)
    out = np.zeros(n, np.uint32)
    if n < 2:
        return out
    suffix = context[:, before:]
    order = multikey(suffix)
    context, left, right, doc = context[order], left[order], right[order], doc[order]
    lcp = common(context[:, before:])
    alone = (lcp < GRAM) & np.append(lcp[1:] < GRAM, True)
    see = np.flatnonzero(~alone)  # the others share no gram with anything
    mirrored = np.ascontiguousarray(context[see, :before][:, ::-1])
    by_left = multikey(mirrored)
    left_lcp = common(mirrored[by_left])
    bits = np.zeros(len(see), np.uint32)
    sub_left, sub_right, sub_doc = left[see], right[see], doc[see]
    for o in range(before + 1):
        use = np.flatnonzero((sub_left >= o) & (sub_right >= length - o))
        if len(use) < 2:
            continue
        run = np.cumsum(lcp < length - o)[see]
        side = np.empty(len(see), np.int64)
        side[by_left] = np.cumsum(left_lcp < o)
        key = run[use] * (len(see) + 1) + side[use]
        sort = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[sort][1:] != key[sort][:-1]))
        low = np.minimum.reduceat(sub_doc[use][sort], first)
        low = np.repeat(low, np.diff(np.append(first, len(use))))
        hit = low < sub_doc[use][sort]
        bits[use[sort][hit]] |= np.uint32(1 << o)
    out[order[see]] = bits
    return out


class Block:
    """Marks of a block's texts, and the distinct ones in the order of their keys."""

    def __init__(self, table: pa.Table, buckets: int, length: int):
        ids = table.column("doc_id").combine_chunks()
        self.ids = np.where(np.asarray(ids.is_null()), _LAST, np.asarray(ids.fill_null(0)))
        self.data, self.off = text.buffers(table.column("text"))
        at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, hi, part, cut in text.slices(self.data, self.off):
            a, h = marks(part, cut, length)
            at.append(a + self.off[lo])
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            keys.append(bucket << np.uint64(40) | (h & np.uint64((1 << 39) - 1)) << np.uint64(1))
        self.at, keys = np.concatenate(at), np.concatenate(keys)
        self.row = np.searchsorted(self.off, self.at, "right") - 1
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        self.which = np.empty(len(keys), np.int64)
        self.which[order] = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        docs = self.ids[self.row][order]
        several = np.minimum.reduceat(docs, heads) != np.maximum.reduceat(docs, heads) if len(heads) else np.zeros(0, bool)
        self.keys = keys[first] | several.astype(np.uint64)
        self.bucket = (self.keys >> np.uint64(40)).astype(np.int64)

    def contexts(self, seen: np.ndarray, length: int):
        """Records of the marks that ``seen`` (per distinct key) allows: grouped where equal, smallest document first."""
        before = length - GRAM
        self.use = np.flatnonzero(seen[self.which])
        at, row = self.at[self.use], self.row[self.use]
        left = np.minimum(at - self.off[row], before)
        right = np.minimum(self.off[row + 1] - at, length)
        step = np.arange(-before, length)
        wide = np.zeros((len(at), -(-(before + length + 2) // 8) * 8), np.uint8)
        for lo in range(0, len(at), PIECE):
            part = slice(lo, lo + PIECE)
            real = (step >= -left[part, None]) & (step < right[part, None])
            wide[part, : before + length] = np.where(real, self.data[np.clip(at[part, None] + step, 0, len(self.data) - 1)], np.uint8(0))
        context = wide[:, : before + length]
        wide[:, -2], wide[:, -1] = left, right
        h = np.zeros(len(at), np.uint64)
        for k, part in enumerate(wide.view(np.uint64).T):
            h = text.mix(h ^ part + np.uint64(k))
        ids = self.ids[row]
        order = np.lexsort((ids, h))
        new = np.append(True, (wide[order][1:] != wide[order][:-1]).any(axis=1)) if len(at) else np.zeros(0, bool)
        self.group = np.empty(len(at), np.int64)
        self.group[order] = np.cumsum(new) - 1
        head = order[new]
        self.least = ids[head]
        self.left, self.right = left, right
        return context[head], left[head], right[head], self.least


def _record(length: int) -> np.dtype:
    return np.dtype([("context", "u1", 2 * length - GRAM), ("left", "u1"), ("right", "u1"), ("doc", "<i8")])


def _rows(block: int, kind: int, bucket: list[int], payload: list[bytes]) -> pa.Table:
    n = len(bucket)
    return pa.table({"block": pa.array([block] * n, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array(bucket, pa.int64()), "payload": pa.array(payload, pa.binary())})


_MESSAGE = "block long, kind int, bucket long, payload binary"


def _seen(table: pa.Table, block: Block) -> np.ndarray:
    """Bit of every distinct key of a block from the answers of kind 1."""
    seen = np.zeros(len(block.keys), bool)
    for kind, bucket, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "payload"))):
        if kind == 1:
            a, b = np.searchsorted(block.bucket, [bucket, bucket + 1])
            seen[a:b] = np.unpackbits(np.frombuffer(payload, np.uint8), count=b - a).astype(bool)
    return seen


def dedup(documents: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """Rows of ``documents`` (needs doc_id, text) with n_bytes, n_removed, n_spans and kept_sha256.

    With ``texts`` the column text is what is left, as UTF-8; characters of which a byte was removed go as a whole.
    """
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    rest = documents.drop(*made, _KEY)
    size, n = rest.agg(F.sum(F.octet_length("text")), F.count_if(F.length("text") >= length)).first()
    size = size or 0
    blocks = max(1, math.ceil(size / BLOCK))
    start = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.length("text") - GRAM, F.lit(1))).cast("int") + 1
    sample = rest.where(F.length("text") >= length).select("doc_id", F.substring(F.col("text"), start, F.lit(GRAM)).alias("lead"))
    leads = sorted({r["lead"].encode()[:GRAM] for r in sampled(sample, max(SAMPLES, 2 * blocks), n, "doc_id", also=("lead",)).collect()})
    ranges = max(1, min(blocks, len(leads) // 2))
    splitters = np.array([leads[len(leads) * i // ranges] for i in range(1, ranges)], dtype=f"S{GRAM}")

    # One shuffle of the texts; the three passes over them read the same exchange, a task a block or a few.
    dealt = rest.withColumn(_KEY, F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks))).repartition(blocks, _KEY)

    def ask_marks(table: pa.Table) -> pa.Table:
        b = Block(table, blocks, length)
        raw = np.ascontiguousarray(b.keys).view(np.uint8).reshape(-1, 8)[:, :5]
        cut = np.searchsorted(b.bucket, np.arange(blocks + 1))
        some = np.flatnonzero(np.diff(cut))
        return _rows(table.column(_KEY)[0].as_py(), 0, some.tolist(), [raw[cut[k] : cut[k + 1]].tobytes() for k in some])

    def tell_marks(table: pa.Table) -> pa.Table:
        keys = []
        for payload in table.column("payload").to_pylist():
            wide = np.zeros((len(payload) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(payload, np.uint8).reshape(-1, 5)
            keys.append(wide.view(np.uint64).reshape(-1))
        every = np.concatenate(keys)
        every.sort()
        low = every >> np.uint64(1)
        many = np.unique(np.concatenate([low[1:][low[1:] == low[:-1]], low[(every & np.uint64(1)).astype(bool)]]))
        answers = []
        for k in keys:
            k = k >> np.uint64(1)
            at = np.minimum(np.searchsorted(many, k), max(0, len(many) - 1))
            answers.append(np.packbits(many[at] == k if len(many) else np.zeros(len(k), bool)).tobytes())
        n = table.num_rows
        return pa.table({"block": table.column("block"), "kind": pa.array([1] * n, pa.int32()), "bucket": table.column("bucket"), "payload": pa.array(answers, pa.binary())})

    def ask_ranges(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(0, 2, [], [])
        b = Block(table, blocks, length)
        records, where = _sent(b, answers)
        cut = np.searchsorted(where, np.arange(ranges + 1))
        pack = zstandard.ZstdCompressor(level=1)
        some = np.flatnonzero(np.diff(cut))
        return _rows(table.column(_KEY)[0].as_py(), 2, some.tolist(), [pack.compress(records[cut[k] : cut[k + 1]].tobytes()) for k in some])

    def _sent(b: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Records of a block by range, and their ranges; ``b.sent`` has the groups in that order."""
        context, left, right, least = b.contexts(_seen(answers, b), length)
        lead = np.ascontiguousarray(context[:, length - GRAM : length]).view(f"S{GRAM}").reshape(-1)
        where = np.searchsorted(splitters, lead, "right")
        b.sent = np.argsort(where, kind="stable")
        records = np.zeros(len(b.sent), _record(length))
        for name, values in (("context", context), ("left", left), ("right", right), ("doc", least)):
            records[name] = values[b.sent]
        return records, where[b.sent]

    def tell_ranges(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        parts = [np.frombuffer(unpack.decompress(p), _record(length)) for p in table.column("payload").to_pylist()]
        every = np.concatenate(parts)
        bits = repeated(every["context"], every["left"].astype(np.int64), every["right"].astype(np.int64), every["doc"], length)
        ends = np.cumsum([len(p) for p in parts])
        answers = [bits[e - len(p) : e].astype("<u4").tobytes() for p, e in zip(parts, ends)]
        n = table.num_rows
        return pa.table({"block": table.column("block"), "kind": pa.array([3] * n, pa.int32()), "bucket": table.column("bucket"), "payload": pa.array(answers, pa.binary())})

    schema = T.StructType([*rest.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    names = rest.columns

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(table, blocks, length)
        _, where = _sent(b, answers)
        bits = np.zeros(len(b.sent), np.uint32)
        for kind, bucket, payload in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "payload"))):
            if kind == 3:
                lo, hi = np.searchsorted(where, [bucket, bucket + 1])
                bits[b.sent[lo:hi]] = np.frombuffer(payload, "<u4")
        at, row = b.at[b.use], b.row[b.use]
        copy = b.ids[row] > b.least[b.group]  # a smaller document of the block has all of it
        mask = bits[b.group]
        starts = np.zeros(len(b.data) + 1, bool)
        for o in range(length - GRAM + 1):
            hit = np.where(copy, (b.left >= o) & (b.right >= length - o), (mask >> np.uint32(o) & np.uint32(1)).astype(bool))
            starts[at[hit] - o] = True
        gone = np.zeros(len(b.data), bool)
        kept, digests = [], []
        n_removed, n_spans = np.zeros(len(b.ids), np.int64), np.zeros(len(b.ids), np.int64)
        touched = np.unique(np.searchsorted(b.off, np.flatnonzero(starts), "right") - 1)
        hit_row = np.zeros(len(b.ids), bool)
        hit_row[touched] = True
        for i, (lo, hi) in enumerate(zip(b.off[:-1], b.off[1:])):
            part = b.data[lo:hi]
            if hit_row[i]:
                step = np.zeros(hi - lo + 1, np.int32)
                first = np.flatnonzero(starts[lo:hi])
                step[first] += 1
                step[first + length] -= 1
                gone = np.cumsum(step[:-1]) > 0
                n_removed[i] = gone.sum()
                n_spans[i] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
                part = part[~gone]
            raw = part.tobytes()
            digests.append(hashlib.sha256(raw).hexdigest())
            if texts:
                kept.append(raw.decode("utf-8", "ignore"))
        columns = {c: table.column(c) for c in names}
        if texts:
            kind = table.schema.field("text").type
            whole = table.column("text")
            columns["text"] = pa.array([k if v else None for k, v in zip(kept, whole.is_valid().to_pylist())], kind)
        return pa.table(columns | {"n_bytes": pa.array(np.diff(b.off)), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array(digests, pa.string())})

    first = dealt.groupBy(_KEY).applyInArrow(lean(ask_marks), _MESSAGE).groupBy("bucket").applyInArrow(lean(tell_marks), _MESSAGE)
    second = dealt.groupBy(_KEY).cogroup(first.groupBy("block")).applyInArrow(lean(ask_ranges), _MESSAGE).groupBy("bucket").applyInArrow(lean(tell_ranges), _MESSAGE)
    return dealt.groupBy(_KEY).cogroup(first.union(second).groupBy("block")).applyInArrow(lean(remove), schema)


#: DuckDB: every window of 50 bytes of every document.
SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] AS g FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
s AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE m < doc_id),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
p AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS z FROM r GROUP BY doc_id, run),
k AS (SELECT p.doc_id, a, z, hex(b[coalesce(lag(z) OVER (PARTITION BY p.doc_id ORDER BY a), 0) + 1:a - 1]) AS before, b FROM p JOIN d USING (doc_id)),
c AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans, string_agg(before, '' ORDER BY a) || hex(any_value(b)[max(z) + 1:octet_length(any_value(b))]) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN c.doc_id IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
