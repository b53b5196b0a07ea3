"""MinHash near-dedup with SetSketch registers.

A document's set are its distinct runs of five words.  Every element makes a Poisson process of points, each falling on one of
``M`` registers; a register keeps the smallest point over all elements, as a power of ``B`` (exponentially spaced, truncated
minima), so registers of unions are maxima of registers and equal registers tell of common elements.

1. One pass over the texts makes the size, a signature of the set and the registers of every document.  Equal
   signatures are equal sets; only the smallest id of each goes on (summed map-side, whatever the number of copies).
2. Registers are banded.  In every bucket one document, the hub, is compared with all others: as many pairs as members.
3. A pair's registers are compared once more, jointly: from how many are larger, smaller and equal, and the two exact sizes, the
   likelihood of the threshold is held against the best one.  Pairs far less likely than any link go.
4. The rest is verified on the full sets, made again from the texts of the documents concerned.
5. Buckets whose members still lie in different components hold pairs that no hub has spoken for.  They are
   compared in tiles of bounded size, between components only, by registers as in step 3 and then by the full sets.  No bucket is
   cut short, however large, and no pairs are written: a tile hands on one edge per document.

Sizes of sets count 64-bit hashes of their elements (a text of ten million words has one collision with a probability of 3e-6).  Links are
verified by two independent hashes of 64 bits for each element.
A link of similarity 0.85 is missed by all bands with a probability below 1e-5 (0.9: below 1e-7), and by step 3 below 1e-8.
Below a threshold of 0.85 bands are of four registers, 25 in all: a link of 0.8 is missed with a probability of 2e-6.

Texts that are null or without words have an empty set and link with nothing.  Fewer than five words are one element.  Rows with
equal ids count as one document, linked to what one of its rows is.  Null ids are returned, linked with nothing.  Other columns
are not read, whatever their names.  A very long text is one set, which has to fit into a worker.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorloom.llm import text
from floorloom.llm.local import lean, reached
from floorloom.operators.connectivity import components
from floorloom.plans.recovery import settled, small

WIDTH = 5
M, BANDS, ROWS = 100, 20, 5
B, A = 1.001, 20.0
#: 100 * intersection >= LINK * union
LINK = 85
#: Log-likelihood by which the threshold may fall short of the best similarity; 18 is six standard deviations.
SLACK = 18.0
TILE = 256
#: Rows of a few numbers each that one task reads of a settled table.
FEW = 1 << 17
_BITS = 52
_ROWS = 1 << (64 - _BITS)


def sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of every row of a slice (at most 4096 rows): 64-bit hashes, sorted in each row, and n + 1 offsets."""
    words = text.Words(data, off, text.SOLID)
    h = words.hashes()
    at = words.runs(width)
    hashes, rows = [text.together(h, at, tuple(range(width)), 0x5E7)], [words.doc[at]]
    for n in range(1, width):  # rows of so few words
        few = words.first[:-1][words.count == n]
        hashes.append(text.together(h, few, tuple(range(n)), 0x5E7 + n))
        rows.append(words.doc[few])
    found = np.concatenate(hashes)
    key = np.concatenate(rows).astype(np.uint64) << np.uint64(_BITS) | found >> np.uint64(64 - _BITS)
    order = np.argsort(key)
    key, found = key[order], found[order]
    if len(key):
        if ((key[1:] == key[:-1]) & (found[1:] != found[:-1])).any():  # hashes that differ in their last bits only
            order = np.lexsort((found, key))
            key, found = key[order], found[order]
        new = np.append(True, (key[1:] != key[:-1]) | (found[1:] != found[:-1]))
        key, found = key[new], found[new]
    cut = np.searchsorted(key, np.arange(len(off), dtype=np.uint64) << np.uint64(_BITS)) if len(off) <= _ROWS else np.append(np.searchsorted(key, np.arange(len(off) - 1, dtype=np.uint64) << np.uint64(_BITS)), len(key))
    return found, cut


def wide_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of every row of a slice as rows of two independent 64-bit hashes, sorted in each row, and n + 1 offsets."""
    words = text.Words(data, off, text.SOLID)
    at = words.runs(width)
    few = [words.first[:-1][words.count == n] for n in range(1, width)]
    rows = np.concatenate([words.doc[at], *(words.doc[f] for f in few)])
    pair = []
    for h in (words.hashes(), words.hashes(text._OTHER)):
        pair.append(np.concatenate([text.together(h, at, tuple(range(width)), 0x5E7), *(text.together(h, f, tuple(range(n)), 0x5E7 + n) for n, f in enumerate(few, 1))]))
    order = np.lexsort((pair[1], pair[0], rows))
    rows, pair = rows[order], np.column_stack(pair)[order]
    if len(rows):
        new = np.append(True, (rows[1:] != rows[:-1]) | (pair[1:] != pair[:-1]).any(axis=1))
        rows, pair = rows[new], pair[new]
    return pair, np.searchsorted(rows, np.arange(len(off)))


def numbered(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the elements (rows of two hashes) of both sides, equal where both hashes are."""
    both = np.concatenate([left, right])
    order = np.lexsort((both[:, 1], both[:, 0]))
    sorted_ = both[order]
    number = np.empty(len(both), np.int64)
    number[order] = np.cumsum(np.append(True, (sorted_[1:] != sorted_[:-1]).any(axis=1))) if len(both) else 0
    return number[: len(left)], number[len(left) :]


def minima(elements: np.ndarray, cut: np.ndarray, m: int = M, a: float = A) -> np.ndarray:
    """Smallest point per row and register; infinite for empty rows."""
    n = np.diff(cut)
    out = np.full(len(n) * m, np.inf)
    todo, reach = np.flatnonzero(n > 0), np.log(m) + 4
    while len(todo):
        # Points up to this height; a register that is empty there makes its row come again with a higher one.
        top = np.zeros(len(n))
        top[todo] = reach / (n[todo] * a)
        many = n[todo]
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(cut[:-1][todo], many)
        row, x = np.repeat(todo, many), np.zeros(len(which))
        h, step = elements[which], np.zeros(len(which), np.uint64)
        expect = a * m * top[row]
        group = np.where(expect < 2, 0, np.ceil(np.log2(np.maximum(expect, 2)))).astype(np.int64)
        for g in np.unique(group):
            i = np.flatnonzero(group == g)
            r, v, k, s = row[i], x[i], h[i], step[i]
            block = 1 if g == 0 else int(2**g + 3 * 2 ** (g / 2))
            while len(r):
                for lo in range(0, len(r), max(1, (1 << 18) // block)):
                    part = slice(lo, lo + max(1, (1 << 18) // block))
                    bits = text.mix(k[part, None] * np.uint64(0x2127599BF4325C37) + (s[part, None] + np.arange(1, block + 1, dtype=np.uint64)) * np.uint64(0x880355F21E6D1965))
                    gaps = -np.log(((bits >> np.uint64(24)).astype(np.float64) + 0.5) / (1 << 40)) / (a * m)
                    points = v[part, None] + np.cumsum(gaps, axis=1)
                    place = r[part, None] * m + (((bits & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)).astype(np.int64)
                    ok = points < top[r[part]][:, None]
                    np.minimum.at(out, place[ok], points[ok])
                    v[part] = points[:, -1]
                more = v < top[r]
                r, v, k, s = r[more], v[more], k[more], s[more] + np.uint64(block)
        todo = todo[np.isinf(out.reshape(-1, m)[todo]).any(axis=1)]
        reach *= 2
    return out.reshape(-1, m)


def registers(points: np.ndarray, b: float = B) -> np.ndarray:
    """Exponents of the minima, truncated to 16 bits; 0 for empty rows."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(points) / np.log(b)), 0, 65535).astype(np.uint16)


def banding(link: int) -> tuple[int, int]:
    """Bands, and registers in each."""
    return (BANDS, ROWS) if link >= LINK else (M // (ROWS - 1), ROWS - 1)


def likely(n_u, n_v, larger, smaller, equal, least: float = LINK / 100, slack: float = SLACK, b: float = B) -> np.ndarray:
    """Whether a similarity of ``least`` or more is plausible for pairs of sets with these sizes and register counts."""
    n_u, n_v = np.asarray(n_u, float), np.asarray(n_v, float)
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)

    def loglik(j):
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (b - 1) / b) / np.log(b)
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))

    bound = np.minimum(u, v) / np.maximum(u, v)  # no two sets of these sizes are more similar
    grid = np.linspace(0, 1, 65)[:, None] * bound
    curve = loglik(grid)
    above = np.where(grid >= least, curve, -np.inf).max(axis=0)
    at = np.minimum(least, bound)
    above = np.maximum(above, loglik(at))
    return (bound >= least - 1e-9) & (curve.max(axis=0) - above <= slack)


def sketch(documents: DataFrame, width: int = WIDTH, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, sig_a, sig_b, registers (binary) and bands of every row; the last four null for empty sets."""
    schema = "doc_id long, n_shingles long, sig_a long, sig_b long, registers binary, bands array<long>"
    n_bands, n_rows = banding(link)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text.buffers(batch.column(1))
            for lo in range(0, batch.num_rows, _ROWS - 1):
                cut0 = off[lo : lo + _ROWS]
                for a, z, part, cut in text.slices(data[cut0[0] : cut0[-1]], cut0 - cut0[0]):
                    found, at = sets(part, cut, width)
                    n = np.diff(at)
                    regs = registers(minima(found, at))
                    sums = [np.append(np.uint64(0), np.cumsum(text.mix(found ^ np.uint64(s)))) for s in (0x1B873593, 0xCC9E2D51)]
                    sigs = [(c[at[1:]] - c[at[:-1]]).view(np.int64) for c in sums]
                    bands = np.full((len(n), n_bands), np.uint64(0))
                    wide = regs[:, : n_bands * n_rows].reshape(len(n), n_bands, n_rows).astype(np.uint64)
                    for k in range(n_rows):
                        bands = text.mix(bands ^ wide[:, :, k])
                    bands = text.mix(bands ^ np.arange(n_bands, dtype=np.uint64)).view(np.int64)
                    none = n == 0
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * M), len(n), [None, pa.py_buffer(np.ascontiguousarray(regs))]).cast(pa.binary())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * n_bands, pa.int32()), pa.array(bands.reshape(-1)))
                    null = pa.array(none)
                    blank = lambda x, null=null: pa.compute.if_else(null, pa.scalar(None, x.type), x)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, z - a), pa.array(n), pa.array(sigs[0], mask=none), pa.array(sigs[1], mask=none), blank(raw), blank(lists)], names=["doc_id", "n_shingles", "sig_a", "sig_b", "registers", "bands"])

    import pyarrow.compute  # noqa: F401  pa.compute for the executors' closure

    return documents.select("doc_id", "text").mapInArrow(lean(run), schema)


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    more, less = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    return more, less, a.shape[-1] - more - less


def _plausible(pairs: DataFrame, reps: DataFrame, link: int) -> DataFrame:
    """Pairs (u, v) whose registers allow a link."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n_" + x), F.col("registers").alias("r_" + x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, M) for x in ("r_u", "r_v"))
            ok = likely(batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy(), *_counts(a, b), link / 100)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "r_u", "r_v").mapInArrow(lean(run), "u long, v long").distinct()


def _elements(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, elements (two hashes each, sorted, as bytes) of the documents in ``wanted`` (doc_id), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text.buffers(batch.column(1))
            for lo in range(0, batch.num_rows, _ROWS - 1):
                cut0 = off[lo : lo + _ROWS]
                for a, z, part, cut in text.slices(data[cut0[0] : cut0[-1]], cut0 - cut0[0]):
                    found, at = wide_sets(part, cut, width)
                    raw = np.ascontiguousarray(found, np.uint64).tobytes()
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + a, z - a), pa.array([raw[16 * i : 16 * j] for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["id", "elements"])

    return documents.select("doc_id", "text").join(small(wanted), "doc_id", "left_semi").mapInArrow(lean(run), "id long, elements binary")


def _verified(pairs: DataFrame, documents: DataFrame, link: int, width: int) -> DataFrame:
    """Pairs (u, v) that are links by their full sets."""
    made = _elements(documents, pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("eu"), batch.column("ev"))):
                x, y = (np.frombuffer(e.as_buffer(), np.uint64).reshape(-1, 2) for e in (a, b))
                if 100 * min(len(x), len(y)) < link * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(*numbered(x, y), assume_unique=True))
                ok[i] = 100 * common >= link * (len(x) + len(y) - common)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    of = lambda x: made.select(F.col("id").alias(x), F.col("elements").alias("e" + x))
    return pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "eu", "ev").mapInArrow(lean(compare), "u long, v long").distinct()


def shared_elements(left: list[np.ndarray], right: list[np.ndarray], block: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets: products of 0/1 matrices over blocks of elements that both sides have."""
    x, y = numbered(*(np.concatenate([np.zeros((0, 2), np.uint64), *s]) for s in (left, right)))
    both = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for side, every in ((left, x), (right, y)):
        row = np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.minimum(np.searchsorted(both, every), max(0, len(both) - 1))
        known = both[at] == every if len(both) else np.zeros(len(every), bool)
        order = np.argsort(at[known], kind="stable")
        places.append((row[known][order], at[known][order]))
    for lo in range(0, len(both), block):
        sides = []
        for (row, at), n in zip(places, (len(left), len(right))):
            a, b = np.searchsorted(at, [lo, lo + block])
            m = np.zeros((n, min(block, len(both) - lo)), np.float32)
            m[row[a:b], at[a:b] - lo] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _between(members: DataFrame, hubs: DataFrame, labels: DataFrame, involved: DataFrame, documents: DataFrame, link: int, width: int) -> DataFrame:
    """Edges (src, dst) from links inside buckets whose members lie in different components after the hubs were compared.

    The members of such buckets that overlap make a clump.  A clump is compared in tiles of at most about TILE by TILE documents, between components only:
    first by registers, which says which documents need their sets in which tile, then by the sets.  A tile hands on one edge per document.
    """
    placed = members.join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    apart = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("n > 2 AND lo <> hi").select("key")
    open_ = settled(placed.join(apart, "key"), FEW)
    none = documents.sparkSession.createDataFrame([], "src long, dst long")
    if open_.isEmpty():
        return none
    clumps = components(open_.join(hubs, "key").select(F.col("hub").alias("src"), F.col("doc_id").alias("dst")))
    rows = open_.select("doc_id", "label").distinct().join(clumps.select(F.col("node").alias("doc_id"), F.col("component").alias("clump")), "doc_id")
    rows = settled(rows, FEW)
    tiles = rows.groupBy("clump").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    rows = rows.join(tiles.drop("n"), "clump").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("clump", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "label")
    # As many groups as the rows of all tiles need, dealt over as many tasks.
    groups = 1 + (tiles.agg(F.sum(F.col("tiles") * F.col("n"))).first()[0] or 0) // (4 * TILE)
    group = F.pmod(F.xxhash64("clump", "i", "j"), F.lit(groups))
    place = "clump long, i int, j int, own int, doc_id long, label long"

    def sides(t: pd.DataFrame, i: int, j: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        return t[t["own"] == i], t[t["own"] == j]

    def plausible(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pdf.iloc[:0]]
        for (_, i, j), t in pdf.groupby(["clump", "i", "j"], sort=False):
            left, right = sides(t, i, j)
            regs = [np.frombuffer(b"".join(x["registers"]), np.uint16).reshape(-1, M) for x in (left, right)]
            hit = np.zeros(len(right), bool)
            met = np.zeros(len(left), bool)
            for k, (label, n) in enumerate(zip(left["label"], left["n_shingles"])):
                see = np.flatnonzero(right["label"].to_numpy() != label)
                if len(see):
                    ok = likely(np.full(len(see), n), right["n_shingles"].to_numpy()[see], *_counts(regs[0][k], regs[1][see]), link / 100)
                    hit[see[ok]] = True
                    met[k] = ok.any()
            out += [left[met], right[hit]] if i != j else [left[met]]
        return pd.concat(out)[["clump", "i", "j", "own", "doc_id", "label"]]

    needed = settled(rows.join(involved, "doc_id").withColumn("g", group).repartition(groups, "g").groupBy("g").applyInPandas(lean(plausible), place))
    if needed.isEmpty():
        return none
    made = _elements(documents, needed.select("doc_id").distinct(), width)

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        for (_, i, j), t in pdf.groupby(["clump", "i", "j"], sort=False):
            left, right = sides(t, i, j)
            a, b = ([np.frombuffer(e, np.uint64).reshape(-1, 2) for e in x["elements"]] for x in (left, right))
            common = shared_elements(a, b)
            union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b]) - common
            apart = left["label"].to_numpy()[:, None] != right["label"].to_numpy()
            u, v = np.nonzero((100 * common >= link * union) & apart)
            ids = np.concatenate([left["doc_id"].to_numpy(), right["doc_id"].to_numpy()])
            low = reached(len(ids), u, v + len(left), ids)
            some = np.flatnonzero(low != ids)
            out.append(np.column_stack([ids[some], low[some]]))
            if len(u):  # the same document may stand on both sides of a tile
                out.append(np.column_stack([ids[u], low[u]]))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["src", "dst"])

    ready = needed.join(made, F.col("doc_id") == F.col("id")).withColumn("g", group).repartition(groups, "g")
    return ready.groupBy("g").applyInPandas(lean(exact), "src long, dst long")


def near_duplicates(documents: DataFrame, link: int = LINK, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``documents`` (needs doc_id, text)."""
    made = settled(sketch(documents, width, link))
    full = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = full.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = settled(full.select("doc_id", "sig_a", "sig_b").join(first, ["sig_a", "sig_b"]).where("rep <> doc_id").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")).distinct(), FEW)
    reps = full.join(small(copies.select(F.col("src").alias("doc_id"))), "doc_id", "left_anti")
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settled(keys.join(crowded, "key"), FEW)
    # The hub of a bucket is its member that meets most others in all buckets: of copies with changes of their own, the common origin.
    degree = members.groupBy("doc_id").agg(F.sum("n").alias("d"))
    hubs = members.join(degree, "doc_id").groupBy("key").agg(F.min(F.struct((-F.col("d")).alias("d"), "doc_id")).alias("h")).select("key", F.col("h.doc_id").alias("hub"))
    hubs = settled(hubs, FEW)
    members = members.select("key", "doc_id")
    involved = settled(reps.select("doc_id", "n_shingles", "registers").join(small(degree.select("doc_id")), "doc_id", "left_semi"), FEW // 8)
    pairs = members.join(hubs, "key").where("hub <> doc_id").select(F.least("hub", "doc_id").alias("u"), F.greatest("hub", "doc_id").alias("v")).distinct()
    linked = settled(_verified(settled(_plausible(pairs, involved, link), FEW), documents, link, width), FEW)
    labels = settled(components(linked, "u", "v"), FEW)
    more = _between(members, hubs, labels, involved, documents, link, width)
    found = components(linked.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(copies).union(more))
    out = made.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB: all sets joined by common elements, reachability by recursion.
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= {LINK} * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""
