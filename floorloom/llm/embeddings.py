"""Embedding near-dedup by product quantisation.

Vectors are scaled to length one, equal ones of a table first reduced to the smallest id and their number.  An index is fitted on
a bounded sample (``SAMPLE`` vectors by hash of the id): coarse lists by k-means, and for the residuals to the list's centre one small
codebook per subspace.  Every vector is then encoded.

Pairs of one list are all compared.  Across lists, a vector is also a query to every other list whose border, the plane halfway
between the two centres, is near: two vectors on different sides of a border are at least as far apart, along its normal, as both
distances to it together, so one end of a link is within half the link's step along that normal.  No step is longer than the link
(``sqrt(2 - 2 * cosine)``), and it is taken to spread as the vectors around their centres do: probed is up to ``Z`` standard deviations of it,
by the larger share of the residuals' variance that either list has along the normal, and never beyond the link's length, at which nothing
can be lost.  In few dimensions that is the bound, in many it is far less.  A query is compared with
the whole of the other list.  Where both ends ask, the query from the list of the smaller number counts the pair.

A comparison looks distances up per subspace, exact vector against code (asymmetric), and keeps pairs that could link given the
code's own error: no link is lost in this step.  What remains is judged by its exact cosine in double precision.  Lists are compared in
tiles of at most about ``TILE`` vectors a side, however large the list.  A tile sums the links of every vector and hands on
one edge per vector to the smallest id that it reaches inside the tile; pairs themselves are never written.

Vectors that are null, empty, zero or have null or non-finite components link with nothing.  Vectors of different length
do not link; each length has an index of its own.  Lists are ``n / PER_LIST``, with ``LEAST`` sampled vectors each: beyond
``SAMPLE / LEAST * PER_LIST`` vectors (two millions) lists grow and are compared in more tiles.  Rows with equal ids count as separate vectors but share a component.  Null ids are returned, linked with nothing.
Other columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorloom.llm.local import reached
from floorloom.operators.connectivity import components
from floorloom.plans.recovery import settled
from floorloom.plans.sampling import sampled

LINK = 0.9
#: Vectors that the index is fitted on; vectors per list, and sampled vectors per list at least.
SAMPLE, PER_LIST, LEAST = 16384, 1024, 8
#: Standard deviations of a link's step across a border that are still probed.
Z = 4.0
SUBSPACES, CODES = 8, 256
SPARE = 1e-3
TILE = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Centres; empty ones stay where they were."""
    pick = np.random.default_rng(seed)
    centres = x[pick.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)[0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row, and squared distances to all, less the row's own square."""
    d = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    return d.argmin(axis=1), d


class Index:
    """Coarse centres and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, lists).astype(np.float32)
        home = nearest(sample, self.centres)[0]
        rest = sample - self.centres[home]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(np.ascontiguousarray(rest[:, c]), CODES, 6).astype(np.float32) for c in self.cuts]
        apart = ((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(axis=2) if len(self.centres) <= 256 else self._apart()
        self.apart = np.sqrt(np.maximum(apart, 1e-20))
        # Share of the residuals' variance along the normal of every border, the larger one of its two lists.
        share = np.zeros_like(self.apart)
        for i in range(len(self.centres)):
            r = rest[home == i]
            if len(r):
                share[i] = (((r @ (self.centres - self.centres[i]).T) / self.apart[i]) ** 2).mean(axis=0) / max(1e-20, (r * r).sum(axis=1).mean())
        self.share = np.maximum(share, share.T)

    def _apart(self) -> np.ndarray:
        s = (self.centres**2).sum(axis=1)
        return s[:, None] + s - 2 * (self.centres @ self.centres.T)

    def encode(self, x: np.ndarray, reach: float, z: float = Z) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Home list, codes, distance to the code, and other lists to probe, of unit vectors."""
        home, d = nearest(x, self.centres)
        rest = x - self.centres[home]
        codes = np.column_stack([nearest(rest[:, c], b)[0] for c, b in zip(self.cuts, self.books)]).astype(np.uint8)
        error = np.sqrt(((rest - np.hstack([b[codes[:, k]] for k, b in enumerate(self.books)])) ** 2).sum(axis=1))
        border = (d - d[np.arange(len(x)), home][:, None]) / (2 * self.apart[home])
        border[np.arange(len(x)), home] = np.inf
        margin = reach * np.minimum(1.0, z * np.sqrt(self.share)) / 2 + SPARE
        return home, codes, error, [np.flatnonzero(row) for row in border <= margin[home]]

    def candidates(self, queries: np.ndarray, home: int, codes: np.ndarray, error: np.ndarray, reach: float) -> np.ndarray:
        """Mask (queries, codes): pairs whose looked-up distance allows a true distance of ``reach``."""
        rest = queries - self.centres[home]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for k, (c, book) in enumerate(zip(self.cuts, self.books)):
            part = rest[:, c]
            look = (part * part).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * (part @ book.T)
            total += look[:, codes[:, k]]
        limit = (reach + error + 1e-4) ** 2 + 1e-4  # single precision
        return total <= limit[None, :]


def times(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row k as often as counts[k] says, and the number of each repetition."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def _unit(values: np.ndarray) -> np.ndarray:
    return (values / np.sqrt((values * values).sum(axis=1))[:, None]).astype(np.float32)


def _kind(vectors: DataFrame) -> type:
    of = vectors.schema["embedding"].dataType
    return np.float32 if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else np.float64


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and v (bytes of the components, as wide as they come) of the vectors that can link."""
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)  # null components become NaN
            n = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            off = np.append(0, np.cumsum(n))
            top = np.zeros(len(n))
            some = np.flatnonzero(n > 0)
            if len(some):
                top[some] = np.maximum.reduceat(np.abs(x), off[some])
            use = np.isfinite(top) & (top > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(use & ((top <= 1e-100) | (top >= 1e100))):
                x[off[k] : off[k + 1]] /= top[k]  # squares neither vanish nor overflow; floats of four bytes never come here
            raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(off * x.itemsize), pa.py_buffer(np.ascontiguousarray(x))])
            keep = pa.array(use)
            yield pa.RecordBatch.from_arrays([ids.filter(keep), pa.array(n[use].astype(np.int32)), raw.filter(keep).cast(pa.binary())], names=["vec_id", "dim", "v"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, v binary")


def _links(distinct: DataFrame, dim: int, kind: type, n: int, link: float) -> DataFrame:
    """Rows (vec_id, n_links, edge) from the tiles of one vector length."""
    spark = distinct.sparkSession
    sample = sampled(distinct, SAMPLE, n, "vec_id").select("v").toPandas()["v"]  # SAMPLE rows at most
    x = _unit(np.frombuffer(b"".join(sample), kind).astype(np.float64).reshape(-1, dim))
    lists = max(1, min(2 + n // PER_LIST, len(x) // LEAST))
    shared = spark.sparkContext.broadcast(Index(x, lists))
    reach = float(np.sqrt(max(0.0, 2 - 2 * link)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("v").to_pylist()), kind).astype(np.float64).reshape(-1, dim)
            home, codes, error, probes = index.encode(_unit(values), reach)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["vec_id", "copies", "v"]).columns, pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float64)), pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))],
                names=["vec_id", "copies", "v", "home", "codes", "error", "probes"],
            )

    coded = settled(distinct.mapInArrow(encode, "vec_id long, copies long, v binary, home int, codes binary, error double, probes array<int>"))
    sizes = {r["home"]: r["n"] for r in coded.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per list
    asked = {r["c"]: r["n"] for r in coded.select(F.explode("probes").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per list
    # Tiles of a list's own vectors, and of the queries to it.
    tiles = spark.sparkContext.broadcast([np.array([-(-of.get(k, least) // TILE) for k in range(lists)]) for of, least in ((sizes, 1), (asked, 0))])
    groups = max(32, (n + sum(asked.values())) // 2048)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, queries = tiles.value
        for batch in batches:
            ids, homes = batch.column("vec_id").to_numpy().astype(np.uint64), batch.column("home").to_numpy().astype(np.int64)
            probes = batch.column("probes")
            asker, other = times(probes.value_lengths().to_numpy())[0], probes.flatten().to_numpy().astype(np.int64)
            spread = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)
            own = spread % split[homes]
            a, t = times(split[homes])  # within the list
            b, u = times(queries[homes])  # as part of the list, for the queries to it
            c, v = times(split[other])  # as a query
            rows = np.concatenate([a, b, asker[c]])
            left = np.concatenate([homes[a], np.full(len(b) + len(c), -1)])
            right = np.concatenate([homes[a], homes[b], other[c]])
            i = np.concatenate([np.minimum(own[a], t), u, spread[asker[c]] % np.maximum(1, queries[other[c]])])
            j = np.concatenate([np.maximum(own[a], t), own[b], v])
            side = np.concatenate([own[a] > t, np.ones(len(b), bool), np.zeros(len(c), bool)])
            key = (left * 1_000_003 + right) * 1_000_003 + i * 1009 + j
            # One message per row and tile: a tile's rows meet in the group of its key.
            for lo in range(0, len(rows), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                out = batch.select(["vec_id", "copies", "v", "home", "codes", "error", "probes"]).take(pa.array(rows[part]))
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), *(pa.array(x[part].astype(np.int32)) for x in (left, right, i, j, side)), *out.columns], names=["key", "a", "b", "i", "j", "side", *out.schema.names])

    dealt = coded.mapInArrow(deal, "key long, a int, b int, i int, j int, side int, vec_id long, copies long, v binary, home int, codes binary, error double, probes array<int>")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        index, out = shared.value, []
        for (a, b, i, j), t in pdf.groupby(["a", "b", "i", "j"], sort=False):
            one = a == b and i == j
            # (within a list, tiles i and j of it; to list b, tile i of the queries and j of the list)
            left = t if one else t[t["side"] == 0]
            right = t if one else t[t["side"] == 1]
            if not len(left) or not len(right):
                continue
            x, y = (np.frombuffer(b"".join(s["v"]), kind).astype(np.float64).reshape(-1, dim) for s in (left, right))
            codes = np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1)
            p, q = [], []
            for lo in range(0, len(left), 256):
                maybe = index.candidates(_unit(x[lo : lo + 256]), b, codes, right["error"].to_numpy(np.float32), reach)
                if one:
                    maybe &= np.arange(len(right)) > np.arange(lo, lo + len(maybe))[:, None]
                u, v = np.nonzero(maybe)
                p.append(u + lo), q.append(v)
            p, q = np.concatenate(p), np.concatenate(q)
            keep = []
            norm_x, norm_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            for lo in range(0, len(p), 1 << 15):  # exact cosine
                u, v = p[lo : lo + (1 << 15)], q[lo : lo + (1 << 15)]
                keep.append((x[u] * y[v]).sum(axis=1) / (norm_x[u] * norm_y[v]) >= link)
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            p, q = p[keep], q[keep]
            if a < 0 and len(p):
                asks = np.zeros((len(right), lists), bool)
                asks[np.repeat(np.arange(len(right)), [len(x) for x in right["probes"]]), np.concatenate(list(right["probes"])).astype(np.int64)] = True
                from_ = left["home"].to_numpy()[p]
                twice = asks[q, from_] & (from_ > b)
                p, q = p[~twice], q[~twice]
            if not len(p):
                continue
            ids = np.concatenate([left["vec_id"].to_numpy(), right["vec_id"].to_numpy()])
            many = [s["copies"].to_numpy() for s in (left, right)]
            n_links = np.bincount(p, many[1][q], len(ids)) + np.bincount(q + len(left), many[0][p], len(ids))
            edge = reached(len(ids), p, q + len(left), ids) if not one else np.tile(reached(len(left), p, q, ids[: len(left)]), 2)
            some = np.flatnonzero(n_links > 0)
            out.append(pd.DataFrame({"vec_id": ids[some], "n_links": n_links[some].astype(np.int64), "edge": edge[some]}))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "n_links": [], "edge": []}).astype("int64")

    grouped = dealt.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("g")
    return grouped.applyInPandas(compare, "vec_id long, n_links long, edge long")


def near_duplicates(vectors: DataFrame, link: float = LINK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (needs vec_id, embedding)."""
    usable = settled(clean(vectors))
    distinct = settled(usable.groupBy("dim", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    sizes = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per vector length
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "vec_id long, n_links long, edge long")
    for r in sorted(sizes):
        found = found.union(_links(distinct.where(F.col("dim") == r["dim"]).drop("dim"), r["dim"], _kind(vectors), r["n"], link))
    found = settled(found)
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n"))
    heads = distinct.join(counts, "vec_id", "left").select(F.col("dim").alias("_d"), F.col("v").alias("_v"), F.col("vec_id").alias("head"), F.col("copies"), F.coalesce("n", F.lit(0)).alias("n"))
    # Every copy has the links of the copy that was compared, and the other copies.
    each = usable.join(heads, (F.col("dim") == F.col("_d")) & (F.col("v") == F.col("_v"))).select("vec_id", "head", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    each = settled(each)
    edges = found.select(F.col("vec_id").alias("src"), F.col("edge").alias("dst")).union(each.select("vec_id", "head")).where("src <> dst")
    reached = components(edges)
    of = each.groupBy("vec_id").agg(F.max("n_links").alias("n_links")).withColumnRenamed("vec_id", "_id")
    out = vectors.select("vec_id").join(of, F.col("vec_id") == F.col("_id"), "left").join(reached, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


#: DuckDB: all pairs, reachability by recursion.
SQL = f"""
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {LINK}),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.v FROM r JOIN l ON l.u = r.seen),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings LEFT JOIN n ON u = vec_id JOIN m ON node = vec_id
"""
