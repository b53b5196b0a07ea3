"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Both are bigram models of one form and one vocabulary, the words of all documents (at least ``2**WORD_BITS``).  A word's probability
after another is its count there, smoothed by ``PULL`` times its share of all words.  The target is trained on the target documents,
the background on all.  ``score`` is the mean over a document's words of the target's loss minus the background's, in nats: low is like
the target.

Words and pairs of words are counted apart, by 63-bit hashes; nothing is folded into a table of fixed size.

1. Rows are dealt once into blocks of about ``BLOCK`` bytes by a hash of their id; labels are dealt likewise.
2. Every block sorts and counts its own words and pairs and sends them, in as many shards as the corpus has times ``SHARD`` bytes.
   A frequent word is one entry per block.
3. A shard sums its entries over all blocks and answers each block, in the order of its entries.
4. A block meets its answers and scores its whole texts.

A task holds one block with its answers or one shard.  Nothing of the corpus comes to the driver but its size; three sums are broadcast.

Null texts and texts without words have no losses and a score of 0.  Null ids are no target but are scored.  Repeated rows count each time.
Without target documents the target model is uniform.  Columns beside doc_id and text are not read, whatever their names.  A very long text
makes a block of its own size, which has to fit into a worker; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorloom.llm import text

WORD_BITS = 20
BLOCK, SHARD = 8 << 20, 16 << 20
_KEY = "_entropy_block"
PULL, FLOOR = 4.0, 0.1


def entries(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words (even) and pairs (odd) of all rows, positions that have a word before them, each word's row, and words per row."""
    words, pairs, seconds, rows, n = [], [], [], [], np.zeros(len(off) - 1, np.int64)
    for lo, hi, part, cut in text.slices(data, off):
        found = text.Words(part, cut, text.ALNUM)
        h, at = found.hashes(), found.runs(2)
        seconds.append(at + 1 + sum(map(len, words)))
        words.append(h & ~np.uint64(1))
        pairs.append(text.together(h, at, (0, 1), 0xB16) | np.uint64(1))
        rows.append(found.doc + lo)
        n[lo:hi] = found.count
    join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
    return join(words, np.uint64), join(pairs, np.uint64), join(seconds, np.int64), join(rows, np.int64), n


def pack(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _counted(dealt: DataFrame, wanted: DataFrame, shards: int) -> DataFrame:
    """block, shard, target and every (the corpus' counts of the block's entries in the shard); words, n_target and n_every (sums of a shard, on one of its rows)."""

    def count(table: pa.Table, liked: pa.Table) -> pa.Table:
        names = ["block", "shard", "keys", "target", "every"]
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), *(pa.array([], pa.binary()) for _ in range(3))], names=names)
        words, pairs, second, rows, n = entries(*text.buffers(table.column("text")))
        ids = table.column("doc_id").combine_chunks()
        mask = np.isin(ids.fill_null(0).to_numpy(), liked.column("doc_id").to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
        keys, at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        every = np.bincount(at, minlength=len(keys))
        target = np.bincount(at[np.concatenate([mask[rows], mask[rows[second]]])], minlength=len(keys))
        cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
        full = np.flatnonzero(np.diff(cut))
        parts = [slice(cut[s], cut[s + 1]) for s in full]
        packed = [[pack(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], [pack(target[p]) for p in parts], [pack(every[p]) for p in parts]]
        return pa.table([pa.array([table.column(_KEY)[0].as_py()] * len(full), pa.int64()), pa.array(full, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=names)

    def add(table: pa.Table) -> pa.Table:
        sent = [np.cumsum(unpack(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        keys, at = np.unique(np.concatenate(sent), return_inverse=True)
        sums = []
        for side in ("target", "every"):
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([unpack(x) for x in table.column(side).to_pylist()]).astype(np.int64))
            sums.append(total)
        cut = np.cumsum([0, *map(len, sent)])
        word = keys & np.uint64(1) == 0
        of_shard = [int(word.sum()), int(sums[0][word].sum()), int(sums[1][word].sum())]
        replies = [pa.array([pack(total[at[lo:hi]]) for lo, hi in zip(cut[:-1], cut[1:])], pa.binary()) for total in sums]
        once = [pa.array([x] + [0] * (len(sent) - 1), pa.int64()) for x in of_shard]
        return pa.table([table.column("block"), table.column("shard"), *replies, *once], names=["block", "shard", "target", "every", "words", "n_target", "n_every"])

    sent = dealt.groupBy(_KEY).cogroup(wanted.groupBy(_KEY)).applyInArrow(count, "block long, shard long, keys binary, target binary, every binary")
    return sent.groupBy("shard").applyInArrow(add, "block long, shard long, target binary, every binary, words long, n_target long, n_every long")


def score(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means over words) and score of every row of ``documents``.

    ``targets`` has the doc_id of target documents.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = 1 + size // BLOCK, 1 + size // SHARD
    # One shuffle of the texts: counting and scoring are parts of one plan and read the same exchange.
    dealt = rows.withColumn(_KEY, F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)))
    wanted = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    replies = _counted(dealt, wanted.withColumn(_KEY, F.pmod(F.xxhash64("doc_id"), F.lit(blocks))), shards)
    sums = replies.agg(*(F.sum(c).alias(c) for c in ("words", "n_target", "n_every")))  # one row
    answers = replies.drop("words", "n_target", "n_every").crossJoin(F.broadcast(sums))

    def run(table: pa.Table, given: pa.Table) -> pa.Table:
        word, pair, second, rows, n = entries(*text.buffers(table.column("text")))
        loss = [np.zeros(len(n)), np.zeros(len(n))]
        if len(word):
            at = np.unique(np.concatenate([word, pair]), return_inverse=True)[1]
            given = given.sort_by("shard")  # shards are ranges of keys, so their answers follow one another in the order of the keys
            vocabulary = max(1 << WORD_BITS, given.column("words")[0].as_py())
            for k, side in enumerate(("target", "every")):
                count = np.concatenate([unpack(x) for x in given.column(side).to_pylist()]).astype(np.float64)[at]
                seen, both = count[: len(word)], count[len(word) :]
                p = (seen + FLOOR) / (given.column(f"n_{side}")[0].as_py() + FLOOR * vocabulary)
                p[second] = (both + PULL * p[second]) / (seen[second - 1] + PULL)
                loss[k] = np.bincount(rows, -np.log(p), len(n)) / np.maximum(n, 1)
        none = n == 0
        return pa.table([table.column("doc_id"), pa.array(n), pa.array(loss[0], mask=none), pa.array(loss[1], mask=none), pa.array(loss[0] - loss[1])], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return dealt.groupBy(_KEY).cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB: words and pairs of words counted by themselves; six places, since sums of doubles depend on their order.
SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
x AS (SELECT r, doc_id, unnest(w) AS b, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS MATERIALIZED (SELECT r, b, lag(b) OVER (PARTITION BY r ORDER BY i) AS a, (t.doc_id IS NOT NULL)::INT AS liked FROM x LEFT JOIN t USING (doc_id)),
u AS MATERIALIZED (SELECT b, count(*)::DOUBLE AS ne, sum(liked)::DOUBLE AS nt FROM m GROUP BY b),
p AS (SELECT a, b, count(*)::DOUBLE AS ne, sum(liked)::DOUBLE AS nt FROM m WHERE a IS NOT NULL GROUP BY a, b),
s AS (SELECT sum(ne) + {FLOOR} * greatest({1 << WORD_BITS}, count(*)) AS e, sum(nt) + {FLOOR} * greatest({1 << WORD_BITS}, count(*)) AS t FROM u),
f AS (SELECT u.b, ne, nt, (ne + {FLOOR}) / e AS pe, (nt + {FLOOR}) / t AS pt FROM u, s),
l AS (
  SELECT r, CASE WHEN m.a IS NULL THEN f.pe ELSE (p.ne + {PULL} * f.pe) / (g.ne + {PULL}) END AS pe,
         CASE WHEN m.a IS NULL THEN f.pt ELSE (p.nt + {PULL} * f.pt) / (g.nt + {PULL}) END AS pt
  FROM m JOIN f ON f.b = m.b LEFT JOIN f g ON g.b = m.a LEFT JOIN p ON p.a = m.a AND p.b = m.b),
o AS (SELECT r, count(*) AS n, -avg(ln(pt)) AS lt, -avg(ln(pe)) AS le FROM l GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(lt, 6) AS target_loss, round(le, 6) AS background_loss, round(coalesce(lt - le, 0), 6) AS score
FROM d LEFT JOIN o USING (r)
"""
