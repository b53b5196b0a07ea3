"""Substring dedup against a scan of all windows."""

import hashlib
import random

import numpy as np
import pytest

from floorloom.llm import suffixes


def brute(rows, length=50):
    """doc_id, n_bytes, n_removed, n_spans, sha256 by the definition; null ids are the largest."""
    first = {}
    key = lambda i: float("inf") if i is None else i
    texts = [(key(i), (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, _), (k, b) in zip(rows, texts):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < k:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé\0") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(40), prose(120)
    rows = [(k, prose(r.randint(0, 60))) for k in range(30)]
    rows += [(100 + k, prose(5) + passage + prose(r.randint(0, 9))) for k in range(12)]
    rows += [(200 + k, base[: r.randint(0, 200)] + "X" + base[r.randint(0, 50) :]) for k in range(12)] + [(300 + k, base) for k in range(8)]
    rows += [(400, "ab" * 400), (401, "ab" * 30), (402, "z" * 49), (403, "z" * 50), (404, "z" * 51), (405, "z" * 49), (406, None), (407, ""), (300, base), (None, base + "q"), (None, "new " * 30)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_texts_and_other_columns(spark):
    body = "é" * 30 + "tail of one document"
    rows = [(2, body, "s", 7), (1, body[:40] + "!", "t", 8), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n_bytes int")
    out = {r["doc_id"]: r for r in suffixes.dedup(df, texts=True).collect()}
    assert out[1]["text"] == rows[1][1] and out[3]["text"] is None and out[2]["block"] == "s"
    assert out[2]["n_bytes"] == len(body.encode()) and len(out[2]["text"].encode()) == len(body.encode()) - out[2]["n_removed"]


def test_empty_table(spark):
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_sorts_bytes():
    r = np.random.default_rng(0)
    rows = r.integers(0, 3, (500, 21)).astype(np.uint8)
    order = suffixes.multikey(rows)
    assert [bytes(rows[i]) for i in order] == sorted(bytes(x) for x in rows)
    lcp = suffixes.common(rows[order])
    for k in range(1, len(rows)):
        a, b = bytes(rows[order[k - 1]]), bytes(rows[order[k]])
        assert lcp[k] == next((i for i in range(21) if a[i] != b[i]), 21)


def test_marks_depend_on_content_only():
    r = np.random.default_rng(1)
    s = r.integers(97, 123, 400).astype(np.uint8)
    a, ha = suffixes.marks(s, np.array([0, 400]))
    pad = np.concatenate([r.integers(97, 123, 77).astype(np.uint8), s[100:150], r.integers(97, 123, 60).astype(np.uint8)])
    b, hb = suffixes.marks(pad, np.array([0, len(pad)]))
    inside = set(ha[(a >= 100) & (a + suffixes.GRAM <= 150)]) & set(hb)
    assert inside  # every string of 50 bytes shares a mark wherever it stands
