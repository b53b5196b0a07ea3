"""Decontamination against a scan of all windows."""

import random
import re

import pytest

from floorloom.llm import decontaminate


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=13):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for name, text in items:
            b = words(text)
            n = min(size, len(b))
            for s in range(len(b) - n + 1 if b else 0):
                g = b[s : s + n]
                for k in range(len(w) - n + 1):
                    if w[k] == g[0] and w[k : k + n] == g:
                        hit.update(range(k, k + n))
                        found.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases():
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice(["the", "of", "Cat", "é", "x1", "dog", "run", "Ü", "q"]) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(k, prose(r.randint(1, 40))) for k in range(12)] + [(20, "Alpha beta"), (21, ""), (22, None), (23, "... !!"), (None, "gamma delta"), (24, "the the the the the the the the the the the the the the"), (3, "again " + "word " * 13)]
    docs = [(k, prose(r.randint(0, 80))) for k in range(40)]
    docs += [(100 + k, prose(r.randint(0, 300)) + " " + (t or "").upper() + " " + prose(9)) for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "alpha, BETA!"), (203, "the " * 60), (202, "alpha, BETA!"), (204, "gamma-delta " + "w " * 39), (205, "gamma-delta " + "w " * 38), (None, "alpha beta")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 18, 40])
def test_against_brute_force(spark, block):
    docs, items = cases()
    got = decontaminate.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=str) == brute(docs, items)


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "i", 9)], "doc_id long, text string, items string, item long")
    row = decontaminate.judge(docs, spark.createDataFrame([], "item_id long, text string")).first()
    assert (row["n_words"], row["n_hit"], row["items"], row["contaminated"], row["item"]) == (2, 0, [], False, 9)
    assert decontaminate.judge(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
