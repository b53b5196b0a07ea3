"""Near-duplicates against all pairs of sets."""

import random
import re

import numpy as np

from floorloom.llm import setsketch


def elements(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, link=85):
    sets = [(i, elements(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= link * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted(((i, len(x), root(i), root(i) == i) for i, x in sets if i is not None), key=str)


def corpus(seed=2):
    r = random.Random(seed)
    prose = lambda n: [f"w{r.randint(0, 4000)}" for _ in range(n)]
    rows = []
    for family in range(6):
        base = prose(r.randint(60, 400))
        for k in range(14):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 6, 12])):
                w[r.randrange(len(w))] = f"z{r.randint(0, 10**6)}"
            rows.append(" ".join(w))
        rows.append(" ".join(base).upper() + "\n")
    chain = prose(300)  # neighbours link, the ends don't
    for k in range(8):
        rows.append(" ".join(chain[: 300 - 4 * k] + [f"c{k}x{j}" for j in range(4 * k)]))
    rows += ["one two", "ONE\ttwo", "one", "", "   ", None, None, "a b c d e", "a b c d e"] + [" ".join(prose(r.randint(1, 90))) for _ in range(60)] + [" ".join(prose(30000))]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = corpus()
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_pairs_without_a_hub_are_found(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "TILE", 3)
    rows = corpus(9)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, "something else that is quite different here"), (5, text), (None, text), (7, None)]
    got = sorted(map(tuple, setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 4, 1, True), (1, 3, 1, True), (5, 4, 1, False), (None, 4, None, True), (7, 0, 7, True)], key=str)
    assert setsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_elements_that_differ_in_few_bits(monkeypatch):
    """Sets keep elements apart whose hashes agree in their leading bits, and common elements are found by both hashes."""
    near = np.array([5 << 20, (5 << 20) + 1, 5 << 20], np.uint64)
    monkeypatch.setattr(setsketch.text, "together", lambda h, at, steps, salt: near[: len(at)])
    data = np.frombuffer(b"a b c d e f g", np.uint8)
    found, cut = setsketch.sets(data, np.array([0, len(data)]))
    assert found.tolist() == [5 << 20, (5 << 20) + 1] and cut.tolist() == [0, 2]
    x, y = np.array([[1, 1], [1, 2], [3, 3]], np.uint64), np.array([[1, 2], [3, 4]], np.uint64)
    a, b = setsketch.numbered(x, y)
    assert np.intersect1d(a, b).tolist() == [a[1]] and setsketch.shared_elements([x], [y]).tolist() == [[1]]


def test_registers_estimate_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 52, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], r.integers(0, 1 << 52, 100).astype(np.uint64)])
    both = setsketch.registers(setsketch.minima(np.concatenate([a, b]), np.array([0, 1000, 2000]), m=4000))
    assert abs((both[0] == both[1]).mean() - 900 / 1100) < 0.03
    union = setsketch.registers(setsketch.minima(np.concatenate([a, b[900:]]), np.array([0, 1100]), m=4000))
    assert (union[0] == np.maximum(both[0], both[1])).all()  # mergeable


def test_likelihood_keeps_links():
    n = np.array([1000.0])
    assert setsketch.likely(n, n, np.array([8]), np.array([8]), np.array([84]))[0]
    assert not setsketch.likely(n, n, np.array([45]), np.array([45]), np.array([10]))[0]
    assert not setsketch.likely(n, n * 2, np.array([5]), np.array([5]), np.array([90]))[0]  # sizes alone forbid it
