"""Vector dedup against all pairs."""

import numpy as np

from floorloom.llm import embeddings


def brute(rows, link=0.9):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float32).astype(float)
    n_links, parent = {k: 0 for k in range(len(rows))}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(ok)
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            x, y = ok[keys[a]], ok[keys[b]]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= link:
                n_links[keys[a]] += 1
                n_links[keys[b]] += 1
                p, q = sorted((root(rows[keys[a]][0]), root(rows[keys[b]][0])))
                parent[q] = p
    return sorted((rows[k][0], n_links[k], None if rows[k][0] is None else root(rows[k][0])) for k in range(len(rows)) if rows[k][0] is not None)


def cases():
    r = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        c = r.normal(size=16)
        for _ in range(r.integers(1, 12)):
            rows.append((c + r.normal(size=16) * r.choice([0.02, 0.15, 0.3])).tolist())
    rows += [[1.0] * 16, [1.0] * 16, [2.0] * 16, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, None, [], [1.0, 0.0], [1.0, 0.1]]
    order = r.permutation(len(rows))
    return [(int(k), rows[i]) for k, i in enumerate(order)]


def test_against_all_pairs(spark):
    rows = cases()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_many_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PER_LIST", 16)
    monkeypatch.setattr(embeddings, "TILE", 8)
    rows = cases()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = {i: n for i, n, _ in brute(rows)}
    found, there = sum(r["n_links"] for r in got), sum(want.values())
    assert all(r["n_links"] <= want[r["vec_id"]] for r in got) and found >= 0.9 * there


def test_null_ids_and_empty_tables(spark):
    got = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["kept"]) for r in got if r["vec_id"] is not None) == [(1, 0, True)] and len(got) == 2
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_every_link_across_many_lists_of_low_rank(spark, monkeypatch):
    """Vectors of four intrinsic dimensions: most links run across lists, and most of those have an end far from the border."""
    monkeypatch.setattr(embeddings, "PER_LIST", 16)
    monkeypatch.setattr(embeddings, "TILE", 32)
    r = np.random.default_rng(5)
    low = r.normal(size=(600, 4)) @ np.linalg.qr(r.normal(size=(64, 4)))[0].T
    unit = (low / np.linalg.norm(low, axis=1)[:, None]).astype(np.float32)
    x = unit.astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    links = x @ x.T / np.outer(norm, norm) >= 0.9
    want = links.sum(axis=1) - 1
    got = embeddings.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(unit)], "vec_id long, embedding array<float>")).collect()
    assert want.sum() > 1000
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))
