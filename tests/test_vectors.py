"""The vector index against brute force, its recall, its plan; linkage in rounds against merging one pair at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cluster, joins, vectors

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k, most=None):
    """{query: [key]} by rounded distance, then key; the nearest of each key."""
    def distance(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(min(max(1 - float(a @ b) / n, 0), 2), 9) if n else 1.0

    out = {}
    for q, x in queries:
        best = {}
        for i, y in rows:
            d = distance(np.array(x), np.array(y))
            best[i] = min(best.get(i, 9), d)
        out[q] = sorted((d, i) for i, d in best.items() if most is None or d <= most)[:k]
    return out


def frame(spark, rows, key="key"):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], f"{key} long, vector array<double>")


@pytest.mark.parametrize("dim,cells,most", [(2, 1, None), (3, 12, None), (8, 20, 0.3), (8, 20, None)])
def test_exact_answers(spark, monkeypatch, dim, cells, most):
    monkeypatch.setattr(vectors, "VECTORS", 17)
    monkeypatch.setattr(vectors, "QUERIES", 5)
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(size=dim)) for i in range(250)] + [(500 + i, np.ones(dim)) for i in range(60)] + [(900 + i, np.zeros(dim)) for i in range(4)]
    rows += [(3, rng.normal(size=dim)), (3, rng.normal(size=dim))]  # a key with several vectors
    queries = [(i, x) for i, x in rows[:20]] + [(500, np.ones(dim)), (900, np.zeros(dim))]
    index = vectors.Index.build(frame(spark, rows).repartition(4), cells)
    got = {}
    for r in index.nearest(frame(spark, queries, "query"), 6, probes=2, most=most).orderBy("rank").collect():
        got.setdefault(r["query"], []).append((round(r.distance, 9), r.key))
    want = {q: x for q, x in brute(rows, queries, 6, most).items() if x}
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<double>")
    assert [(r.query_id, r.ref_id) for r in joins.nearest(df, df, 3).collect()] == [(1, 1)]
    assert joins.nearest(df.limit(0), df, 3).collect() == [] and joins.nearest(df, df.limit(0), 3).collect() == []


def test_recall_and_plan(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vectors.Index.build(e.withColumnRenamed("id", "key"), 16)
    q = e.withColumnRenamed("id", "query")
    exact = {(r["query"], r.key) for r in index.nearest(q, 5).collect()}
    some = index.nearest(q, 5, probes=10, exact=False)  # these vectors hardly cluster: 8 of 16 cells give 0.88
    found = {(r["query"], r.key) for r in some.collect()}
    assert len(exact) == 5 * e.count() and len(found & exact) >= 0.9 * len(exact)
    plan = some._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def points(seed, n, dim=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return centres[rng.integers(0, 6, n)] + rng.normal(0, 0.25, (n, dim))


@pytest.mark.parametrize("seed,n,cut,most", [(1, 60, 0.15, 300), (2, 90, 0.3, 20)])
def test_linkage_in_rounds_is_linkage(spark, monkeypatch, seed, n, cut, most):
    monkeypatch.setattr(vectors, "VECTORS", 25)
    x = points(seed, n)
    label = cluster.split_clusters(x, cut, most)
    want = {i: int(np.flatnonzero(label == label[i]).min()) for i in range(n)}
    df = frame(spark, enumerate(x), "id")
    for limit in (2000, 1):
        assert {r.id: r.cluster for r in cluster.clusters(df, "id", "vector", cut, most, in_one_task=limit).collect()} == want


def test_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS", 11)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    x = points(5, 120)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.Index.build(frame(spark, enumerate(x)), 9)
    edges = [(r.a, r.b) for r in cluster.linked(index, 0.05).collect()]

    def components(pairs):
        root = list(range(len(x)))
        for a, b in pairs:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
        return root

    near = [(a, b) for a in range(len(x)) for b in range(a) if 1 - u[a] @ u[b] <= 0.05]
    assert components(edges) == components(near) and len(edges) < len(near)
