"""Queries without SQL against plain versions over a whole small table."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cluster
from tessella.plans import catalog, q_merge
from tessella.session import Tables

SF = "/root/testdata/sf0.001"


def bits(x):
    return int(x, 16)


@pytest.fixture(scope="module")
def hashes(spark):
    return {r.doc_id: (r.hash, r.n_chars) for r in q_merge._hashes(Tables(spark, SF)).collect()}


def pairs(hashes, most):
    """Pairs of each hash's first document, and each further document of a hash with the first."""
    first = {}
    for i in sorted(hashes):
        if hashes[i][0] is not None:
            first.setdefault(hashes[i][0], i)
    reps = sorted(first.values())
    out = {(a, b): (bits(hashes[a][0]) ^ bits(hashes[b][0])).bit_count() for a in reps for b in reps if a < b}
    out = {p: d for p, d in out.items() if d <= most}
    return out | {(first[h], i): 0 for i, (h, _) in hashes.items() if h is not None and first[h] != i}


def test_hamming_pairs(spark, hashes):
    got = {(r.a, r.b): r.distance for r in catalog.QUERIES["join4_hamming_pairs"](spark, SF).collect()}
    assert got == pairs(hashes, 10) and len(got) > 5


def test_duplicate_groups(spark, hashes):
    near = pairs(hashes, 10)
    root = {i: i for p in near for i in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    members = defaultdict(list)
    for i in root:
        members[find(i)].append(i)
    want = {}
    for g, each in members.items():
        keeper = max(each, key=lambda i: (hashes[i][1], -i))
        least = min(d for (a, _), d in near.items() if find(a) == g)
        for i in each:
            own = [d for p, d in near.items() if i in p]
            direct = near.get((min(i, keeper), max(i, keeper)))
            want[i] = (g, keeper, len(each), 0 if i == keeper else direct if direct is not None else min(own), least)
    got = {r.id: (r.group, r.keeper, r["size"], r.edge, r.min_distance) for r in catalog.QUERIES["set6_duplicate_groups"](spark, SF).collect()}
    assert got == want


def test_near_misses(spark, hashes):
    want = sorted((d, *p) for p, d in pairs(hashes, 15).items() if 11 <= d <= 15)[:50]
    assert [(r.distance, r.a, r.b) for r in catalog.QUERIES["ops15_near_misses"](spark, SF).collect()] == want


def test_clusters_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    label = cluster.split_clusters(np.array([r.embedding for r in rows], float), 0.45)
    want = {int(i): int(ids[label == k].min()) for i, k in zip(ids, label)}
    assert {r.id: r.cluster for r in catalog.QUERIES["set11_clusters"](spark, SF).collect()} == want


def test_prototypes_are_means_of_their_own(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    own = defaultdict(list)
    for r in rows:
        own[r.label].append(np.array(r.embedding, float))
    got = defaultdict(list)
    for r in catalog.QUERIES["set13_prototypes"](spark, SF).collect():
        got[r.owner].append((r.n, np.array(r.vector)))
    assert set(got) == set(own)
    for k, each in got.items():
        assert sum(n for n, _ in each) == len(own[k]) and len(each) <= 5
        mean = sum(n * v for n, v in each) / len(own[k])
        assert np.allclose(mean, np.mean(own[k], axis=0), atol=1e-6)


def test_likely_owners(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    protos = [(r.owner, np.array(r.vector)) for r in cluster.prototypes(e, "label", "vec_id", "embedding").collect()]
    want = {}
    for c in range(7):
        m = np.mean([r.embedding for r in e.where(F.col("vec_id") % 7 == c).collect()], axis=0)
        d, owner = min((max(1 - float(m @ p / np.linalg.norm(m) / np.linalg.norm(p)), 0), o) for o, p in protos)
        if d <= 1.0:
            want[c] = (owner, round(d, 6))
    got = {r.cluster: (r.owner, round(r.distance, 6)) for r in catalog.QUERIES["set14_likely_owners"](spark, SF).collect()}
    assert got == want


def test_probed_neighbours_are_mostly_the_nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows}
    want = {(q, i) for q in x if q % 50 == 0 for _, i in sorted((round(1 - float(x[q] @ y) / np.linalg.norm(x[q]) / np.linalg.norm(y), 9), i) for i, y in x.items())[:5]}
    got = {(r.query_id, r.ref_id) for r in catalog.QUERIES["join8_probed"](spark, SF).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_sketched_levels_are_near_the_exact_ones(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_returnflag", "l_extendedprice", "l_orderkey").collect():
        rows[r[0]].append((r[1], r[2]))
    for r in catalog.QUERIES["fx21_sketched"](spark, SF).collect():
        prices = np.sort([p for p, _ in rows[r.l_returnflag]])
        assert r.n == len(prices) and abs(r.orders - len({o for _, o in rows[r.l_returnflag]})) <= 0.05 * r.orders
        for level, q in ((r.low, 0.01), (r.mid, 0.5), (r.high, 0.99)):
            assert abs(np.searchsorted(prices, level) / len(prices) - q) <= 0.01
