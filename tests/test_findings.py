"""Queries over small tables of the shapes that larger inputs have."""

from datetime import date, timedelta
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.functions import sql, text, values
from tessella.operators import cluster, graph, intervals, joins, postings, vectors
from tessella.plans import catalog
from tessella.streaming import keyed
from tests.compare import database, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def altered(spark, tmp_path):
    """altered(table=change): a folder of the small tables, some of them changed."""

    def build(**changes):
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            df = spark.read.parquet(f"{SF}/{t}.parquet")
            changes.get(t, lambda x: x)(df).coalesce(1).write.parquet(str(tmp_path / f"{t}.dir"))
            next((tmp_path / f"{t}.dir").glob("part-*.parquet")).rename(tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return build


def same(spark, folder, name):
    got = spark_rows(catalog.QUERIES[name](spark, folder))
    assert got == sql_rows(database(folder), catalog.ORACLE[name])
    return got[1]


def test_trailing_hour_takes_the_nearest_second(spark, altered):
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, (event_id div 2) * 10000 + (event_id % 2) * 3600.2 + 0.4)")
    assert len(same(spark, altered(events=lambda e: e.withColumns({"user_id": F.lit(1).cast("long"), "ts": at})), "ops1_trailing_hour")) > 900


def test_exclusions_of_parts_numbered_beyond_suppliers(spark, altered):
    assert len(same(spark, altered(lineitem=lambda li: li.withColumn("l_partkey", F.col("l_partkey") + 99_950)), "set7_exclusions")) > 1000


def test_overlaps_are_counted_without_pairs(spark):
    rng, day = Random(3), lambda n: None if n is None else date(1990, 1, 1) + timedelta(n)
    draw = lambda: [rng.choice([None, *range(40)]) for _ in range(2)]
    rows, spans = [draw() for _ in range(60)], [draw() for _ in range(60)]
    lo, hi = lambda x: -1 if x[0] is None else x[0], lambda x: 99 if x[1] is None else x[1]
    for ordered in (False, True):
        take = lambda some: [x for x in some if not ordered or lo(x) <= hi(x)]
        want = {i: n for i, s in enumerate(take(spans)) if (n := sum(lo(r) <= hi(s) and hi(r) >= lo(s) for r in take(rows)))}
        r = spark.createDataFrame([(day(a), day(b)) for a, b in take(rows)], "lo date, hi date")
        s = spark.createDataFrame([(i, day(a), day(b)) for i, (a, b) in enumerate(take(spans))], "ix int, q_lo date, q_hi date")
        assert {x.ix: x.n for x in intervals.overlap_counts(r, "lo", "hi", s).collect()} == want


def joined(df):
    """Rows of df, and how many the joins on the way to them made at most."""
    rows, todo, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        else:
            if "Join" in p.nodeName() or "CartesianProduct" in p.nodeName():
                most = max(most, p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, most


def test_faces_and_regions_meet_by_different_boxes(spark):
    box = lambda x, y, w: values.box(x / 10.0, y / 10.0, F.lit(w), F.lit(w))
    faces = spark.range(2000).select(F.lit(1).alias("k"), "id", box(F.col("id") % 5, F.col("id") % 4, 0.2).alias("box"))
    regions = spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("r_id"), box(F.col("id") % 6 * 2, F.col("id") % 3 * 2, 0.3).alias("r_box")).where("r_id not in (12, 24)")
    one = regions.where("r_id < 6 or r_id = 8")
    rows, most = joined(joins.assigned(faces, regions.unionByName(one.where("false")), "k"))
    assert len(rows) == 2000 and most <= 10_000
    assert {r.r_id for r in rows} == {None}  # a second region of the same box is always there
    assert {r.r_id for r in joins.assigned(faces, one.where("r_id in (0, 8)"), "k").collect()} == {0, 8, None}


def test_overlapping_boxes_of_a_key_are_multiplied(spark):
    spot = [((i * 7 % 5) / 10, (i * 3 % 4) / 10) for i in range(300)]
    rows = spark.createDataFrame([(i % 2, x, y) for i, (x, y) in enumerate(spot)], "k int, x double, y double").select("k", values.box(F.col("x"), F.col("y"), F.lit(0.2), F.lit(0.2)).alias("b"))
    side = lambda a, b: max(min(a + 0.2, b + 0.2) - max(a, b), 0.0)
    want = {k: sum(side(a[0], b[0]) * side(a[1], b[1]) > 0.02 * (0.2 * 0.2) for i, a in enumerate(spot[k::2]) for b in spot[k::2][:i]) for k in (0, 1)}
    got, most = joined(joins.overlapping_pairs(rows, "k", "b", 0.02))
    assert {r.k: r.n for r in got} == want and most <= 500 < min(want.values())


def test_brute_pairs_are_dealt_to_tasks(spark):
    h = lambda n: spark.range(n).coalesce(1).select("id", F.lpad(F.hex("id"), 64, "0").alias("h"))
    p = graph.brute_pairs(h(64), "id", "h", 1)
    assert {(r.a, r.b) for r in p.collect()} == {(a, b) for b in range(64) for a in range(b) if (a ^ b).bit_count() <= 1}
    assert graph.brute_pairs(h(40_000), "id", "h", 1).rdd.getNumPartitions() >= 8
    plan = graph.brute_pairs(h(110_000), "id", "h", 1)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan


def test_accepted_lines_are_joined_once(spark):
    df = catalog.QUERIES["api13_accept"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def near_hashes(spark, n=400):
    """Hashes of which many are alike in most bits, so that some band values have most of the rows."""
    rng = Random(5)
    base, rows = rng.getrandbits(256), {}
    while len(rows) < n:
        x = base if len(rows) % 4 else rng.getrandbits(256)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(256)
        rows.setdefault(x, len(rows))
    ids = [3 * i % n for i in range(n)] if n % 3 else list(range(n))
    got = {ids[i]: x for x, i in rows.items()}
    df = spark.createDataFrame([(i, f"{x:064x}") for i, x in got.items()], "id long, h string")
    return df, {(a, b): d for b in got for a in got if a < b and (d := (got[a] ^ got[b]).bit_count()) <= 15}


def test_near_hashes_of_large_buckets_meet_in_blocks(spark, monkeypatch):
    df, pairs = near_hashes(spark)
    want = sorted((a, b, d) for (a, b), d in pairs.items() if d <= 10)
    for block, dealt in ((20, 50), (graph.BLOCK, graph.DEALT)):
        monkeypatch.setattr(graph, "BLOCK", block)
        monkeypatch.setattr(graph, "DEALT", dealt)
        found = graph.hamming_pairs(df, "id", "h", 10)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 1000
        assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 2


def test_first_near_misses_do_not_make_all_pairs(spark, monkeypatch):
    df, pairs = near_hashes(spark)
    ways, made = {"low": (11, 15, 50), "few": (11, 15, 10**6), "mixed": (15, 15, 300), "none": (1, 1, 50)}, []
    plain = graph.hamming_pairs
    monkeypatch.setattr(graph, "hamming_pairs", lambda *a: made.append(a[-1]) or plain(*a))
    for low, high, limit in ways.values():
        want = sorted((d, a, b) for (a, b), d in pairs.items() if low <= d <= high)[:limit]
        for first in (3, 100, 1000):
            made.clear()
            got = graph.first_near_misses(df, "id", "h", low, high, limit, first)
            assert [(r.distance, r.a, r.b) for r in got.collect()] == want
            assert not made or first < 1000
            if (low, limit, first) == (11, 50, 100):
                assert not made


def test_search_tokens_are_split_and_joined(spark):
    said = [None, "", " ", "'", "a", "  Éva-O'Neil (née Löw) ", "x\ty\n z", "ÀÿŻ!ß9", "日本 a 語", "--a--", "İstanbul", "𝒳 b", "a" * 5000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").coalesce(1)
    old = F.trim(F.regexp_replace(text.unaccent(F.lower("x")), "[^a-z0-9']+", " "))
    sql.register(spark)
    new = df.select("i", text.search_token(F.col("x")).alias("token"))
    want = {r.i: r.token for r in df.select("i", F.when(old != "", old).alias("token")).collect()}
    assert {r.i: r.token for r in new.collect()} == want
    assert {r.i: r.token for r in df.selectExpr("i", "search_token(x) as token").collect()} == want
    assert "regexp_replace" not in new._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_is_sorted_by_as_many_tasks_as_its_texts_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "WORDS", 7)
    docs = [(i, " ".join(f"w{i * k % 11}" for k in range(i % 9)) + ("  the end" if i % 3 else ""), None if i % 4 else "the w1") for i in range(200)] + [(7, "w1 w1 again", None), (None, "w1", "w1")]
    df = spark.createDataFrame(docs, "id long, body string, head string").coalesce(1)
    plain = lambda x: F.split(x, " ")
    want = {}
    for i, body, head in docs:
        for weight, x in (("b", body), ("a", head)):
            for k, w in enumerate(x.split(" ") if x and i is not None else ()):
                if w:
                    want.setdefault((w, weight, i), set()).add(k)
    for name, letters in (("one", postings.LETTERS), ("many", 100)):
        monkeypatch.setattr(postings, "LETTERS", letters)
        index = postings.Postings(spark, str(tmp_path / name))
        index.add(df, "id", {"b": "body", "a": "head"}, plain)
        state = index._state()[0]
        found = spark.read.parquet(state["path"]).collect()
        assert {(r.lexeme, r.weight, r.row_id): r.positions for r in found} == {k: sorted(v) for k, v in want.items()} and len(found) == len(want)
        held = spark.read.parquet(state["directory"]).collect()
        assert sum(r.n for r in held) == len(want) and min(r["first"] for r in held) == "again" and max(r["last"] for r in held) == "w9"
    assert len(held) > 10


def plain_prototypes(x, most=5, rounds=20):
    n = len(x)
    if n <= 2:
        return [(n, x.mean(axis=0))]
    k = min(most, max(2, n // 4))
    c = x[np.linspace(0, n - 1, k).astype(int)]
    for _ in range(rounds):
        label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.stack([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
    return [(int((label == i).sum()), c[i]) for i in range(k)]


def test_prototypes_look_at_some_vectors_at_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    own = {o: rng.normal(size=(n, 6)).astype(np.float32) for o, n in ((1, 1), (2, 2), (3, 3), (4, 90))}
    rows = [(o, i, v.tolist()) for o, x in own.items() for i, v in enumerate(x)] + [(3, 99, None), (5, 1, None)]
    df = spark.createDataFrame(rows, "owner int, id long, v array<float>").repartition(3)
    for at_once in (7, cluster.AT_ONCE):
        monkeypatch.setattr(cluster, "AT_ONCE", at_once)
        got = cluster.prototypes(df, "owner", "id", "v").collect()
        for o, x in own.items():
            want, mine = plain_prototypes(x.astype(float)), [(r.n, r.vector) for r in got if r.owner == o]
            assert [n for n, _ in mine] == [n for n, _ in want] and np.allclose([v for _, v in mine], [v for _, v in want])
        assert {r.owner for r in got} == set(own)


def shuffled_bytes(spark):
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_links_shuffle_what_grows_as_the_vectors_do(spark, monkeypatch):
    for module, name, value in ((vectors, "VECTORS", 20), (vectors, "QUERIES", 10), (cluster, "LEAST", 20), (cluster, "BLOCKS", 4)):
        monkeypatch.setattr(module, name, value, raising=False)
    wrote = []
    for n in (200, 800):
        x = np.random.default_rng(n).normal(size=(n, 32)).tolist()
        index = vectors.Index.build(spark.createDataFrame(list(enumerate(x)), "key long, vector array<double>"), 1)
        before = shuffled_bytes(spark)
        cluster.linked(index, 0.45).collect()
        wrote.append(shuffled_bytes(spark) - before)
    assert 0 < wrote[1] < 5 * wrote[0]  # four times the vectors; 16 times where all small blocks meet


def test_what_single_precision_leaves_open_is_decided_in_double(monkeypatch):
    monkeypatch.setattr(cluster, "AGAIN", 7)
    rng = np.random.default_rng(3)
    a = np.zeros((40, 8))
    a[:, 0] = 1
    b = rng.normal(size=(60, 8))
    b[:, 0] = 0
    side = np.sqrt(1 - 0.55**2)
    b = b / np.linalg.norm(b, axis=1, keepdims=True) * side
    b[:, 0] = 0.55 + np.linspace(-3e-7, 3e-7, 60)
    rows, near = cluster._within(a, b, 0.45)
    want = 1 - np.einsum("ij,kj->ik", a, b) <= 0.45
    assert 0 < want.sum() < want.size and rows.tolist() == list(range(40)) and (near == want).all()


def test_a_block_links_copies_and_two_blocks_only_what_is_near(monkeypatch):
    monkeypatch.setattr(cluster, "TILE", (3, 5))
    u = np.repeat(np.eye(4), 5, axis=0)
    for x, y in ((0, 0), (0, 1)):
        block = np.arange(20) % 2 if y else np.zeros(20, int)
        t = pa.table({"key": np.arange(20), "u": pa.array([r.tobytes() for r in u], pa.binary()), "block": block, "x": [x] * 20, "y": [y] * 20})
        got = cluster._block_forest(t, 0.1).to_pylist()
        assert sorted((r["a"] // 5, r["b"] // 5) for r in got) == [(k, k) for k in range(4) for _ in range(4)]


class CountedState:
    """A value state that counts what it is asked: each call is a round trip between Python and the JVM."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1


def test_once_asks_the_state_of_a_known_key_once():
    state, each = CountedState(), keyed._Once(100)
    each.init(state)
    row = lambda n, at: Row(id=n, **{keyed.AT: at * 1_000_000})
    asked = []
    for rows in ([row(1, 9), row(2, 5), row(3, 7)], [row(4, 6), row(5, 9)], [row(6, 300)]):
        before = state.calls
        asked.append(([r.id for r in each.handleInputRows(("k",), iter(rows), None)], state.calls - before, state.value))
    assert asked == [([2], 3, (9_000_000,)), ([], 1, (9_000_000,)), ([6], 2, (300_000_000,))]
