"""Snapshots, versioned tables and the inverted index: what they write, undo, refuse and find."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators.postings import Postings
from tessella.operators.versions import VersionedTable
from tessella.plans import search
from tessella.sources.snapshots import Conflict, Snapshots


def size(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r))


def test_two_writers_conflict(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.latest() is None
    assert s.commit(None, {"n": 0}) == 0 and s.commit(0, {"n": 1}) == 1
    with pytest.raises(Conflict):
        s.commit(0, {"n": 2})
    assert s.read() == {"n": 1} and s.read(0) == {"n": 0} and s.latest() == 1
    assert not [f for f in os.listdir(tmp_path / "s" / "versions") if f.endswith(".tmp")]


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    first = [(i, f"v{i}", i % 7) for i in range(500)] + [(None, "null key", 1)]
    t.create(spark.createDataFrame(first, "k long, v string, at int").repartition(5))
    assert rows(t.read()) == sorted(first, key=lambda r: (r[0] is None, r))
    t.upsert(spark.createDataFrame([(3, "new", 9, "x"), (900, "added", 1, "x"), (None, "was null", 2, "x"), (3, "new", 9, "x")], "k long, v string, at int, extra string"))
    want = {r[0]: r for r in first} | {3: (3, "new", 9), 900: (900, "added", 1), None: (None, "was null", 2)}
    assert rows(t.read()) == sorted(want.values(), key=lambda r: (r[0] is None, r))
    t.upsert(spark.createDataFrame([(3, "late", 8), (4, "newer", 99), (5, "same", 5), (901, "other", 0)], "k long, v string, at int"), newer="at")
    want |= {4: (4, "newer", 99), 901: (901, "other", 0)}
    assert rows(t.read()) == sorted(want.values(), key=lambda r: (r[0] is None, r))
    t.delete(spark.createDataFrame([(0,), (4,), (12345,)], "k long"))
    for k in (0, 4):
        del want[k]
    assert rows(t.read()) == sorted(want.values(), key=lambda r: (r[0] is None, r))
    assert rows(t.read(0)) == sorted(first, key=lambda r: (r[0] is None, r))
    t.compact()
    assert rows(t.read()) == sorted(want.values(), key=lambda r: (r[0] is None, r))
    t.undo(0)
    assert rows(t.read()) == sorted(first, key=lambda r: (r[0] is None, r))
    assert [w for _, w in t.history()] == ["create", "upsert", "upsert", "delete", "compact", "undo to 0"]


def test_random_changes_against_a_dict(spark, tmp_path):
    rng = random.Random(3)
    t, want = VersionedTable(spark, str(tmp_path / "t"), ["a", "b"]), {}
    for i in range(200):
        want[i % 20, i // 20] = rng.random()
    t.create(spark.createDataFrame([(*k, v) for k, v in want.items()], "a int, b int, v double").repartition(3))
    past = [dict(want)]
    for _ in range(4):
        change = {(rng.randrange(25), rng.randrange(12)): rng.random() for _ in range(15)}
        t.upsert(spark.createDataFrame([(*k, v) for k, v in change.items()], "a int, b int, v double"))
        want |= change
        past.append(dict(want))
        gone = rng.sample(sorted(want), 5)
        t.delete(spark.createDataFrame(gone, "a int, b int"))
        for k in gone:
            del want[k]
        past.append(dict(want))
    for v, state in enumerate(past):
        assert rows(t.read(v)) == sorted((*k, x) for k, x in state.items())


def test_an_upsert_writes_what_it_changes(spark, tmp_path):
    root = tmp_path / "t"
    t = VersionedTable(spark, str(root), ["id"])
    t.create(spark.range(0, 100_000).select("id", F.md5(F.col("id").cast("string")).alias("v")).coalesce(4))
    before = size(root)
    t.upsert(spark.range(0, 100_000, 100).select("id", F.md5(F.lit("x")).alias("v")))
    assert size(root) - before < 0.05 * before
    with pytest.raises(Conflict):
        t.upsert(spark.range(5).select("id", F.lit("w").alias("v")), base=0)
    assert t.read().where(F.col("v") == F.md5(F.lit("x"))).count() == 1000


TEXTS = [(1, "The red house by the lake", "summer garden"), (2, "A house of red stones", "lake by the house"), (3, None, "red house red house"), (4, "boats", None), (None, "red", "red"), (5, "", "the red lake house")]


def lex(x):
    return F.split(F.lower(x), "[^a-z0-9]+")


def plain(docs, words, phrase):
    out = {}
    for i, *texts in docs:
        for w, t in zip("ad", texts):
            have = [x for x in __import__("re").split("[^a-z0-9]+", (t or "").lower()) if x] if t else []
            ok = all(x in have for x in words) and (not phrase or any(have[k : k + len(words)] == words for k in range(len(have))))
            if ok and i is not None and i not in out:
                out[i] = w
    return out


def test_postings_against_a_scan(spark, tmp_path):
    p = Postings(spark, str(tmp_path / "p"))
    frame = lambda docs: spark.createDataFrame(docs, "id long, a string, d string")
    p.add(frame(TEXTS).repartition(3), "id", {"a": "a", "d": "d"}, lex)
    terms = [(0, ["red"], False), (1, ["red", "house"], True), (2, ["house", "lake"], False), (3, ["zebra"], False), (4, ["red", "house", "red"], True)]

    def check(docs):
        found = {ix: {} for ix, _, _ in terms}
        for r in p.find(terms).collect():
            found[r.ix][r.row_id] = r.weight
        assert found == {ix: plain(docs, words, phrase) for ix, words, phrase in terms}

    check(TEXTS)
    changed = [(2, "nothing", None), (9, "red house", "x"), (4, "the red house", None)]
    p.add(frame(changed), "id", {"a": "a", "d": "d"}, lex, spark.createDataFrame([(1,)], "id long"))
    now = [r for r in TEXTS if r[0] not in (1, 2, 4)] + changed
    check(now)
    p.add(frame([(1, "red again", None)]), "id", {"a": "a", "d": "d"}, lex)
    check(now + [(1, "red again", None)])
    p.compact()
    check(now + [(1, "red again", None)])
    assert p.find([(0, ["red"], False)]).where("row_id = 3").first().rank == pytest.approx(1 + 0.6931, abs=1e-3)


def test_a_search_opens_only_files_of_its_lexemes(spark, tmp_path):
    p = Postings(spark, str(tmp_path / "p"))
    words = spark.range(2000).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.substring(F.md5((F.col("id") * 31 + i).cast("string")), 1, 6))).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        p.add(words, "id", {"a": "t"}, lex)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (segment,) = p._state()
    every = spark.read.parquet(segment["directory"]).count()
    one = words.first().t.split()[0]
    assert every >= 12 and len(p.files(segment, [one])) <= 2
    found = p.read([one])
    assert {r.row_id for r in found.collect()} == {r.id for r in words.where(F.array_contains(lex("t"), one)).collect()}


@pytest.mark.parametrize("fold", [True, False])
def test_search_is_the_same_with_an_index(spark, tmp_path, fold):
    docs = spark.createDataFrame([(1, "Gärden paths", "boats"), (2, "", "the gardens and boats at home"), (3, "boat house", "garden boat"), (4, None, None)], "id long, a string, d string")
    s = search.Sources(rows=docs, id="id", weights={"a": "a", "d": "d"}, fold=fold)
    with_index = search.indexed(s, str(tmp_path / "p"))
    for q in ("garden", "boat garden", '"boat house"', "boats 1962", "the", "home zebra", '"garden boat" house', '"at home"', "gardens boats"):
        assert rows(search.search(s, q)) == rows(search.search(with_index, q)), q
    ranked = search.search(with_index, "boats" if not fold else "boat", within=True).collect()
    assert [int(r.score) for r in ranked] == [int(r.score) for r in search.search(with_index, "boats" if not fold else "boat").collect()]
