"""Operators that deal hot keys to many tasks give what their plain forms give."""

import random
import string

from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import graph, joins, merge, windows


def test_numbers_of_hot_and_null_kinds(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["cold", None]), i) for i in rnd.sample(range(10_000), 900)] + [("lone", 5)]
    df = spark.createDataFrame(rows, "kind string, i long").repartition(7)
    got = {(r.kind, r.i): r.n for r in windows.places_within(df, "kind", [F.col("i")], "n").collect()}
    want = {}
    for kind in {k for k, _ in rows}:
        want |= {(kind, i): n for n, i in enumerate(sorted(i for k, i in rows if k == kind), 1)}
    assert got == want
    assert windows.places_within(df.where("false"), "kind", [F.col("i")], "n").count() == 0


def test_samples_by_kind(spark):
    df = spark.range(103).select(F.when(F.col("id") < 60, "a").when(F.col("id") < 100, "b").alias("kind"), "id")
    got = [(r["rank"], r.kind, r.id) for r in windows.stratified(df, "kind", "id", 4, 9).collect()]
    assert got == [(1, None, 100), (1, "a", 0), (1, "b", 60), (2, None, 101), (2, "a", 15), (2, "b", 70), (3, None, 102), (3, "a", 30), (3, "b", 80)]


def test_look_alikes_equal_all_pairs(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 12))) for _ in range(150)]
    words += [w[:4] + "".join(rnd.choice(string.ascii_lowercase) for _ in range(6)) for w in words[:20]]
    words += ["large red box", "small red box", "", "!!", words[0], None]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    one = df.where("x is not null").distinct()
    for least in (0.3, 0.6):
        p = one.crossJoin(one.select(F.col("x").alias("y"))).where("x < y")
        want = {(r.x, r.y) for r in p.where(text.looks_alike(F.col("x"), F.col("y"), least)).collect()}
        assert {(r.x, r.y) for r in joins.look_alike_pairs(df, least).collect()} == want and len(want) > 20


def test_pairs_come_once(spark):
    """Near hashes agree in many bands; each pair is one row, whatever their bits."""
    rnd = random.Random(3)
    base = rnd.getrandbits(256)
    rows = [(0, f"{base:064x}"), (1, f"{base ^ 1:064x}"), (2, f"{base ^ (1 << 255) ^ (1 << 64):064X}"), (3, None), (4, f"{0:064x}"), (5, f"{(1 << 256) - 1:064x}")]
    df = spark.createDataFrame(rows, "id long, h string")
    assert sorted(map(tuple, graph.hamming_pairs(df, "id", "h", 10).collect())) == [(0, 1, 1), (0, 2, 2), (1, 2, 3)]


def test_ids_of_many_partitions_and_none(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(40)
    out = merge.next_ids(df, spark.range(3), "id", [F.col("k")], 10)
    assert {r.k: r.id for r in out.collect()} == {k: 10 + k for k in range(500)}
    assert merge.next_ids(df.where("false"), spark.range(30), "id", [F.col("k")], 10).count() == 0
