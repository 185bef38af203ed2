"""Sketches within their stated error, merged over days; exact levels against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import sketches

SF = "/root/testdata/sf0.1"


def test_days_merge_within_the_error(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_returnflag", F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_extendedprice")
    daily = sketches.sketched(rows, ["l_returnflag", "day"], ["l_orderkey"], ["l_extendedprice"])
    got = {r.l_returnflag: r for r in sketches.merged(daily, ["l_returnflag"]).select("*", sketches.distinct_count("hll_l_orderkey").alias("d"), *[sketches.level("kll_l_extendedprice", q).alias(f"q{i}") for i, q in enumerate((0.01, 0.5, 0.99))]).collect()}
    for r in rows.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("d"), F.count("*").alias("n"), F.array_sort(F.collect_list("l_extendedprice")).alias("v")).collect():
        own, v = got[r.l_returnflag], np.array(r.v)
        assert own.n == r.n and abs(own.d - r.d) <= 3 * 0.016 * r.d
        for x, q in ((own.q0, 0.01), (own.q1, 0.5), (own.q2, 0.99)):
            assert abs(np.searchsorted(v, x) / len(v) - q) <= 0.01


def test_nothing_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    got = {r.k: (r.d, r.q) for r in sketches.sketched(df, ["k"], ["v"], ["v"]).select("k", sketches.distinct_count("hll_v").alias("d"), sketches.level("kll_v", 0.5).alias("q")).collect()}
    assert got == {"a": (0, None), "b": (1, 2.0)}
    assert sketches.exact_level(df.limit(0), ["k"], "v", 0.5).collect() == []


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.995, 1.0])
def test_exact_levels(spark, q):
    rng = random.Random(7)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(6000)], "ties": [float(rng.choice([1, 1, 1, 2])) for _ in range(3000)], "one": [4.0], None: [1.0, 2.0, 5.0], "same": [3.0] * 2000}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("hot", None)], "k string, v double").repartition(4)
    got = {r.k: r.level for r in sketches.exact_level(df, ["k"], "v", q, few=150).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(float(np.quantile(vs, q)), abs=1e-12), (k, q)
