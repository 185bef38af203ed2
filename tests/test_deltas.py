"""Aggregates after deltas against a rebuild, over random edits; and what folding reads."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import deltas

SCHEMA = "k string, v long, w long"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folded_is_rebuilt(spark, seed):
    rng = random.Random(seed)
    some = lambda: (rng.choice(["a", "b", "c", "d", None]), rng.choice([None, *range(6)]), rng.randrange(100))
    base = [some() for _ in range(40)]
    extremes = {"min": "v", "max": "v,w"}
    view = deltas.built(spark.createDataFrame(base, SCHEMA), ["k"], ["w", "v"], extremes)
    asked = []
    for _ in range(3):
        gone = rng.sample(range(len(base)), 12)
        new = [some() for _ in range(rng.randrange(10))]
        signed = [(*base[i], -1) for i in gone] + [(*r, 1) for r in new]
        base = [r for i, r in enumerate(base) if i not in gone] + new
        now = spark.createDataFrame(base, SCHEMA)

        def refill(keys, now=now):
            asked.append(keys.count())
            return now.join(keys.withColumnRenamed("k", "kk"), F.col("k").eqNullSafe(F.col("kk")), "left_semi")

        view = deltas.folded(view, spark.createDataFrame(signed, SCHEMA + ", sign int"), ["k"], ["w", "v"], extremes, refill)
        view = spark.createDataFrame(view.collect(), view.schema)
        assert rows(view) == rows(deltas.built(now, ["k"], ["w", "v"], extremes))
    assert asked


def test_counts_need_no_base(spark):
    base = spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"), F.col("id").alias("v"))
    view = deltas.built(base, ["k"], ["v"])
    change = spark.createDataFrame([("1", 1, -1), ("9", 5, 1), ("2", 2, -1)], "k string, v long, sign int")
    stored = spark.createDataFrame(view.collect(), view.schema)
    out = deltas.folded(stored, change, ["k"], ["v"])
    got = {r.k: (r.n, r.sum_v) for r in out.collect()}
    before = {r.k: (r.n, r.sum_v) for r in view.collect()}
    assert got == before | {"1": (before["1"][0] - 1, before["1"][1] - 1), "9": (1, 5), "2": (before["2"][0] - 1, before["2"][1] - 2)}
    assert "Range" not in out._jdf.queryExecution().toString()


def test_a_lost_extreme_without_refill_is_an_error(spark):
    view = deltas.built(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v long"), ["k"], extremes={"min": "v"})
    with pytest.raises(ValueError):
        deltas.folded(view, spark.createDataFrame([("a", 1, -1)], "k string, v long, sign int"), ["k"], extremes={"min": "v"})
