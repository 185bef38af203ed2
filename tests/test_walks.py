"""Bursts and the limiter against plain walks, with keys that go over many tasks, and in bounded memory."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import walks, windows

AT = dt.datetime(2024, 1, 1)


def plain_bursts(rows, window, least, most_bits):
    out, by_key = {}, {}
    for r in rows:
        if r[1] is not None:
            by_key.setdefault(r[0], []).append(r)
    for each in by_key.values():
        each.sort(key=lambda r: (r[1], r[2]))
        i = 0
        while i < len(each):
            group = [r for r in each[i:] if (r[1] - each[i][1]).total_seconds() <= window]
            close = all((a[3][0] ^ b[3][0]).bit_count() <= most_bits for a in group for b in group)
            if len(group) >= least and close:
                for r in group:
                    out[r[2]] = (group[0][2], len(group), (group[-1][1] - group[0][1]).total_seconds())
                i += len(group)
            else:
                i += 1
    return out


def some_rows(n, seed):
    rng, rows, t = random.Random(seed), [], AT
    for i in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 0.3, 0.5, 1, 1.9, 2.0, 2.1, 9]))
        rows.append((rng.choice(["hot"] * 8 + ["x", None]), t if rng.random() > 0.02 else None, i, [rng.choice([0, 1, 3, 7, 255])]))
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=[1, 9])
def parts(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("bits,seed", [(64, 1), (2, 2)])
def test_bursts(spark, parts, bits, seed):
    rows = some_rows(400, seed)
    df = spark.createDataFrame(rows, "k string, t timestamp, i long, h array<long>").repartition(4)
    got = {r.id: (r.burst, r["size"], round(r.span, 6)) for r in windows.bursts(df, ["k"], "t", "i", 2.0, 3, "h", bits).collect()}
    assert got == plain_bursts(rows, 2.0, 3, bits) and len(got) > 40


def test_limiter(spark, parts):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "y"]), AT + dt.timedelta(seconds=rng.randrange(4000)), i) for i in range(500)]
    want, kept = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        own = kept.setdefault(k, [])
        live = [x for x in own if (t - x).total_seconds() < 60]
        ok = len(live) < 4
        want[i] = (k, ok, 0 if ok else int(-(-(60 - (t - live[-4]).total_seconds()) // 1)))
        own += [t] * ok
    got = {r.id: (r.k, r.ok, r.retry_after) for r in windows.admitted(spark.createDataFrame(rows, "k string, t timestamp, i long"), "k", "t", "i", 4, 60).collect()}
    assert got == want and 0 < sum(ok for _, ok, _ in want.values()) < 500


def test_a_hot_key_goes_to_many_tasks_and_a_session_over_several(spark, parts):
    rows = spark.range(5000).select(F.lit("hot").alias("k"), (F.col("id") * 1000 + F.when(F.col("id") >= 4000, 10_000_000).otherwise(0)).alias("t"), "id")
    found = walks.sessions(rows, ["k"], 5000)
    assert [r["count"] for r in found.groupBy("session").count().orderBy("count").collect()] == [1000, 4000]
    assert found.select(F.spark_partition_id()).distinct().count() >= min(parts, 3)


def test_a_walk_holds_one_window(spark):
    import pyarrow as pa

    held = []

    def batches():
        for lo in range(0, 200_000, 10_000):
            n = range(lo, lo + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array([1] * 10_000), pa.array([i * 500_000 for i in n]), pa.array(list(n))], ["session", "t", "id"])

    for out in walks.burst_walk(2_000_000, 3, 4)(batches()):
        held.append(out.num_rows)
    assert sum(held) == 200_000 and max(held) <= 10_010
