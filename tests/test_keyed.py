"""Keyed state: equal to plain walks over the arrivals, and bounded."""

import datetime as dt
import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.streaming import keyed

START = dt.datetime(2024, 1, 1)


def feed(spark, folder, batches):
    """A stream whose micro-batches are the given lists of (k, id, seconds)."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i:04d}.json").write_text("".join(json.dumps({"k": k, "id": n, "t": s if s is None else (START + dt.timedelta(seconds=s)).isoformat()}) + "\n" for k, n, s in rows))
        stamp = 1_700_000_000 + i
        os.utime(folder / f"{i:04d}.json", (stamp, stamp))
    return spark.readStream.schema("k string, id long, t timestamp").option("maxFilesPerTrigger", 1).json(str(folder))


def run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def arrivals(seed, batches, keys, lag, step):
    """Batches that each go on by `step` seconds, rows being up to `lag` seconds late."""
    rnd, out, n = random.Random(seed), [], 0
    for b in range(batches):
        rows = []
        for _ in range(12):
            n += 1
            rows.append((rnd.choice(keys), n, b * step + rnd.randrange(step) - rnd.randrange(lag)))
        out.append(rows)
    return [[(k, n, max(s, 0)) for k, n, s in rows] for rows in out]


def test_the_limiter_never_admits_too_many_and_equals_a_walk(spark, tmp_path):
    batches = arrivals(3, 4, ["a", "b", None], 50, 100)
    batches[1].append(("a", 999, None))
    got, _ = run(keyed.limited(feed(spark, tmp_path / "in", batches), "k", "t", "id", 2, 40, "1 hour"), tmp_path, "lim")
    admitted, want = defaultdict(list), {}
    for rows in batches:
        for k, n, s in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
            near = sorted(x for x in admitted[k] if s - 40 < x < s + 40)
            want[n] = (k, len(near) < 2, 0 if len(near) < 2 else near[-2] + 40 - s)
            if len(near) < 2:
                admitted[k].append(s)
    assert {r.id: (r.k, r.ok, r.retry_after) for r in got} == want and len(got) == 48
    assert all(sum(s - 40 < x <= s for x in xs) <= 2 for xs in admitted.values() for s in xs)
    with pytest.raises(ValueError):
        keyed.limited(feed(spark, tmp_path / "none", [[("a", 1, 1)]]), "k", "t", "id", 0, 40)


def test_newest_rows_as_a_feed(spark, tmp_path):
    batches = arrivals(5, 4, ["a", "b", None], 150, 100)
    got, _ = run(keyed.newest(feed(spark, tmp_path / "in", batches), ["k"], "t"), tmp_path, "new")
    best, want = {}, []
    for rows in batches:
        top = {}
        for k, n, s in rows:
            if s >= top.get(k, (best.get(k, -1),))[0]:
                top[k] = (s, n)
        best |= {k: s for k, (s, _) in top.items()}
        want += [(str(k), n) for k, (_, n) in top.items()]
    assert sorted((str(r.k), r.id) for r in got) == sorted(want)


def test_state_is_bounded_by_what_is_active(spark, tmp_path):
    """Each batch has keys of its own: state that never expired would hold a key of every batch."""
    batches = [[(f"k{b}-{i}", b * 5 + i, b * 3600 + i) for i in range(5)] for b in range(6)]
    got, held = run(keyed.newest(feed(spark, tmp_path / "in", batches), ["k"], "t", "10 minutes"), tmp_path, "bounded")
    assert len(got) == 30
    # a batch's keys live until the watermark that the batch after it is run with
    assert max(held) == 10 and held[-1] == 5


def test_delivered_again_applied_once_without_reading_the_target(spark, tmp_path):
    target, old = tmp_path / "target", tmp_path / "old"
    at = lambda s: START + dt.timedelta(seconds=s)
    seen = spark.createDataFrame([("a", 0, at(0)), ("a", 1, at(5))], "k string, id long, t timestamp")
    seen.write.parquet(str(target / "query=first" / "batch=0"))
    known = spark.read.schema("k string, id long, t timestamp").parquet(str(target / "query=first"))
    first = [[("a", 10, 10), ("b", 12, 20), ("b", 11, 15)], [("b", 13, 30), ("c", 14, 40), (None, 15, 41)], [(None, 16, 42), ("c", 17, 20)]]
    stream = keyed.once(feed(spark, tmp_path / "in", first), ["k"], "t", 86400, seen=known)
    q = keyed.deliver(stream, str(target), str(tmp_path / "ck"))
    q.awaitTermination(300)
    rows = lambda: sorted((str(r.k), r.id) for r in spark.read.schema("k string, id long, t timestamp").option("recursiveFileLookup", True).parquet(str(target)).collect())
    assert rows() == [("None", 15), ("a", 0), ("a", 1), ("b", 11), ("c", 14)]
    # the target is gone, and what comes again is still known
    target.rename(old)
    (tmp_path / "in" / "0009.json").write_text(json.dumps({"k": "b", "id": 90, "t": at(60).isoformat()}) + "\n" + json.dumps({"k": "d", "id": 91, "t": at(61).isoformat()}) + "\n")
    stream = keyed.once(spark.readStream.schema("k string, id long, t timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), ["k"], "t", 86400, seen=seen)
    keyed.deliver(stream, str(target), str(tmp_path / "ck")).awaitTermination(300)
    assert rows() == [("d", 91)]


def test_a_key_counts_again_after_its_horizon(spark, tmp_path):
    batches = [[("a", 1, 0)], [("a", 2, 90), ("z", 3, 90)], [("z", 4, 400)], [("z", 5, 500), ("a", 6, 501)]]
    got, _ = run(keyed.once(feed(spark, tmp_path / "in", batches), ["k"], "t", 100, "10 seconds"), tmp_path, "again")
    # a is back within 100 seconds, then after 411; z after 310, then after just 100
    assert sorted(r.id for r in got) == [1, 3, 4, 6]


def test_any_column_names(spark, tmp_path):
    s = feed(spark, tmp_path / "in", [[("a", 1, 5), ("a", 2, 3)]]).withColumnsRenamed({"k": "a key", "id": "micros", "t": "__at"}).withColumn("c0", F.lit(7))
    got = keyed.drained(keyed.once(s, ["a key"], "__at", 60), "names")
    assert got.columns == ["a key", "micros", "__at", "c0"] and [(r[0], r[1], r[3]) for r in got.collect()] == [("a", 2, 7)]


def test_empty_streams(spark, tmp_path):
    s = feed(spark, tmp_path / "in", [[("a", 1, None)]])
    got = keyed.drained(keyed.once(s, ["k"], "t", 60), "nothing")
    assert got.count() == 0 and got.columns == ["k", "id", "t"]
    assert got.select(F.count("*")).first()[0] == 0
