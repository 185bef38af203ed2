"""Streaming operators over files, run until nothing is left."""

import json

from tessella.streaming import collect


def lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def run(df, name, mode, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_limiter_keeps_state_between_batches(spark, tmp_path):
    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}"
    lines(tmp_path / "in", "1.json", [{"u": 1, "t": at(0)}, {"u": 1, "t": at(10)}, {"u": 1, "t": at(20)}, {"u": 2, "t": at(5)}])
    lines(tmp_path / "in", "2.json", [{"u": 1, "t": at(65)}, {"u": 1, "t": at(66)}])
    stream = collect.results_stream(spark, str(tmp_path / "in"), "u long, t timestamp", files_per_batch=1)
    got = sorted((r.u, r.t.minute * 60 + r.t.second, r.ok) for r in run(collect.limited(stream, "u", "t", 2, 60), "limited", "append", tmp_path / "ck").collect())
    assert got == [(1, 0, True), (1, 10, True), (1, 20, False), (1, 65, True), (1, 66, False), (2, 5, True)]


def test_newest_row_wins_whatever_the_order(spark, tmp_path):
    lines(tmp_path / "in", "1.json", [{"k": 1, "t": "2024-01-02T00:00:00", "v": "new"}, {"k": 2, "t": "2024-01-01T00:00:00", "v": "a"}])
    lines(tmp_path / "in", "2.json", [{"k": 1, "t": "2024-01-01T00:00:00", "v": "old"}])
    stream = collect.results_stream(spark, str(tmp_path / "in"), "k long, t timestamp, v string", files_per_batch=1)
    got = {r.k: r.v for r in run(collect.newest(stream, ["k"], "t", "30 days"), "newest", "complete", tmp_path / "ck").collect()}
    assert got == {1: "new", 2: "a"}


def test_lines_are_appended(spark, tmp_path):
    lines(tmp_path / "in", "1.json", [{"ref": "a"}, {"ref": "b"}])
    stream = collect.results_stream(spark, str(tmp_path / "in"), "ref string")
    collect.append_lines(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.ref for r in spark.read.schema("ref string").json(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_queue(spark):
    q = spark.createDataFrame([("b", "describe", "open"), ("a", "describe", "open"), ("c", "classify", "open"), ("d", "classify", "done")], "name string, kind string, status string")
    assert [r.name for r in collect.resumable(q, ["classify", "describe"]).collect()] == ["c", "a", "b"]
    inbox = spark.createDataFrame([("x",), ("y",)], "ref string")
    assert [r.ref for r in collect.pending(inbox, spark.createDataFrame([("x",)], "ref string")).collect()] == ["y"]


def test_a_row_that_fails_fails_alone(spark):
    got = []

    def run(batches):
        for b in batches:
            assert len(b) <= 5
            if (b.id == 13).any():
                raise ValueError("unlucky")
            yield b.assign(v=b.id * 2)

    collect.Job("half", lambda s: s.range(30).repartition(2), run, "id long, v long", lambda df: got.extend(df.collect()), ("id",)).go(spark, 5)
    assert sorted((r.id, r.v) for r in got if r.error is None) == [(i, i * 2) for i in range(30) if i != 13]
    assert [(r.id, r.v, r.error) for r in got if r.error] == [(13, None, "ValueError: unlucky")]


def test_pools_end_where_they_began(spark):
    with collect.pool(spark, "pages"):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "pages"
        assert spark.range(3).count() == 3
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_zip_archives(spark, tmp_path):
    import zipfile

    from pyspark.sql import functions as F

    from tessella.sources import files

    rows = spark.range(200).select(F.concat(F.lit("1962/"), (F.col("id") % 190).cast("string"), F.lit(".jpg")).alias("destination"), F.when(F.col("id") != 7, F.concat(F.lit("pixels "), F.col("id").cast("string"))).alias("content"))
    m = files.zip_archives(rows, str(tmp_path / "zips"), 5).collect()
    assert sum(r.entries for r in m) == 199 and len(m) == 5
    found = {}
    for r in m:
        with zipfile.ZipFile(tmp_path / "zips" / r.archive) as z:
            assert z.testzip() is None and len(z.namelist()) == r.entries
            found |= {n: z.read(n) for n in z.namelist()}
    assert len(found) == 199 and {found["1962/3.jpg"], found["1962/3 (2).jpg"]} == {b"pixels 3", b"pixels 193"}
    first = {p.name: p.read_bytes() for p in (tmp_path / "zips").iterdir() if p.suffix == ".zip"}
    files.zip_archives(rows.repartition(3), str(tmp_path / "zips"), 5)
    assert first == {p.name: p.read_bytes() for p in (tmp_path / "zips").iterdir() if p.suffix == ".zip"}
