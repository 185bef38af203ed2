"""The line source: pruned folders, pieces that lose and double no line, and a stream that replays and then follows."""

import json
import os

import pytest

from tessella.sources.datasource import LineReader, LineStream, register

SCHEMA = "id long, day string, v string"


@pytest.fixture
def root(tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        os.makedirs(tmp_path / f"day={day}")
    return tmp_path


def append(root, day, name, rows, end="\n"):
    with open(root / f"day={day}" / f"{name}.jsonl", "a") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)


def test_batch_reads_are_pruned_and_whole(spark, root):
    register(spark)
    append(root, "2024-01-01", "a", [{"id": i, "v": "x" * (i % 50)} for i in range(200)])
    append(root, "2024-01-02", "b", [{"id": 1000, "v": "y"}, "no json", "[1]", "", {"id": 1001}])
    append(root, "2024-01-03", "c", [{"id": 2000}, {"id": 2001}], end="")  # the last line isn't ended
    read = lambda piece: spark.read.format("line_json").schema(SCHEMA).option("path", str(root)).option("piece", str(piece)).load()
    want = sorted([*((i, "2024-01-01", "x" * (i % 50)) for i in range(200)), (1000, "2024-01-02", "y"), (1001, "2024-01-02", None), (2000, "2024-01-03", None)])
    for piece in (7, 64, 1000, 1 << 20):
        assert sorted(map(tuple, read(piece).collect()), key=lambda r: r[0]) == want
    one = read(64).where("day = '2024-01-02' and id > 1000")
    assert [r.id for r in one.collect()] == [1001]


def test_only_folders_of_the_days_are_listed_as_partitions(root):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import StructType

    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        append(root, day, "a", [{"id": 1}] * 10)
    reader = LineReader({"path": str(root), "piece": "40"}, StructType())
    left = list(reader.pushFilters([In(("day",), ("2024-01-02", "2024-01-03")), EqualTo(("day",), "2024-01-03"), GreaterThan(("id",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert {p.day for p in reader.partitions()} == {"2024-01-03"} and len(reader.partitions()) == 3


def test_offsets_end_at_line_ends(root):
    from pyspark.sql.types import StructType

    append(root, "2024-01-01", "a", [{"id": 1}, {"id": 2}], end='\n{"id"')
    stream = LineStream({"path": str(root), "piece": "5"}, StructType.fromDDL(SCHEMA))
    seen, start = [], stream.initialOffset()
    for _ in range(4):
        end = stream.latestOffset()
        seen += [r[0] for p in stream.partitions(start, end) for r in stream.read(p)]
        start = end
    assert seen == [1, 2]
    append(root, "2024-01-01", "a", [": 3}"])
    end = stream.latestOffset()
    assert [r[0] for p in stream.partitions(start, end) for r in stream.read(p)] == [3]
    again = LineStream({"path": str(root)}, StructType.fromDDL(SCHEMA))  # a restart: what the checkpoint says is handed over
    assert again.partitions(start, end) and [r[0] for p in again.partitions({}, end) for r in again.read(p)] == [1, 2, 3]
    assert again.latestOffset() == end


def test_a_stream_replays_and_then_follows(spark, root, tmp_path_factory):
    register(spark)
    out, checkpoint = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("checkpoint"))

    def run():
        s = spark.readStream.format("line_json").schema(SCHEMA).option("path", str(root)).option("piece", "200").load()
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
        return q

    ids = lambda: sorted(r.id for r in spark.read.schema(SCHEMA).parquet(out).collect())
    append(root, "2024-01-01", "a", [{"id": i} for i in range(60)])
    q = run()
    try:
        q.processAllAvailable()
        for n in range(60, 80):
            append(root, f"2024-01-0{1 + n % 3}", "a" if n % 2 else "b", [{"id": n}])
        q.processAllAvailable()
    finally:
        q.stop()
    append(root, "2024-01-02", "late", [{"id": n} for n in range(80, 90)])
    q = run()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert ids() == list(range(90))
