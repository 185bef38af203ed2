"""A deterministic sharded WARC writer and its reader.

Records are in order of their key and a hash of their payload. Their running sum of bytes, exact and the same whatever
Spark's partitioning, cuts them into shards of about equal size, each written by one task. A shard is sorted and written
as gzip members, rolling to a new file once the compressed size is reached. Files get temporary names; the manifest,
written by Spark's commit protocol, says which attempt counts; those are then renamed. Headers and digests are made anew.

Of records with equal payloads the one with the smallest key is a response, the others revisit it (rows that repeat
the smallest key are responses too). Null keys come last, and a null payload is empty. Record ids come from key, payload and
the number among rows that are equal in both, so rows of one key have different ids. Rows of equal key and payload share a
shard, through which they stream. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, skew_join, written

#: Bounds of a shard's payload bytes; the driver sees one row per shard.
LEAST_SHARD, MOST_SHARD = 16 << 20, 1 << 30
#: Payloads with copies are broadcast up to this many rows of about 60 bytes.
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, temporary string, records long, bytes long"


def _urn(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, number: int = 0) -> bytes:
    """One WARC/1.1 record, not compressed; `number` tells rows of equal key and payload apart. A revisit keeps the HTTP
    header, with the payload's full length."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(f"page:{page_id}:{sha1}:{number}"),
        "WARC-Date": DATE,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": _urn(f"page:{refers_to}:{sha1}:0"), "X-Refers-To-Page-ID": str(refers_to), "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Files:
    """The files of one task, rolled by compressed size."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.roll, self.out, self.done = roll_bytes, None, []

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.done.append((self.shard, self.name, self.temporary, self.records, self.bytes))
            self.out = None

    def add(self, shard: int, member: bytes) -> None:
        if self.out and (shard != self.shard or self.bytes >= self.roll):
            number = self.number + 1 if shard == self.shard else 0
            self.close()
        elif not self.out:
            number = 0
        else:
            number = None
        if number is not None:
            self.shard, self.number, self.records, self.bytes = shard, number, 0, 0
            self.name = f"shard-{shard:05d}-{number:05d}.warc.gz"
            self.temporary = f".{self.name}.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.out.write(member)
        self.records += 1
        self.bytes += len(member)


def _payload():
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def _narrow(pages: DataFrame) -> DataFrame:
    """page_id, h (hash of the payload), size, digest of every row, written: the payloads are read once for all of these."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), _payload().alias("html"))
    return written(p.select("page_id", F.xxhash64("html").alias("h"), F.octet_length("html").cast("long").alias("size"), F.sha1("html").alias("digest")), "records")


def resolved(pages: DataFrame, narrow: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html (bytes), h, refers_to (null for responses). Only ids and digests are shuffled here."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _payload().alias("html"))
    p = p.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html"), "h": F.xxhash64("html")})
    groups = narrow.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups, "payloads")
    if groups.count() <= BROADCAST_ROWS:
        joined = p.join(F.broadcast(groups), "digest", "left")
    else:
        joined = skew_join(p, groups, "digest", "n", narrow.count(), "left")
    other = F.col("first").isNotNull() & (F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "h", F.when(other, F.col("first")).alias("refers_to"))


def boundaries(narrow: DataFrame, shard_bytes: int | None = None) -> list[tuple[int | None, int]]:
    """The first (page_id, h) of each shard: where the running sum of bytes passes a multiple of shard_bytes (by default a
    thousandth of all, within bounds). A row per shard reaches the driver, and one per partition of the sorted records."""
    groups = narrow.groupBy("page_id", "h").agg(F.sum("size").alias("size"))
    groups = written(groups.orderBy(F.col("page_id").asc_nulls_last(), "h").withColumn("pid", F.spark_partition_id()), "sorted")
    before, offsets = 0, {}
    for pid, size in sorted(groups.groupBy("pid").agg(F.sum("size")).collect()):
        offsets[pid] = before
        before += size
    if not offsets:
        return []
    shard_bytes = shard_bytes or min(max(before // 1000, LEAST_SHARD), MOST_SHARD)
    at = groups.sparkSession.createDataFrame(list(offsets.items()), "pid int, before long")
    run = F.sum("size").over(Window.partitionBy("pid").orderBy(F.col("page_id").asc_nulls_last(), "h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # pid differs from sort to sort, the sum before a record doesn't
    shard = F.floor((F.col("before") + F.col("run") - F.col("size")) / shard_bytes)
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "h")
    first = groups.withColumn("run", run).join(F.broadcast(at), "pid").groupBy(shard.alias("shard")).agg(F.min(key).alias("k"))
    return [(r.k.page_id, r.k.h) for r in first.orderBy("shard").collect()]


def shard_of(ids: np.ndarray, none: np.ndarray, hashes: np.ndarray, first: list[tuple[int | None, int]]) -> np.ndarray:
    """The last shard whose first (page_id, h) isn't beyond a record's; null ids (`none`) are beyond all others."""
    known = np.array([i for i, _ in first if i is not None], np.int64)
    out = np.where(none, len(known), np.searchsorted(known, ids, "left"))
    # boundaries within one id, of which there are several where it has many bytes
    cuts: dict[int | None, list[int]] = {}
    for i, h in first:
        cuts.setdefault(i, []).append(h)
    for i in np.unique(ids[~none & np.isin(ids, known)]).tolist():
        rows = ~none & (ids == i)
        out[rows] += np.searchsorted(np.array(cuts[i]), hashes[rows], "right")
    out[none] += np.searchsorted(np.array(cuts.get(None, []), np.int64), hashes[none], "right")
    return np.maximum(out - 1, 0)


def write(pages: DataFrame, path: str, shard_bytes: int | None = None, roll_bytes: int = 128 << 20, min_bytes: int = 0) -> DataFrame:
    """Writes the archive below path and returns its manifest (shard, file, temporary, records, bytes)."""
    spark = pages.sparkSession
    narrow = _narrow(pages)
    first = boundaries(narrow, shard_bytes)

    def run(ids: pd.Series, none: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(shard_of(ids.to_numpy(), none.to_numpy(bool), h.to_numpy(), first).astype("int32"))

    # a column of numbers with nulls would reach Pandas as floats
    shard = F.pandas_udf(run, "int")(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNull(), "h")
    rows = resolved(pages, narrow, min_bytes).withColumn("shard", shard)
    by_key = F.col("page_id").asc_nulls_last()
    rows = rows.repartitionById(max(len(first), 1), "shard").sortWithinPartitions("shard", by_key, "h", "html", "url")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, last, number = _Files(f"{path}/archive", roll_bytes), None, 0
        for b in batches:
            for values in zip(*(b.column(i) for i in range(5))):
                page_id, url, html, refers, shard = (v.as_py() for v in values)
                number = number + 1 if last == (page_id, html) else 0
                last = page_id, html
                files.add(shard, _member(record(page_id, url, html, refers, number)))
        files.close()
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*files.done) if files.done else [[]] * 5, kinds)], ["shard", "file", "temporary", "records", "bytes"])

    rows.select("page_id", "url", "html", "refers_to", "shard").mapInArrow(task, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(f"{path}/archive")
        for b in batches:
            for name, temporary in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if fs.get_file_info(f"{folder}/{temporary}").type != pafs.FileType.NotFound:
                    fs.move(f"{folder}/{temporary}", f"{folder}/{name}")
            yield b

    manifest.mapInArrow(commit, MANIFEST).write.format("noop").mode("overwrite").save()
    return manifest


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip stream, read member by member; a member that is cut off is an error."""
    inflate, held, begun = zlib.decompressobj(31), b"", False
    body = io.BytesIO()
    while True:
        chunk = held or stream.read(1 << 20)
        if not chunk:
            if begun:
                raise ValueError("the last record is cut off")
            return
        begun = True
        body.write(inflate.decompress(chunk))
        held = inflate.unused_data
        if inflate.eof:
            head, _, rest = body.getvalue().partition(b"\r\n\r\n")
            names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield names, rest[: int(names["Content-Length"])]
            inflate, body, begun = zlib.decompressobj(31), io.BytesIO(), False


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of the files
    in the manifest, their digests and their numbers of records checked."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file", "records")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in schema.split(", ")]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(f"{path}/archive")
        for b in batches:
            for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for head, block in parse(f):
                        seen += 1
                        if head["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
                            raise ValueError(f"{name}: block digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and (len(payload) != size or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                            raise ValueError(f"{name}: payload digest")
                        rows.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, head["WARC-Target-URI"], size, digest, head["WARC-Type"], int(head["X-Refers-To-Page-ID"]) if revisit else None, None if revisit else payload))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name}: {seen} records, the manifest has {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names)

    return manifest.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(load, schema)


def report(pages: DataFrame, path: str | None = None) -> DataFrame:
    path = path or scratch(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
