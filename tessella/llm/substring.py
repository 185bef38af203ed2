"""Substring dedup with a log-structured index of window hashes.

A window is `size` consecutive words of one document. It is known by two hashes of different word hashes: its anchor,
the least of the hashes of the shorter runs of words inside it, and a check hash of all its words. Equal windows have
equal anchors, and neighbouring windows mostly share theirs, so that a document names an anchor once for several windows.

A batch of documents becomes entries (anchor, document, checks), sorted by anchor and pre-aggregated in the map tasks,
dealt out by the top bits of the anchor and merge-joined there with the historical runs: immutable files, sorted by
anchor, one per run and bucket. A window whose anchor and check (96 bits) were seen in an earlier batch, or in a smaller
doc_id of this one, is flagged. What the batch adds is written as a new run under a temporary name, and counts once the
manifest names it; when runs are many they are compacted into one.

Only flags (document, hash) go back to the texts, which drop the covered words.

Null texts have no words. A null doc_id counts as larger than any other (and so do ids of the last 2^20 of the 64-bit
range); such documents are dealt out by their texts. Rows with equal ids do not deduplicate each other (no id is smaller).
Extra columns are ignored. Batches come in order of doc_id: runs already written are not judged again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, mix, packed, portions, scratch, text_or_empty, unpacked, written

#: Ids from here on stand for null: this many names, so that such documents do not all meet in one task.
NULLS = 1 << 20
LAST = (1 << 63) - 1 - NULLS
#: Words of the runs inside a window of which the least hash is its anchor.
ANCHOR = 5
#: Text that a task hashes at once, that one merge bucket stands for, and that one part of the final pass holds.
CHUNK_CHARS = 8_000_000
BUCKET_CHARS = 12_000_000
PART_CHARS = 12_000_000
BASE, BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ENTRIES = "kind int, grp int, a binary, b binary, c binary, d binary"
COLUMNS = [("kind", pa.int32()), ("grp", pa.int32()), *[(k, pa.binary()) for k in "abcd"]]


class Windows:
    """Anchors and checks of a text's windows. The checks come from word hashes of another seed."""

    def __init__(self, size: int):
        self.size, self.first, self.second = size, WordHasher(), WordHasher(0x5EED)

    def __call__(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, part = len(tokens) - self.size + 1, min(ANCHOR, self.size)
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        w, v = self.first(tokens), self.second(tokens)
        s, c = np.zeros(len(w) - part + 1, np.uint64), np.zeros(n, np.uint64)
        for j in range(part):
            s = s * BASE + w[j : j + len(s)]
        for j in range(self.size):
            c = c * BASE2 + v[j : j + n]
        s = mix(s)
        a = s[:n].copy()
        for j in range(1, self.size - part + 1):
            np.minimum(a, s[j : j + n], out=a)
        return mix(a), (mix(c) >> np.uint64(32)).astype(np.uint32)


def key_of(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One hash of both, by which flags name a window."""
    return mix(a ^ (c.astype(np.uint64) * BASE2))


def _ids(ids: pa.ChunkedArray, texts: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers; null ones get one of the last numbers by their text."""
    ids = ids.cast(pa.int64())
    if not ids.null_count:
        return ids.to_numpy()
    from xxhash import xxh64_intdigest

    out, none = pc.fill_null(ids, 0).to_numpy().copy(), pc.is_null(ids).to_numpy()
    at = np.flatnonzero(none)
    out[at] = [LAST + 1 + xxh64_intdigest(texts[int(i)].as_py() or "") % (NULLS - 1) for i in at]
    return out


def _order(ids: np.ndarray) -> np.ndarray:
    return np.minimum(ids, LAST)


def _parts(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _flag_rows(ids: np.ndarray, hashes: np.ndarray, parts: int, first: int) -> list[tuple]:
    out = []
    if len(ids):
        p = _parts(ids, parts)
        order = np.lexsort((hashes, ids, p))
        cut = np.flatnonzero(np.diff(p[order])) + 1
        for some in np.split(order, cut):
            out.append((1, first + int(p[some[0]]), packed(hashes[some]), packed(ids[some], True), b"", b""))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, (_, k) in zip(zip(*rows) if rows else [[]] * len(COLUMNS), COLUMNS)], [n for n, _ in COLUMNS])


def _starts(*values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    n = len(values[0])
    return np.flatnonzero(np.concatenate([[True], np.any([v[1:] != v[:-1] for v in values], axis=0)])) if n else np.empty(0, np.int64)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _entries(table: pa.Table, windows: Windows, buckets: int, parts: int) -> list[tuple]:
    texts = table.column("text")
    ids = _ids(table.column("doc_id"), texts)
    tokens = [t.encode().split() for t in texts.to_pylist()]
    doc = np.repeat(np.arange(len(ids)), np.fromiter(map(len, tokens), np.int64, len(tokens)))
    a, c = windows([x for t in tokens for x in t])
    del tokens
    whole = doc[: len(a)] == doc[windows.size - 1 :] if len(a) else np.empty(0, bool)
    a, c, d = a[whole], c[whole], ids[doc[: len(whole)][whole]]
    key = key_of(a, c)
    order = np.argsort(key)
    a, c, d, key = a[order], c[order], d[order], key[order]
    at = _starts(key, a, c)
    if not len(at):
        return []
    least = np.minimum.reduceat(d, at)
    later = _order(d) > np.repeat(_order(least), _sizes(at, len(d)))
    rows = _flag_rows(d[later], key[later], parts, buckets)
    a, c, d = a[at], c[at], least
    order = np.argsort(a)
    a, c, d = a[order], c[order], d[order]
    edge = np.searchsorted(a, np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets))
    for b, (lo, hi) in enumerate(zip([0, *edge], [*edge, len(a)])):
        if hi > lo:
            group = _starts(a[lo:hi], d[lo:hi])
            names, place = np.unique(d[lo:hi][group], return_inverse=True)
            n = np.minimum(_sizes(group, hi - lo), 1 << 15).astype(np.uint16)
            if int(n.astype(np.int64).sum()) != hi - lo:  # a group beyond 16 bits of windows: one group per window
                group, n = np.arange(hi - lo), np.ones(hi - lo, np.uint16)
                names, place = np.unique(d[lo:hi], return_inverse=True)
            small = np.uint16 if len(names) < 1 << 16 else np.uint32
            rows.append((0, b, packed(a[lo:hi][group], True), packed(names, True), packed(place.astype(small)), _joined(packed(n), packed(c[lo:hi]))))
    return rows


def _joined(x: bytes, y: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + x + y


def _entry(a: bytes, b: bytes, c: bytes, d: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, checks and documents of an entry row, one of each per window."""
    cut = 8 + int.from_bytes(d[:8], "little")
    n = unpacked(d[8:cut])
    return np.repeat(unpacked(a, True), n), unpacked(d[cut:]), np.repeat(unpacked(b, True)[unpacked(c)], n)


def _run_file(run: str, bucket: int) -> str:
    return f"{run}/bucket-{bucket:05d}.parquet"


def _read_run(run: str, bucket: int) -> tuple[np.ndarray, np.ndarray] | None:
    fs, path = pafs.FileSystem.from_uri(_run_file(run, bucket))
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    t = pq.read_table(path, filesystem=fs).combine_chunks()
    lists = t.column("checks").chunk(0) if t.num_rows else pa.array([], pa.list_(pa.uint32()))
    return np.repeat(t.column("anchor").to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()


def _write_run(run: str, bucket: int, a: np.ndarray, c: np.ndarray) -> None:
    fs, path = pafs.FileSystem.from_uri(_run_file(run, bucket))
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    at = _starts(a)
    checks = pa.ListArray.from_arrays(pa.array(np.append(at, len(a)), pa.int32()), pa.array(c, pa.uint32()))
    pq.write_table(pa.table({"anchor": pa.array(a[at], pa.uint64()), "checks": checks}), temporary, filesystem=fs, compression="zstd", use_dictionary=False, column_encoding={"anchor": "DELTA_BINARY_PACKED", "checks.list.element": "PLAIN"})
    fs.move(temporary, path)


class WindowIndex:
    """Sorted immutable runs of window hashes below `path`, with a manifest that names those that count."""

    def __init__(self, spark: SparkSession, path: str | None = None, size: int = 13, buckets: int = 16, fan_in: int = 4):
        self.spark, self.path, self.size, self.buckets, self.fan_in = spark, path or scratch(spark, "windows"), size, buckets, fan_in
        kept = self._load()
        if kept:
            self.size, self.buckets = kept["size"], kept["buckets"]
        self.runs: list[str] = kept["runs"] if kept else []
        self.compactions = kept["compactions"] if kept else 0

    def _load(self) -> dict | None:
        fs, path = pafs.FileSystem.from_uri(f"{self.path}/manifest.json")
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _commit(self, runs: list[str]) -> None:
        fs, path = pafs.FileSystem.from_uri(f"{self.path}/manifest.json")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path + ".tmp") as f:
            f.write(json.dumps({"size": self.size, "buckets": self.buckets, "runs": runs, "compactions": self.compactions}).encode())
        fs.move(path + ".tmp", path)
        self.runs = runs

    def ingest(self, docs: DataFrame, parts: int) -> DataFrame:
        """Flags (part of the document, a = hashes, b = doc_ids) of docs (doc_id, text) against all earlier batches and
        itself; what it adds becomes a run."""
        size, buckets, runs = self.size, self.buckets, list(self.runs)
        new = f"{self.path}/run-{uuid.uuid4().hex}"

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows, held, chars = Windows(size), [], 0
            for whole in batches:
                for b in portions(whole, 1, CHUNK_CHARS):
                    more = pc.sum(pc.binary_length(b.column(1))).as_py() or 0
                    if held and chars + more > CHUNK_CHARS:
                        yield _batch(_entries(pa.Table.from_batches(held), windows, buckets, parts))
                        held, chars = [], 0
                    held.append(b)
                    chars += more
            if held:
                yield _batch(_entries(pa.Table.from_batches(held), windows, buckets, parts))

        def merge(table: pa.Table) -> pa.Table:
            if table.column("kind")[0].as_py() == 1:
                return table
            bucket = table.column("grp")[0].as_py()
            old = [x for x in (_read_run(r, bucket) for r in runs) if x]
            found = [_entry(*x) for x in zip(*(table.column(k).to_pylist() for k in "abcd"))]
            n_old = sum(len(x[0]) for x in old)
            a = np.concatenate([x[0] for x in (*old, *found)])
            c = np.concatenate([x[1] for x in (*old, *found)])
            d = np.concatenate([np.full(n_old, np.iinfo(np.int64).min), *[x[2] for x in found]])
            order = np.lexsort((c, a))
            a, c, d = a[order], c[order], d[order]
            at = _starts(a, c)
            least = np.minimum.reduceat(d, at)
            later = (_order(d) > np.repeat(_order(least), _sizes(at, len(d)))) & (order >= n_old)
            unseen = least > np.iinfo(np.int64).min
            _write_run(new, bucket, a[at][unseen], c[at][unseen])
            return pa.Table.from_batches([_batch(_flag_rows(d[later], key_of(a[later], c[later]), parts, buckets))])

        chosen = docs.select("doc_id", text_or_empty("text").alias("text"))
        flags = written(chosen.mapInArrow(entries, ENTRIES).groupBy("grp").applyInArrow(merge, ENTRIES), "flags")
        self._commit([*self.runs, new])
        if len(self.runs) > self.fan_in:
            self.compact()
        return flags.select((F.col("grp") - buckets).alias("part"), "a", "b")

    def compact(self) -> None:
        """Merges all runs into one, bucket by bucket; the manifest then names that one alone."""
        runs, new = list(self.runs), f"{self.path}/run-{uuid.uuid4().hex}"

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bucket in b.column(0).to_pylist():
                    if found := [x for x in (_read_run(r, bucket) for r in runs) if x]:
                        a, c = (np.concatenate(x) for x in zip(*found))
                        order = np.lexsort((c, a))
                        a, c = a[order], c[order]
                        at = _starts(a, c)
                        _write_run(new, bucket, a[at], c[at])
                yield b

        self.spark.range(self.buckets).repartitionById(self.buckets, F.col("id").cast("int")).mapInArrow(one, "id long").write.format("noop").mode("overwrite").save()
        self.compactions += 1
        self._commit([new])
        for r in runs:
            fs, path = pafs.FileSystem.from_uri(r)
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_dir(path)


def cleaned(docs: DataFrame, flags: DataFrame, parts: int, size: int = 13) -> DataFrame:
    """doc_id, text (kept words joined by a space), n_words, n_removed of docs (doc_id, text). Texts meet their flags by
    parts of the documents, to which they go compressed."""
    schema = "doc_id long, text string, n_words long, n_removed long"
    sent = [("part", pa.int32()), *[(k, pa.binary()) for k in ("ids", "none", "ends", "body")]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            ids, none = _ids(pa.chunked_array([b.column(0)]), pa.chunked_array([b.column(1)])), pc.is_null(b.column(0)).to_numpy(zero_copy_only=False)
            p, texts, rows = _parts(ids, parts), [t.encode() for t in b.column(1).to_pylist()], []
            order = np.argsort(p, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(p[order])) + 1) if len(order) else []:
                own = [texts[i] for i in some]
                ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
                rows.append((int(p[some[0]]), packed(ids[some]), packed(none[some].astype(np.uint8)), packed(ends, True), zstandard.compress(b"".join(own), 3)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, (_, k) in zip(zip(*rows) if rows else [[]] * 5, sent)], [n for n, _ in sent])

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        windows = Windows(size)
        by_doc: dict[int, np.ndarray] = {}
        if right.num_rows:
            h = np.concatenate([unpacked(x) for x in right.column("a").to_pylist()])
            d = np.concatenate([unpacked(x, True) for x in right.column("b").to_pylist()])
            order = np.argsort(d, kind="stable")
            h, d = h[order], d[order]
            at = _starts(d)
            by_doc = dict(zip(d[at].tolist(), np.split(h, at[1:])))
        ids, texts, n_words, n_removed = [], [], [], []
        for some, none, ends, body in zip(*(left.column(k).to_pylist() for k in ("ids", "none", "ends", "body"))):
            whole, some, lo = zstandard.decompress(body) if body else b"", unpacked(some).tolist(), 0
            for i, null, hi in zip(some, unpacked(none).tolist(), unpacked(ends, True).tolist()):
                tokens, lo = whole[lo:hi].split(), hi
                gone = np.zeros(len(tokens) + 1, np.int64)
                if i in by_doc and len(tokens) >= size:
                    hit = np.flatnonzero(np.isin(key_of(*windows(tokens)), by_doc[i]))
                    np.add.at(gone, hit, 1)
                    np.add.at(gone, hit + size, -1)
                covered = np.cumsum(gone)[:-1] > 0
                ids.append(None if null else i)
                n_words.append(len(tokens))
                n_removed.append(int(covered.sum()))
                texts.append(b" ".join(t for t, x in zip(tokens, covered.tolist()) if not x) if n_removed[-1] else b" ".join(tokens))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    placed = placed.mapInArrow(place, "part int, ids binary, none binary, ends binary, body binary")
    return placed.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(drop, schema)


def deduplicated(docs: DataFrame, size: int = 13, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """All of docs in batches of about equal numbers of documents, by doc_id, through a fresh index whose runs are
    compacted on the way and which is left complete: a later batch can be held against it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = F.percentile_approx("doc_id", [(i + 1) / batches for i in range(batches - 1)])
    cuts, chars = docs.agg(cuts, F.sum(F.length("text"))).first()
    chars, cuts = chars or 0, sorted(set(cuts or []))
    buckets = 1 << max(4, int(chars // BUCKET_CHARS).bit_length())
    parts = max(12, int(chars // PART_CHARS) + 1)
    index = WindowIndex(docs.sparkSession, size=size, buckets=buckets, fan_in=fan_in)
    flags = []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        above = F.lit(True) if lo is None else F.col("doc_id") > lo
        below = F.lit(True) if hi is None else F.col("doc_id") <= hi
        some = above & below if hi is not None else F.coalesce(above, F.lit(True))
        flags.append(index.ingest(docs.where(some), parts))
    return cleaned(docs, reduce(DataFrame.unionByName, flags), parts, size)


def report(df: DataFrame) -> DataFrame:
    return deduplicated(df).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
