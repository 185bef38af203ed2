"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a vector of radius + 1 bits, not zero in all; for each non-zero vector v, table v keeps the bits whose
vector has an odd product with v. Any `radius` bits leave some v orthogonal to all of them, so a pair within the
radius agrees on everything that table keeps: every such pair meets in some table, and none is missed.

Only distinct fingerprints are compared. Within a table's bucket no pairs are emitted: small buckets give a
spanning forest of their links; in large ones every fingerprint is keyed by itself with one or two of the free bits
cleared, and keys are shared by four fingerprints at most. For another radius than two, large buckets are compared block by block.

A null or word-less text has fingerprint zero and is linked like any other. Repeated rows share a fingerprint.
A component's id ignores null doc_ids (null if it has no other). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, skew_join, written

SMALL = 1024


def fingerprint(text: str | None, size: int = 3) -> int:
    """Signed 64-bit SimHash of a text's word shingles, letters A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    h = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text)).mapInArrow(run, f"doc_id {dict(df.dtypes)[id_col]}, fp long")


def fingerprint_column(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t if isinstance(t, str) else None)).astype("int64")

    return F.pandas_udf(run, "long")(text)


def covering_masks(radius: int) -> list[int]:
    """The bits that each table keeps. Bits take the non-zero vectors in turn, a balanced assignment."""
    size = radius + 1
    vectors = [1 + bit % ((1 << size) - 1) for bit in range(64)]
    return [sum(1 << bit for bit, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within one bucket: from each fingerprint to the smallest it reaches."""
    bits = fps.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    root = np.full(len(fps), -1)
    for i in range(len(fps)):
        if root[i] < 0:
            todo = [i]
            root[i] = i
            while todo:
                new = np.flatnonzero(near[todo].any(axis=0) & (root < 0))
                root[new] = i
                todo = new.tolist()
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def links(distinct: DataFrame, radius: int = 2, tables: list[int] | None = None) -> DataFrame:
    """Edges (a, b) over distinct fingerprints `fp`, with the components of all links within the radius. tables: the bits
    that each table keeps, such that all pairs within the radius agree in one; covering masks if not given."""
    kept = tables or covering_masks(radius)
    masks = [_signed(m) for m in kept]
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])).alias("x")
    keys = distinct.select("fp", entries).select("fp", "x.t", "x.key")
    counted = written(keys.groupBy("t", "key").count().where("count > 1"), "buckets")
    met = written(keys.join(counted, ["t", "key"]), "met")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}

        def done(groups: list[list[int]]) -> pa.RecordBatch:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for g in groups:
                x, y = _forest(np.sort(np.array(g, np.int64)), radius)
                a.append(x)
                b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            full = []
            for t, key, fp, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                g = held.setdefault((t, key), [])
                g.append(fp)
                if len(g) == n:
                    full.append(held.pop((t, key)))
            yield done(full)

    few = met.where(F.col("count") <= SMALL).repartition("t", "key").sortWithinPartitions("t", "key")
    edges = few.select("t", "key", "fp", "count").mapInArrow(small, "a long, b long")
    many = met.where(F.col("count") > SMALL)
    if many.isEmpty():
        return edges
    if radius != 2:
        return edges.unionByName(_between_blocks(many, radius))
    free = [[1 << b for b in range(64) if not m >> b & 1] for m in kept]
    # a text for each table instead of some 400 literals, which weigh on the driver
    clears = F.array(*[F.split(F.lit(",".join(str(_signed(x | y)) for x, y in combinations_with_replacement(bits, 2))), ",").cast("array<bigint>") for bits in free])
    keyed = many.select("fp", F.explode(F.get(clears, F.col("t"))).alias("clear")).select("fp", "clear", F.col("fp").bitwiseAND(F.bitwise_not("clear")).alias("rest"))
    shared = keyed.groupBy("clear", "rest").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = shared.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b")
    return edges.unionByName(star.select("a", "b"))


def _between_blocks(many: DataFrame, radius: int) -> DataFrame:
    """Edges in large buckets for any radius: a bucket's fingerprints in blocks, each compared with each."""
    k = F.ceil(F.col("count") / SMALL).cast("int")
    own = F.pmod(F.xxhash64("fp"), k).cast("int")
    pairs = many.select("t", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), k - 1)).alias("other"))
    pairs = pairs.select("t", "key", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def forest(table: pa.Table) -> pa.Table:
        a, b = _forest(np.sort(table.column("fp").to_numpy()), radius)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return pairs.groupBy("t", "key", "x", "y").applyInArrow(forest, "a long, b long")


def grouped(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """doc_id, fp, root and component_id of every row of df; components of links within the radius, equal in root."""
    docs = written(fingerprints(df, id_col, text), "fingerprints")
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    total = docs.count()
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    of_fp = skew_join(rooted, written(named, "named"), "root", "m", distinct.count(), "inner").select("fp", "n", "root", "component_id")
    return skew_join(docs, written(of_fp, "of_fp"), "fp", "n", total, "inner").select("doc_id", "fp", "root", "component_id")


def report(df: DataFrame) -> DataFrame:
    return grouped(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df with the smallest id of their component; of equal ids in one component, one row stays.

    Rows without an id stay only where their whole component has none, one of each component; rows of one id in
    different components all stay.
    """
    had = df.columns
    known = grouped(df, id_col, text)
    own = known.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = own.groupBy("root").agg(F.first("doc_id").alias("__k"), F.min("fp").alias("__fp")).drop("root")
    marked = df.withColumn("__own", fingerprint_column(F.col(text)))
    out = marked.join(keep, marked[id_col].eqNullSafe(keep["__k"]) & (marked["__own"] == keep["__fp"]), "left_semi")
    return out.dropDuplicates([id_col, "__own"]).select(*[F.col(f"`{c}`") for c in had])
