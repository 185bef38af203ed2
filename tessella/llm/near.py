"""Near-duplicates by five-word shingles: SimHash and MinHash bands find candidates, exact Jaccard similarity decides.

Texts are split into words, letters A-Z in lower case, and compared as sets of five-word shingles (shorter texts are one
shingle of all their words; texts without words equal each other). 24 bands of five MinHashes each miss a pair at
similarity 0.8 with a chance of 0.00007, and less above. The components of operator 10, SimHashes linked within two bits by
covering masks, are buckets as well.

Only distinct texts are compared. A bucket's texts are not paired with each other: each is verified against one of them,
the pivot, the smallest hash. By the triangle inequality of the Jaccard distance, two texts whose distances to the pivot differ by more than
1 - threshold aren't similar, so texts that are similar to the pivot have nothing left to be compared with but those of up to
twice that distance. What is left for a pivot is compared in blocks, block against block, of which only links come out. So a large
group of near copies costs a comparison or two a text, and no pair that shares a bucket is left undecided.

Texts are known by a 64-bit hash, shingles likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import WordHasher, components, mix, own_names, skew_join, text_or_empty, written

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 5
#: Texts of a bucket that are compared with as many others in one task, and what is broadcast at most.
BLOCK, BROADCAST_BYTES = 512, 32 << 20
_rng = np.random.default_rng(5)
_MULTIPLIERS = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def shingles(text: str, hasher: WordHasher) -> np.ndarray:
    """Sorted different hashes of a text's shingles, one at least."""
    w = hasher(text.encode().lower().split())
    size = max(min(SHINGLE, len(w)), 1)
    if not len(w):
        return np.zeros(1, np.uint64)
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = mix(h ^ w[i : len(w) - size + 1 + i]) + np.uint64(i + 1)
    return np.unique(h)


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band of a set of shingles."""
    from xxhash import xxh64_intdigest

    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, (x[None, i : i + 4096] * _MULTIPLIERS + _OFFSETS).min(axis=1))
    return [xxh64_intdigest(r.tobytes(), b) - (1 << 63) for b, r in enumerate(least.reshape(BANDS, ROWS))]


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def similar(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of `threshold` or more."""
    return min(len(x), len(y)) >= threshold * max(len(x), len(y)) and jaccard(x, y) >= threshold - 1e-9


def _node(text: str | Column) -> Column:
    return F.xxhash64(text_or_empty(text))


def _buckets(texts: DataFrame) -> DataFrame:
    """bucket, node of texts (node, text), a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            keys = [band_keys(shingles(t, hasher)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], ["bucket", "node"])

    return texts.mapInArrow(run, "bucket long, node long")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, hasher).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "h"])

    return texts.mapInArrow(run, "node long, h binary")


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The Jaccard distances of pairs (a, b): a, b, d. A text b has few of them, a text a perhaps many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [1 - jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], ["a", "b", "d"])

    wanted = pairs.groupBy("a").agg(F.count("*").alias("m")).join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a")
    wanted = written(wanted, "pivots")
    per_text = pairs.groupBy("b").agg(F.collect_list("a").alias("each")).join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    per_text = per_text.select("b", "hb", F.explode("each").alias("a"))
    if (wanted.agg(F.sum(F.octet_length("ha") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = per_text.join(F.broadcast(wanted), "a")
    else:
        joined = skew_join(per_text, wanted, "a", "m", pairs.count(), "inner")
    return written(joined.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long, d double"), "distances")


def _block_links(table: pa.Table) -> pa.Table:
    """Links that connect what is similar among a bucket's texts: within a block, or between two blocks."""
    table = table.sort_by("d")
    nodes, d, block = (table.column(k).to_numpy() for k in ("node", "d", "block"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist()]
    within, root, a, b = len(np.unique(block)) == 1, list(range(len(nodes))), [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    last = np.searchsorted(d, d + (1 - THRESHOLD) + 1e-9, side="right")
    for i in range(len(nodes)):
        for j in range(i + 1, int(last[i])):
            if (within or block[i] != block[j]) and find(i) != find(j) and similar(sets[i], sets[j]):
                root[find(j)] = find(i)
                a.append(nodes[i])
                b.append(nodes[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rest_links(distances: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the texts compared with one pivot that their distances to it leave open. Buckets of one pivot are one here."""
    most = 1 - THRESHOLD + 1e-9
    known = distances.select(F.col("a").alias("bucket"), F.col("b").alias("node"), "d")
    far, middle = F.col("d") > most, (F.col("d") > most) & (F.col("d") <= 2 * most)
    open_ = known.groupBy("bucket").agg(F.count_if(far).alias("far"), F.min(F.when(middle, F.col("d"))).alias("middle"), F.count("*").alias("n"))
    open_ = written(open_.where((F.col("far") > 1) | F.col("middle").isNotNull()).drop("far"), "open")
    rest = skew_join(known, open_, "bucket", "n", known.count(), "inner")
    rest = rest.where(far | (F.col("d") >= F.col("middle") - most)).select("bucket", "node", "d")
    rest = written(rest, "rest")
    blocks = written(rest.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"), F.count("*").alias("n")).where("n > 1"), "blocks")
    placed = skew_join(rest, blocks, "bucket", "n", rest.count(), "inner").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    placed = placed.select("bucket", "node", "d", "block", other.alias("other"))
    placed = placed.select("bucket", "node", "d", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return placed.join(sets, "node").groupBy("bucket", "x", "y").applyInArrow(_block_links, "a long, b long")


def links(texts: DataFrame) -> DataFrame:
    """Components of similar texts, of texts (node, text): node, root of all that have a neighbour."""
    keys = written(_buckets(texts).distinct(), "buckets")
    counted = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("who")).where("n > 1")
    # bands in which the same texts meet are one bucket
    counted = written(counted.groupBy("n", "pivot", "who").agg(F.min("bucket").alias("bucket")).drop("who"), "counted")
    pairs = skew_join(keys, counted, "bucket", "n", keys.count(), "inner").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    alike = simhash.grouped(texts, "node").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    pairs = written(pairs.unionByName(alike).distinct(), "pairs")
    candidates = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "candidates")
    some = F.broadcast(candidates) if candidates.count() * 64 <= BROADCAST_BYTES else candidates
    sets = written(_sets(texts.join(some, "node", "left_semi").dropDuplicates(["node"])), "sets")
    distances = _distances(pairs, sets)
    near = distances.where(F.col("d") <= 1 - THRESHOLD + 1e-9).select("a", "b")
    return components(near.unionByName(_rest_links(distances, sets)))


def grouped(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """node, doc_id, m (rows of that id and text) and root (equal within a component) of all rows of df."""
    rows = df.select(_node(text).alias("node"), F.col(id_col).alias("doc_id")).groupBy("node", "doc_id").agg(F.count("*").alias("m"))
    rows = written(rows, "rows")
    roots = links(df.select(_node(text).alias("node"), text_or_empty(text).alias("text")))
    sizes = rows.groupBy("node").agg(F.count("*").alias("k"))
    rooted = written(sizes.join(roots, "node", "left").select("node", "k", F.coalesce("root", "node").alias("root")), "rooted")
    return skew_join(rows, rooted, "node", "k", rows.count(), "inner").select("node", "doc_id", "m", "root")


@own_names
def representatives(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df of each component: the one with the smallest id, any id before none.

    Rows of one id (or none) in different components all stay.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "m")).alias("x")
    keep = written(grouped(df, id_col, text).groupBy("root").agg(first).select(F.col("x.node").alias("__n"), F.col("x.doc_id").alias("__k"), F.col("x.m").alias("__m")), "keep")
    marked = df.withColumn("__node", _node(text))
    out = marked.join(keep, (F.col("__node") == F.col("__n")) & marked[id_col].eqNullSafe(F.col("__k")), "left_semi")
    if not keep.where("__m > 1").isEmpty():
        out = out.dropDuplicates(["__node"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
