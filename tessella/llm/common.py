"""Shared helpers: the cluster's shared folder, written intermediates, word hashing, skew-safe joins."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder, stars

#: Words are runs of anything but ASCII white space; bytes.split() splits at exactly these.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For stages that keep a table's columns and name their own with two underscores: a table's columns of such names are
    called otherwise meanwhile."""

    @functools.wraps(stage)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        had = df.columns
        if not any(c.startswith("__") for c in had):
            return stage(df, *args, **options)
        out = stage(df.toDF(*[f"column {i}" if c.startswith("__") else c for i, c in enumerate(had)]), *args, **options)
        return out.toDF(*had, *out.columns[len(had) :])

    return run


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of words; empty if none."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal or both-null keys, keeping the left copy of them."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"__r_{k}"])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def skew_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Join on a key of which right has one row each, and in `count` how many rows left has of it.

    Keys with over a thousandth of the `total` rows number at most a thousand: they are collected, and their rows meet a
    broadcast. The others have no hot key and are shuffled. Left should be a written table, as it is read twice.
    """
    hot_at = max(total // 1000, 1)
    hot = F.broadcast(right.where(F.col(count) > hot_at))
    cold = right.where(F.col(count) <= hot_at)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return left.join(cold, key, how)
    among = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return left.where(among).join(hot, key).unionByName(left.where(~among).join(cold, key, how))


class WordHasher:
    """64-bit hashes of words, remembering a bounded number of them."""

    def __init__(self, seed: int = 0, room: int = 200_000):
        import xxhash

        self.hash, self.seed, self.room, self.known = xxhash.xxh64_intdigest, seed, room, {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            if len(known) > self.room:
                known.clear()
            h, s = self.hash, self.seed
            for t in set(tokens).difference(known):
                known[t] = h(t, s)
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def packed(values: np.ndarray, sorted_values: bool = False) -> bytes:
    """An integer array as compressed bytes: differences if sorted, equal bytes of the elements side by side."""
    import zstandard

    values = np.ascontiguousarray(values)
    if sorted_values and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    body = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return values.dtype.str.encode().ljust(4) + zstandard.compress(body, 1)


def unpacked(blob: bytes, sorted_values: bool = False) -> np.ndarray:
    import zstandard

    kind = np.dtype(blob[:4].decode().strip())
    body = np.frombuffer(zstandard.decompress(blob[4:]), np.uint8)
    values = np.ascontiguousarray(body.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if sorted_values else values


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def portions(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of a text column each, at least a row."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")), lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b) that reach a smaller one; root is the smallest."""
    return stars(edges).toDF("node", "root")
