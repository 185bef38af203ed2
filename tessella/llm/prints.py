"""Document fingerprints: SimHash of weighted terms, and permuted block tables that find all within a Hamming radius.

Terms are a text's words (letters A-Z in lower case) and its pairs of neighbouring words. Each term's hash votes on 64
signed bits with the weight 1 + floor(log2(occurrences)), so that what a text repeats doesn't outvote what it says. Equal
texts have equal fingerprints; a text without words has fingerprint zero. The likeness of two fingerprints is the cosine
that their distance stands for, cos(pi * distance / 64), and zero from half the bits on.

Tables: 64 bits in `blocks` blocks, and a table for each choice of blocks - radius of them, keyed by these blocks.
Fingerprints within the radius differ in at most `radius` blocks, so some table has both under one key. With six blocks and
radius three there are twenty tables of 31 or 32 bits. Only distinct fingerprints enter them, and no pairs are
emitted within a key: `classes` links each to the smallest it reaches.

Documents follow each other by descending id (nulls last; ties by text): the table is range-sorted once, every task
walks its rows, and the last row of each meets the first row of the next one that has any. Null texts are empty; repeated
rows follow each other; a single row follows itself; extra columns are ignored; no rows give none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, components, mix, skew_join, text_or_empty, written
from .simhash import links

RADIUS, BLOCKS = 3, 6

#: Terms whose votes are counted at once.
AT_ONCE = 1 << 15


class Printer:
    """Fingerprints texts in a worker."""

    def __init__(self):
        self.hash = WordHasher(seed=13)

    def __call__(self, text: str) -> int:
        """The signed 64-bit fingerprint."""
        words = text.encode().lower().split()
        if not words:
            return 0
        h = mix(self.hash(words))
        terms, times = np.unique(np.concatenate([h, mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])]), return_counts=True)
        weights = np.frexp(times.astype(np.float64))[1].astype(np.float32)  # 1 + floor(log2(times))
        votes = np.zeros(64, np.float64)
        for lo in range(0, len(terms), AT_ONCE):
            bits = np.unpackbits(terms[lo : lo + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += weights[lo : lo + AT_ONCE] @ bits.astype(np.float32)
        return int(np.packbits(2 * votes > weights.sum(dtype=np.float64), bitorder="little").view("<i8")[0])


def likeness(a: int, b: int) -> float:
    distance = ((a ^ b) & (1 << 64) - 1).bit_count()
    return max(0.0, math.cos(math.pi * distance / 64)) if distance < 32 else 0.0


def edited(text: str, following: str) -> str:
    """The text, its last third replaced by as much of the beginning of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printed = Printer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([printed(x.as_py()) for x in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return df.select(F.col(id_col).alias("doc_id"), text_or_empty(text)).mapInArrow(run, f"doc_id {dict(df.dtypes)[id_col]}, fp long")


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The bits that each table keeps: all choices of blocks - radius blocks."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("there must be more blocks than the radius, and at most 64")
    ends = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << hi) - (1 << lo) for lo, hi in zip(ends, ends[1:])]
    return [sum(c) for c in combinations(own, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, t, key): the entries of each fingerprint in all tables."""
    entries = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*entries)).alias("x")).select("fp", "x.t", "x.key")


def within(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, found, distance): all stored fingerprints within the radius of each distinct query fingerprint, once."""
    masks = block_masks(radius, blocks)
    hits = _keys(queries.select("fp").distinct(), masks).join(_keys(stored.select("fp").distinct(), masks).withColumnRenamed("fp", "found"), ["t", "key"])
    differs = F.col("fp").bitwiseXOR(F.col("found"))
    table: Column = F.lit(None)
    for t, m in reversed(list(enumerate(masks))):
        table = F.when(differs.bitwiseAND(F.lit(_signed(m)).cast("long")) == 0, t).otherwise(table)
    distance = F.bit_count(differs)
    return hits.where((distance <= radius) & (F.col("t") == table)).select("fp", "found", distance.alias("distance"))


def classes(printed: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, n, class_id) of the distinct fingerprints of (doc_id, fp): n rows have it; class_id is the smallest doc_id
    that it reaches by links within the radius, null if there is none."""
    distinct = written(printed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct, radius, block_masks(radius, blocks)))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("m"))
    return skew_join(rooted, written(named, "named"), "root", "m", distinct.count(), "inner").select("fp", "n", "class_id")


_FIGURES = "n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
_NAMES = [f.split()[0] for f in _FIGURES.split(", ")]


def _figures(printed: Printer, text: str, fp: int, following: str, following_fp: int) -> tuple:
    new = edited(text, following)
    new_fp = printed(new)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), fp, new_fp, likeness(fp, new_fp), likeness(fp, following_fp)


def edits(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next: each text, edited with the next one's beginning."""
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col]
    ranged = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text")).repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Figures of all rows but the last, which waits with its text; the first row's text and fingerprint, too."""
        printed, task, held = Printer(), TaskContext.get().partitionId(), None
        id_type = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (id_type, *_KINDS, pa.int32(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 10, kinds)], ["doc_id", *_NAMES, "task", "edge", "text"])

        edge = lambda name, row: (row[0], None, None, row[2], None, None, None, task, name, row[1])
        for batch in batches:
            id_type, rows = batch.column(0).type, []
            for own_id, own in zip(batch.column(0), batch.column(1)):
                row = (own_id.as_py(), own.as_py(), printed(own.as_py()))
                rows.append((held[0], *_figures(printed, held[1], held[2], row[1], row[2]), None, None, None) if held else edge("head", row))
                held = row
            yield out(rows)
        if held:
            yield out([edge("tail", held)])

    found = written(ranged.mapInArrow(walk, f"doc_id {kind}, {_FIGURES}, task int, edge string, text string"), "edits")
    heads = found.where("edge = 'head'").select(F.col("task").alias("next"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    tasks = sorted(r[0] for r in heads.select("next").collect())  # numbers of tasks, no rows
    follows = F.broadcast(spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1])), "task int, next int"))
    tails = found.where("edge = 'tail'").join(follows, "task").join(heads, "next").select("doc_id", "text", "fp", "next_text", "next_fp")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printed = Printer()
        for batch in batches:
            rows = [_figures(printed, *(x.as_py() for x in row)) for row in zip(*batch.columns[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 6, _KINDS)]], ["doc_id", *_NAMES])

    settled = tails.mapInArrow(settle, f"doc_id {kind}, {_FIGURES}")
    return found.where("edge is null").select("doc_id", *_NAMES).unionByName(settled)


def report(df: DataFrame) -> DataFrame:
    """The figures of `edits`, and the class of each document among all fingerprints within the radius."""
    rows = written(edits(df), "edited")
    known = written(classes(rows), "classes")
    of_class = skew_join(rows, known, "fp", "n", rows.count(), "inner")
    hexa = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return of_class.select("doc_id", "n_chars", "edited_sha256", hexa("fp").alias("fingerprint"), hexa("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "class_id")
