"""Inverted index: postings of lexemes, sorted over files, with a directory of what file has which lexemes.

A posting is (lexeme, weight class, row, positions). A segment holds the postings of a batch of rows, range-sorted by lexeme and
row, so that a frequent lexeme goes over several files; its directory has the first and last lexeme of each file. A search reads
the directory, then only the files that may hold its lexemes, and of these the row groups that do. Changed rows come as further
segments: a row's postings count in the last segment that names the row. `compact` makes one segment of all.

Lexemes are what `lexemes` makes of a text; null texts have none. Rows without an id can't be found. Repeated ids are one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from .graph import kept_table

POSTING = "lexeme string, weight string, row_id long, positions array<int>"
#: A directory of up to so many files is kept by the driver.
HELD = 10_000
#: Letters of text, about, whose postings are sorted in one task, and postings that are; words that a task groups at a time.
LETTERS, SORTED, WORDS = 16_000_000, 1_000_000, 1_000_000
_DIRECTORY = "file string, first string, last string, n long"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (row_id, weight, lexemes), some rows at a time."""
    for b in batches:
        n = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, lo = np.cumsum(n), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - n[lo] + WORDS, "right")))
            yield _postings(b.slice(lo, hi - lo), n[lo:hi])
            lo = hi


def _postings(b: pa.RecordBatch, n: np.ndarray) -> pa.RecordBatch:
    """A posting for each lexeme of each row, with the places where the row has it."""
    flat, row = b.column(2).flatten(), np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    own = np.flatnonzero(pc.fill_null(pc.not_equal(flat, ""), False).to_numpy(zero_copy_only=False))
    words = flat.take(pa.array(own)).dictionary_encode()
    key = words.indices.to_numpy().astype(np.int64) * len(n) + row[own]
    order = np.argsort(key, kind="stable")  # places stay in order, and postings of a lexeme are neighbours, which shuffles in fewer bytes
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    at = pa.array(row[own][order][first])
    positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(place[own][order].astype(np.int32)))
    lexeme = words.dictionary.take(words.indices.take(pa.array(order[first])))
    return pa.RecordBatch.from_arrays([lexeme, b.column(1).take(at), b.column(0).take(at), positions], ["lexeme", "weight", "row_id", "positions"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last lexeme of each file in a batch: a least text by key would sort all postings of a task."""
    for b in batches:
        for file in b.column(0).unique().to_pylist():
            own = b.column(1).filter(pc.equal(b.column(0), file))
            ends = pc.min_max(own).as_py()
            yield pa.RecordBatch.from_pydict({"file": [file], "first": [ends["min"]], "last": [ends["max"]], "n": [len(own)]})


class Postings:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, Snapshots(spark, root)
        self._held: dict[str, list] = {}  # directories of up to HELD files, by path: they never change

    def _store(self, postings: DataFrame) -> dict:
        """Writes sorted postings and their directory."""
        path, directory = self.log.new_part(), self.log.new_part()
        postings.write.parquet(path)
        files = self.spark.read.schema(POSTING).parquet(path).select(F.col("_metadata.file_path").alias("file"), "lexeme")
        files = files.mapInArrow(_ends, _DIRECTORY).groupBy("file")
        files.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).coalesce(1).write.parquet(directory)
        return {"path": path, "directory": directory, "rows": None}

    def _ranged(self, postings: DataFrame, size: int, most: int) -> DataFrame:
        """Postings dealt by lexeme and row to tasks, as many as the size needs."""
        tasks = -(-size // most)
        return postings.repartitionByRange(*([tasks] if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else []), "lexeme", "row_id")

    def _state(self, version: int | None = None) -> list[dict]:
        return self.log.read(version)["segments"] if self.log.latest() is not None else []

    def add(self, rows: DataFrame, id_col: str, texts: dict[str, str], lexemes: Callable[[Column], Column], removed: DataFrame | None = None) -> int:
        """A segment of new or changed rows, whose texts are given by weight class, and of removed ids. The first is the base."""
        base = self.log.latest()
        classes = [F.struct(F.lit(w).alias("weight"), lexemes(F.col(c)).alias("lexemes")) for w, c in texts.items()]
        known = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), *texts.values())
        # a row's words are grouped where it is read, so that a posting is shuffled and not each of its words
        found = known.select("row_id", F.explode(F.array(*classes)).alias("x")).select("row_id", "x.*").mapInArrow(_grouped, POSTING)
        found = kept_table(found, "postings")  # else the sample of the ranges splits all texts once more
        letters = reduce(Column.__add__, [F.coalesce(8 * F.size(c) if rows.schema[c].dataType.typeName() == "array" else F.length(c), F.lit(0)) for c in texts.values()])
        ranged = self._ranged(found, known.agg(F.sum(letters.cast("long"))).first()[0] or 0, LETTERS)
        if not known.groupBy("row_id").count().where("count > 1").isEmpty():
            ranged = ranged.groupBy("lexeme", "weight", "row_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
        segment = self._store(ranged.sortWithinPartitions("lexeme", "row_id", "weight"))
        if base is not None:
            segment["rows"] = self.log.new_part()
            named = rows.select(F.col(id_col).cast("long").alias("row_id"))
            named = named if removed is None else named.unionByName(removed.select(F.col(removed.columns[0]).cast("long").alias("row_id")))
            named.distinct().write.parquet(segment["rows"])
        return self.log.commit(base, {"segments": [*self._state(base), segment]})

    def files(self, segment: dict, lexemes: list[str]) -> list[str]:
        """The files of a segment that may hold one of the lexemes."""
        path = segment["directory"]
        directory = self.spark.read.schema(_DIRECTORY).parquet(path)
        if path not in self._held and directory.limit(HELD + 1).count() <= HELD:
            self._held[path] = directory.collect()
        if path in self._held:
            return [r.file for r in self._held[path] if any(r.first <= x <= r.last for x in lexemes)]
        may = reduce(Column.__or__, [F.lit(x).between(F.col("first"), F.col("last")) for x in lexemes])
        return [r.file for r in directory.where(may).select("file").collect()]  # names of files only

    def _live(self, parts: list[tuple[int, DataFrame]], segments: list[dict]) -> DataFrame:
        """Postings of segments, by number, without those of rows that a later segment names."""
        found = reduce(DataFrame.unionByName, [p.withColumn("segment", F.lit(i)) for i, p in parts])
        changes = [self.spark.read.schema("row_id long").parquet(s["rows"]).withColumn("until", F.lit(i)) for i, s in enumerate(segments) if s["rows"]]
        if changes:
            last = reduce(DataFrame.unionByName, changes).groupBy("row_id").agg(F.max("until").alias("until"))
            found = found.join(last, "row_id", "left").where(F.coalesce("until", F.lit(0)) <= F.col("segment")).drop("until")
        return found.drop("segment")

    def read(self, lexemes: list[str], version: int | None = None) -> DataFrame:
        """The live postings of some lexemes."""
        segments, parts = self._state(version), []
        for i, s in enumerate(segments):
            files = self.files(s, lexemes) if lexemes else []
            if files:
                parts.append((i, self.spark.read.schema(POSTING).parquet(*files).where(F.col("lexeme").isin(lexemes))))
        return self._live(parts, segments) if parts else self.spark.createDataFrame([], POSTING)

    def compact(self) -> int:
        """All live postings as one segment."""
        base = self.log.latest()
        segments = self._state(base)
        live = self._live([(i, self.spark.read.schema(POSTING).parquet(s["path"])) for i, s in enumerate(segments)], segments)
        sizes = reduce(DataFrame.unionByName, [self.spark.read.schema(_DIRECTORY).parquet(s["directory"]) for s in segments])
        ranged = self._ranged(live, sizes.agg(F.sum("n")).first()[0] or 0, SORTED)
        return self.log.commit(base, {"segments": [self._store(ranged.sortWithinPartitions("lexeme", "row_id", "weight"))]})

    def find(self, terms: list[tuple[int, list[str], bool]]) -> DataFrame:
        """(row_id, ix, weight, rank) of terms (ix, lexemes, phrase or not): the first weight class that has all of the term's
        lexemes, next to each other in a phrase. Rank, for rows of one class, grows with the occurrences: the sum of
        1 + ln(occurrences)."""
        wanted = [(x, ix, k, len(words), phrase and len(words) > 1) for ix, words, phrase in terms for k, x in enumerate(words)]
        uses = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("of", "ix", "k", "n_words", "phrase"), w)]) for w in wanted])
        met = self.read(sorted({w[0] for w in wanted})).select("*", F.explode(F.filter(uses, lambda u: u["of"] == F.col("lexeme"))).alias("u")).select("*", "u.*")
        phrases = any(w[4] for w in wanted)
        where = F.collect_list(F.struct("k", "positions")) if phrases else F.lit(None).cast("array<struct<k:int,positions:array<int>>>")
        per_class = met.groupBy("row_id", "ix", "weight").agg(
            F.count("*").alias("n"), F.max("n_words").alias("n_words"), F.max("phrase").alias("phrase"), F.sum(1 + F.log(F.size("positions"))).alias("rank"), where.alias("places")
        )
        per_class = per_class.where("n = n_words")
        if phrases:
            start = F.get(F.filter("places", lambda p: p["k"] == 0), F.lit(0))["positions"]
            runs = F.exists(start, lambda at: F.forall("places", lambda p: F.array_contains(p["positions"], at + p["k"])))
            per_class = per_class.where(~F.col("phrase") | runs)
        best = per_class.groupBy("row_id", "ix").agg(F.min_by(F.struct("weight", "rank"), "weight").alias("b"))
        return best.select("row_id", "ix", "b.weight", "b.rank")
