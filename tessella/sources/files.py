"""Files as tables: trees, hashes, manifests, line JSON, CSV exports."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import scan_order

EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "heic", "webp")


def file_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, content: bool = False) -> DataFrame:
    """path, folder, name, modified, length (and content) of a tree's files with a wanted extension. Like all of Spark's
    readers it passes over files and folders whose names start with an underscore or a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = files.where(ext.isin(*extensions)).select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"), "length", "content")
    return out if content else out.drop("content")


def numbered_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    return scan_order(file_tree(spark, root, extensions), "folder", "name", "modified")


def content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256)).drop("content")


def ingest(files: DataFrame, known: DataFrame, decoded: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, already known, quarantined) files: hashed, anti-joined with known hashes, and those that a decoder (a
    struct of value and error) refuses set aside with the reason, so that one bad file stops nothing."""
    h = files.withColumn("sha256", F.sha2("content", 256)).withColumn("__d", decoded)
    bad = h.where(F.col("__d.error").isNotNull()).select("path", "sha256", F.col("__d.error").alias("error"))
    good = h.where(F.col("__d.error").isNull())
    k = known.select(F.col("sha256").alias("__k")).distinct()
    seen = good.join(k, good["sha256"] == F.col("__k"), "left_semi").drop("__d")
    fresh = good.join(k, good["sha256"] == F.col("__k"), "left_anti").withColumn("value", F.col("__d.value")).drop("__d")
    return fresh, seen, bad


def folder_hints(df: DataFrame, folder: str) -> DataFrame:
    """(folder, kind, value, confidence): a month from the deepest _YYYY-MM part, an album from the last named part."""
    months = F.regexp_extract_all(F.col(folder), F.lit(r"_((?:19|20)\d{2}-(?:0[1-9]|1[0-2]))(?=/|$)"), 1)
    last = F.element_at(F.split(folder, "/"), -1)
    named = F.trim(F.regexp_replace(F.regexp_replace(last, r"_(?:19|20)\d{2}-\d{2}$", ""), "[_-]+", " "))
    each = df.select(F.col(folder).alias("folder"), F.when(F.size(months) > 0, F.element_at(months, -1)).alias("m"), named.alias("a")).distinct()
    month = each.where("m is not null").select("folder", F.lit("date").alias("kind"), F.col("m").alias("value"), F.lit(0.3).alias("confidence"))
    album = each.where(F.col("a").rlike("[A-Za-z]")).select("folder", F.lit("album").alias("kind"), F.col("a").alias("value"), F.lit(0.5).alias("confidence"))
    return month.unionByName(album)


def manifest_groups(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, group_id) from JSON manifests {"files": [{"name", "groups": [..]}]}, one per file or, with `lines`, per line."""
    m = spark.read.schema("files array<struct<name: string, groups: array<bigint>>>").json(path, multiLine=not lines)
    return m.select(F.explode("files").alias("f")).select(F.col("f.name").alias("file"), F.explode("f.groups").alias("group_id"))


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, change in added, removed, changed) between two tables (path, sha256)."""
    x, y = a.select(F.col("path").alias("p"), F.col("sha256").alias("h")), b.select(F.col("path").alias("q"), F.col("sha256").alias("i"))
    j = x.join(y, F.col("p") == F.col("q"), "full_outer")
    change = F.when(F.col("p").isNull(), "added").when(F.col("q").isNull(), "removed").when(F.col("h") != F.col("i"), "changed")
    return j.select(F.coalesce("p", "q").alias("path"), change.alias("change")).where("change is not null")


def read_results(spark: SparkSession, path: str, schema: str, after: int | None = None) -> DataFrame:
    """Lines of JSON, without malformed and summary lines; `after` skips what a cursor has seen by its `line` field."""
    rows = spark.read.schema(f"{schema}, summary boolean, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where(F.col("_bad").isNull() & ~F.coalesce("summary", F.lit(False))).drop("summary", "_bad")
    return rows if after is None else rows.where(F.col("line") > after)


def dump_csv(tables: dict[str, tuple[DataFrame, str]], folder: str, single: bool = False) -> dict[str, int]:
    """One CSV folder per table, range-sorted by its key, so that the parts in order are the table in order; with
    `single`, one part (for tables known to be small)."""
    counts = {}
    for name, (df, key) in tables.items():
        df = df.coalesce(1).sortWithinPartitions(key) if single else df.orderBy(key)
        df.write.mode("overwrite").option("quoteAll", "false").csv(f"{folder}/{name}", header=True)
        counts[name] = df.sparkSession.read.csv(f"{folder}/{name}", header=True).count()
    return counts


def csv_cell(x: Column) -> Column:
    """Quoted, with doubled quotes, where a comma, quote or line end asks for it."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text line per row; list cells are joined by '; '."""
    kinds = dict(df.dtypes)
    cells = [csv_cell(F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c)) for c in columns]
    return df.select(F.concat_ws(",", *cells).alias("value"))


def export_plan(rows: DataFrame, id_col: str, path: Column, lists: dict[str, tuple[DataFrame, str, str]], present: str) -> DataFrame:
    """Every row with its lists (table, key, value), its destination and whether its file is missing."""
    for name, (table, key, value) in lists.items():
        c = table.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_set(value)).alias(name))
        rows = rows.join(c, rows[id_col] == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.array().cast(f"array<{dict(table.dtypes)[value]}>")))
    return rows.withColumns({"destination": path, "missing": ~F.coalesce(present, F.lit(False))})


ARCHIVES = "archive string, entries long, bytes long"


def zip_archives(rows: DataFrame, folder: str, archives: int, name: str = "destination", content: str = "content") -> DataFrame:
    """Writes rows (name, content as bytes) into ZIP archives, stored without compression, and returns their manifest (archive,
    entries, bytes). A row's archive follows from its name; each is written by one task under a temporary name, entry by entry
    in order of the names, and moved to its own; a repeated task writes the same again. Rows without content are left out, and
    of equal names the second gets " (2)" and so on before its extension."""
    spark = rows.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, sink, number, last, same, n = None, None, None, None, 1, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            out.close()
            size = sink.tell()
            sink.close()
            final = f"archive-{number:05d}.zip"
            fs.move(f"{root}/{temporary}", f"{root}/{final}")
            done.append((final, n, size))

        for b in batches:
            for part, entry, data in zip(*(b.column(i) for i in range(3))):
                part, entry, data = part.as_py(), entry.as_py(), data.as_py()
                if part != number:
                    if out:
                        close()
                    number, n, last = part, 0, None
                    temporary = f".archive-{number:05d}.{uuid4().hex}.tmp"
                    sink = fs.open_output_stream(f"{root}/{temporary}", compression=None)
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                same = same + 1 if entry == last else 1
                last = entry
                stem, dot, ext = entry.rpartition(".")
                unique = entry if same == 1 else f"{stem} ({same}){dot}{ext}" if dot else f"{entry} ({same})"
                out.writestr(zipfile.ZipInfo(unique, (1980, 1, 1, 0, 0, 0)), data)
                n += 1
        if out:
            close()
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["archive", "entries", "bytes"])

    part = F.pmod(F.xxhash64(name), F.lit(archives)).cast("int")
    chosen = rows.where(F.col(content).isNotNull()).select(part.alias("part"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    placed = chosen.repartitionById(archives, "part").sortWithinPartitions("part", "name", F.xxhash64("content"))
    placed.mapInArrow(task, ARCHIVES).write.mode("overwrite").parquet(f"{folder}-manifest")
    return spark.read.schema(ARCHIVES).parquet(f"{folder}-manifest")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
