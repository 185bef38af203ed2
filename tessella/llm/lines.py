"""Line dedup by site-relative frequency: a line on too large a share of a host's pages is boilerplate.

A page counts once per distinct line; lines without a word are never boilerplate. Null hosts form one site. Null
texts have no lines, count as pages of their site, and stay null. Lines are compared unchanged, by 128 bits of hash
within their host. Repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, null_safe, own_names, written

#: Lines to drop are broadcast up to this many rows of about 40 bytes, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("line"), line).alias("k2")]


def boilerplate(df: DataFrame, host: Column, text: str = "text", max_ratio: float = 0.02, min_pages: int = 3) -> DataFrame:
    """Rows (host, k1, k2, pages, total) for the lines that exceed the ratio."""
    base = df.select(host.alias("host"), F.col(text).alias("t"))
    totals = base.groupBy("host").agg(F.count("*").alias("total"))
    lines = base.select("host", F.explode(F.array_distinct(F.split("t", "\n"))).alias("line")).where(F.col("line").rlike(f"[^{WS[1:]}"))
    counts = lines.select("host", *_key(F.col("line"))).groupBy("host", "k1", "k2").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    found = null_safe(counts, totals, ["host"]).where(F.col("pages") > max_ratio * F.col("total"))
    return written(found.select("host", "k1", "k2", "pages", "total"), "boilerplate")


@own_names
def without_boilerplate(df: DataFrame, host: Column, text: str = "text", max_ratio: float = 0.02, min_pages: int = 3) -> DataFrame:
    """df with its columns, the lines dropped from `text`, and `n_lines` and `n_removed` at the end."""
    drop = boilerplate(df, host, text, max_ratio, min_pages)
    n = drop.count()
    drop = drop.select("host", "k1", "k2")
    # which lines go depends on host and text alone, so these are the key, whatever the ids are
    mine = df.withColumns({"__l_host": host, "__l_a": F.xxhash64(F.col(text)), "__l_b": F.xxhash64(F.lit("text"), F.col(text))})
    lines = mine.select("__l_host", "__l_a", "__l_b", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select(F.col("__l_host").alias("host"), "__l_a", "__l_b", "pos", *_key(F.col("line")))
    hits = null_safe(lines, F.broadcast(drop) if n <= BROADCAST_ROWS else drop, ["host", "k1", "k2"], "left_semi")
    # copies of a text on a host share one entry
    places = hits.groupBy(F.col("host").alias("__l_host"), "__l_a", "__l_b").agg(F.sort_array(F.collect_set("pos")).alias("__l_gone"))
    out = null_safe(mine, places, ["__l_host", "__l_a", "__l_b"], "left")
    all_lines = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains("__l_gone", i)), "\n")
    return out.select(
        *[(F.when(F.col("__l_gone").isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns],
        F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("__l_n_lines"),
        F.coalesce(F.array_size("__l_gone"), F.lit(0)).cast("long").alias("__l_n_removed"),
    )


def report(df: DataFrame) -> DataFrame:
    """Documents by source: doc_id, text without boilerplate, n_lines, n_removed."""
    out = without_boilerplate(df.select("doc_id", "text", "source"), F.col("source"))
    return out.select("doc_id", "text", F.col("__l_n_lines").alias("n_lines"), F.col("__l_n_removed").alias("n_removed"))
