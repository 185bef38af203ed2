"""Benchmark decontamination with SimHash windows and a multi-index over Hamming blocks.

Item-sized windows of documents are fingerprinted from their words. The 64 bits are cut into eight blocks; a pair
within 23 bits has at least one block that differs in at most two bits, so each item is stored under its blocks
and all their neighbours of one and two bits, and every window within the radius meets it there. Candidates are then verified
by the exact weighted similarity of their five-word shingles (weight: the shingle's length, times its count). A window as
similar as 0.8 differs in nine bits on average and beyond 23 about once in a million.

Windows are only fingerprinted where verification can succeed: what a window shares with an item weighs at least
`threshold` times the item, so a document needs shingles of the item of that weight, and windows start where a shared
shingle puts the item's start.

Words are runs of letters and digits in lower case. Items of fewer than five words have no shingle and match
nothing. Null texts have no words. Rows of equal id and text count once. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_safe, own_names, text_or_empty, written

SHINGLE, RADIUS, BLOCKS = 5, 23, 8
#: Item tables, and documents with candidates, are broadcast up to this many bytes, and shuffled beyond.
BROADCAST_BYTES = 32 << 20


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bounded(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df with a broadcast hint if its rows, of 64 bytes and what `size` says, are proven few enough."""
    total = df.agg(F.sum(F.lit(64).cast("long") + (size if size is not None else F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def _shingle_rows(df: DataFrame, keep: list[str], w: str = "w", weights: bool = False) -> DataFrame:
    """keep, pos, h (and weight, its length): a row per shingle. Shifted copies of the words are zipped and generated, all in
    compiled code."""
    n = F.greatest(F.size(w) - SHINGLE + 1, F.lit(0))
    zipped = F.arrays_zip(*[F.slice(w, F.lit(i + 1), n).alias(f"s{i}") for i in range(SHINGLE)])
    rows = df.select(*keep, F.posexplode(zipped).alias("pos", "s"))
    length = [F.length(F.concat_ws(" ", *[F.col(f"s.s{i}") for i in range(SHINGLE)])).cast("long").alias("weight")] if weights else []
    return rows.select(*keep, "pos", F.xxhash64(*[F.col(f"s.s{i}") for i in range(SHINGLE)]).alias("h"), *length)


def fingerprint(w: Column) -> Column:
    """64-bit SimHash of an array of words."""
    zero = F.array_repeat(F.lit(0), 64)

    def add(acc: Column, x: Column) -> Column:
        return F.transform(acc, lambda c, i: c + F.call_function("getbit", F.xxhash64(x), i).cast("int"))

    counts = F.aggregate(w, zero, add)
    ones = F.transform(counts, lambda c, i: F.when(c * 2 > F.size(w), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _blocks(fp: str, near: bool) -> Column:
    """Structs (block, value); with `near`, also each value's neighbours of one and two bits: a few lambdas, since 296 written-out
    structs weigh on the driver in every plan that holds them."""
    flips = F.split(F.lit(",".join(map(str, [0, *sorted({1 << i | 1 << j for i in range(8) for j in range(8)})] if near else [0]))), ",").cast("array<bigint>")

    def values(b: Column) -> Column:
        value = F.call_function("shiftrightunsigned", F.col(fp), b * 8).bitwiseAND(F.lit(255).cast("long"))
        return F.transform(flips, lambda flip: F.struct(b.alias("block"), value.bitwiseXOR(flip).alias("value")))

    return F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), values))).alias("k")


def _joined_shingles(w: Column) -> Column:
    n = F.greatest(F.size(w) - SHINGLE + 1, F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))).otherwise(F.array().cast("array<string>"))


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document and item that match: doc_id, text_key, item_id, start_word, n_words, similarity of the best window."""
    i = items.select("item_id", plain_words(text_or_empty("text")).alias("iw")).dropDuplicates(["item_id", "iw"])
    i = i.where(F.size("iw") >= SHINGLE).withColumns({"n": F.size("iw"), "item_key": F.xxhash64("iw")})
    i = written(i.withColumn("ifp", fingerprint(F.col("iw"))), "items")
    item_rows = _shingle_rows(i.select("item_key", "n", F.col("iw").alias("w")).dropDuplicates(["item_key"]), ["item_key", "n"])
    # the weight of an item's shingle: its length, times its count
    lengths = _shingle_rows(i.select("item_key", F.col("iw").alias("w")).dropDuplicates(["item_key"]), ["item_key"], weights=True)
    weights = lengths.groupBy("item_key", "h").agg(F.sum("weight").alias("weight"))
    item_rows = written(item_rows.withColumnRenamed("pos", "off").join(weights, ["item_key", "h"]), "item-shingles")
    d = docs.select(F.col("doc_id"), F.xxhash64(text_or_empty("text")).alias("text_key"), text_or_empty("text").alias("text"))
    rows = _shingle_rows(d.select("doc_id", "text_key", plain_words(F.col("text")).alias("w")), ["doc_id", "text_key"])
    hits = rows.join(_bounded(item_rows), "h")
    # by item: enough weight of different shingles, and where the item would start
    places = hits.groupBy("doc_id", "text_key", "item_key", "n").agg(F.collect_set(F.struct("h", "weight")).alias("shared"), F.collect_set(F.col("pos") - F.col("off")).alias("starts"))
    places = places.withColumn("shared", F.aggregate("shared", F.lit(0).cast("long"), lambda acc, x: acc + x["weight"]))
    whole = weights.groupBy("item_key").agg(F.sum("weight").alias("whole"))
    places = places.join(_bounded(whole), "item_key").where(F.col("shared") >= F.col("whole") * threshold)
    places = places.select("doc_id", "text_key", "n", F.explode("starts").alias("start")).distinct()
    windows = written(places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("places")), "places")
    found = null_safe(d, _bounded(windows, F.size("places") * 16), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    found = found.select("doc_id", "text_key", plain_words(F.col("text")).alias("w"), "places")
    found = found.select("doc_id", "text_key", F.explode("places").alias("p"), "w").select("doc_id", "text_key", F.greatest("p.start", F.lit(0)).alias("start"), "p.n", "w")
    found = found.select("doc_id", "text_key", "start", "n", F.slice("w", F.col("start") + 1, F.col("n")).alias("ww")).where(F.size("ww") >= SHINGLE)
    found = written(found.withColumn("fp", fingerprint(F.col("ww"))), "windows")
    index = i.select("item_id", "item_key", "ifp", "n", _blocks("ifp", True)).select("item_id", "item_key", "ifp", "n", "k.block", "k.value")
    probes = found.select("doc_id", "text_key", "start", "n", "fp", "ww", _blocks("fp", False)).select("doc_id", "text_key", "start", "n", "fp", "ww", "k.block", "k.value")
    close = probes.join(_bounded(index), ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    close = close.dropDuplicates(["doc_id", "text_key", "start", "n", "item_id", "item_key"])
    texts = i.select("item_key", "iw").dropDuplicates(["item_key"])
    close = close.join(_bounded(texts, F.size("iw") * 24), "item_key")
    # exact similarity of the two bags of shingles
    pair = ["doc_id", "text_key", "start", "n", "item_id", "item_key"]
    side = lambda col, a, b: close.select(*pair, F.explode(_joined_shingles(F.col(col))).alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    bags = side("ww", 1, 0).unionByName(side("iw", 0, 1)).groupBy(*pair, "s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    weigh = F.length("s")
    scored = bags.groupBy(*pair).agg((F.sum(F.least("a", "b") * weigh) / F.sum(F.greatest("a", "b") * weigh)).alias("similarity")).where(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("start", "n", "similarity"), F.struct("similarity", -F.col("start"))).alias("x")
    return scored.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", F.col("x.start").cast("long").alias("start_word"), F.col("x.n").cast("long").alias("n_words"), F.col("x.similarity"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return matches(docs, items).groupBy("doc_id", "item_id").agg(F.min_by("start_word", F.struct(-F.col("similarity"), "start_word")).alias("start_word"), F.max("n_words").alias("n_words"), F.round(F.max("similarity"), 6).alias("similarity"))


@own_names
def without_matches(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    bad = written(matches(docs, items, threshold).select("doc_id", "text_key").distinct(), "contaminated")
    marked = docs.withColumn("__d_key", F.xxhash64(text_or_empty("text")))
    bad = bad.select(F.col("doc_id").alias("__d_id"), F.col("text_key").alias("__d_bad"))
    return marked.join(_bounded(bad), marked["doc_id"].eqNullSafe(F.col("__d_id")) & (F.col("__d_key") == F.col("__d_bad")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
