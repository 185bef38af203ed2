"""Near-duplicates over 256-bit hashes: banded candidate pairs, components, keepers, resolving and undoing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import hamming, limbs


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only in local mode without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return root.rstrip("/")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def _band_masks(bands: int) -> list[list[int]]:
    """256 bits dealt in turn to so many bands: for each four signed 64-bit masks."""
    masks = [[sum(1 << b for b in range(64) if (b + 64 * limb) % bands == i) for limb in range(4)] for i in range(bands)]
    return [[m - (1 << 64) if m >> 63 else m for m in each] for each in masks]


#: Hashes of a band's value that meet in one task, and rows of small buckets that are dealt to one group, about.
BLOCK, DEALT = 2048, 20_000
_FOUND = "a long, b long, distance int"


def _found(t: pa.Table, i: np.ndarray, j: np.ndarray, bits: np.ndarray, masks: np.ndarray, distance: int) -> pa.Table:
    """Those of the pairs i, j of rows that are within the distance, in the first band that they share and in no other."""
    near = np.flatnonzero(bits <= distance)
    i, j, rep, limb = i[near], j[near], t["rep"].to_numpy(), [t[f"l{k}"].to_numpy() for k in range(4)]
    apart = np.zeros((len(masks), len(near)), bool)
    for k, x in enumerate(limb):
        apart |= ((x[i] ^ x[j])[None] & masks[:, k : k + 1]) != 0
    own = np.flatnonzero(apart.argmin(axis=0) == t["band"].to_numpy()[i]) if len(near) else near
    a, b = rep[i[own]], rep[j[own]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": bits[near][own].astype(np.int32)})


def _small_buckets(masks: np.ndarray, distance: int):
    """Rows of whole small buckets: each meets the next of its bucket, then the next but one, and so on."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(np.lexsort((t["value"].to_numpy(), t["band"].to_numpy())))
        band, value, limb = t["band"].to_numpy(), t["value"].to_numpy(), np.stack([t[f"l{k}"].to_numpy() for k in range(4)], axis=1)
        out, live, k = [], np.arange(len(t)), 1
        while len(live := live[live < len(t) - k]):
            live = live[(band[live] == band[live + k]) & (value[live] == value[live + k])]
            out.append(_found(t, live, live + k, np.bitwise_count((limb[live] ^ limb[live + k]).view(np.uint64)).sum(axis=1, dtype=np.int32), masks, distance))
            k += 1
        return pa.concat_tables(out) if out else _found(t, live, live, np.zeros(0, np.int32), masks, distance)

    return run


def _two_blocks(masks: np.ndarray, distance: int):
    """Rows of two blocks of a large bucket, or of one: each of the one meets each of the other."""

    def run(t: pa.Table) -> pa.Table:
        block, x, y = t["block"].to_numpy(), t["x"][0].as_py(), t["y"][0].as_py()
        limb, rows, columns = [t[f"l{k}"].to_numpy() for k in range(4)], np.flatnonzero(block == x), np.flatnonzero(block == y)
        out = [_found(t, rows[:0], rows[:0], np.zeros(0, np.int32), masks, distance)]
        for lo in range(0, len(rows), 256):
            some = rows[lo : lo + 256]
            bits = sum(np.bitwise_count((v[some][:, None] ^ v[columns][None]).view(np.uint64)).astype(np.int16) for v in limb)
            i, j = np.nonzero(bits <= distance)
            if x == y:
                once = some[i] < columns[j]
                i, j = i[once], j[once]
            out.append(_found(t, some[i], columns[j], bits[i, j], masks, distance))
        return pa.concat_tables(out)

    return run


def hamming_pairs(df: DataFrame, id_col: str, hexa: str, distance: int) -> DataFrame:
    """Pairs (a, b, distance) within `distance` <= 15 bits of 256; a row without a hash has none. The bits are dealt to distance + 1
    bands, of which two such hashes agree in one, so that a grouping by bands misses none and a band is as wide as can be (23 bits for
    ten: a hash meets one in eight million that are far from it). Hashes of long texts are alike in most bits, so that a band's value may
    have a good part of all rows: such a bucket is dealt in blocks, of which two meet in a task. A pair comes out of its first band alone.
    Rows are deduplicated by hash first, so copies do not multiply in a band."""
    if not 0 <= distance <= 15:
        raise ValueError("bands are selective up to 15 bits; use brute_pairs beyond")
    h = df.select(F.col(id_col).cast("long").alias("id"), F.lower(hexa).alias("hex")).where(F.col("hex").isNotNull())
    reps = h.groupBy("hex").agg(F.min("id").alias("rep"))
    masks = _band_masks(distance + 1)
    signed = np.array(masks, np.int64)
    part = lambda k, m: F.col(f"l{k}").bitwiseAND(F.lit(m).cast("long"))
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(*[part(k, m) for k, m in enumerate(each)]).alias("value")) for i, each in enumerate(masks)])
    limb = [f"l{k}" for k in range(4)]
    split = reps.select("rep", limbs(F.col("hex")).alias("l")).select("rep", *[F.get("l", F.lit(k)).alias(f"l{k}") for k in range(4)])
    rows = split.select("rep", *limb, F.explode(keys).alias("k")).select("rep", *limb, "k.band", "k.value")
    rows = rows.join(rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"), ["band", "value"])
    groups = -(-reps.count() * len(masks) // DEALT) or 1
    few = rows.where(F.col("n") <= BLOCK).drop("n").groupBy(F.pmod(F.xxhash64("band", "value"), F.lit(groups)))
    many = rows.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("n", "blocks", "other")
    near = few.applyInArrow(_small_buckets(signed, distance), _FOUND).unionByName(many.groupBy("band", "value", "x", "y").applyInArrow(_two_blocks(signed, distance), _FOUND))
    copies = h.join(reps, "hex").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    return near.unionByName(copies)


def brute_pairs(df: DataFrame, id_col: str, hexa: str, distance: int) -> DataFrame:
    """Every pair within any distance: compares all rows, whose number's square it takes. Rows are broadcast in blocks, and dealt so that a task
    compares 200 million pairs at most."""
    from .joins import BROADCAST_ROWS, in_blocks

    h = df.select(F.col(id_col).cast("long").alias("id"), limbs(F.lower(hexa)).alias("l"))
    n = h.count()
    parts = max(-(-n * min(n, 2 * BROADCAST_ROWS) // 200_000_000), h.rdd.getNumPartitions(), 1)
    x = h.repartition(parts).alias("x")

    def each(block: DataFrame) -> DataFrame:
        p = x.join(block.toDF("y_id", "y_l"), F.col("x.id") < F.col("y_id"))
        return p.select(F.col("x.id").alias("a"), F.col("y_id").alias("b"), hamming(F.col("x.l"), F.col("y_l")).alias("distance")).where(F.col("distance") <= distance)

    return in_blocks(h, "id", each)


def without_pairs(pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pairs but for the excluded ones, which are ordered here whatever their order was."""
    return pairs.join(ordered_pairs(excluded, *excluded.columns[:2]), ["a", "b"], "left_anti")


def stars(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, group) of all that can reach a smaller id: group is the smallest. Large-star and small-star steps over written
    tables, until nothing changes."""
    e = kept_table(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = kept_table(small.where("a <> b").distinct(), "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("group")).select(F.col("a").alias("id"), "group")


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, group) of all that occur in a pair of two: group is the smallest id reachable."""
    members = stars(pairs, rounds)
    return members.unionByName(members.select(F.col("group").alias("id"), "group").distinct())


def duplicate_groups(pairs: DataFrame, facts: DataFrame, id_col: str, better: list[Column]) -> DataFrame:
    """Members of each group with the keeper, the group's size and least edge, and the member's edge to the keeper (else its least edge)."""
    pairs = kept_table(pairs, "pairs")
    groups = kept_table(components(pairs), "groups")
    known = groups.join(facts.withColumnRenamed(id_col, "id"), "id")
    best = known.groupBy("group").agg(F.max_by("id", F.struct(*better, -F.col("id"))).alias("keeper"), F.count("*").alias("size"))
    both = pairs.select("a", "b", "distance").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    m = groups.join(best, "group").join(both.withColumnRenamed("a", "id"), "id", "left")
    to_keeper = F.min(F.when(F.col("b") == F.col("keeper"), F.col("distance")))
    per = m.groupBy("group", "id", "keeper", "size").agg(F.when(F.col("id") == F.col("keeper"), 0).otherwise(F.coalesce(to_keeper, F.min("distance"))).alias("edge"), F.min("distance").alias("__least"))
    least = per.groupBy("group").agg(F.min("__least").alias("min_distance"))
    return per.join(least, "group").drop("__least")


def near_misses(pairs: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    return pairs.where(F.col("distance").between(low, high)).groupBy("a", "b").agg(F.min("distance").alias("distance")).orderBy("distance", "a", "b").limit(limit)


def first_near_misses(df: DataFrame, id_col: str, hexa: str, low: int, high: int, limit: int, first: int = 1_000) -> DataFrame:
    """near_misses of all pairs of different hashes, without making them all. The first pairs by distance, a and b are looked for where they are: the
    hashes with the smallest ids, `first` of them, meet all others; if they have `limit` pairs of the least distance, no pair of others
    comes before these. Else all pairs are made, within a distance that grows until there are enough, since bands are wider for less."""
    h = df.select(F.col(id_col).cast("long").alias("id"), F.lower(hexa).alias("hex")).where(F.col("hex").isNotNull()).groupBy("hex").agg(F.min("id").alias("id"))
    h = kept_table(h.select("id", limbs(F.col("hex")).alias("l")), "reps")
    if low > 0:
        x = F.broadcast(h.orderBy("id").limit(first).toDF("a", "x"))
        met = h.join(x, F.col("a") < F.col("id")).select("a", F.col("id").alias("b"), hamming(F.col("x"), F.col("l")).alias("distance"))
        found = kept_table(near_misses(met, low, high, limit), "misses")
        if found.where(F.col("distance") == low).count() == limit or h.count() <= first:
            return found.orderBy("distance", "a", "b")
    for most in range(low, high + 1):
        found = kept_table(near_misses(hamming_pairs(df, id_col, hexa, most), low, most, limit), "misses")
        if most == high or found.count() == limit:
            break
    return found.orderBy("distance", "a", "b")


def rekeyed(child: DataFrame, mapping: DataFrame, key: str, unique: list[str]) -> DataFrame:
    """Child rows of losers moved to their keepers (mapping: loser, keeper), identical ones once."""
    j = child.join(mapping, F.col(key) == F.col("loser"), "left")
    moved = j.select(*[F.coalesce("keeper", key).alias(c) if c == key else F.col(c) for c in child.columns])
    return moved.dropDuplicates(unique)


def resolve(rows: DataFrame, mapping: DataFrame, id_col: str, flag: str, private: str) -> tuple[DataFrame, DataFrame]:
    """(new rows, log): losers are flagged, and a keeper becomes private if any of its losers was."""
    carried = rows.join(mapping, rows[id_col] == F.col("loser")).groupBy("keeper").agg(F.bool_or(private).alias("__p"))
    j = rows.join(mapping.select(F.col("loser"), F.col("keeper").alias("__k")), rows[id_col] == F.col("loser"), "left").join(carried, rows[id_col] == F.col("keeper"), "left")
    lost, shut = F.col("loser").isNotNull(), F.coalesce("__p", F.lit(False))
    new = {flag: F.col(flag) | lost, private: F.col(private) | shut}
    after = j.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])
    log = j.where(lost | (shut & ~F.col(private))).select(F.col(id_col).alias("entity_id"), F.when(lost, "resolve_loser").otherwise("carry_private").alias("action"), F.struct(flag, private).alias("previous"), F.struct(new[flag].alias(flag), new[private].alias(private)).alias("new"))
    return after, log


def undo_resolve(rows: DataFrame, log: DataFrame, id_col: str, flag: str, private: str) -> DataFrame:
    j = rows.join(log.select(F.col("entity_id"), F.col("previous").alias("__old")), rows[id_col] == F.col("entity_id"), "left")
    return j.select(*[F.coalesce(F.col(f"__old.{c}"), F.col(c)).alias(c) if c in (flag, private) else F.col(c) for c in rows.columns])


def merge_entities(faces: DataFrame, variants: DataFrame, winner: int, loser: int) -> tuple[DataFrame, DataFrame]:
    """Faces of the loser become the winner's; so do name variants that the winner lacks, whatever their case."""
    moved = faces.withColumn("person_id", F.when(F.col("person_id") == loser, winner).otherwise(F.col("person_id")))
    held = variants.where(F.col("person_id") == winner).select(F.lower("variant").alias("__v"))
    mine = variants.where(F.col("person_id") == loser)
    gain = mine.join(held, F.lower(mine["variant"]) == F.col("__v"), "left_anti").withColumn("person_id", F.lit(winner).cast(dict(variants.dtypes)["person_id"]))
    return moved, variants.where(F.col("person_id") != loser).unionByName(gain)
