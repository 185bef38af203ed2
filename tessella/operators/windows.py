"""Latest rows, sequences, keepers, bursts, sliding counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import walks


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by an order that should end in an id."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def accepted_or_superseded(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("decision", F.when(n == 1, "accepted").otherwise("superseded"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "n") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def scan_order(df: DataFrame, folder: str, name: str, time: str, most_years: int = 5) -> DataFrame:
    """Sequence 1..n per folder: by time, then natural name; by name alone if all times are equal or span too long."""
    w = Window.partitionBy(folder)
    seconds = F.unix_timestamp(F.max(time).over(w)) - F.unix_timestamp(F.min(time).over(w))
    df = df.withColumn("fallback", F.coalesce((seconds == 0) | (seconds > most_years * 365 * 86400), F.lit(True)))
    key = F.when(~F.col("fallback"), F.unix_timestamp(time))
    return df.withColumn("sequence", F.row_number().over(Window.partitionBy(folder).orderBy(key, natural_key(F.col(name)), name)))


def natural_key(x: Column) -> Column:
    """Lower case, every number padded with zeros to 64 digits."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"([0-9]+)", "0" * 64 + "$1"), r"0*([0-9]{64})(?![0-9])", "$1"))


def renumbered(df: DataFrame, keys: list[str], order: list[Column], current: str, id_col: str) -> DataFrame:
    """Only the rows whose number changes: id, old, new."""
    new = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.select(id_col, F.col(current).alias("old"), new.alias("new"), *[k for k in keys if k != id_col]).where(~F.col("old").eqNullSafe(F.col("new")))


def predecessor(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str = "front") -> DataFrame:
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def around(df: DataFrame, keys: list[str], sequence: str, reach: int, value: str, out: str = "near") -> DataFrame:
    """Values of the rows whose sequence is at most `reach` away, in order."""
    w = Window.partitionBy(*keys).orderBy(sequence).rangeBetween(-reach, reach)
    return df.withColumn(out, F.collect_list(value).over(w))


def keeper(df: DataFrame, key: str, id_col: str, better: list[Column]) -> DataFrame:
    """The row of each key that is greatest by a tuple, the smallest id of equals: a plain aggregate."""
    return df.groupBy(key).agg(F.max_by(id_col, F.struct(*better, -F.col(id_col))).alias("keeper"))


def reasons(df: DataFrame, key: str, id_col: str, flags: dict[str, str], sizes: dict[str, str], last: dict[str, str] | None = None) -> DataFrame:
    """Per key: the keeper by flags, then sizes, then the last flags, and why: the flags that it has and some other lacks, and the
    sizes in which it is above the largest other, as a ratio where that isn't zero; failing these the last flags; failing all
    "lower id". A single row is the "only member"."""
    last = last or {}
    value = {n: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for n, c in (flags | sizes | last).items()}
    best = keeper(df, key, id_col, [value[n] for n in (*flags, *sizes, *last)])
    own = F.col(id_col) == F.col("keeper")
    mine = {n: F.max(F.when(own, v)).alias(f"__m_{n}") for n, v in value.items()}
    low = {n: F.min(F.when(~own, value[n])).alias(f"__l_{n}") for n in (*flags, *last)}
    high = {n: F.max(F.when(~own, value[n])).alias(f"__h_{n}") for n in sizes}
    g = df.join(best, key).groupBy(key, "keeper").agg(F.count("*").alias("__n"), *mine.values(), *low.values(), *high.values())
    beats = lambda n: F.when((F.col(f"__m_{n}") > 0) & (F.col(f"__l_{n}") <= 0), n)

    def ratio(n: str) -> Column:
        m, h = F.col(f"__m_{n}"), F.col(f"__h_{n}")
        return F.when((m > h) & (h > 0), F.concat(F.format_string("%.1f", F.bround(m / h, 1)), F.lit(f"x {n}"))).when(m > h, f"has {n}")

    chain = F.concat_ws(" > ", *map(beats, flags), *map(ratio, sizes))
    rest = F.concat_ws(" > ", *map(beats, last)) if last else F.lit("")
    why = F.when(F.col("__n") == 1, "only member").when(chain != "", chain).when(rest != "", rest).otherwise("lower id")
    return g.select(key, "keeper", why.alias("reasons"))


def bursts(df: DataFrame, keys: list[str], time: str, id_col: str, window: float = 2.0, least: int = 3, limbs: str | None = None, most_bits: int = 4) -> DataFrame:
    """Greedy anchored groups per key: rows within `window` seconds of the first; at least so many, any two of which
    differ in few bits; else the next row becomes the anchor. Not a gap session. A key of any size is walked in sessions; a task
    holds the rows of one window. Rows without a time are in none."""
    more = [F.col(limbs).alias("limbs")] if limbs else []
    rows = df.where(F.col(time).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], walks.micros(df, time).alias("t"), F.col(id_col).cast("long").alias("id"), *more)
    apart = walks.sessions(rows, [f"k{i}" for i in range(len(keys))], int(window * 1e6))
    return walks.streamed(apart.select("session", "t", "id", *["limbs"] * bool(limbs)), walks.burst_walk(int(window * 1e6), least, most_bits), "id long, burst long, size long, span double")


def trailing_count(df: DataFrame, key: str, time: str, seconds: int, out: str = "n_recent") -> DataFrame:
    """Rows of the key in the trailing window, by times rounded to the nearest second, halves to the even one."""
    at = F.rint(walks.micros(df, time) / 1e6).cast("long")
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds, 0)
    return df.withColumn(out, F.count("*").over(w))


def admitted(df: DataFrame, key: str, time: str, id_col: str, limit: int, seconds: int = 3600) -> DataFrame:
    """The limiter's exact rule: a hit counts if fewer than `limit` admitted ones lie in the trailing window; refused
    hits don't count. Rows (key, id, ok, retry_after in seconds). A key's hits are walked in sessions; a task holds the hits that
    still count. Hits without a time are left out."""
    rows = df.where(F.col(time).isNotNull()).select(F.col(key).alias("k0"), walks.micros(df, time).alias("t"), F.col(id_col).cast("long").alias("id"))
    apart = walks.sessions(rows, ["k0"], seconds * 1_000_000)
    out = walks.streamed(apart.select("session", "t", "id", "k0"), walks.limit_walk(limit, seconds), f"key {dict(df.dtypes)[key]}, id long, ok boolean, retry_after long")
    return out.withColumnRenamed("key", key)


def tumbling(df: DataFrame, key: str, time: str, width: str, limit: int) -> DataFrame:
    w = F.window(time, width)
    return df.groupBy(key, w.alias("w")).count().select(key, F.col("w.start").alias("start"), F.col("count").alias("n"), (F.col("count") > limit).alias("over"))


def places_within(df: DataFrame, kind: str, order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 within each kind, in order, for kinds that may hold any share of the rows: a range sort deals a kind
    to many tasks, a row's place in its task's part of the kind is told from the sorted run, and the sizes of the parts before are added. The
    order has to be total, or equal rows take their numbers by chance. Nulls are a kind."""
    from .graph import kept_table

    n = max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    placed = df.select("*", F.struct(F.col(kind).isNotNull().alias("k"), F.col(kind).alias("v")).alias("__k"), F.struct(*order).alias("__o"))
    placed = placed.repartitionByRange(n, "__k", "__o").sortWithinPartitions("__k", "__o")
    placed = kept_table(placed.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")), "places")
    parts = placed.groupBy("__k", "__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__f"))
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__b", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return placed.join(parts, ["__k", "__p"]).withColumn(name, F.col("__b") + F.col("__m") - F.col("__f") + 1).select(*df.columns, name)


def stratified(df: DataFrame, kind: str, id_col: str, per_kind: int, total: int) -> DataFrame:
    """Every k-th row of each kind, so that about `per_kind` are taken, dealt round-robin up to `total`."""
    placed = places_within(df, kind, [F.col(id_col)], "__r")
    sizes = df.groupBy(F.col(kind).alias("__kind")).agg(F.count("*").alias("__n"))
    step = F.greatest(F.floor(F.col("__n") / per_kind), F.lit(1))
    taken = placed.join(sizes, F.col(kind).eqNullSafe(F.col("__kind"))).where((F.col("__r") - 1) % step == 0).withColumn("rank", ((F.col("__r") - 1) / step + 1).cast("int"))
    return taken.where(F.col("rank") <= per_kind).orderBy("rank", kind).limit(total).drop("__r", "__n", "__kind")
