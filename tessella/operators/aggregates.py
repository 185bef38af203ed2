"""Counts with filters, roll-ups, histograms, reports, means of vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_where(cases: dict[str, Column]) -> list[Column]:
    """One filtered count per case, over one scan."""
    return [F.count_if(c).alias(n) for n, c in cases.items()]


def activity(df: DataFrame, user: str, kind: str, time: str, month: str, kinds: dict[str, list[str]], sums: dict[str, Column] | None = None) -> DataFrame:
    """Per user: counts of a month's rows by groups of kinds, and sums; users without any are left out."""
    start = F.to_timestamp(F.lit(f"{month}-01"))
    rows = df.where((F.col(time) >= start) & (F.col(time) < F.add_months(start, 1).cast("timestamp")))
    counts = count_where({n: F.col(kind).isin(*k) for n, k in kinds.items()})
    out = rows.groupBy(user).agg(*counts, *[v.alias(n) for n, v in (sums or {}).items()])
    return out.where(reduce(lambda a, b: a + b, [F.col(n) for n in kinds]) > 0)


def totals(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row of independent aggregates; each side of the cross product is one row."""
    one = [df.agg(c.alias(n)) for n, (df, c) in parts.items()]
    return reduce(lambda a, b: a.crossJoin(b), one)


def facets(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(facet, value, n) of several groupings at once; the rows are read once."""
    names = list(columns)
    keyed = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), columns[n].cast("string").alias("value")) for n in names])).alias("k"))
    return keyed.groupBy("k.facet", "k.value").agg(F.count("*").alias("n"))


def decade(date: Column) -> Column:
    return (F.floor(F.year(date) / 10) * 10).cast("int")


def first_by(value: str, order: list[Column], only: Column | None = None) -> Column:
    """The value of the first row by an order; the order's parts must be comparable ascending."""
    key = F.struct(*order)
    return F.min_by(F.when(only, F.col(value)) if only is not None else F.col(value), F.when(only, key) if only is not None else key)


def joined_distinct(col: str, separator: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(col)), separator)


def as_json(fields: list[str]) -> Column:
    """A JSON array of the group's rows, sorted by the fields."""
    return F.to_json(F.sort_array(F.collect_list(F.struct(*fields))))


def status_of(n: Column, approved: Column, rejected: Column) -> Column:
    """Of a set of files: pending, partial, approved or rejected."""
    done = approved + rejected
    return F.when(n == 0, "pending").when(done == 0, "pending").when(done < n, "partial").when(approved == 0, "rejected").otherwise("approved")


def weighted_flags(df: DataFrame, key: str, flags: dict[str, tuple[DataFrame | Column, int]], out: str = "score") -> DataFrame:
    """Sum of the weights of the flags that hold: a Column, or being a key of a table."""
    score = F.lit(0)
    for i, (what, weight) in enumerate(flags.values()):
        if isinstance(what, DataFrame):
            k = what.select(F.col(what.columns[0]).alias(f"__k{i}")).distinct()
            df = df.join(k, df[key] == F.col(f"__k{i}"), "left").withColumn(f"__f{i}", F.col(f"__k{i}").isNotNull()).drop(f"__k{i}")
            score = score + F.when(F.col(f"__f{i}"), weight).otherwise(0)
        else:
            score = score + F.when(F.coalesce(what, F.lit(False)), weight).otherwise(0)
    return df.withColumn(out, score).drop(*[f"__f{i}" for i in range(len(flags))])


def progress(parts: dict[str, DataFrame], done: DataFrame) -> DataFrame:
    """(job, eligible, done) per job; `done` has a row (job, id) per finished item."""
    eligible = reduce(DataFrame.unionByName, [d.groupBy().agg(F.count("*").alias("eligible")).select(F.lit(n).alias("job"), "eligible") for n, d in parts.items()])
    return eligible.join(done.groupBy("job").agg(F.count("*").alias("done")), "job", "left").select("job", "eligible", F.coalesce("done", F.lit(0)).alias("done"))


def key_frequency(df: DataFrame, payload: str) -> DataFrame:
    return df.select(F.explode(F.json_object_keys(payload)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def table_status(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, n, latest) of several tables."""
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n"), F.max(t).cast("timestamp").alias("latest")).select(F.lit(n).alias("table"), "n", "latest") for n, (d, t) in tables.items()])


def at_least(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bound, n): rows with at least the bound; one pass."""
    one = df.agg(*[F.count_if(F.col(value) >= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("x.bound", "x.n")


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    return df.groupBy((F.floor(value / width)).alias("bucket")).agg(F.count("*").alias("n"))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean): element-wise, with partial sums in the map tasks."""
    per = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def mean_pairwise_cosine(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, mean cosine distance over pairs), without forming a pair: the sum of all dot products of unit vectors
    is the squared length of their sum."""
    from ..functions.values import unit

    u = df.select(key, F.posexplode(unit(F.col(vector))).alias("i", "x"))
    per = u.groupBy(key, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("q"))
    g = per.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"))
    return g.where("n > 1").select(key, "n", (1 - (F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("mean_distance"))


def size_estimate(df: DataFrame, size: str, copies: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(size).isNull()).alias("missing"), F.sum(F.coalesce(size, F.lit(0))).alias("bytes"), F.sum(F.coalesce(size, F.lit(0)) * copies).alias("bytes_with_copies"))


def with_total(df: DataFrame, out: str = "total") -> DataFrame:
    """Every row with the number of rows: a count of its own, as a window over everything would be one task."""
    return df.crossJoin(df.agg(F.count("*").alias(out)))


def unique_labels(df: DataFrame, name: str, year: str, id_col: str, out: str = "label") -> DataFrame:
    """Names that differ in nothing but case get the year, and still equal ones the id."""
    first = Window.partitionBy(F.lower(name))
    with_year = F.when((F.count("*").over(first) > 1) & F.col(year).isNotNull(), F.concat(F.col(name), F.lit(" (b. "), F.col(year).cast("string"), F.lit(")"))).otherwise(F.col(name))
    df = df.withColumn("__l", with_year)
    second = Window.partitionBy(F.lower("__l"))
    return df.withColumn(out, F.when(F.count("*").over(second) > 1, F.concat(F.col("__l"), F.lit(" #"), F.col(id_col).cast("string"))).otherwise(F.col("__l"))).drop("__l")
