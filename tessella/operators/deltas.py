"""Aggregates kept up to date by signed deltas: counts and sums are added to, minima and maxima are refilled only where they went.

A view has a row for each key: `n`, the sums, and for each extreme its value and how many rows have it. A delta is a row with `sign` 1 or
-1 (an update is one of each). Folding reads the view and the deltas; the base table is read only for keys whose last row
with an extreme was taken out and where no delta says what comes next, and only through `refill`. Null values count for nothing in
sums and extremes. Null keys are a key. Keys without rows leave the view. Deltas must be those of the base: a row that was never there
can't be taken out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept_table

#: Which way an extreme looks.
EXTREMES = {"min": (F.min, F.least, lambda a, b: a < b), "max": (F.max, F.greatest, lambda a, b: a > b)}


def _named(extremes: dict[str, str]) -> list[tuple[str, str, str]]:
    """(name, kind, column) of extremes given as {"min": "a", "max": "b"} or {"min": "a,b"}."""
    return [(f"{kind}_{c}", kind, c) for kind, columns in extremes.items() for c in columns.split(",")]


def built(rows: DataFrame, keys: list[str], sums: list[str] = (), extremes: dict[str, str] | None = None) -> DataFrame:
    """The view of a whole table."""
    named = _named(extremes or {})
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0).cast(dict(rows.groupBy().agg(F.sum(c).alias("x")).dtypes)["x"])).alias(f"sum_{c}") for c in sums], *[EXTREMES[kind][0](c).alias(name) for name, kind, c in named])
    for name, _, c in named:
        ends = rows.join(out.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(name).alias("__v")), _same(keys) & (F.col(c) == F.col("__v")))
        counts = ends.groupBy(*[F.col(f"__k{i}") for i in range(len(keys))]).agg(F.count("*").alias(f"{name}_n"))
        out = out.join(counts, _same(keys), "left").drop(*[f"__k{i}" for i in range(len(keys))]).withColumn(f"{name}_n", F.coalesce(f"{name}_n", F.lit(0)))
    return out


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])


def folded(view: DataFrame, deltas: DataFrame, keys: list[str], sums: list[str] = (), extremes: dict[str, str] | None = None, refill: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The view after the deltas (keys, values, sign). refill: given keys, their rows as they are now."""
    named = _named(extremes or {})
    sign = F.col("sign").cast("long")
    signed = lambda c: F.coalesce(F.sum(F.col(c) * F.col("sign")), F.lit(0))
    kinds = dict(view.dtypes)
    changes = deltas.groupBy(*keys).agg(F.sum(sign).alias("__n"), *[signed(c).cast(kinds[f"sum_{c}"]).alias(f"__sum_{c}") for c in sums])
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    drop = [f"__k{i}" for i in range(len(keys))]
    joined = view.join(changes.select(*own, "__n", *[f"__sum_{c}" for c in sums]), _same(keys), "full")
    out = joined.select(*[F.coalesce(k, f"__k{i}").alias(k) for i, k in enumerate(keys)], (F.coalesce("n", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("n"), *[(F.coalesce(f"sum_{c}", F.lit(0)) + F.coalesce(f"__sum_{c}", F.lit(0))).cast(kinds[f"sum_{c}"]).alias(f"sum_{c}") for c in sums], *[c for name, _, _ in named for c in (name, f"{name}_n")])
    stale: list[Column] = []
    for name, kind, c in named:
        best, nearer, before = EXTREMES[kind]
        # the values that deltas add or take out on the whole, a row for each key and value
        net = deltas.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.sum(sign).alias("__net")).where("__net <> 0")
        met = net.join(view.select(*own, F.col(name).alias("__old")), _same(keys), "left")
        per = met.groupBy(*keys).agg(
            best(F.when(F.col("__net") > 0, F.col(c))).alias("__new"),
            F.coalesce(F.sum(F.when(F.col(c) == F.col("__old"), F.col("__net"))), F.lit(0)).alias("__at_old"),
            F.max_by("__net", F.when(F.col("__net") > 0, F.col(c))).alias("__top_n") if kind == "max" else F.min_by("__net", F.when(F.col("__net") > 0, F.col(c))).alias("__top_n"),
        )
        out = out.join(per.select(*own, "__new", "__at_old", "__top_n"), _same(keys), "left").drop(*drop)
        old, old_n, new = F.col(name), F.coalesce(f"{name}_n", F.lit(0)) + F.coalesce("__at_old", F.lit(0)), F.col("__new")
        holds = old.isNotNull() & (old_n > 0)
        passed = new.isNotNull() & (old.isNull() | before(new, old))
        value = F.when(passed, new).when(holds, old).otherwise(F.lit(None))
        count = F.when(passed, F.col("__top_n")).when(holds, old_n).otherwise(F.lit(0))
        lost = old.isNotNull() & (old_n <= 0) & ~F.coalesce(passed, F.lit(False)) & (F.col("n") > 0)
        out = out.withColumn("__value", value).withColumn("__count", count).withColumn(f"__lost_{name}", lost)
        out = out.withColumns({name: F.col("__value"), f"{name}_n": F.col("__count")}).drop("__value", "__count", "__new", "__at_old", "__top_n")
        stale.append(F.col(f"__lost_{name}"))
    lost_columns = [f"__lost_{name}" for name, _, _ in named]
    if not named:
        return out.where("n > 0").select(*view.columns)
    out = kept_table(out.where("n > 0"), "folded")
    gone = reduce(Column.__or__, stale)
    again = out.where(gone).select(*keys)
    if again.isEmpty():
        return out.select(*view.columns)
    if refill is None:
        raise ValueError("an extreme has no rows left: give refill")
    fresh = built(refill(again), keys, list(sums), extremes)
    return out.where(~gone).drop(*lost_columns).select(*view.columns).unionByName(fresh.select(*view.columns))
