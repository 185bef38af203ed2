"""Distinct counts and levels from mergeable sketches stored per group and day; exact levels without holding a group's values.

A sketch is a few kilobytes whatever it has seen. Those of groups and days are stored and merged on demand, so a range of days is
read from a row for each day. Distinct counts are HyperLogLog (lg_k 12: a standard error of 1.6 %), levels are KLL (k 800: a rank error of
about 0.4 %). Nulls count for nothing; a group without values has null levels and a distinct count of zero.

Exact levels are found by narrowing: a sketch gives bounds between which the level lies for certain (counts check it), the values
between them are sketched again, and so on, until so few are left that they can be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept_table

LG_K, K = 12, 800
#: Values of a group that are sorted in one buffer.
FEW = 10_000
#: Bounds are taken from so many equal shares of a sketch.
GRID = 200


def sketched(rows: DataFrame, keys: list[str], distinct: list[str] = (), levels: list[str] = ()) -> DataFrame:
    """(keys, n, hll_<column>, kll_<column>): keys should hold the day."""
    plain = {c: F.col(c) if kind in ("int", "bigint", "string", "binary") else F.col(c).cast("string") for c, kind in rows.dtypes}
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.hll_sketch_agg(plain[c], F.lit(LG_K)).alias(f"hll_{c}") for c in distinct], *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(K)).alias(f"kll_{c}") for c in levels])


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same for fewer keys: of days, or of groups."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[(F.hll_union_agg if c.startswith("hll_") else F.kll_merge_agg_double)(c).alias(c) for c in sketches.columns if c.startswith(("hll_", "kll_"))])


def distinct_count(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def level(sketch: str, q: float) -> Column:
    """The value that a share q of the values doesn't exceed, within the sketch's error of rank."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(q))))


def exact_level(rows: DataFrame, keys: list[str], value: str, q: float, few: int | None = None, slack: float = 0.01) -> DataFrame:
    """(keys, level): the exact quantile of each group, between its neighbours in proportion, as percentile() has it."""
    few = FEW if few is None else few
    names = [f"__k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], v.alias("__v"))
    same = lambda a, b: [a[n].eqNullSafe(b[n]) for n in names]
    state = known.groupBy(*names).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    state = kept_table(state.withColumns({"__below": F.lit(0).cast("long"), "__mid": F.col("__n")}), "levels")
    first = F.floor(F.lit(q) * (F.col("__n") - 1)).cast("long")
    while True:
        open_ = (F.col("__mid") > few) & (F.col("__lo") < F.col("__hi"))
        wide = state.where(open_)
        if wide.isEmpty():
            break
        s = wide.select(*names, "__n", "__lo", "__hi", "__below", "__mid")
        inside = known.join(s, same(known, s)).where(F.col("__v").between(F.col("__lo"), F.col("__hi"))).select(s["__n"], *[s[n] for n in names], "__lo", "__hi", "__below", "__mid", "__v")
        sketch = inside.groupBy(*names, "__n", "__lo", "__hi", "__below", "__mid").agg(F.kll_sketch_agg_double("__v", F.lit(K)).alias("__s"))
        at = (first - F.col("__below")) / F.col("__mid")
        grid = F.kll_sketch_get_quantile_double("__s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
        place = lambda p, to: F.get("__grid", F.least(F.greatest(to(p * GRID), F.lit(0)), F.lit(GRID)).cast("int"))
        guess = sketch.withColumn("__grid", grid).select(*names, "__n", "__lo", "__hi", "__below", "__mid", place(at - slack, F.floor).alias("__a"), place(at + slack + 2 / F.col("__mid"), F.ceil).alias("__b"))
        guess = kept_table(guess, "bounds")
        counted = known.join(guess, same(known, guess)).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
        kept = [guess[n] for n in names]
        counted = counted.select(*kept, "__n", "__lo", "__hi", "__below", "__mid", "__a", "__b", "__v").groupBy(*names, "__n", "__lo", "__hi", "__below", "__mid", "__a", "__b").agg(
            F.count_if(F.col("__v") < F.col("__a")).alias("__less"), F.count_if(F.col("__v").between(F.col("__a"), F.col("__b"))).alias("__in")
        )
        rank, below = first, F.col("__below") + F.col("__less")
        # the level's two neighbours must both lie between the bounds; a bound that is too near stays where it was
        low_fits, high_fits = rank >= below, F.least(rank + 1, F.col("__n") - 1) < below + F.col("__in")
        narrowed = counted.select(
            *names,
            "__n",
            F.when(low_fits & high_fits, F.col("__a")).otherwise(F.col("__lo")).alias("__lo"),
            F.when(low_fits & high_fits, F.col("__b")).otherwise(F.col("__hi")).alias("__hi"),
            F.when(low_fits & high_fits, below).otherwise(F.col("__below")).alias("__below"),
            F.when(low_fits & high_fits, F.col("__in")).otherwise(F.col("__mid")).alias("__mid"),
        )
        before = wide.agg(F.sum("__mid")).first()[0]
        narrowed = kept_table(narrowed, "levels")
        slack = slack if narrowed.agg(F.sum("__mid")).first()[0] < before else slack * 4
        state = kept_table(state.where(~open_).unionByName(narrowed), "levels")
    s = state
    inside = known.join(s, same(known, s)).where(F.col("__v").between(F.col("__lo"), F.col("__hi")) & (F.col("__lo") < F.col("__hi"))).select(*[s[n] for n in names], "__n", "__below", "__v")
    near = inside.groupBy(*names, "__n", "__below").agg(F.sort_array(F.collect_list("__v")).alias("__vs"))
    exact = F.lit(q) * (F.col("__n") - 1)
    at = lambda r: F.get("__vs", F.least(r, F.col("__n") - 1).cast("int") - F.col("__below").cast("int"))
    part = exact - F.floor(exact)
    out = near.select(*names, (at(first) * (1 - part) + at(first + 1) * part).alias("level"))
    equal = state.where("__lo = __hi").select(*names, F.col("__lo").alias("level"))
    return out.unionByName(equal).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "level")
