"""Interval joins by dyadic blocks: spans of days cut into a logarithmic number of blocks whose lengths are powers of two.

Two spans overlap if one of them holds the other's first day. A span's blocks (at most two of each length) are disjoint, so a day
lies in one of them or none, and the blocks around a day are known from the day alone. So each pair of overlapping spans is found
once, by an equi-join on (level, block), however long spans are; open bounds reach to the end of time and cost no more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

#: Days are counted from so many before 1970, and there are 2^LEVELS of them: about 5,700 years.
FIRST_DAY, LEVELS = 1_000_000, 21


def _day(x: Column, open_end: int) -> Column:
    day = F.unix_date(x.cast("date")) + FIRST_DAY
    return F.when(x.isNull(), open_end).otherwise(F.greatest(F.least(day, F.lit((1 << LEVELS) - 1)), F.lit(0)))


def blocks(lo: Column, hi: Column) -> Column:
    """Array of (level, block): the closed span of days cut into the fewest dyadic blocks; empty if it ends before it begins."""

    def at(level: Column) -> Column:
        size = F.expr("1L") * F.pow(F.lit(2), level).cast("long")
        left = F.ceil(lo / size).cast("long")
        right = F.floor((hi + 1) / size).cast("long")
        inner = left + left % 2
        take = lambda cond, block: F.when(cond, F.struct(level.cast("int").alias("level"), block.alias("block")))
        return F.array(take((left < right) & (left % 2 == 1), left), take((inner < right) & (right % 2 == 1), right - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)))


def around(day: Column, levels: list[int]) -> Column:
    """Array of (level, block) of the blocks that hold a day."""
    return F.array(*[F.struct(F.lit(n).alias("level"), F.floor(day / (1 << n)).cast("long").alias("block")) for n in levels])


def overlapping(rows: DataFrame, lo: str, hi: str, spans: DataFrame, q_lo: str = "q_lo", q_hi: str = "q_hi") -> DataFrame:
    """rows and spans whose closed spans of days overlap, each pair once; null bounds are open. Columns of both, which must differ."""
    both = [(rows, F.col(lo), F.col(hi)), (spans, F.col(q_lo), F.col(q_hi))]
    out = []
    for held, (inner, i_lo, _), (outer, o_lo, o_hi) in ((0, *both), (1, *both[::-1])):
        cut = outer.withColumn("__b", F.explode(blocks(_day(o_lo, 0), _day(o_hi, (1 << LEVELS) - 1)))).select(*outer.columns, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))
        levels = sorted(r[0] for r in cut.select("__level").distinct().collect())  # LEVELS + 1 at most
        if not levels:
            continue
        points = inner.withColumn("__b", F.explode(around(_day(i_lo, 0), levels))).select(*inner.columns, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))
        met = points.join(cut, ["__level", "__block"]).drop("__level", "__block")
        if held:  # spans that begin on one day are found once: above
            met = met.where(_day(i_lo, 0) != _day(o_lo, 0))
        out.append(met.select(*rows.columns, *spans.columns))
    if not out:
        return rows.join(spans, F.lit(False))
    found = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return found.where(dates.overlaps(F.col(lo), F.col(hi), F.col(q_lo), F.col(q_hi)))


def _up_to(days: DataFrame, asked: DataFrame, out: str) -> DataFrame:
    """(day, out) for the days of `asked` (day): how many of `days` (day) are no later. Days are counted in dyadic blocks, of which an asked day
    reads those that make up the time until its end; those that none precedes are left out."""
    each = days.groupBy("day").agg(F.count("*").alias("n")).select("n", F.explode(around(F.col("day"), list(range(LEVELS + 1)))).alias("b"))
    held = each.groupBy("b.level", "b.block").agg(F.sum("n").alias("n"))
    cut = asked.distinct().select("day", F.explode(blocks(F.lit(0), F.col("day"))).alias("b")).select("day", "b.level", "b.block")
    return cut.join(held, ["level", "block"]).groupBy("day").agg(F.sum("n").alias(out))


def overlap_counts(rows: DataFrame, lo: str, hi: str, spans: DataFrame, q_lo: str = "q_lo", q_hi: str = "q_hi", out: str = "n") -> DataFrame:
    """spans, whose rows must differ, with the number of rows that overlap them, those with none left out; null bounds are open. No pair is made: from the rows
    that begin by a span's last day those that end before its first day are taken off. Where one ends before it begins, that doesn't
    hold, and its pairs are joined."""
    end = (1 << LEVELS) - 1
    back = lambda a, b: _day(F.col(a), 0) > _day(F.col(b), end)
    ahead, asked = rows.where(~back(lo, hi)), spans.withColumns({"__lo": _day(F.col(q_lo), 0), "__hi": _day(F.col(q_hi), end)})
    begun = _up_to(ahead.select(_day(F.col(lo), 0).alias("day")), asked.select(F.col("__hi").alias("day")), "__begun")
    gone = _up_to(ahead.select((_day(F.col(hi), end) + 1).alias("day")), asked.select(F.col("__lo").alias("day")), "__gone")
    n = F.col("__begun") - F.coalesce("__gone", F.lit(0))
    met = asked.where("__lo <= __hi").join(begun.withColumnRenamed("day", "__hi"), "__hi").join(gone.withColumnRenamed("day", "__lo"), "__lo", "left")
    found = [met.select(*spans.columns, n.alias(out))]
    for some, others in ((rows.where(back(lo, hi)), spans), (ahead, spans.where(back(q_lo, q_hi)))):
        if not (some if others is spans else others).isEmpty():
            found.append(overlapping(some.select(lo, hi), lo, hi, others, q_lo, q_hi).groupBy(*spans.columns).agg(F.count("*").alias(out)))
    if len(found) == 1:
        return found[0].where(F.col(out) > 0)
    return reduce(DataFrame.unionByName, found).groupBy(*spans.columns).agg(F.sum(out).alias(out)).where(F.col(out) > 0)
