"""Quality rules as a bitmask ledger: each rule is evaluated once, policies are applied to the stored bits.

Nulls and empty texts measure zero throughout and fail `too_few_words`; repeated rows each get their own
ledger row; extra columns are ignored by `ledger` and passed through by `judged`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, own_names, text_or_empty, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")

#: Name -> failure over the measures. A rule's position is its bit; append only.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols_per_word": "10 * n_symbols > n_words",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 20 * n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "shouting": "n_letters > 0 AND 10 * n_upper > 7 * n_letters",
    "few_letters": "10 * n_letters < 3 * word_chars",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of what rejects a document: any failure in `rules`, or over `tolerance` failures in `soft`."""

    version: str
    rules: tuple[str, ...]
    soft: tuple[str, ...] = ()
    tolerance: int = 0

    def rejects(self, bits: Column) -> Column:
        hard = bits.bitwiseAND(F.lit(sum(BITS[r] for r in self.rules)).cast("long")) != 0
        mild = F.bit_count(bits.bitwiseAND(F.lit(sum(BITS[r] for r in self.soft)).cast("long"))) > self.tolerance
        return hard | mild if self.soft else hard


BASE = Policy("base", ("too_few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", (*BASE.rules, "symbols_per_word", "short_mean_word", "long_mean_word", "few_letters"), ("repeated_lines", "shouting"), 0))}


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures, as `__q_` columns; per row, without a shuffle."""
    t = F.col("__q_text")
    df = df.withColumn("__q_text", text_or_empty(text))
    df = df.withColumn("__q_w", words(t)).withColumn("__q_lines", F.split(t, "\n"))
    df = df.withColumn("__q_full", F.filter("__q_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("__q_n_words", F.size("__q_w").cast("long"))
    n = F.greatest(F.col("__q_n_words").cast("int") - 2, F.lit(0))
    df = df.withColumn("__q_tri", F.arrays_zip(F.slice("__q_w", F.lit(1), n).alias("x"), F.slice("__q_w", F.lit(2), n).alias("y"), F.slice("__q_w", F.lit(3), n).alias("z")))
    hashes = F.transform("__q_tri", lambda s: F.xxhash64(s["x"], s["y"], s["z"]))
    df = df.withColumn("__q_h", hashes)
    repeats = F.size(F.array_distinct("__q_h")) < F.size("__q_h")
    # only texts with a repeated window go on: sorted by hash, words and place, equal windows are neighbours
    rows = F.transform(F.col("__q_tri"), lambda s, i: F.struct(F.get("__q_h", i).alias("h"), s.alias("s"), i.alias("p")))
    df = df.withColumn("__q_sorted", F.when(repeats, F.sort_array(rows)))
    df = df.withColumn("__q_same", F.when(F.col("__q_sorted").isNotNull(), F.zip_with("__q_sorted", F.slice("__q_sorted", F.lit(2), F.size("__q_sorted")), lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["s"] == b["s"]), F.lit(False)))))
    twice = F.filter(F.transform("__q_sorted", lambda a, i: F.when(F.get("__q_same", i) | F.coalesce(F.get("__q_same", i - 1), F.lit(False)), a["p"])), lambda p: p.isNotNull())
    df = df.withColumn("__q_starts", F.sort_array(twice))
    covered = F.aggregate(F.zip_with("__q_starts", F.slice("__q_starts", F.lit(2), F.size("__q_starts")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    bare = F.regexp_replace(t, WS + "+", "")
    out = {
        "word_chars": F.length(bare),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("__q_full") - F.size(F.array_distinct("__q_full")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("__q_full"),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        "n_upper": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
    }
    df = df.withColumns({f"__q_{k}": v.cast("long") for k, v in out.items()})
    return df.drop("__q_text", "__q_w", "__q_lines", "__q_full", "__q_tri", "__q_h", "__q_sorted", "__q_same", "__q_starts")


def bits() -> Column:
    """The failure bits from the measures named without a prefix."""
    total = F.lit(0).cast("long")
    for name, rule in RULES.items():
        total = total.bitwiseOR(F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the id, every measure, and `failed`, the mask of failed rules."""
    m = measured(df.select(F.col(id_col).alias("__q_id"), F.col(text).alias("__q_in")), "__q_in")
    return m.select(F.col("__q_id").alias(id_col), *[F.col(f"__q_{k}").alias(k) for k in MEASURES]).withColumn("failed", bits())


def verdicts(led: DataFrame, policy: str = "v1") -> DataFrame:
    return led.withColumn("kept", ~POLICIES[policy].rejects(F.col("failed")))


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents failing it, those failing nothing else in the policy, and how many
    the policy without it would keep. One pass of bitwise aggregation."""
    p = POLICIES[policy]
    names = [*p.rules, *p.soft]
    mask = sum(BITS[r] for r in names)
    own = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    one = led.groupBy(own.alias("own")).agg(F.count("*").alias("n"))
    per = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in names])).alias("r")
    rows = one.select("own", "n", per)
    hit = rows["own"].bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("own") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("own").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


@own_names
def passing(df: DataFrame, text: str = "text", policy: str = "v1") -> DataFrame:
    """The rows of df that the policy keeps, with all their columns."""
    had = df.columns
    m = measured(df, text)
    failing = F.lit(0).cast("long")
    for name, rule in RULES.items():
        for k in MEASURES:
            rule = re.sub(rf"\b{k}\b", f"`__q_{k}`", rule)
        failing = failing.bitwiseOR(F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    # no condition passes a projection with rand(): below the measures it would repeat each of them many times over
    m = m.withColumn("__q_stay", F.rand(0))
    kept = F.when(F.col("__q_stay") >= 0, ~POLICIES[policy].rejects(failing))
    return m.where(kept).select(*[F.col(f"`{c}`") for c in had])
