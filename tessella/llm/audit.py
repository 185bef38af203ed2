"""Filter interaction audit: what each filter removes, after any others, in every order.

Rows are range-sorted by a fingerprint of their text, the text and the id, and each is compared with its predecessor: one
with a smaller id and the same text makes it a duplicate. A text may go on from one partition to the next, so the rows of
a partition's first fingerprint that begin a text, and the texts of its last, carry a digest; the smallest id of a digest
settles them. (The range bounds are drawn from fingerprints and ids alone, so that no sample of texts goes to the driver;
equal fingerprints of different texts are told apart by the sort and the digest.) In the same pass every row gets its
failure mask, a bit for each filter.

Masks are then merged into counters of each part, source by source: how many rows fail none of a set of filters, for all
32 sets. Counters are additive, so audits of disjoint tables of one part can be summed; the figures of every order and
step are differences of them.

Null texts are empty ones, null parts are ''. A row without an id neither is a duplicate nor makes one; rows with the same
id don't make each other duplicates. A document is good or toxic if any of its labels says so. Extra columns are ignored;
no rows give no parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: In the order of the bits. E is the duplicate filter.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOL = re.compile(rb"[#$%&*|]").search


def text_mask(text: bytes, n_points: int) -> int:
    """The bits of A to D: under 200 words; under half of them different; over 2 % capitals A-Z; one of #$%&*|."""
    words = text.split()
    few = len(words) < 200
    alike = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > 2 * n_points
    return few | alike << 1 | loud << 2 | (_SYMBOL(text) is not None) << 3


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (fp, text, id, part): id, part, mask, whether it is a row, and the digest of what is unsettled."""
    first_fp = fp = text = least = id_type = None
    texts: list[tuple[bytes, object]] = []  # of this fingerprint: each text's digest and smallest id

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (id_type, pa.string(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 5, kinds)], ["id", "part", "mask", "is_row", "digest"])

    for batch in batches:
        rows, id_type = [], batch.column(2).type
        points = pc.utf8_length(batch.column(1))
        columns = (batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), points)
        for own_fp, own_text, own_id, part, n in zip(*columns):
            own_fp, own_text, own_id = own_fp.as_py(), own_text.as_py(), own_id.as_py()
            if first_fp is None:
                first_fp = own_fp
            if own_fp != fp:
                texts = []
            if own_fp != fp or own_text != text:
                fp, text, least = own_fp, own_text, None
                texts.append((text, None))
            if least is None and own_id is not None:
                least = own_id
                texts[-1] = (text, least)
            again = own_id is not None and least < own_id
            open_ = fp == first_fp and own_id is not None and not again
            rows.append((own_id, part.as_py(), text_mask(text, n.as_py()) | DUPLICATE * again, True, hashlib.sha256(text).digest() if open_ else None))
        yield out(rows)
    if texts and fp != first_fp:
        yield out([(i, "", 0, False, hashlib.sha256(t).digest()) for t, i in texts if i is not None])


def masks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) of every row of docs."""
    # rows of one text and id are dealt by their place, so that repeated rows can be split, too
    rows = docs.select(text_or_empty(text).alias("text"), F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.select(F.xxhash64("text").alias("fp"), "text", "id", "part", F.monotonically_increasing_id().alias("place"))
    ranged = rows.repartitionByRange("fp", "id", "place").sortWithinPartitions("fp", "text", "id").drop("place")
    found = written(ranged.mapInArrow(_walk, f"id {dict(docs.dtypes)[id_col]}, part string, mask int, is_row boolean, digest binary"), "masks")
    least = found.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"))
    unsettled = found.where("is_row and digest is not null").join(least, "digest")
    settled = unsettled.select("id", "part", F.col("mask").bitwiseOR(F.when(F.col("least") < F.col("id"), DUPLICATE).otherwise(0)).alias("mask"))
    return found.where("digest is null").select("id", "part", "mask").unionByName(settled)


def counters(found: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): the rows of a part that fail exactly these filters, by their labels."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.groupBy(F.col(id_col).alias("id")).agg(says("quality"), says("toxic")).where("quality or toxic")
    told = found.join(known, "id", "left").select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
    return told.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def _sets(condition: Column) -> Column:
    """For each set of filters, the rows that fail none of it and meet the condition."""
    passes = lambda s: F.col("mask").bitwiseAND(F.lit(s)) == 0
    return F.array(*[F.sum(F.when(passes(s) & condition, F.col("n")).otherwise(0)) for s in range(1 << len(FILTERS))])


def audit(counts: DataFrame) -> DataFrame:
    """The figures of every part, order and step."""
    bits = [1 << i for i in range(len(FILTERS))]
    fails = lambda b: F.col("mask").bitwiseAND(F.lit(b)) != 0
    orders = ["".join(p) for p in permutations(FILTERS)]
    # among the filters that a row fails, each comes first in an equal share of all orders
    share = F.expr(f"n * ({len(orders)} div greatest(bit_count(mask), 1))")
    sums = lambda of: F.array(*[of(b) for b in bits])
    parts = counts.groupBy("part").agg(
        _sets(F.lit(True)).alias("passing"),
        _sets(F.col("good")).alias("passing_good"),
        _sets(F.col("toxic")).alias("passing_toxic"),
        sums(lambda b: F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0))).alias("only"),
        sums(lambda b: F.sum(F.when(fails(b), share).otherwise(0))).alias("shares"),
    )
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = [F.instr("filter_order", f) for f in FILTERS]
    before = reduce(Column.__add__, [F.when(p < F.col("step"), b).otherwise(0) for p, b in zip(at, bits)])
    own = reduce(Column.__add__, [F.when(p == F.col("step"), i).otherwise(0) for i, p in enumerate(at)])
    steps = steps.withColumns({"before": before, "own": own}).withColumn("bit", F.expr("shiftleft(1, own)"))
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("before") + F.col("bit"))
    failing = F.get("passing", F.lit(0)) - F.get("passing", F.col("bit"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("passing", F.col("before") + F.col("bit")).alias("kept"),
        lost("passing").alias("removed"),
        (failing - lost("passing")).alias("redundant"),
        F.get("only", F.col("own")).alias("unique_fails"),
        lost("passing_good").alias("good_lost"),
        lost("passing_toxic").alias("toxic_lost"),
        F.get("shares", F.col("own")).alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(counters(masks(docs), labels))
