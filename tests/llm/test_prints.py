"""Document fingerprints against plain versions: edits in order, likeness, tables that miss nothing, classes."""

import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import prints

SF = "/root/testdata/sf0.001"
ALL = (1 << 64) - 1


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & ALL
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & ALL
    return x ^ x >> 33


def plain_print(text):
    words = [w for w in text.encode().lower().split()]
    h = [mixed(xxhash.xxh64_intdigest(w, 13)) for w in words]
    terms = Counter(h + [mixed((a * 0x9E3779B97F4A7C15 + b) & ALL) for a, b in zip(h, h[1:])])
    out = 0
    for bit in range(64):
        score = sum(n.bit_length() * (1 if t >> bit & 1 else -1) for t, n in terms.items())
        out |= (score > 0) << bit
    return out


def plain_rows(docs):
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        new = t[: len(t) - third] + following[:third]
        a, b, c = plain_print(t), plain_print(new), plain_print(following)
        like = lambda x, y: max(0.0, math.cos(math.pi * (x ^ y).bit_count() / 64)) if (x ^ y).bit_count() < 32 else 0.0
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", like(a, b), like(a, c)))
    return out


def classes(docs, radius=3):
    """The smallest id of each text's component, by all pairs."""
    fps = {t: plain_print(t or "") for _, t in docs}
    nodes = sorted(set(fps.values()))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(nodes):
        for y in nodes[k + 1 :]:
            if (x ^ y).bit_count() <= radius:
                root[find(x)] = find(y)
    least = {}
    for i, t in docs:
        if i is not None:
            r = find(fps[t])
            least[r] = min(least.get(r, i), i)
    return {(i, t): least.get(find(fps[t])) for i, t in docs}


ODD = [(5000, None), (5001, ""), (None, "a row without an id"), (None, None), (5002, "😀é中" * 50), (5003, "A a A a"), (5004, "x" * 9000), (5004, "x" * 9000), (5004, "another text of one id"), (5005, "word " * 2000), (5006, "\x1c \x85 two")]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD


@pytest.mark.parametrize("parts", [1, 6, 50])
def test_report(spark, docs, parts):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("fp", "task", "edge", "next", "n", "root", "n_chars")})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prints.report(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(plain_rows(docs), key=key)
    want = classes(docs)
    by_print = {(r.doc_id, r.fingerprint): r.class_id for r in got}
    assert by_print == {(i, f"{plain_print(t or ''):016x}"): c for (i, t), c in want.items()}


def test_one_row_and_none(spark):
    one = prints.report(spark.createDataFrame([(1, "only this text here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"only this text" [:13] + b"only t").hexdigest()
    assert prints.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("radius,blocks", [(3, 6), (3, 4), (2, 5), (1, 2), (0, 1)])
def test_tables_find_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, radius + 1))) for b in base for _ in range(8)]
    signed = [x - (1 << 64) if x >> 63 else x for x in base + near]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    queries = df.where("fp % 3 = 0")
    want = {(x, y, d) for x in signed if x % 3 == 0 for y in signed for d in [((x ^ y) & ALL).bit_count()] if d <= radius}
    got = [tuple(r) for r in prints.within(queries, df, radius, blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_an_edit_is_nearer_than_another_text(spark):
    rows = prints.report(spark.read.parquet(f"{SF}/documents.parquet")).where("n_chars > 300").collect()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.6 > 0.25 > sum(r.near_next for r in rows) / len(rows)


def test_radius_and_blocks_must_fit():
    with pytest.raises(ValueError):
        prints.block_masks(3, 3)
