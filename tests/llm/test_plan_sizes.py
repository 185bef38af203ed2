"""Plans of the pipeline stay small on the driver, and say the same as when they were written out."""

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import decontaminate, simhash
from tessella.operators.graph import stars


def nodes(plan):
    """How many expressions a logical plan holds."""
    todo, found, plans = [], 0, [plan]
    while plans:
        p = plans.pop()
        plans += [p.children().apply(i) for i in range(p.children().size())]
        todo += [p.expressions().apply(i) for i in range(p.expressions().size())]
    while todo:
        e = todo.pop()
        found += 1
        todo += [e.children().apply(i) for i in range(e.children().size())]
    return found


def test_blocks_and_their_neighbours(spark):
    fps = [0, -1, 1, -(1 << 63), 0x0123456789ABCDEF]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    flips = [0, *sorted({1 << i | 1 << j for i in range(8) for j in range(8)})]
    for near in (False, True):
        out = df.select("fp", decontaminate._blocks("fp", near)).select("fp", "k.block", "k.value")
        want = sorted((x, b, ((x & ((1 << 64) - 1)) >> 8 * b & 255) ^ f) for x in fps for b in range(8) for f in (flips if near else [0]))
        assert dict(out.dtypes) == {"fp": "bigint", "block": "int", "value": "bigint"}
        assert sorted(map(tuple, out.collect())) == want
        assert nodes(out._jdf.queryExecution().analyzed()) < 100


def test_large_buckets_link_what_small_ones_do(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = np.random.default_rng(2)
    some = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 6)]
    near = {x ^ int(1 << int(b)) if b < 63 else x for x in some for b in rng.integers(0, 63, 12)} | set(some)
    df = spark.createDataFrame([(x,) for x in sorted(near)], "fp long")
    edges = simhash.links(df)
    assert nodes(edges._jdf.queryExecution().analyzed()) < 300
    got = stars(edges)
    root = {x: x for x in near}
    while True:
        new = {x: min(root[y] for y in near if (x ^ y).bit_count() <= 2 or x == y) for x in near}
        if new == root:
            break
        root = new
    assert {r.id: r.group for r in got.collect()} == {x: r for x, r in root.items() if x != r}
    assert got.select(F.count("*")).first()[0]
