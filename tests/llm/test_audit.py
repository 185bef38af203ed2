"""The filter interaction audit against plain loops, with texts that go on over partitions."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from tessella.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """(part, order, step) -> the seven figures; docs: (doc_id, text, source), labels: (doc_id, quality, toxic)."""
    rows, first = [], {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((s or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out = defaultdict(lambda: [0] * 7)
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone, had = [r for r in left if f in r[1]], len(left)
                left = [r for r in left if f not in r[1]]
                assert had == len(gone) + len(left)
                own = out[part, "".join(order), step]
                own[0], own[1] = len(left), len(gone)
                own[2] = sum(p == part and f in x for p, x, _, _ in rows) - len(gone)
                own[3] = sum(p == part and x == {f} for p, x, _, _ in rows)
                own[4], own[5] = sum(r[2] for r in gone), sum(r[3] for r in gone)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step][6] = sum(out[part, "".join(o), o.index(f) + 1][1] for o in permutations("ABCDE"))
    return dict(out)


def figures(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [(1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (None, LONG, "a"), (None, None, "b"), (4, None, "b"), (5, "", "b"), (5, None, "b"), (6, LONG + " SHOUT" * 60, "a"), (7, LONG + " #", "c"), (8, "é" * 100 + "ABC", "c"), (8, "word " * 500, "c"), (9, "\x1c\x85 not white", "a"), (10, LONG, "")]
DOCS += [(20 + i, "copies of one text in a large group", "hot") for i in range(400)] + [(500, "copies of one text in a large group", "hot")] * 50
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, None, 1), (6, 1, 1), (7, 0, 1), (None, 1, 1), (30, 1, 1), (30, 1, 1), (999, 1, 1)]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_against_loops(spark, parts):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert figures(audit.report(docs, labels)) == plain(DOCS, LABELS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_fingerprints_of_different_texts(monkeypatch):
    """Texts of one fingerprint that go on over several tasks: settled by their digests."""
    import pyarrow as pa

    rows = sorted((7, t, i, "p") for i, t in enumerate(["x", "y", "x", "z", "x", "y", "x", "z", "y"]))
    rows.sort(key=lambda r: r[2])  # tasks hold ranges of ids, and each is sorted by text
    tasks = [sorted(rows[lo : lo + 3]) for lo in range(0, len(rows), 3)]
    found = []
    for t in tasks:
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in t[lo : lo + 2]], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string()))], ["fp", "text", "id", "part"]) for lo in (0, 2)]
        for b in audit._walk(iter(batches)):
            found += b.to_pylist()
    least = defaultdict(lambda: 99)
    for r in found:
        if r["digest"]:
            least[r["digest"]] = min(least[r["digest"]], r["id"])
    dup = {r["id"] for r in found if r["is_row"] and (r["mask"] & 16 or r["digest"] and least[r["digest"]] < r["id"])}
    assert dup == {2, 4, 5, 6, 7, 8}


def test_counters_add_up(spark):
    """Counters of two halves of one part, summed, give the audit of both (duplicates across the halves aside)."""
    docs = [(i, f"text number {i} " * (1 + i % 5), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) toxic")
    frame = lambda rows: audit.counters(audit.masks(spark.createDataFrame(rows, "doc_id long, text string, source string")), labels)
    assert figures(audit.audit(frame(docs[:25]).unionByName(frame(docs[25:])))) == figures(audit.audit(frame(docs)))
