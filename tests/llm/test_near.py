"""The pipeline's near-duplicate stage against plain Jaccard similarity of five-word shingles."""

import random

import pytest

from tests.llm import brute
from tessella.llm import near, simhash

SCHEMA = "doc_id long, text string"


def sets(text):
    w = brute.WORD.findall(brute.lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(texts, threshold=0.8):
    """Root of each of a list of texts."""
    s = [sets(t) for t in texts]
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a] & s[b])
            if both >= threshold * (len(s[a]) + len(s[b]) - both):
                root[find(a)] = find(b)
    return [find(x) for x in range(len(s))]


def kept(rows):
    roots, least = components([t for _, t in rows]), {}
    for r, (i, t) in zip(roots, rows):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return sorted(least.values())


def stage(spark, rows):
    import corpus_pipeline as c

    out = c.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    return sorted((r.doc_id is None, r.doc_id or 0) for r in out)


def variants(n, words, edits, seed=1):
    """Texts with `edits` words replaced at random places of one text."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    while len(out) < n:
        w = list(base)
        for _ in range(edits):
            w[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_copies_go(spark):
    texts = variants(2, 100, 1) + variants(2, 200, 3, 2) + variants(2, 60, 9, 3)
    assert stage(spark, list(enumerate(texts))) == [(False, 0), (False, 2), (False, 4), (False, 5)]


@pytest.mark.parametrize("edits,block", [(2, 512), (4, 512), (6, 512), (6, 7)])
def test_groups(spark, monkeypatch, edits, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = list(enumerate(variants(40, 150, edits) + variants(40, 40, 1, 2) + [None, "", " \n", "one", "ONE", "one two"]))
    assert stage(spark, rows) == kept(rows)


def test_chains_through_one_bucket(spark):
    # neighbours are similar, ends are not: pivots of one end don't decide the others
    rnd = random.Random(4)
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(w)))
        for _ in range(3):
            w[rnd.randrange(200)] = f"y{rnd.randrange(10**6)}"
    assert stage(spark, rows) == kept(rows) == [(False, 0)]


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert stage(spark, rows) == kept(rows)


def test_rows_without_or_with_repeated_ids(spark):
    a, b, c = variants(2, 100, 0, 1)[0], variants(2, 100, 0, 2)[0], variants(2, 100, 0, 3)
    rows = [(None, a), (None, b), (7, a[::-1]), (7, b[::-1]), (1, c[0]), (1, c[0]), (None, c[1])]
    df = near.representatives(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.doc_id or 0, r.text) for r in df.collect())) == sorted([(0, a), (0, b), (7, a[::-1]), (7, b[::-1]), (1, c[0])])


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as c
    from tessella.llm import quality

    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.source, r.text) for r in quality.passing(raw).collect()]
    cleaned = [(i, x[0]) for i, x in brute.lines(left).items()]
    stay = {i for _, i in kept(cleaned)}
    assert stay < {r for r in dict(cleaned)} and len(stay) < len({v[1] for v in brute.near(cleaned).values()})
    left = [x for x in cleaned if x[0] in stay]
    bad = {d for d, _ in brute.contaminated(left, items)}
    assert {r.doc_id: r.decoded_sha256 for r in c.run(spark, sf).collect()} == {i: brute.sha(t) for i, t in left if i not in bad}


def test_simhash_keeps_a_row_of_each_component(spark):
    a, b = variants(1, 100, 0, 1)[0], variants(1, 100, 0, 2)[0]
    rows = [(None, a), (None, a), (None, b), (7, a[::-1]), (7, b[::-1])]
    df = simhash.representatives(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id or 0, r.text) for r in df.collect()) == sorted([(0, a), (0, b), (7, a[::-1]), (7, b[::-1])])


def test_simhash_finds_near_copies_by_itself(spark, monkeypatch):
    rows = [(2 * i + k, t) for i in range(6) for k, t in enumerate(variants(2, 400, 1, i))]
    apart = lambda x, y: ((simhash.fingerprint(x) ^ simhash.fingerprint(y)) & (1 << 64) - 1).bit_count()
    rows = [r for i in range(0, 12, 2) if apart(rows[i][1], rows[i + 1][1]) <= 2 for r in rows[i : i + 2]]
    monkeypatch.setattr(near, "_buckets", lambda texts: texts.selectExpr("0L as bucket", "node").where("false"))
    assert len(rows) > 2 and stage(spark, rows) == [(False, i) for i, _ in rows[::2]]
