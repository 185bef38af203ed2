"""Every query and the pipeline on empty tables, and on tables with nulls in any column, repeated rows and long texts."""

import pytest

from tessella.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
PROSE = "Every evening the lamplighter walked along the narrow canal and greeted each of the sleepy herons by name before he lit the last lantern near the old stone bridge where boats from distant harbours rested until morning while children counted stars above quiet roofs and somewhere a clock struck nine without any hurry at all"


def tables(spark, folder, docs, pages, items, labels=()):
    for name, rows, schema in (("documents", docs, DOCS), ("pages", pages, PAGES), ("benchmark", items, ITEMS), ("labels", list(labels), LABELS)):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    docs = [(1, PROSE, "en", "a", 5), (1, PROSE, "en", "a", 5), (2, PROSE, None, None, None), (None, PROSE, "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None)]
    docs += [(3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, PROSE + " tail " * 60_000, "en", "a", 9), (6, "\n".join([PROSE] * 3), "en", None, 3)]
    pages = [(1, "http://x.example/a", "<p>a</p>"), (1, "http://x.example/a", "<p>a</p>"), (None, "http://x.example/b", "<p>a</p>"), (None, None, None), (2, None, "<p>" + "word " * 100_000), (3, "::", "")]
    items = [(1, PROSE), (1, PROSE), (None, "null id but words enough to be an item of its own"), (2, None), (3, "too short"), (4, "")]
    labels = [(1, 1, 0), (1, 1, 0), (None, 1, 1), (2, None, None), (3, 0, 1)]
    return tables(spark, tmp_path_factory.mktemp("odd"), docs, pages, items, labels)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name == "op2_decontaminate":
        assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 1), (None, 1), (5, 1), (6, 1)}
    elif name == "quality_ablations":
        assert len(rows) == 8
    elif name == "op12_filter_audit":
        assert {(r.part, r.removed) for r in rows if r.filter_order == "EABCD" and r.step == 1} == {("a", 1), ("", 1)}  # of id 2, and of id 4 an empty text
        assert len(rows) == 2 * 600
    else:
        assert len(rows) == (6 if name in ("op5_warc", "op7_html_text") else 10)
    if name == "op5_warc":
        a = [r for r in rows if r.payload_bytes == 8]
        assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in a) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    if name == "op6_substring_dedup":
        assert {(r.doc_id, r.n_removed > 0) for r in rows if r.n_words} == {(1, False), (2, True), (5, True), (6, True), (None, True)}
    if name == "op10_simhash":
        assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {3}


def test_pipeline_on_odd_rows(spark, odd, empty):
    import corpus_pipeline as c

    assert c.run(spark, empty).collect() == []
    # the prose is boilerplate of its source there, and what it leaves empty is one component
    assert [r.doc_id for r in c.run(spark, odd).collect()] == [1]


CLASH = ("host", "template", "block", "salt", "digest", "h", "size", "shard", "pid", "n", "w", "iw", "item_key", "fp", "places", "start", "pos", "line", "k1", "total", "part", "failed", "pii", "root", "node", "bucket", "d", "__n", "__k", "__m", "__node", "__q_text", "__q_w", "__q_stay", "__l_gone", "__l_host", "__d_id", "__d_bad", "__d_key")


def test_columns_of_clashing_names(spark, odd):
    from pyspark.sql import functions as F

    from tessella.llm import decontaminate, lines, near, quality, warc, wrappers

    more = {c: F.lit(1) for c in CLASH}
    read = lambda t: spark.read.parquet(f"{odd}/{t}.parquet")
    docs, pages, items = read("documents"), read("pages"), read("benchmark")
    same = lambda a, b, cols: sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))
    assert same(wrappers.extracted(pages), wrappers.extracted(pages.withColumns(more)), ["page_id", "text"])
    assert same(warc.report(pages), warc.report(pages.withColumns(more)), ["page_id", "record_type", "refers_to"])
    assert same(decontaminate.report(docs, items), decontaminate.report(docs.withColumns(more), items.withColumns(more)), ["doc_id", "item_id"])
    for stage in (quality.passing, lambda d: lines.without_boilerplate(d, F.col("source")), near.representatives, lambda d: decontaminate.without_matches(d, items.withColumns(more))):
        wide = docs.withColumns(more)
        out = stage(wide)
        assert out.columns[: len(wide.columns)] == wide.columns
        assert {r["__n"] for r in out.select("__n").collect()} <= {1}
        assert same(stage(docs), out, docs.columns)
