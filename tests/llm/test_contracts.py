"""Every contract query against a plain version, over whole small tables and planted edge cases."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import Row

from tests.llm import brute
from tessella.llm import bpe, decontaminate, kneser_ney, lines, pii, quality, simhash, substring, warc, wrappers
from tessella.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "a b c a b c a b c",
    "same line\nsame line\n\nsame line\n \n",
    "x" * 50_000,
    "word " * 20_000,
    "mail a@b.c@d.ef and .@x.y.z-1 and foo@bar 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (555) 123-4567. +12 345 +1234567890123456",
    " a@b.co  1.2.3.4 ",
    "😀 a@b.co 😀 1.2.3.4    é",
    "9" * 3000,
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5",
    "+" * 100 + "1" * 12 + " ) ) )",
    "GB82 WEST 1234 5698 7654 32 GB82 WEST 1234 5698 7654 33 ssn 123-45-6789 or 123-45-6789",
    'token = "908038b7daaf91e730d2f64001c52934d43d9336"',
    "\x1c\x1d\x85  don't  I'LL we've 123abc \r\n\r\n  end  ",
]


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return real + [(10_000 + i, t, "odd") for i, t in enumerate(ODD)] + [(20_000 + i, t, None) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def frame(spark, docs):
    rows = [Row(doc_id=i, text=t, lang="x", source=s, n_chars=1, fp=3, pos=1, n=2, part=9, host="h") for i, t, s in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int, pos int, n int, part int, host string").repartition(5).cache()


def empty(df):
    return df.limit(0)


def test_quality(frame, docs):
    led = quality.verdicts(quality.ledger(frame))
    got = {r.doc_id: r for r in led.collect()}
    for i, t, _ in docs:
        *want, base = brute.quality(t)
        r = got[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want, i
        assert not (base and r.kept)
        assert bool(r.failed & 3) == base
    kept = {i for i, r in got.items() if r.kept}
    assert {r.doc_id for r in quality.passing(frame).collect()} == kept
    assert quality.passing(frame).columns == frame.columns
    ab = {r.rule: r for r in quality.ablations(led).collect()}
    assert ab["too_few_words"].n_failed == sum(r.n_words < 50 for r in got.values())
    assert quality.ledger(empty(frame)).count() == 0


def test_pii(frame, docs):
    got = {r.doc_id: r for r in pii.report(frame).collect()}
    for i, t, _ in docs:
        counts, spans = brute.pii(t)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == counts, (i, t[:80])
        assert got[i].base_sha256 == brute.sha(spans), i
        assert set(filter(None, spans.split(","))) <= set(got[i].spans.split(","))
    by_text = {t: got[i].spans for i, t, _ in docs}
    iban = next(s for t, s in by_text.items() if t and t.startswith("GB82"))
    assert "iban:0:27" in iban and iban.count("iban") == 1
    assert "ssn:" in iban
    assert by_text[ODD[17]].startswith("secret:")


def test_pii_redacts(spark):
    df = spark.createDataFrame([(1, "call a@b.co now"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redacted(pii.with_spans(df)).collect()}
    assert out == {1: "call [email] now", 2: ""}


def test_bpe(frame, docs):
    import hashlib
    import struct

    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={x: i for i, x in enumerate(tokens)}, special_tokens={})
    got = {r.doc_id: r for r in bpe.report(frame).collect()}
    for i, text, _ in docs:
        ids = t.encode_ordinary(text or "") if len(text or "") < 60_000 or " " in text else None
        assert got[i].decoded_sha256 == brute.sha(text or ""), i
        if ids is not None:
            assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()), i
    full = bpe.encoded(frame.where("doc_id = 10004")).first()
    assert full.decoded == "two words" and list(full.ids) == t.encode_ordinary("two words")


def test_bpe_every_code_point_and_token():
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={x: i for i, x in enumerate(tokens)}, special_tokens={})
    codec = bpe.Codec(bpe.model_bytes(tokens), tokens, P.PATTERN)
    import numpy as np

    for lo in range(0, 0x30000, 0x400):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)} " for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == t.encode_ordinary(text), hex(lo)
    for x in tokens[::7]:
        try:
            text = x.decode()
        except UnicodeDecodeError:
            continue
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == t.encode_ordinary(text)


def test_simhash(frame, docs):
    want = brute.near([(i, t) for i, t, _ in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(frame).collect()}
    assert got == want
    kept = {r.doc_id for r in simhash.representatives(frame).collect()}
    assert kept == {c for _, c in want.values()}
    assert simhash.report(empty(frame)).count() == 0


def test_covering_masks_meet():
    masks = simhash.covering_masks(2)
    for a in range(64):
        for b in range(64):
            x = (1 << a) | (1 << b)
            assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("small,radius", [(1024, 2), (4, 2), (1024, 3), (4, 3), (4, 1)])
def test_links_in_large_buckets(spark, monkeypatch, small, radius):
    import random

    rnd = random.Random(1)
    monkeypatch.setattr(simhash, "SMALL", small)
    fps = {0}
    while len(fps) < 300:
        x = rnd.choice(sorted(fps))
        for _ in range(rnd.choice((1, 2, 3))):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    from tessella.llm.common import components

    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, radius)).collect()}
    mask = (1 << 64) - 1
    seen, groups = set(), []
    for f in fps:
        if f not in seen:
            todo, g = [f], {f}
            while todo:
                x = todo.pop()
                new = {y for y in fps - g if (x ^ y).bit_count() <= radius}
                g |= new
                todo += new
            seen |= g
            groups.append(g)
    for g in groups:
        root = min(simhash._signed(x) for x in g)
        for x in g:
            assert got.get(simhash._signed(x & mask), simhash._signed(x)) == root


def test_substring(frame, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(frame).collect()}
    assert got == brute.substring([(i, t) for i, t, _ in docs])
    assert substring.report(empty(frame)).count() == 0


def test_window_index_over_batches_and_compaction(spark, docs):
    rows = sorted((i, t) for i, t, _ in docs)
    index = substring.WindowIndex(spark, buckets=16, fan_in=1)
    flags, all_docs = None, spark.createDataFrame(rows, "doc_id long, text string")
    step = len(rows) // 3 + 1
    for lo in range(0, len(rows), step):
        part = spark.createDataFrame(rows[lo : lo + step], "doc_id long, text string")
        index = substring.WindowIndex(spark, index.path, buckets=99 if lo else 16)
        index.fan_in = 1
        f = index.ingest(part, 4)
        flags = f if flags is None else flags.unionByName(f)
    assert len(index.runs) == 1 and index.buckets == 16
    got = {r.doc_id: r.n_removed for r in substring.cleaned(all_docs, flags, 4).collect()}
    assert got == {i: x[1] for i, x in brute.substring(rows).items()}


def test_lines(frame, docs):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.report(frame).collect()}
    assert got == brute.lines([(i, s, t) for i, t, s in docs])


def test_decontaminate(spark, frame, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    listed = [(r.item_id, r.text) for r in items.collect()]
    edited = listed[1][1].split()
    edited[0] = "changed"
    more = docs + [(30_000, "pre " + " ".join(edited) + " post", "x"), (30_001, listed[2][1].upper(), "x")]
    df = spark.createDataFrame([(i, t) for i, t, _ in more], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.report(df, items).collect()}
    assert got == brute.contaminated([(i, t) for i, t, _ in more], listed)
    clean = {r.doc_id for r in decontaminate.without_matches(df, items).collect()}
    assert clean == {i for i, _, _ in more} - {d for d, _ in got}
    assert decontaminate.report(df, items.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages += [(900, "u", None), (901, None, ""), (902, "u\r\nX: y", "é" * 1000), (903, "v", "é" * 1000), (904, "w", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.report(df, str(tmp_path / "a")).collect()}
    assert got == brute.warc([(i, h) for i, _, h in pages])
    a = {p.name: p.read_bytes() for p in (tmp_path / "a/archive").iterdir() if p.suffix == ".gz"}
    warc.write(df.repartition(7), str(tmp_path / "b"))
    assert a == {p.name: p.read_bytes() for p in (tmp_path / "b/archive").iterdir() if p.suffix == ".gz"}
    warc.write(df, str(tmp_path / "c"), shard_bytes=50_000, roll_bytes=4_000)
    again = warc.read(spark, str(tmp_path / "c"))
    assert again.count() == len(pages) and again.where("url = 'u%0D%0AX: y'").count() == 1
    assert again.where("record_type = 'response' and page_id = 902").first().payload.decode() == "é" * 1000
    assert warc.report(df.limit(0), str(tmp_path / "d")).count() == 0


def test_language_model(frame, docs):
    got = {r.doc_id: r for r in kneser_ney.report(frame).collect()}
    sent = {i: brute.WORD.findall(brute.lower(t)) for i, t, _ in docs}
    train = [sent[i] for i in sent if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(x for s in train for x in [*s, None])
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for s in train for p in zip(["<b>", *s], [*s, None]))
    after, kinds = Counter(), {}
    for (a, b), k in pairs.items():
        after[a] += k
        kinds.setdefault(a, Counter())[min(k, 3)] += 1
    cont = Counter(b for _, b in pairs)
    disc = lambda cc: kneser_ney.discounts([sum(x == k for x in cc.values()) for k in (1, 2, 3, 4)])
    dp, dw, types = disc(pairs), disc(cont), len(pairs)
    d = lambda ds, k: ds[min(k, 3) - 1] if k else 0
    left = sum(d(dw, k) for k in cont.values()) / types

    def low(w):
        return (cont[w] - d(dw, cont[w])) / types + left / (v + 1)

    def p(a, w):
        if not after[a]:
            return low(w)
        return (pairs[a, w] - d(dp, pairs[a, w])) / after[a] + sum(dp[k - 1] * m for k, m in kinds[a].items()) / after[a] * low(w)

    for i, s in sent.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(s) + 1, n)
        assert r.n_known == sum(c[x] > 0 for x in [*s, None])
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*s, None]), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["<b>", *s], [*s, None])), rel_tol=1e-9), i
    for a in ["<b>", *list(sent[0])[:3]]:
        assert math.isclose(sum(p(a, w) for w in c) + p(a, "\0unseen"), 1, rel_tol=1e-9)


def test_language_model_beats_its_base(spark):
    r = QUERIES["op8_lm_scores"](spark, SF).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert r[0] > r[1]


PAGE = """<html><head><title>t</title><script>var x="<p>no</p>";</script></head><body><nav>menu %d</nav>
<div id="cookie-notice">we use cookies</div><div class=promo>buy</div><p>Printed with care by the site</p>
<article><h1>Head %d</h1><p>First &amp; <b>bold</b><br>line %d<p>Second   para %d</p><form>send</form><ul><li>one %d<li>two</ul>
<section class="comments"><p>reader says</p></section></article><aside>side</aside><footer>foot</footer></body></html>"""


def test_wrappers(spark):
    pages = [(i, f"https://a.example/{i}", PAGE % ((i,) * 5)) for i in range(4)]
    pages += [(10, None, None), (11, "x", "plain text"), (12, "http://b.example", "<p>cut <b>of"), (13, "http://b.example", "<div>a</div>b<!-- c"), (14, "http://a.example", "<p>a &lt;b&gt; &copy; &eacute;&#x41;</p><p></p>")]
    got = {r.page_id: r for r in wrappers.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i].text == f"Head {i}\n\nFirst & bold line {i}\n\nSecond para {i}\n\none {i}\n\ntwo"
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (10, 11, 12, 13)] == ["", "plain text", "cut of", "a\n\nb"]
    assert got[14].text == "a <b> © éA"


@pytest.mark.parametrize(
    "source,want",
    [
        ("<body class='has-sidebar'><div id='content' class='with-comments'>text</div><div class='cookieBanner'>c</div></body>", "text"),
        ("<article><p>a</p><article class='comment'><p>reader</p></article></article>", "a"),
        ("<main><h1>t</h1><article>b</article><div class='related-posts'>r</div></main>", "t\n\nb"),
        ("<article><header><h1>t</h1></header>x<footer>f</footer></article><header>site</header>", "t\n\nx"),
        ("<p>a<script>'<p>no</p>'</script>b</p><style>p{}</style><noscript>n</noscript>", "ab"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
        ("<p title='a>b'>x &amp;lt; y&nbsp;z</p><!-- <p>no</p> --><p hidden>h</p><p>cut <a href='x", "x &lt; y z\n\ncut"),
        ("a < b and c <3", "a < b and c <3"),
        ("<textarea>form</textarea><select><option>1</select>t", "t"),
    ],
)
def test_main_text(source, want):
    assert wrappers.main_text(source) == want


def test_wrapper_expressions():
    w = wrappers.fold([f"<div><p>Always</p><h1>t{i}</h1><ul>{'<li>x%d</li>' % i * (i + 1)}</ul>{'<i>opt</i>' if i % 2 else ''}</div>" for i in range(4)])
    text = wrappers.regular_expression(w)
    assert "(<li>#PCDATA</li>)+" in text and "(<i>" in text and ")?" in text and "<h1>#PCDATA</h1>" in text
    assert len(wrappers.constants(w)) == 1
    assert wrappers.main_text("<p>Always</p><h1>z</h1>", frozenset()) == "Always\n\nz"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    raw = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in raw.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(i, t, s) for i, t, s in rows if not brute.quality(t)[-1]]
    passed = {r.doc_id for r in quality.passing(raw).collect()}
    assert passed <= {i for i, _, _ in left}
    left = [x for x in left if x[0] in passed]
    cleaned = brute.lines([(i, s, t) for i, t, s in left])
    from tests.llm.test_near import kept

    stay = {i for _, i in kept([(i, cleaned[i][0]) for i, _, _ in left])}
    left = [(i, cleaned[i][0]) for i, _, _ in left if i in stay]
    bad = {d for d, _ in brute.contaminated(left, items)}
    want = {i: brute.sha(t) for i, t in left if i not in bad}
    assert {r.doc_id: r.decoded_sha256 for r in c.run(spark, SF).collect()} == want
    docs = raw
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == raw.columns, name
    assert [f(spark, raw.limit(0), SF).count() for _, f in c.STAGES] == [0] * 5


def test_warc_ids_far_apart_and_repeated(spark, tmp_path):
    pages = [(i, "u", f"page {i} " * 40) for i in range(400)] + [(-(2**63), "low", "far"), (2**63 - 1, "high", "off"), (None, "none", "n"), (None, "none", "n")]
    pages += [(7, f"again{i}", f"other {i % 50} " * 40) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    manifest = warc.write(df, str(tmp_path / "a"), shard_bytes=8_000)
    per_shard = [r[1] for r in manifest.groupBy("shard").agg({"records": "sum"}).collect()]
    assert sum(per_shard) == len(pages) and len(per_shard) > 20 and max(per_shard) < 60
    got = warc.read(spark, str(tmp_path / "a"))
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes) for r in got.collect()) == sorted((i is None, i or 0, len(h)) for i, _, h in pages)
    ids = []
    for p in (tmp_path / "a/archive").iterdir():
        if p.suffix == ".gz":
            with p.open("rb") as f:
                ids += [h["WARC-Record-ID"] for h, _ in warc.parse(f)]
    assert len(ids) == len(set(ids)) == len(pages)
    warc.write(df.repartition(7), str(tmp_path / "b"), shard_bytes=8_000)
    files = lambda x: {p.name: p.read_bytes() for p in (tmp_path / x / "archive").iterdir() if p.suffix == ".gz"}
    assert files("a") == files("b")


@pytest.mark.parametrize("cut", [5, 400])
def test_warc_files_cut_off(spark, tmp_path, cut):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(20)], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "a"))
    file = next(p for p in (tmp_path / "a/archive").iterdir() if p.suffix == ".gz")
    file.write_bytes(file.read_bytes()[:-cut])
    with pytest.raises(Exception, match="cut off|records"):
        warc.read(spark, str(tmp_path / "a")).count()


def test_pii_work_grows_with_the_text(spark):
    import time

    rows = [(1, "10a" * 333_000), (2, "a@b.co " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].spans == "" and got[2].n_email == 60_000
    assert got[2].base_sha256 == brute.sha(brute.pii(rows[1][1])[1])


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("ssn 123-45-6789", "ssn", True),
        ("ref 123-45-6789", "ssn", False),
        ("socialite 123-45-6789", "ssn", False),
        ("to GB82 WEST 1234 5698 7654 32", "iban", True),
        ("for example GB82 WEST 1234 5698 7654 32", "iban", False),
        ("example account GB82 WEST 1234 5698 7654 32", "iban", True),
        ('token = "908038b7daaf91e730d2f64001c5"', "secret", True),
        ('dummy token = "908038b7daaf91e730d2f64001c5"', "secret", False),
        ('dummy access token = "908038b7daaf91e730d2f64001c5"', "secret", True),
    ],
)
def test_pii_context_decides(spark, text, kind, found):
    r = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (kind in r.spans) == found
    assert len(r.scores.split(",")) == len(r.spans.split(","))


def test_pii_context_words_end_somewhere(spark):
    rows = [(1, "ip 1.2.3.4"), (2, "ipsum 1.2.3.4")]
    got = {r.doc_id: r.scores for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "0.8", 2: "0.6"}


def test_decontamination_misses_no_edited_copy(spark):
    """Windows with edits at their edges and inside, against brute force: everything of 0.8 or more is found."""
    import random

    rnd = random.Random(3)
    words = [f"w{i}x{rnd.randrange(10**6)}" for i in range(5000)]
    items = [(k, " ".join(rnd.choices(words, k=(60, 100, 30, 12)[k % 4]))) for k in range(40)] + [(99, "again and again " * 60)]
    docs = []
    for n in range(600):
        w = items[n % 41][1].split()
        for _ in range(rnd.randrange(4)):
            cut = rnd.randrange(1, 9)
            where = rnd.choice((0, len(w) - cut, rnd.randrange(len(w))))
            w[where : where + cut] = rnd.choices(words, k=cut)
        docs.append((n, " ".join([*rnd.choices(words, k=rnd.randrange(30)), *w, *rnd.choices(words, k=9)])))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.report(df, it).collect()}
    want = brute.contaminated(docs, items)
    assert len(want) > 200 and got == want
