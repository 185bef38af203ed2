"""What wrappers decide, and a plain extractor over whole tables."""

import pytest

from tests.llm import brute
from tessella.llm import wrappers


def extracted(spark, bodies):
    pages = [(i, f"http://a.example/{i}", b) for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_copies_of_an_article_stay_whole(spark):
    copies = [f"<nav>menu {i}</nav><p>seen {i}</p><article><h1>t</h1><p class=lead>lead</p><pre>code</pre></article>" for i in range(4)]
    other = ["<nav>m</nav><article><h1>u</h1><p>another</p></article>"]
    assert extracted(spark, copies + other) == dict(enumerate(["t\n\nlead\n\ncode"] * 4 + ["u\n\nanother"]))


def test_single_block_article_stays(spark):
    assert set(extracted(spark, [f"<div>{i}</div><main><p>all there is</p></main>" for i in range(4)]).values()) == {"all there is"}


def test_nothing_inside_an_article_is_template_text(spark):
    pages = [f"<article><h1>t{i}</h1><p>Shared paragraph</p><ul><li>own {i}</ul></article>" for i in range(4)]
    assert extracted(spark, pages) == {i: f"t{i}\n\nShared paragraph\n\nown {i}" for i in range(4)}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_tables(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    want = {r.page_id: brute.article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in wrappers.extracted(pages).collect()}
    assert got == want


def soup(i):
    paragraphs = "".join(f"<p>paragraph {i} {j} with words of its own {i * 7 + j}</p>" for j in range(3))
    return f"<body><div id=top>Site name</div><div class=box><h1>Title {i}</h1><div class=inner>{paragraphs}<div>Printed with care</div></div></div><div class=low><p>Made by us</p><a href=x>Other {i}</a></div></body>"


def test_the_wrapper_finds_the_main_block_where_no_tag_names_it(spark):
    got = extracted(spark, [soup(i) for i in range(5)])
    paragraphs = lambda i: [f"paragraph {i} {j} with words of its own {i * 7 + j}" for j in range(3)]
    assert got == {i: "\n\n".join([f"Title {i}", *paragraphs(i)]) for i in range(5)}
    alone = wrappers.main_text(soup(1))
    assert alone.startswith("Site name") and alone.endswith("Other 1")


def test_copies_outside_of_articles_are_no_evidence(spark):
    copies = [f"<div class=ads>{i}</div><p>seen {i}</p><div><p>{'long text ' * 20}</p><p>{'more of it ' * 20}</p><p>{'and the end ' * 20}</p><p>short</p></div>" for i in range(5)]
    for text in extracted(spark, copies).values():
        assert "short" in text and "and the end" in text


@pytest.mark.parametrize("tags", ["<div>", "<b>", "<ul><li>", "<p><b>", "<table><tr><td>"])
def test_deep_pages(spark, tags):
    pages = [tags * 10_000 + f"deep {i}" for i in range(4)] + ["<p>flat</p>"]
    got = extracted(spark, pages)
    assert [got[i] for i in range(5)] == [f"deep {i}" for i in range(4)] + ["flat"]


def test_wrappers_survive_packing_and_folding_in_any_grouping():
    pages = [wrappers.expression(wrappers.parse(soup(i))) for i in range(6)]
    state = None
    for p in pages:
        state = wrappers._add(state, wrappers.unpacked_wrapper(wrappers.packed_wrapper(p)))
    halves = [wrappers.merged(pages[:3]), wrappers.merged(pages[3:])]
    assert wrappers.constants(state) == wrappers.constants(wrappers.merged(halves)) != []
    assert wrappers.main_block(state) == wrappers.main_block(wrappers.merged(halves)) != 0


def test_folds_by_levels(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 2)
    pages = spark.createDataFrame([(i, "http://a.example/x", soup(i)) for i in range(40)], "page_id long, url string, html string").repartition(9)
    r = wrappers.infer(pages).collect()
    assert [(x.host, x.n) for x in r] == [("a.example", 40)]
    w = wrappers.unpacked_wrapper(r[0].wrapper)
    assert w[wrappers.TIMES] == 40 and wrappers.main_block(w)
    assert "(<p>#PCDATA</p>)+" in wrappers.regular_expression(w)


def test_turns_are_repeated_groups():
    w = wrappers.fold([f"<dl>{''.join(f'<dt>k{i}{j}</dt><dd>v{i}{j}</dd>' for j in range(i + 2))}</dl>" for i in range(4)])
    assert wrappers.regular_expression(w) == "<dl>(<dt>#PCDATA</dt>)+(<dd>#PCDATA</dd>)+</dl>"


def test_many_hosts_meet_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_KEYS", 0)
    got = extracted(spark, [soup(i) for i in range(5)])
    assert got[3].startswith("Title 3") and "Printed" not in got[3]


ARTICLE = '<html><body><nav>Menu</nav><div class="content"><h1>Title</h1><p>Main text of the page, long enough to be told.</p></div>{}</body></html>'


@pytest.mark.parametrize(
    "more,want",
    [
        ("<aside><article>Teaser</article></aside>", "Title\n\nMain text of the page, long enough to be told."),
        ('<div class="related"><article>Teaser</article></div>', "Title\n\nMain text of the page, long enough to be told."),
        ("<section><article>Teaser</article></section>", "Title\n\nMain text of the page, long enough to be told.\n\nTeaser"),
        ("<article></article>", "Title\n\nMain text of the page, long enough to be told."),
    ],
)
def test_an_article_that_is_not_the_article(more, want):
    assert wrappers.main_text(ARTICLE.format(more)) == want


def test_an_article_keeps_what_is_not_named_without_doubt():
    body = '<p>One two three.</p><label>Label</label><menu><li>Soup</menu><div hidden>Hidden</div><p class="legal">Law</p><p class="response">Answer</p><p class="search-results-story">Story</p><p class="social-history">History</p>'
    gone = '<div class="comments">C</div><div id="comment-list">C</div><div class="share-buttons">X</div><div class="ad-slot">A</div><div class="newsletterBox">N</div><div class="social"><a href="/">F</a></div><form><label>L</label></form>'
    assert wrappers.main_text(f"<article>{body}{gone}</article>") == "One two three.\n\nLabel\n\nSoup\n\nHidden\n\nLaw\n\nAnswer\n\nStory\n\nHistory"


def test_text_outside_of_a_page_without_article_is_never_lost():
    for tag in ("div", "section", "article", "main", "p", "td"):
        assert wrappers.main_text(f"<body><{tag}>Some words</{tag}></body>") == "Some words"


@pytest.mark.parametrize("n,m,kinds", [(40, 60, 3), (700, 900, 2), (900, 700, 40), (3000, 2500, 5), (1, 400_000, 2), (400_000, 1, 2)])
def test_siblings_are_aligned_as_well_as_possible(n, m, kinds):
    import random

    rng = random.Random(n)
    x, y = [str(rng.randrange(kinds)) for _ in range(n)], [str(rng.randrange(kinds)) for _ in range(m)]
    found = wrappers._matches(x, y)
    assert all(x[i] == y[j] for i, j in found) and all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
    if n * m < 1_000_000:
        last = [0] * (m + 1)
        for a in x:
            now = [0]
            for j, b in enumerate(y):
                now.append(last[j] + 1 if a == b else max(last[j + 1], now[j]))
            last = now
        assert len(found) == last[-1]
    else:
        assert len(found) == int(wrappers._common(x, y)[-1])


def test_rare_optional_parts_go_whatever_the_size(monkeypatch):
    monkeypatch.setattr(wrappers, "RARE", 10)
    pages = [f"<body><div>common {i}</div>" + ("<b>rare</b>" if i == 3 else "") + ("<i>often</i>" if i % 2 else "") + "</body>" for i in range(40)]
    sigs = {e[0] for e in wrappers._nodes(wrappers.fold(pages))}
    assert "b" not in sigs and "i" in sigs
