"""Operators against hand-made cases and plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import dates, metaphone, text, values
from tessella.operators import cluster, graph, intervals, joins, merge, paging, windows
from tessella.operators.predicates import Filters, list_key, parse_list_key
from tessella.plans import search
from tessella.sources import files
from tessella.streaming import collect


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("a,b,want", [("smith", "schmitt", 0.1667), ("katherine", "kathryn", 0.2857), ("schmidt", "schmitt", 0.4545), ("", "", 0.0), ("same", "SAME", 1.0)])
def test_trigram_similarity(spark, a, b, want):
    assert abs(one(spark, text.trigram_similarity(F.lit(a), F.lit(b)))[0] - want) < 1e-3


def test_text_functions(spark):
    r = one(
        spark,
        text.search_token(F.lit("  Éva-O'Neil (née Löw) ")),
        text.search_token(F.lit("!!!")),
        text.folder_name(F.lit('a/b: "c" . ')),
        text.folder_name(F.lit("CON")),
        text.initials(F.lit("ada  maria lee")),
        text.byte_size(F.lit(3 * 1024 * 1024)),
        text.normal_extension(F.lit("x.JPEG")),
        text.replace_text(F.lit("a.b a.B"), "A.b", "$1", False),
        text.display_name(F.lit("Ada"), F.lit("Ad"), F.lit("Lee"), F.lit("Jr."), F.lit("Low")),
        text.snippet(F.lit("x" * 50 + " word " + "y" * 90), "word"),
        text.plural(F.lit(1), "photo"),
    )
    assert list(r)[:9] == ["eva o'neil nee low", None, "a_b_ _c_", "CON_", "AL", "3.0 MB", "jpg", "$1 $1", 'Ada "Ad" Lee Jr. (née Low)']
    assert r[9].startswith("…x") and r[9].endswith("y…") and "word" in r[9] and r[10] == "1 photo"


@pytest.mark.parametrize("a,b", [("Smith", "Smyth"), ("Philip", "Filip"), ("Catherine", "Katherine"), ("Wright", "Right")])
def test_phonetic_keys_agree(a, b):
    assert text.phonetic_key(a) == text.phonetic_key(b)


#: Published codes of names and words.
SPOKEN = """testing TSTN TSTN|The 0 T|quick KK KK|brown PRN PRN|fox FKS FKS|jumped JMPT AMPT|over AFR AFR|lazy LS LS|dogs TKS TKS|MacCafferey MKFR MKFR|Stephan STFN STFN|Kuczewski KSSK KXFS
mclaughlin MKLF MKLF|xenophobia SNFP SNFP|Fokker FKR FKR|Joqqi JK AK|Hovvi HF HF|Czerny SRN XRN|Smith SM0 XMT|Schmidt XMT SMT|Thomas TMS TMS|Wagner AKNR FKNR|Xavier SF SFR|Michael MKL MXL|Jose HS HS
Cabrillo KPRL KPR|rough RF RF|Thumb 0M TM|island ALNT ALNT|Caesar SSR SSR|sugar XKR SKR|edge AJ AJ|Edgar ATKR ATKR|Wright RT RT|Knight NT NT|Bach PK PK|Filipowicz FLPT FLPF|Arnow ARN ARNF|Arnoff ARNF ARNF
school SKL SKL|accident AKST AKST|laugh LF LF|cagney KKN KKN|breaux PR PR|resnais RSN RSNS|artois ART ARTS|danger TNJR TNKR|Schneider XNTR SNTR|Snider SNTR XNTR|campbell KMPL KMPL|raspberry RSPR RSPR
Orchestra ARKS ARKS|chianti KNT KNT|character KRKT KRKT|chorus KRS KRS|chore XR XR|focaccia FKX FKX|ghislane JLN JLN|ghost KST KST|biaggi PJ PK"""


def test_double_metaphone(spark):
    known = [x.split() for x in SPOKEN.replace("\n", "|").split("|")]
    df = spark.createDataFrame([(w,) for w, _, _ in known] + [("",), ("12",), (None,), ("O'Neil-éx",)], "w string")
    got = [(r.w, r.c and tuple(r.c)) for r in df.select("w", metaphone.double_metaphone(F.col("w")).alias("c")).collect()]
    assert got[: len(known)] == [(w, (a, b)) for w, a, b in known]
    assert [c for _, c in got[len(known) :]] == [None, None, None, ("ANLK", "ANLK")]
    assert all(metaphone.codes(w) == c for w, c in got)


def test_phonetic_key_of_nothing():
    assert text.phonetic_key("") is None and text.phonetic_key("12") is None


SAID = [
    ("1962", ("1962-01-01", "year")),
    ("March 1962", ("1962-03-01", "month")),
    ("March of 1962", ("1962-03-01", "month")),
    ("sept 1962", ("1962-09-01", "month")),
    ("3/1962", ("1962-03-01", "month")),
    ("1962-3", ("1962-03-01", "month")),
    ("the 60s", ("1960-01-01", "decade")),
    ("1960s", ("1960-01-01", "decade")),
    ("20s", ("2020-01-01", "decade")),
    ("the sixties", ("1960-01-01", "decade")),
    ("circa 1950", ("1950-01-01", "year")),
    ("abt 1962", ("1962-01-01", "year")),
    ("1962?", ("1962-01-01", "year")),
    ("4 July 1962", ("1962-07-04", "exact")),
    ("12th of March, 1962", ("1962-03-12", "exact")),
    ("July 4th, 1962", ("1962-07-04", "exact")),
    ("7/4/1962", ("1962-07-04", "exact")),
    ("1962-07-04", ("1962-07-04", "exact")),
    ("summer 1971", ("1971-07-01", "year")),
    ("winter of 1971", ("1971-01-01", "year")),
    ("Christmas 1965", ("1965-12-01", "month")),
    ("xmas 1965", ("1965-12-01", "month")),
    ("30 February 1962", None),
    ("29 February 1960", ("1960-02-29", "exact")),
    ("1799", None),
    ("2101", None),
    ("May", None),
    ("12345", None),
    ("no date", None),
    ("", None),
    (None, None),
]


def test_free_dates(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SAID)], "i int, s string")
    got = [r.p and (str(r.p.date), r.p.precision) for r in df.orderBy("i").select(dates.free_date(F.col("s")).alias("p")).collect()]
    assert got == [w for _, w in SAID]
    for said, want in SAID:
        p = dates.parse_free(said)
        assert (p and (str(p.date), p.precision)) == want


@pytest.mark.parametrize(
    "date,clock,month,scan,want",
    [
        ("1998-05-03", "1998-05-03 12:00:00", None, False, ""),
        ("1998-05-03", None, None, True, "a"),
        ("2003-01-01", "2003-01-01 00:00:30", None, False, "b"),
        ("2003-01-01", "2003-01-01 00:01:00", None, False, ""),
        ("1998-05-03", None, "1998-02-01", False, ""),
        ("1998-05-03", None, "1998-01-01", False, "c"),
        ("1825-12-31", None, None, False, "d"),
        ("2030-01-01", None, None, False, "d"),
        ("2030-01-01", "2030-01-01 00:00:00", "1998-01-01", True, "abcd"),
    ],
)
def test_date_hygiene(spark, date, clock, month, scan, want):
    day = lambda x: F.lit(x).cast("date")
    flags = dates.hygiene_flags(day(date), F.lit(clock).cast("timestamp"), day(month), day("2020-01-01"), F.lit(scan))
    assert "".join(one(spark, flags)[0]) == want


@pytest.mark.parametrize(
    "taken,scan,modified,want",
    [
        (None, True, None, None),
        ("1998-05-03 12:00:00", True, None, "scanner_clock"),
        ("1998-01-01 00:00:59", False, None, "unset_camera_clock"),
        ("1820-05-03 12:00:00", False, None, "implausible_date"),
        ("1998-05-04 12:00:00", False, "1998-05-03 12:00:00", None),
        ("1998-05-04 12:00:01", False, "1998-05-03 12:00:00", "implausible_date"),
        ("1998-05-04 12:00:01", False, None, None),
    ],
)
def test_dates_at_ingest(spark, taken, scan, modified, want):
    at = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, dates.ingest_reason(at(taken), F.lit(scan), at(modified)))[0] == want


def test_week_window_wraps(spark):
    w = dates.WeekWindow.from_spec("fri 22:00-06:00")
    rows = spark.createDataFrame([("2024-01-05 23:00:00",), ("2024-01-06 05:59:00",), ("2024-01-06 06:00:00",), ("2024-01-06 23:00:00",)], "t string")
    assert [r[0] for r in rows.select(w.contains(F.to_timestamp("t"))).collect()] == [True, True, False, False]


def test_filters_and_keys():
    f = Filters.parse("year=1962&decade=x&untagged=1&from=1950&unknown=2&q= a ")
    assert (f.year, f.decade, f.untagged, f.year_from, f.text) == (1962, None, True, 1950, "a")
    for key in ("p.12", "a.5", "b.recent", "nd.x"):
        f, sort = parse_list_key(key)
        assert list_key(f, sort or "") == key


def test_cursors():
    for c in ((None, 5), ("a~b c", 7), ("1962-01-01", 1)):
        assert paging.decode(paging.encode(*c)) == c
    with pytest.raises(ValueError):
        paging.decode("x~y")


@pytest.mark.parametrize("descending", [True, False])
def test_pages_cover_the_list_both_ways(spark, descending):
    rows = [(i, [None, 3, 1, 3][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v int")
    sort = paging.Sort("v", descending)
    want = [r.id for r in df.orderBy(*sort.order()).collect()]
    got, cursor = [], None
    while page := paging.page(df, sort, 7, cursor).collect():
        got += [r.id for r in page]
        cursor = (page[-1].v, page[-1].id)
    assert got == want
    back = [r.id for r in paging.page(df, sort, 200, (page[-1].v, page[-1].id) if page else cursor, True).collect()]
    assert back == want[:-1][::-1]
    near = {r.side: r.id for r in paging.neighbours(df, sort, want[5]).collect()}
    assert near == {"previous": want[4], "next": want[6]}


def test_bursts_are_anchored(spark):
    at = dt.datetime(2024, 1, 1)
    seconds = [0, 1.5, 2.9, 3.0, 4.5, 4.9, 20, 21, 21.5]
    df = spark.createDataFrame([(i, "f", at + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "id long, f string, t timestamp")
    got = {r.id: r.burst for r in windows.bursts(df, ["f"], "t", "id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6}


def test_refused_hits_do_not_count(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, 1, at + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 3599, 3600, 3605, 3611])], "id long, u long, t timestamp")
    got = [r.ok for r in windows.admitted(df, "u", "t", "id", 2).orderBy("id").collect()]
    assert got == [True, True, False, False, True, False, True]


def _hex(n):
    return f"{n:064x}"


def test_banded_pairs_equal_brute_force(spark):
    rnd = random.Random(42)
    rows = [rnd.getrandbits(256) for _ in range(300)]
    for k in range(20):
        x = rows[k]
        for b in rnd.sample(range(256), k):
            x ^= 1 << b
        rows.append(x)
    rows.append(rows[0])
    df = spark.createDataFrame([(i, _hex(x)) for i, x in enumerate(rows)], "id long, h string")
    for d in (0, 10, 15):
        got = {(r.a, r.b): r.distance for r in graph.hamming_pairs(df, "id", "h", d).collect()}
        want = {(r.a, r.b): r.distance for r in graph.brute_pairs(df, "id", "h", d).collect()}
        last = len(rows) - 1  # a copy: linked to its representative, whose links stand for its own
        assert {k: v for k, v in want.items() if last not in k} | {(0, last): 0} == got
    with pytest.raises(ValueError):
        graph.hamming_pairs(df, "id", "h", 16)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (5, 5)]
    got = {r.id: r.group for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: g for i, g in got.items() if i < 100} == {i: 1 for i in range(1, 61)}
    assert all(got[i] == 100 for i in range(100, 130)) and got[201] == got[200] == 200


def test_duplicate_groups_pick_keepers(spark):
    pairs = spark.createDataFrame([(1, 2, 4), (2, 3, 6), (8, 9, 0)], "a long, b long, distance int")
    facts = spark.createDataFrame([(1, 10), (2, 30), (3, 30), (8, 5), (9, 5)], "id long, pixels int")
    got = {r.id: (r.keeper, r.size, r.edge, r.min_distance) for r in graph.duplicate_groups(pairs, facts, "id", [F.col("pixels")]).collect()}
    assert got == {1: (2, 3, 4, 4), 2: (2, 3, 0, 4), 3: (2, 3, 6, 4), 8: (8, 2, 0, 0), 9: (8, 2, 0, 0)}


def test_merge_entities(spark):
    faces = spark.createDataFrame([(1, 7), (2, 8)], "id long, person_id long")
    v = spark.createDataFrame([(7, "Ann"), (8, "ANN"), (8, "Anna")], "person_id long, variant string")
    f, names = graph.merge_entities(faces, v, 7, 8)
    assert {r.person_id for r in f.collect()} == {7}
    assert sorted(r.variant for r in names.collect()) == ["Ann", "Anna"]


def test_last_writer_wins(spark):
    t = lambda d: d and dt.datetime(2024, 1, d)
    ours = spark.createDataFrame([(1, "o", t(2)), (2, "o", None), (3, "o", t(2)), (4, "o", t(3)), (5, "o", None)], "id long, v string, at timestamp")
    theirs = spark.createDataFrame([(1, "t", t(2)), (2, "t", t(1)), (3, "t", None), (4, "t", t(2)), (5, "t", None), (6, "t", None)], "id long, v string, at timestamp")
    got = {r.id: r.v for r in merge.upsert(ours, theirs, ["id"], guarded={"v": "at"}).collect()}
    assert got == {1: "t", 2: "t", 3: "o", 4: "o", 5: "t", 6: "t"}


def test_next_ids_are_dense(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k")).repartition(5)
    got = {r.k: r.id for r in merge.next_ids(df, spark.range(3), "id", [F.col("k")], 1000).collect()}
    assert got == {k: 1000 + k for k in range(100)}


def test_nearest_zero_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0])], "id long, vector array<double>")
    got = [(r.ref_id, round(r.distance, 6)) for r in joins.nearest(df.where("id = 1"), df, 3).orderBy("rank").collect()]
    assert got == [(1, 0.0), (3, 0.0), (2, 1.0)]


def test_clusters_and_split(spark):
    rnd = np.random.default_rng(0)
    centres = np.eye(3)
    x = np.concatenate([c + rnd.normal(0, 0.02, (10, 3)) for c in centres])
    assert len(set(cluster.average_linkage(x, 0.45))) == 3
    assert len(set(cluster.split_clusters(x, 1.9, most=12))) >= 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    groups = {r.id: r.cluster for r in cluster.clusters(df, "id", "v").collect()}
    assert set(groups.values()) == {0, 10, 20}


def test_dyadic_interval_join_equals_plain(spark):
    d = lambda n: n is not None and dt.date(1800, 1, 1) + dt.timedelta(days=n) or None
    rnd = random.Random(3)

    def some(n):
        out = []
        for i in range(n):
            a = rnd.randrange(1, 90_000)
            b = a + rnd.choice([0, 1, 30, 900, 40_000, -5])
            out.append((i, d(rnd.choice([a, a, a, None])), d(rnd.choice([b, b, b, None]))))
        return out + [(n, d(5000), d(5000)), (n + 1, d(5000), d(5000)), (n + 2, None, None)]

    rows, spans = some(60), some(50)
    got = [(r.id, r.ix) for r in intervals.overlapping(spark.createDataFrame(rows, "id int, lo date, hi date"), "lo", "hi", spark.createDataFrame(spans, "ix int, q_lo date, q_hi date")).collect()]
    want = {(i, k) for i, a, b in rows for k, x, y in spans if (y is None or a is None or a <= y) and (x is None or b is None or b >= x)}
    assert len(got) == len(set(got)) and set(got) == want


def test_dyadic_blocks_are_few_and_exact(spark):
    rnd = random.Random(4)
    spans = [(a := rnd.randrange(100_000), a + rnd.choice([0, 1, 2, 7, 1000, 99_999])) for _ in range(200)] + [(0, (1 << intervals.LEVELS) - 1), (5, 4)]
    df = spark.createDataFrame(spans, "lo long, hi long")
    for r in df.select("lo", "hi", intervals.blocks(F.col("lo"), F.col("hi")).alias("b")).collect():
        days = sorted((b.block << b.level, (b.block + 1 << b.level) - 1) for b in r.b)
        assert len(days) <= 2 * max((r.hi - r.lo + 1).bit_length(), 1)
        assert (not days and r.hi < r.lo) or (days[0][0], days[-1][1]) == (r.lo, r.hi) and all(y + 1 == x for (_, y), (x, _) in zip(days, days[1:]))


def test_assigned_regions(spark):
    faces = spark.createDataFrame([(1, 1, (0.0, 0.0, 1.0, 1.0)), (1, 2, (1.5, 0.0, 1.0, 1.0)), (1, 3, (5.0, 5.0, 1.0, 1.0))], "photo int, id int, box struct<x: double, y: double, w: double, h: double>")
    regions = spark.createDataFrame([(1, 10, (0.0, 0.0, 2.0, 2.0)), (1, 11, (2.0, 0.0, 2.0, 2.0))], "photo int, r_id int, r_box struct<x: double, y: double, w: double, h: double>")
    got = {r.id: r.r_id for r in joins.assigned(faces, regions, "photo").collect()}
    assert got == {1: 10, 2: None, 3: None}


D = dt.date


@pytest.mark.parametrize(
    "q,lo,hi,label",
    [
        ("1962", D(1962, 1, 1), D(1962, 12, 31), "1962"),
        ("1962-1965", D(1962, 1, 1), D(1965, 12, 31), "1962–1965"),
        ("1965-1962", D(1962, 1, 1), D(1965, 12, 31), "1962–1965"),
        ("1962 to 1965", D(1962, 1, 1), D(1965, 12, 31), "1962–1965"),
        ("1960s", D(1960, 1, 1), D(1969, 12, 31), "the 1960s"),
        ("60s", D(1960, 1, 1), D(1969, 12, 31), "the 1960s"),
        ("the sixties", D(1960, 1, 1), D(1969, 12, 31), "the 1960s"),
        ("before 1950", None, D(1949, 12, 31), "before 1950"),
        ("after 1980", D(1981, 1, 1), None, "after 1980"),
        ("since 1980", D(1981, 1, 1), None, "after 1980"),
        ("March 1962", D(1962, 3, 1), D(1962, 3, 31), "March 1962"),
        ("1962-03", D(1962, 3, 1), D(1962, 3, 31), "March 1962"),
        ("summer 1971", D(1971, 1, 1), D(1971, 12, 31), "1971"),
        ("February 1960", D(1960, 2, 1), D(1960, 2, 29), "February 1960"),
        ("February 1961", D(1961, 2, 1), D(1961, 2, 28), "February 1961"),
        ("May 1962", D(1962, 5, 1), D(1962, 5, 31), "May 1962"),
    ],
)
def test_query_dates(q, lo, hi, label):
    (t,) = search.parse(q).terms
    assert (t.lo, t.hi, t.label) == (lo, hi, label)


def test_query_words():
    for name in ("May", "June", "Rose", "April"):
        (t,) = search.parse(name).terms
        assert not t.is_date and t.text == name
    phrase, year = search.parse('"the lake" 1962').terms
    assert (phrase.text, phrase.quoted, phrase.is_date, year.label) == ("the lake", True, False, "1962")
    (quoted,) = search.parse('"1962"').terms
    assert quoted.quoted and not quoted.is_date
    for q in ("", "   ", "xyzzy", "???", "1", "12345", "99999", "before", "after 20", "1962-", "-1962", "a" * 500, '"unclosed', "peggy & chuck", None):
        assert all(isinstance(t.text, str) for t in search.parse(q).terms)
    assert not any(t.is_date for q in ("xyzzy", "before", "1", "12345") for t in search.parse(q).terms)
    t = search.parse("peggy porch 1962").terms
    assert [(x.ix, x.text) for x in t] == [(0, "peggy"), (1, "porch"), (2, "1962")]
    many = search.parse("a b c d e f g h i j k")
    assert len(many.terms) == 8 and many.truncated and not search.parse("a b").truncated
    t = search.parse("peggy in the 60s").terms
    assert [(x.text, x.label) for x in t] == [("peggy", None), ("in the 60s", "the 1960s")]
    assert search.parse("peggy before 1950").describe() == "peggy + before 1950"


def test_search_names_places_and_kinds(spark):
    rows = spark.createDataFrame([(i, "") for i in range(1, 8)], "id long, a string")
    names = spark.createDataFrame([(1, "margaret", None, "exact"), (1, "peggy", None, "nickname"), (2, "margret", None, "variant")], "id long, token string, key string, kind string")
    tagged = spark.createDataFrame([(1, 1, False), (2, 1, True), (3, 2, False)], "row_id long, person_id long, suggested boolean")
    places = spark.createDataFrame([(9, "lake placid", None, "exact"), (9, "the lake", None, "alias")], "id long, token string, key string, kind string")
    placed = spark.createDataFrame([(1, 9, False), (4, 9, True)], "row_id long, place_id long, suggested boolean")
    s = search.Sources(rows=rows, id="id", weights={"a": "a"}, names=names, tagged=tagged, places=places, placed=placed)
    found = lambda q: [(r.row_id, r.score) for r in search.search(s, q).collect()]
    assert found("margaret") == [(1, 100), (2, 70)] and found("peggy") == [(1, 90), (2, 60)] and found("margret") == [(3, 95)]
    assert found('"lake placid"') == [(1, 88), (4, 58)] == found('"the lake"')
    assert found('peggy "the lake"') == [(1, 178)]
    page = search.explained(search.search(s, 'peggy "the lake"'), s, 'peggy "the lake"')
    assert page.first().why == ["Shows Peggy", "Taken at The Lake"]


def test_spans_of_any_number(spark):
    from tessella.operators import joins

    day = lambda n: dt.date(1990, 1, 1) + dt.timedelta(days=n)
    rows = spark.createDataFrame([(i, day(i * 37 % 4000), day(i * 37 % 4000 + i % 400)) for i in range(120)], "id int, lo date, hi date")
    spans = [(i, None if i % 5 == 0 else day(i * 91 % 4000), None if i % 7 == 0 else day(i * 91 % 4000 + 60)) for i in range(60)]
    q = spark.createDataFrame(spans, "ix int, q_lo date, q_hi date")
    few, many = (sorted(map(tuple, joins.in_span(rows, "lo", "hi", q, few=n).select("id", "ix", "score").collect())) for n in (1000, 1))
    assert few == many and len(few) > 1000


def test_nearest_in_blocks(spark, monkeypatch):
    from tessella.operators import joins

    monkeypatch.setattr(joins.in_blocks, "__defaults__", (7,))
    q = spark.createDataFrame([(i, i * 7919) for i in range(40)], "q_id long, x long")
    r = spark.createDataFrame([(i, i * 104729) for i in range(60)], "r_id long, y long")
    got = {x.q_id: (x.d, x.r_id) for x in joins.nearest_hash(q, r, F.bit_count(F.col("x").bitwiseXOR(F.col("y"))), 6).collect()}
    want = {i: min(((i * 7919 ^ j * 104729).bit_count(), j) for j in range(60)) for i in range(40)}
    assert got == {i: x for i, x in want.items() if x[0] <= 6} != {}


def test_search_layers(spark):
    rows = spark.createDataFrame([(1, "Gardens at home", "boats"), (2, "boats", "the garden"), (3, "nothing", "at all")], "id long, a string, d string")
    s = search.Sources(rows=rows, id="id", weights={"a": "a", "d": "d"})
    assert [(r.row_id, r.score) for r in search.search(s, "garden").collect()] == [(1, 80), (2, 40)]
    assert [(r.row_id, r.score) for r in search.search(s, "boat garden").collect()] == [(2, 120), (1, 120)]
    assert search.search(s, "the").count() == 0 and search.search(s, "zebra garden").count() == 0
    assert [r.row_id for r in search.search(s, "the garden", allowed=spark.createDataFrame([(2,)], "i long")).collect()] == [2]
    assert [r.row_id for r in search.search(s, '"at home"').collect()] == [1]


def test_json_helpers(spark):
    r = one(spark, values.first_object(F.lit('x {"a": 1} y')), values.first_object(F.lit("none")), values.json_number(F.lit('{"k": 87}'), "$.k"), values.json_number(F.lit("bad"), "$.k"), values.json_keys_within(F.lit('{"crop":1}'), ["crop", "turn"]))
    assert list(r) == ['{"a": 1}', None, 87.0, None, True]


def test_file_sources(spark, tmp_path):
    for folder, names in (("x_1962-03/a_1971-05", ["img10.jpg", "img9.JPG", "x.txt"]), ("Trip to lake", ["b.tiff"])):
        (tmp_path / folder).mkdir(parents=True)
        for n in names:
            (tmp_path / folder / n).write_bytes(n.encode())
    t = files.numbered_tree(spark, str(tmp_path))
    assert {r.name for r in t.collect()} == {"img10.jpg", "img9.JPG", "b.tiff"}
    hashed = files.content_hash(files.file_tree(spark, str(tmp_path), content=True))
    assert all(len(r.sha256) == 64 for r in hashed.collect())
    hints = {(r.kind, r.value) for r in files.folder_hints(t, "folder").collect()}
    assert ("date", "1971-05") in hints and ("album", "Trip to lake") in hints


def test_natural_order(spark):
    names = ["IMG1", "img9", "img10", "x1699999999999.jpg", "x1700000000000.jpg", "x10000000000000.jpg"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "n string")
    assert [r.n for r in df.orderBy(windows.natural_key(F.col("n"))).collect()] == names


def test_manifest_and_csv(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"files": [{"name": "a.jpg", "groups": [1, 2]}, {"name": "b.jpg", "groups": []}]}')
    assert {(r.file, r.group_id) for r in files.manifest_groups(spark, str(tmp_path / "m.json")).collect()} == {("a.jpg", 1), ("a.jpg", 2)}
    counts = files.dump_csv({"t": (spark.range(5), "id")}, str(tmp_path / "csv"))
    assert counts == {"t": 5}


def test_results_are_applied_once(spark, tmp_path):
    inbox, target, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"ref": "a", "v": 1}\nnot json\n{"ref": "b", "v": 2}\n{"summary": true}\n')
    schema = "ref string, v int"

    def go():
        collect.apply_once(collect.results_stream(spark, str(inbox), schema), ["ref"], str(target), str(ck)).awaitTermination(120)
        return sorted((r.ref, r.v) for r in spark.read.parquet(str(target)).where("ref is not null").collect())

    assert go() == [("a", 1), ("b", 2)]
    (inbox / "2.json").write_text('{"ref": "b", "v": 9}\n{"ref": "c", "v": 3}\n')
    assert go() == [("a", 1), ("b", 2), ("c", 3)]
    assert files.read_results(spark, str(inbox / "1.json"), schema).count() == 2


def test_jobs_registry(spark):
    done = []
    job = collect.register(collect.Job("double", lambda s: s.range(4), lambda it: (p.assign(id=p.id * 2, error=None) for p in it), "id long", lambda df: done.extend(r.id for r in df.collect())))
    job.go(spark)
    assert sorted(done) == [0, 2, 4, 6] and collect.REGISTRY["double"] is job


@pytest.mark.parametrize("most,n", [(0, 1), (3, 1), (10, 4)])
def test_nearest_hash_by_bands_equals_all_pairs(spark, most, n):
    rnd = random.Random(most)
    base = [[rnd.getrandbits(64) - (1 << 63) for _ in range(n)] for _ in range(25)]

    def near(h):
        out = list(h)
        for _ in range(rnd.randrange(most + 3)):
            bit = 1 << rnd.randrange(64)
            k = rnd.randrange(n)
            x = (out[k] & (1 << 64) - 1) ^ bit
            out[k] = x - (1 << 64) if x >> 63 else x
        return out

    q, r = [(i, near(base[i % 25])) for i in range(80)], [(i, near(base[i % 25])) for i in range(60)] + [(99, None)]
    bits = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))
    want = {i: d for i, x in q for d in [min((bits(x, y), k) for k, y in r if y)] if d[0] <= most}
    got = joins.nearest_hash_by_bands(spark.createDataFrame(q, "q_id int, x array<long>"), spark.createDataFrame(r, "r_id int, y array<long>"), most, n)
    assert {x.q_id: (x.d, x.r_id) for x in got.collect()} == want
