"""Text, names, dates, hashes and JSON over documents, parts, orders and events; the layered search."""

import dataclasses
import re
import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import dates, metaphone, text, values
from ..operators import graph, joins
from ..operators.postings import Postings
from ..session import spread
from ..sources.snapshots import stamp
from . import search
from .registry import query

_MARKED, _PLAIN = text.MARKED, text.PLAIN
_FOLD = f"translate(lower(x), '{_MARKED}', '{_PLAIN}')"


@query("fn1_search_token", f"select doc_id, nullif(trim(regexp_replace({_FOLD}, '[^a-z0-9'']+', ' ', 'g')), '') as token from (select doc_id, text as x from documents)")
def search_token(t):
    return t.documents.select("doc_id", text.search_token(F.col("text")).alias("token"))


@query("fn2_search_text", f"select doc_id, translate(coalesce(lang, ''), '{_MARKED}', '{_PLAIN}') as lang, length(translate(text, '{_MARKED}', '{_PLAIN}')) as n from documents")
def search_text(t):
    return t.documents.select("doc_id", text.search_text(F.col("lang")).alias("lang"), F.length(text.search_text(F.col("text"))).cast("long").alias("n"))


#: Double Metaphone codes of the words in part, nation, region and customer.
_SPOKEN = """
africa AFRK AFRK|america AMRK AMRK|anvil ANFL ANFL|asia AS AX|automobile ATMP ATMP|blue PL PL|bolt PLT PLT|building PLTN PLTN|cold KLT KLT|europe ARP ARP
furniture FRNT FRNT|gear JR KR|gizmo JSM KSM|hot HT HT|household HSHL HSHL|large LRJ LRK|machinery MXNR MKNR|middle MTL MTL|nation NXN NXN|new N NF
old ALT ALT|plate PLT PLT|red RT RT|ring RNK RNK|rod RT RT|small SML XML|widget AJT FJT
"""
_CODES = "(values " + ", ".join("('{}', '{}', '{}')".format(*x.split()) for x in _SPOKEN.strip().replace("\n", "|").split("|") if x) + ") as k(word, first, second)"


@query("fn3_phonetic", f"select p_partkey, first as key from (select p_partkey, regexp_extract(p_name, '([A-Za-z]+)', 1) as word from part) left join {_CODES} using (word)")
def phonetic(t):
    w = t.part.select("p_partkey", F.regexp_extract("p_name", "([A-Za-z]+)", 1).alias("word"))
    return w.select("p_partkey", text.phonetic(F.col("word")).alias("key"))


@query(
    "fn3_both_codes",
    f"""with w as (select 'part' as kind, p_partkey as id, split_part(p_name, ' ', 2) as word from part union all select 'nation', n_nationkey, split_part(n_name, ' ', 1) from nation union all
    select 'region', r_regionkey, split_part(r_name, ' ', 1) from region union all select 'customer', c_custkey, c_mktsegment from customer) select kind, id, first, second from w left join {_CODES} on k.word = regexp_replace(lower(w.word), '[^a-z]', '', 'g')""",
)
def both_codes(t):
    kinds = {"part": (t.part, "p_partkey", F.split_part("p_name", F.lit(" "), F.lit(2))), "nation": (t.nation, "n_nationkey", F.split_part("n_name", F.lit(" "), F.lit(1))), "region": (t.region, "r_regionkey", F.split_part("r_name", F.lit(" "), F.lit(1))), "customer": (t.customer, "c_custkey", F.col("c_mktsegment"))}
    words = [df.select(F.lit(k).alias("kind"), F.col(key).cast("long").alias("id"), w.alias("word")) for k, (df, key, w) in kinds.items()]
    spoken = reduce(lambda a, b: a.unionByName(b), words).withColumn("c", metaphone.double_metaphone(F.col("word")))
    return spoken.select("kind", "id", "c.first", "c.second")


@query(
    "fn4_trigram",
    """with a as (select distinct p_type as x from part), p as (select a.x as x, b.x as y from a, a b where a.x < b.x),
    g as (select x, w, unnest(list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))) as g from (select x, unnest(regexp_split_to_array(lower(x), '[^a-z0-9]+')) as w from a) where w <> ''),
    d as (select distinct x, g from g), n as (select x, count(*) as n from d group by 1)
    select p.x, p.y, round(coalesce(c, 0) / (n1.n + n2.n - coalesce(c, 0)), 6) as similarity from p join n n1 on n1.x = p.x join n n2 on n2.x = p.y left join (select d.x, e.x as y, count(*) as c from d join d e using (g) group by 1, 2) k on k.x = p.x and k.y = p.y""",
)
def trigram(t):
    a = t.part.select("p_type").distinct()
    p = a.select(F.col("p_type").alias("x")).join(joins.bounded(a.select(F.col("p_type").alias("y"))), F.col("x") < F.col("y"))
    return p.select("x", "y", F.round(text.trigram_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("fn5_all_words", "select doc_id from documents where list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'worthless') and list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'idiot')")
def all_words(t):
    w = F.split(F.lower("text"), "[^a-z0-9]+")
    return t.documents.where(F.array_contains(w, "worthless") & F.array_contains(w, "idiot")).select("doc_id")


@query("fn8_snippet", "select doc_id, case when a > 1 then '…' else '' end || trim(substr(text, a, b - a)) || case when b <= length(text) then '…' else '' end as snippet from (select doc_id, text, greatest(strpos(lower(text), 'worthless') - 30, 1) as a, least(strpos(lower(text), 'worthless') + 70, length(text) + 1) as b from documents where contains(lower(text), 'worthless'))")
def snippet(t):
    return t.documents.select("doc_id", text.snippet(F.col("text"), "worthless").alias("snippet")).where("snippet is not null")


@query("fn11_replace", "select doc_id, md5(replace(text, 'worthless', 'w$1th\\less')) as h from documents where contains(text, 'worthless')")
def replace(t):
    return t.documents.where(text.holds(F.col("text"), "worthless", True)).select("doc_id", F.md5(text.replace_text(F.col("text"), "worthless", "w$1th\\less")).alias("h"))


@query("fn11_replace_any_case", "select p_partkey, regexp_replace(p_brand, '(?i)brand#', 'B$', 'g') as b from part")
def replace_any_case(t):
    return t.part.select("p_partkey", text.replace_text(F.col("p_brand"), "BRAND#", "B$", False).alias("b"))


@query("fn12_display_name", "select c_custkey, concat_ws(' ', nullif(trim(c_name), ''), case when c_custkey % 2 = 0 then '\"' || c_mktsegment || '\"' end, case when c_custkey % 3 = 0 then 'Jr.' end, case when c_custkey % 5 = 0 then '(née ' || c_mktsegment || ')' end) as name from customer")
def display_name(t):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    n = text.display_name(F.col("c_name"), F.when(k % 2 == 0, s), F.lit(""), F.when(k % 3 == 0, "Jr."), F.when(k % 5 == 0, s))
    return t.customer.select("c_custkey", n.alias("name"))


@query("fn13_name_forms", "select c_custkey, c_name || ' ' || c_mktsegment as keyword, c_name || ' M ' || c_mktsegment as formal from customer")
def name_forms(t):
    f = text.name_forms(F.col("c_name"), F.lit("M"), F.col("c_mktsegment"), F.lit(None).cast("string"), F.array("c_name"))
    return t.customer.select("c_custkey", f.alias("f")).select("c_custkey", "f.keyword", "f.formal")


@query("fn14_folder", r"""select page_id, case when c = '' then 'Unnamed' when regexp_matches(c, '^(con|prn|aux|nul|com[1-9]|lpt[1-9])([.].*)?$', 'i') then c || '_' else c end as folder
from (select page_id, regexp_replace(substr(regexp_replace(regexp_replace(trim(x), '\s+', ' ', 'g'), '[<>:"/\\|?*]', '_', 'g'), 1, 80), '[. ]+$', '') as c from (select page_id, case page_id % 5 when 0 then url when 1 then 'a/b:  "' || page_id || '" . ' when 2 then 'Con.' || page_id when 3 then 'lpt' || page_id % 12 else repeat(' . ', cast(page_id % 3 as int)) end as x from pages))""")
def folder(t):
    k = F.col("page_id")
    name = F.when(k % 5 == 0, F.col("url")).when(k % 5 == 1, F.concat(F.lit('a/b:  "'), k.cast("string"), F.lit('" . '))).when(k % 5 == 2, F.concat(F.lit("Con."), k.cast("string")))
    name = name.when(k % 5 == 3, F.concat(F.lit("lpt"), (k % 12).cast("string"))).otherwise(F.repeat(F.lit(" . "), (k % 3).cast("int")))
    return t.pages.select("page_id", text.folder_name(name).alias("folder"))


@query("fn16_places", "select n_nationkey, n_name as city, case when n_nationkey % 2 = 0 then 'ST' end as state, r_name as country from nation join region on n_regionkey = r_regionkey")
def places(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat_ws(", ", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "ST"), "r_name")
    return n.select("n_nationkey", text.place_parts(name).alias("p")).select("n_nationkey", "p.city", "p.state", "p.country")


@query("fn17_caption", "select doc_id, length(c) as n, starts_with(c, lang || chr(10) || source) as headed from (select doc_id, lang, source, case when length(text) <= 2000 - length(h) - 1 then h || chr(10) || text else h || chr(10) || rtrim(substr(text, 1, 2000 - length(h) - 2)) || '…' end as c from (select *, lang || chr(10) || source as h from documents where text is not null))")
def caption(t):
    c = text.caption([F.col("lang"), F.col("source")], F.col("text"), 2000)
    return t.documents.where("text is not null").select("doc_id", F.length(c).cast("long").alias("n"), F.startswith(c, F.concat_ws("\n", "lang", "source")).alias("headed"))


@query("fn18_locator", "select p_partkey, p_brand || ' #' || lpad(cast(p_size as varchar), 3, '0') as locator from part")
def locator(t):
    return t.part.select("p_partkey", text.locator(F.col("p_brand"), F.col("p_size")).alias("locator"))


@query("fn19_formats", "select doc_id, n_chars || case when n_chars = 1 then ' char' else ' chars' end as p, case when n_chars < 1024 then n_chars || ' B' else cast(round(n_chars / 1024.0) as bigint) || ' KB' end as b, case when doc_id % 2 = 0 then cast(doc_id as varchar) else doc_id || '–' || (doc_id + 1) end as y from documents")
def formats(t):
    d = F.col("doc_id")
    return t.documents.select("doc_id", text.plural(F.col("n_chars"), "char").alias("p"), text.byte_size(F.col("n_chars")).alias("b"), text.year_span(d, d + d % 2).alias("y"))


@query("fn20_extension", "select p_partkey, case p_partkey % 3 when 0 then 'jpg' when 1 then 'tif' else 'png' end as ext, lpad(cast(p_partkey as varchar), 8, '0') as id8 from part")
def extension(t):
    k = F.col("p_partkey")
    name = F.concat(F.lit("x."), F.when(k % 3 == 0, "JPEG").when(k % 3 == 1, "tiff").otherwise("PNG"))
    return t.part.select("p_partkey", text.normal_extension(name).alias("ext"), text.padded_id(k).alias("id8"))


_PRECISION = "case o_orderkey % 4 when 0 then 'exact' when 1 then 'month' when 2 then 'year' else 'decade' end"
_SPAN = f"(select o_orderkey, d, p, case p when 'decade' then make_date(year(d) // 10 * 10, 1, 1) when 'year' then make_date(year(d), 1, 1) when 'month' then date_trunc('month', d)::date else d end as lo, case p when 'decade' then make_date(year(d) // 10 * 10 + 9, 12, 31) when 'year' then make_date(year(d), 12, 31) when 'month' then last_day(d) else d end as hi from (select o_orderkey, o_orderdate::date as d, {_PRECISION} as p from orders))"


def _dated(t):
    k = F.col("o_orderkey") % 4
    p = F.when(k == 0, "exact").when(k == 1, "month").when(k == 2, "year").otherwise("decade")
    d = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), p.alias("p"))
    return d.withColumn("s", dates.span(F.col("d"), F.col("p"))).select("o_orderkey", "d", "p", "s.lo", "s.hi")


@query("fx1_span", f"select o_orderkey, lo, hi from {_SPAN}")
def span(t):
    return _dated(t).select("o_orderkey", "lo", "hi")


@query("fx2_json_span", "select o_orderkey, case when o_orderkey % 3 <> 1 then o_orderdate::date end as lo from orders")
def json_span(t):
    k = F.col("o_orderkey") % 3
    payload = F.when(k == 0, F.format_string('{"date": "%s"}', F.date_format("o_orderdate", "yyyy-MM-dd"))).when(k == 1, F.lit('{"date": "1995-13-40"}')).otherwise(F.format_string('{"date": "%s", "precision": "exact"}', F.date_format("o_orderdate", "yyyy-MM-dd")))
    return t.orders.select("o_orderkey", dates.json_span(payload).alias("s")).select("o_orderkey", "s.lo")


@query("fx5_labels", f"select o_orderkey, case p when 'decade' then (year(d) // 10 * 10) || 's' when 'year' then cast(year(d) as varchar) when 'month' then strftime(d, '%B %Y') else strftime(d, '%-d %B %Y') end as label from {_SPAN}")
def labels(t):
    return _dated(t).select("o_orderkey", dates.label(F.col("d"), F.col("p")).alias("label"))


@query("fx6_placement", f"select o_orderkey, case when o_orderkey % 5 = 0 then 'Unsorted' when p in ('exact', 'month') then strftime(d, '%Y/%m') when p = 'year' then strftime(d, '%Y') else (year(d) // 10 * 10) || 's' end as path from {_SPAN}")
def placement(t):
    return _dated(t).select("o_orderkey", dates.placement(F.col("d"), F.col("p"), F.col("o_orderkey") % 5 != 0).alias("path"))


@query("fx7_months", "select o_orderkey, strftime(o_orderdate - interval 5 month, '%Y-%m') as earlier, abs((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 6) as apart from orders")
def months(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", dates.shift_month(F.date_format(d, "yyyy-MM"), -5).alias("earlier"), dates.months_apart(d, F.to_date(F.lit("1995-06-01"))).cast("long").alias("apart"))


_HYGIENE = """(select o_orderkey, concat_ws('', case when o_orderkey % 7 = 0 then 'a' end, case when clock is not null and month(clock) = 1 and day(clock) = 1 and hour(clock) = 0 and minute(clock) = 0 then 'b' end, case when o_orderkey % 2 = 0 and abs((year(d) - 1995) * 12 + month(d) - 6) > 3 then 'c' end, case when year(d) < 1826 or d > date '1998-03-02' then 'd' end) as rules
from (select o_orderkey, d, case when o_orderkey % 3 <> 0 then d + to_seconds((o_orderkey % 3 - 1) * 70) end as clock from (select o_orderkey, case when o_orderkey % 97 = 0 then o_orderdate::date - interval 180 year else o_orderdate::date end::date as d from orders)))"""


def _hygiene(t):
    k = F.col("o_orderkey")
    d = F.when(k % 97 == 0, F.add_months(F.col("o_orderdate").cast("date"), -2160)).otherwise(F.col("o_orderdate").cast("date"))
    rows = t.orders.select("o_orderkey", d.alias("d"))
    clock = F.when(k % 3 != 0, F.timestamp_seconds(F.unix_timestamp(F.col("d").cast("timestamp")) + (k % 3 - 1) * 70))
    month = F.when(k % 2 == 0, F.to_date(F.lit("1995-06-01")))
    return rows.select("o_orderkey", dates.hygiene_flags(F.col("d"), clock, month, F.to_date(F.lit("1998-03-02")), k % 7 == 0).alias("f"))


@query("fx8_hygiene", f"select o_orderkey, rules, nullif(substr(rules, 1, 1), '') as first from {_HYGIENE}")
def hygiene(t):
    return _hygiene(t).select("o_orderkey", F.array_join("f", "").alias("rules"), dates.first_rule(F.col("f")).alias("first"))


@query("agg23_rule_hits", f"select rule, count(*) as n from (select unnest(string_split(rules, '')) as rule from {_HYGIENE}) where rule <> '' group by 1")
def rule_hits(t):
    return _hygiene(t).select(F.explode("f").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("fx9_fields", f"select o_orderkey, case when p = 'exact' then d end as day, case when p <> 'decade' then cast(year(d) as int) end as year from {_SPAN}")
def fields(t):
    return _dated(t).select("o_orderkey", dates.date_fields(F.col("d"), F.col("p")).alias("f")).select("o_orderkey", "f.day", "f.year")


@query("fx11_blackout", "select event_id from events where (isodow(ts) <= 5 and hour(ts) * 60 + minute(ts) >= 1350) or (isodow(ts - interval 1 day) <= 5 and hour(ts) * 60 + minute(ts) < 375)")
def blackout(t):
    return t.events.where(dates.WeekWindow.from_spec("mon-fri 22:30-06:15").contains(F.col("ts"))).select("event_id")


@query("fx12_hamming", "select p_partkey, bit_count(xor(p_partkey, 123456789)) + bit_count(xor(p_partkey * 7919, 987654321)) as d from part")
def hamming(t):
    k = F.col("p_partkey")
    a, b = F.array(k, k * 7919), F.array(F.lit(123456789).cast("long"), F.lit(987654321).cast("long"))
    return t.part.select("p_partkey", values.hamming(a, b, 2).cast("long").alias("d"))


@query("fx13_bands", "select p_partkey, cast(i as int) as band, substr(sha256(p_name), cast(4 * i + 1 as int), 4) as value from part, (select unnest(range(16)) as i)")
def bands(t):
    return t.part.select("p_partkey", F.explode(values.bands(F.sha2("p_name", 256))).alias("b")).select("p_partkey", "b.band", "b.value")


@query("fx16_scores", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(least(greatest((l_quantity - 5) / 20, 0), 1) * (1 - least(greatest((l_tax - 0.02) / 0.04, 0), 1)) * least(least(greatest((l_discount - 0) / 0.03, 0), 1), 1 - least(greatest((l_discount - 0.06) / 0.04, 0), 1)), 6) as score from lineitem")
def scores(t):
    s = values.ramp_up(F.col("l_quantity"), 5, 25) * values.ramp_down(F.col("l_tax"), 0.02, 0.06) * values.plateau(F.col("l_discount"), 0.0, 0.03, 0.06, 0.1)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(s, 6).alias("score"))


@query("fx19_cascade", "select l_returnflag, first, rest, count(*) as n from (select l_returnflag, case when c[1] is null then '-' else c[1] end as first, array_to_string(c[2:], '+') as rest from (select l_returnflag, list_filter([case when l_quantity > 40 then 'bulk' end, case when l_discount >= 0.08 then 'cut' end, case when l_tax <= 0.01 then 'free' end], lambda x: x is not null) as c from lineitem)) group by all")
def cascade(t):
    first, rest = values.first_match([(F.col("l_quantity") > 40, "bulk"), (F.col("l_discount") >= 0.08, "cut"), (F.col("l_tax") <= 0.01, "free")])
    return t.lineitem.groupBy("l_returnflag", F.coalesce(first, F.lit("-")).alias("first"), F.array_join(rest, "+").alias("rest")).agg(F.count("*").alias("n"))


@query("fx22_angles", "select p_partkey, round(45 - ((45 - p_size * 7.5) % 90 + 90) % 90, 6) as angle from part")
def angles(t):
    return t.part.select("p_partkey", F.round(values.normal_angle(F.col("p_size") * 7.5), 6).alias("angle"))


@query("fx23_boxes", "select p_partkey, round(case p_size % 8 + 1 when 2 then 1 - x - w when 3 then 1 - x - w when 5 then y when 6 then y when 7 then 1 - y - h when 8 then 1 - y - h else x end, 9) as bx, round(case p_size % 8 + 1 when 3 then 1 - y - h when 4 then 1 - y - h when 5 then x when 6 then 1 - x - w when 7 then 1 - x - w when 8 then x else y end, 9) as by, case when p_size % 8 + 1 >= 5 then h else w end as bw from (select p_partkey, p_size, (p_partkey % 50) / 100.0::double as x, (p_partkey % 30) / 100.0::double as y, 0.25::double as w, 0.5::double as h from part)")
def boxes(t):
    k = F.col("p_partkey")
    b = values.box(k % 50 / 100.0, k % 30 / 100.0, F.lit(0.25), F.lit(0.5))
    s = values.stored_box(b, F.col("p_size") % 8 + 1)
    return t.part.select("p_partkey", F.round(s["x"], 9).alias("bx"), F.round(s["y"], 9).alias("by"), s["w"].alias("bw"))


@query("fx24_child_key", "select l_orderkey, l_partkey, sha256(l_orderkey || ':' || l_partkey) as key from lineitem")
def child_key(t):
    return t.lineitem.select("l_orderkey", "l_partkey", values.child_key(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("key"))


@query("fx25_payload_hash", """select c_custkey, sha256('{"id":' || c_custkey || ',"none":null,"segment":"' || c_mktsegment || '"}') as h from customer""")
def payload_hash(t):
    return t.customer.select("c_custkey", values.payload_hash({"segment": F.col("c_mktsegment"), "id": F.col("c_custkey"), "none": F.lit(None).cast("string")}).alias("h"))


@query("fx26_json_text", "select event_id, case when event_type = 'click' then 'clicked ' || json_extract_string(props, '$.k') when event_type = 'purchase' then 'bought' end as words from events")
def json_text(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", F.when(F.col("event_type") == "click", F.concat(F.lit("clicked "), k)).when(F.col("event_type") == "purchase", "bought").alias("words"))


@query("fx27_json_set", """select event_id, '{"k":"' || json_extract_string(props, '$.k') || '","seen":"' || event_type || '"}' as props from events""")
def json_set(t):
    return t.events.select("event_id", values.json_set(F.col("props"), "seen", F.col("event_type")).alias("props"))


@query("fx28_normalised", "select l_orderkey, l_linenumber, l_partkey, least(greatest(l_quantity / 40, 0.2), 1.0) as q from lineitem")
def normalised(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", values.clamp(F.col("l_quantity") / 40, 0.2, 1.0).alias("q"))


@query("fx29_first_object", "select event_id, props as object from events")
def first_object(t):
    loose = F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n``` and more } text"))
    return t.events.select("event_id", values.first_object(loose).alias("object"))


#: Ways to say a date of the year y, month m and day d, with what is meant; one for each row of part in turn.
_SAID = (
    ("M y", "month"), ("M of y", "month"), ("m/y", "month"), ("y-m", "month"), ("d M y", "exact"), ("dth of M, y", "exact"), ("M d, y", "exact"), ("m/d/y", "exact"), ("y-m-d", "exact"),
    ("y", "year"), ("circa y", "year"), ("y?", "year"), ("around y!", "year"), ("summer y", "season"), ("Winter of y", "season"), ("Christmas y", "feast"), ("xmas of y", "feast"),
    ("the 60s", "60"), ("sixties", "60"), ("20s", "20"), ("in the early 1930s", "30"), ("no idea", "none"), ("M", "none"), ("M 31, y", "last"), ("99999", "none"),
)
_PICK = f"p_partkey % {len(_SAID)}"


def _case(values, otherwise="null"):
    return f"case {_PICK} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values) if v is not None) + f" else {otherwise} end"


def _first(kind, said):
    fixed = {"60": "date '1960-01-01'", "20": "date '2020-01-01'", "30": "date '1930-01-01'", "feast": "make_date(y, 12, 1)", "year": "make_date(y, 1, 1)", "month": "make_date(y, m, 1)", "exact": "make_date(y, m, d)"}
    if kind == "season":
        return f"make_date(y, {7 if said.startswith('summer') else 1}, 1)"
    return "case when day(last_day(make_date(y, m, 1))) = 31 then make_date(y, m, 31) end" if kind == "last" else fixed.get(kind)


_PRECISIONS = {"season": "year", "feast": "month", "60": "decade", "20": "decade", "30": "decade", "last": "exact"}


@query("fx3_free_dates", f"""select p_partkey, meant as date, case when meant is not null then prec end as precision from (select p_partkey, case when y between 1800 and 2100 or {_PICK} in ({', '.join(str(i) for i, (_, k) in enumerate(_SAID) if k in ('60', '20', '30'))}) then {_case([_first(k, s) for s, k in _SAID])} end as meant, {_case([f"'{_PRECISIONS.get(k, k)}'" for _, k in _SAID])} as prec
from (select p_partkey, cast(1790 + p_partkey % 320 as int) as y, cast(1 + p_partkey % 12 as int) as m, cast(1 + p_partkey % 28 as int) as d from part))""")
def free_dates(t):
    k = F.col("p_partkey")
    m = 1 + k % 12
    month = F.get(F.array(*[F.lit(x.capitalize()) for x in dates.MONTHS]), (m - 1).cast("int"))
    values_ = {"y": (1790 + k % 320).cast("string"), "d": (1 + k % 28).cast("string"), "m": m.cast("string"), "M": month}
    pieces = lambda said: [values_[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\b([ydmM])(?=th\b|\b)", said))]
    said = F.lit(None).cast("string")
    for i, (form, _) in enumerate(_SAID):
        said = F.when(k % len(_SAID) == i, F.concat(*pieces(form))).otherwise(said)
    return t.part.select("p_partkey", dates.free_date(said).alias("p")).select("p_partkey", "p.date", "p.precision")


def _sources(t):
    """Documents with a dated span from their id, texts weighted by source and body, and tagged labels as people."""
    day = F.date_add(F.to_date(F.lit("1960-01-01")), (F.col("doc_id") % 15000).cast("int"))
    k = F.col("doc_id") % 3
    p = F.when(k == 0, "exact").when(k == 1, "month").otherwise("year")
    rows = spread(t.documents).select("doc_id", "text", "source", "lang", dates.span(day, p).alias("s"), p.alias("precision")).select("doc_id", "text", "source", "lang", "s.lo", "s.hi", "precision")
    return search.Sources(rows=rows, id="doc_id", weights={"b": "source", "d": "text"}, spans=("lo", "hi", "precision"), fold=False)


_HITS = """with spans as (select doc_id, text, source, case doc_id % 3 when 0 then d when 1 then date_trunc('month', d)::date else make_date(year(d), 1, 1) end as lo, case doc_id % 3 when 0 then d when 1 then last_day(d) else make_date(year(d), 12, 31) end as hi, case doc_id % 3 when 2 then 55 else 75 end as s from (select *, date '1960-01-01' + cast(doc_id % 15000 as int) as d from documents)),
hits as (select doc_id, 0 as ix, case when list_contains(regexp_split_to_array(lower(source), '[^a-z0-9]+'), 'worthless') then 70 when list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'worthless') then 40 end as score from spans union all
select doc_id, 1, case when list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), '1960s') then 40 end from spans union all
select doc_id, 1, s - case when lo >= date '1960-01-01' and hi <= date '1961-12-31' then 0 else 8 end from spans where lo <= date '1961-12-31' and hi >= date '1960-01-01')
select doc_id as row_id, cast(sum(b) as bigint) as score from (select doc_id, ix, max(score) as b from hits where score is not null group by 1, 2) group by 1 having count(*) = 2 order by 2 desc, 1 desc limit 50"""


#: The indexes that this application has built, by what they were built from.
_INDEXES: dict[tuple, Postings] = {}


def build_index(t):
    """The documents with their inverted index, built once for an application and a state of the table."""
    s, path = _sources(t), f"{t.path}/documents.parquet"
    key = (t.spark.sparkContext.applicationId, path, stamp(t.spark, path))
    if key not in _INDEXES:
        _INDEXES[key] = search.indexed(s, f"{graph.shared_folder(t.spark)}/postings-{uuid.uuid4().hex}").postings
    return dataclasses.replace(s, postings=_INDEXES[key])


@query("search_ranked", _HITS)
def ranked(t):
    return search.search(build_index(t), "worthless 1960-1961").select("row_id", "score")


@query("search_scanned", _HITS)
def scanned(t):
    return search.search(_sources(t), "worthless 1960-1961").select("row_id", "score")


@query(
    "fn7_rank_in_class",
    """with w as (select doc_id, 70 as class, unnest(regexp_split_to_array(lower(source), '[^a-z0-9]+')) as w from documents union all select doc_id, 40, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) from documents),
    n as (select doc_id, class, count(*) filter (where w = 'worthless') as a, count(*) filter (where w = 'idiot') as b from w where w in ('worthless', 'idiot') group by 1, 2),
    best as (select doc_id, max(class) as class from n where a > 0 and b > 0 group by 1),
    r as (select n.*, 2 + ln(a) + ln(b) as r from n join best using (doc_id, class))
    select doc_id as row_id, round(class + r / (1 + r) / 9, 9) as score from r order by 2 desc, 1 desc limit 50""",
)
def rank_in_class(t):
    hits = search.index_hits(dataclasses.replace(build_index(t), within=True), [search.Term(0, "worthless idiot")])
    return hits.select("row_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), F.desc("row_id")).limit(50)


@query("fn6_stored_documents", _HITS)
def stored_documents(t):
    s = search.stored(_sources(t))
    return search.search(dataclasses.replace(s, rows=graph.kept_table(s.rows, "documents")), "worthless 1960-1961").select("row_id", "score")


_LABEL = "case doc_id % 3 when 0 then strftime(d, '%-d %B %Y') when 1 then strftime(d, '%B %Y') else cast(year(d) as varchar) end"


@query("search_explained", f"""with spans as (select doc_id, text, source, case doc_id % 3 when 0 then d when 1 then date_trunc('month', d)::date else make_date(year(d), 1, 1) end as lo, case doc_id % 3 when 0 then d when 1 then last_day(d) else make_date(year(d), 12, 31) end as hi, case doc_id % 3 when 2 then 55 else 75 end as s, {_LABEL} as label from (select *, date '1960-01-01' + cast(doc_id % 15000 as int) as d from documents)),
hits as (select *, case when list_contains(regexp_split_to_array(lower(source), '[^a-z0-9]+'), 'worthless') then 70 when list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'worthless') then 40 end as a, s - case when lo >= date '1960-01-01' and hi <= date '1969-12-31' then 0 else 8 end as b from spans where lo <= date '1969-12-31' and hi >= date '1960-01-01'),
page as (select * from hits where a is not null order by a + b desc, doc_id desc limit 20),
cut as (select *, greatest(strpos(lower(text), 'worthless') - 30, 1) as x, least(strpos(lower(text), 'worthless') + 70, length(text) + 1) as y from page)
select doc_id as row_id, cast(a + b as bigint) as score, 'Mentioned in its text (' || case a when 70 then 'b' else 'd' end || '); Dated ' || label as why, case when contains(lower(text), 'worthless') then case when x > 1 then '…' else '' end || trim(substr(text, x, y - x)) || case when y <= length(text) then '…' else '' end end as snippet from cut""")
def explained(t):
    s = build_index(t)
    page = search.search(s, "worthless 1960 to 1969", 20)
    return search.explained(page, s, "worthless 1960 to 1969", "text").select("row_id", "score", F.array_join("why", "; ").alias("why"), "snippet")


@query("search_names", """select o_orderkey as row_id, 80 + max(case when l_returnflag = 'R' then 20 else 50 end) as score, 'Shows Supplier; Mentioned in its text (a)' as why from orders join lineitem on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT' group by 1 order by 2 desc, 1 desc limit 50""")
def names(t):
    people = t.supplier.select(F.col("s_suppkey").alias("id"), F.lower(F.regexp_replace("s_name", "[^A-Za-z]", "")).alias("token"))
    people = graph.kept_table(people.withColumn("key", text.phonetic(F.col("token"))), "names")  # spoken codes are stored with names
    tagged = t.lineitem.select(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("person_id"), (F.col("l_returnflag") == "R").alias("suggested"))
    s = search.Sources(rows=t.orders.select("o_orderkey", F.col("o_orderpriority").alias("text")), id="o_orderkey", weights={"a": "text"}, names=people, tagged=tagged)
    page = search.search(s, "suplier urgent")
    return search.explained(page, s, "suplier urgent").select("row_id", "score", F.array_join("why", "; ").alias("why"))


@query("search_places", """with p as (select c_custkey as id, case c_custkey % 3 when 0 then 100 when 1 then 95 else 90 end as rank from customer where c_mktsegment = 'BUILDING')
select o_orderkey as row_id, cast(88 + rank + case when o_orderstatus = 'P' then -30 else 0 end as bigint) as score, 'Shows Building; Taken at ' || upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) as why
from orders join p on o_custkey = id join customer on c_custkey = id join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE' order by 2 desc, 1 desc limit 60""")
def places_and_kinds(t):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "exact").when(k % 3 == 1, "variant").otherwise("nickname")
    people = t.customer.select(k.alias("id"), F.lower("c_mktsegment").alias("token"), F.lit(None).cast("string").alias("key"), kind.alias("kind"))
    tagged = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("person_id"), (F.col("o_orderstatus") == "P").alias("suggested"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda name, kind: n.select(F.col("n_nationkey").alias("id"), F.lower(name).alias("token"), F.lit(None).cast("string").alias("key"), F.lit(kind).alias("kind"))
    placed = t.orders.join(t.customer, F.col("o_custkey") == k).select(F.col("o_orderkey").alias("row_id"), F.col("c_nationkey").alias("place_id"), F.lit(False).alias("suggested"))
    s = search.Sources(rows=t.orders.select("o_orderkey", F.lit("").alias("text")), id="o_orderkey", weights={"a": "text"}, names=people, tagged=tagged, places=one("n_name", "exact").unionByName(one("r_name", "alias")), placed=placed)
    page = search.search(s, "building europe", 60)
    return search.explained(page, s, "building europe").select("row_id", "score", F.array_join("why", "; ").alias("why"))
