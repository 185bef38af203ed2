"""Joins, aggregates and windows over orders, events, parts and lines."""

from pyspark.sql import functions as F

from ..operators import aggregates, intervals, joins, windows
from .registry import query


@query("join1_exact_or_alike", "with names as (select s_suppkey as id, lower(s_name) as token, substr(s_name, 1, 12) as key from supplier), terms as (select cast(row_number() over (order by s_suppkey) - 1 as int) as ix, lower(s_name) as term, substr(s_name, 1, 12) as key from supplier where s_suppkey in (3, 44, 71)), hits as (select ix, id, token, 100 as rank from names join terms on token = term union all select ix, id, token, 50 from names join terms using (key) where substr(token, 1, 4) = substr(term, 1, 4)) select ix, id, token, rank from (select *, row_number() over (partition by ix, id order by rank desc, token) as n from hits) where n = 1")
def exact_or_alike(t):
    names = t.supplier.select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("token"), F.substring("s_name", 1, 12).alias("key"))
    ix = F.when(F.col("s_suppkey") == 3, 0).when(F.col("s_suppkey") == 44, 1).otherwise(2)
    terms = t.supplier.where("s_suppkey in (3, 44, 71)").select(ix.alias("ix"), F.lower("s_name").alias("term"), F.substring("s_name", 1, 12).alias("key"))
    return joins.exact_or_alike(terms, names)


_SPANS = "(select 0 as ix, date '1993-02-10' as q_lo, date '1993-02-20' as q_hi union all select 1, null, date '1992-01-15' union all select 2, date '1998-07-01', null)"
_ROWS = "(select o_orderkey, case when o_orderkey % 4 = 0 then cast(date_trunc('month', o_orderdate) as date) else cast(o_orderdate as date) end as lo, case when o_orderkey % 4 = 0 then last_day(o_orderdate) else cast(o_orderdate as date) end as hi from orders)"


def _dated(t):
    month, d = F.col("o_orderkey") % 4 == 0, F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.when(month, F.trunc(d, "month")).otherwise(d).alias("lo"), F.when(month, F.last_day(d)).otherwise(d).alias("hi"))


@query("join3_interval_overlap", f"select o_orderkey, ix, case when (q_lo is null or lo >= q_lo) and (q_hi is null or hi <= q_hi) then 75 else 67 end as score from {_ROWS} join {_SPANS} on (q_hi is null or lo <= q_hi) and (q_lo is null or hi >= q_lo)")
def interval_overlap(t):
    spans = t.spark.sql("select 0 as ix, date '1993-02-10' as q_lo, date '1993-02-20' as q_hi union all select 1, null, date '1992-01-15' union all select 2, date '1998-07-01', null")
    return joins.in_span(_dated(t), "lo", "hi", spans).select("o_orderkey", "ix", "score")


@query("join3_many_intervals", f"select event_id, count(*) as n from {_ROWS} join (select event_id, cast(to_days(cast(event_id % 2400 as int)) + timestamp '1992-01-01' as date) as q_lo, cast(to_days(cast(event_id % 2400 + event_id % 30 as int)) + timestamp '1992-01-01' as date) as q_hi from events) on lo <= q_hi and hi >= q_lo group by 1")
def many_intervals(t):
    d = lambda n: F.date_add(F.to_date(F.lit("1992-01-01")), n.cast("int"))
    e = F.col("event_id")
    spans = t.events.select("event_id", d(e % 2400).alias("q_lo"), d(e % 2400 + e % 30).alias("q_hi"))
    return intervals.overlap_counts(_dated(t), "lo", "hi", spans).groupBy("event_id").agg(F.sum("n").alias("n"))


@query("join10_predecessor", "select l_orderkey, l_linenumber, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as front from lineitem")
def predecessor(t):
    return windows.predecessor(t.lineitem, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "l_partkey").select("l_orderkey", "l_linenumber", "front")


@query("join11_pairings", "with r as (select l_orderkey, l_linenumber, l_tax * 10 + l_discount * 5 as score, l_quantity as aspect, lag(l_linenumber) over w as front, lag(l_tax * 10 + l_discount * 5) over w as ps, lag(l_quantity) over w as pa, l_returnflag from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)) select l_orderkey, l_linenumber as back, front, round(score, 6) as score from r where score >= 0.6 and front is not null and ps < 0.6 and (abs(aspect - pa) / greatest(aspect, pa) <= 0.15 or score >= 0.8) and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')")
def pairings(t):
    score = F.col("l_tax") * 10 + F.col("l_discount") * 5
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    rows = t.lineitem.withColumns({"score": score, "aspect": F.col("l_quantity")})
    out = joins.pairing_proposals(rows, ["l_orderkey"], order, "l_linenumber", "score", "aspect", [])
    p = t.orders.where("o_orderstatus = 'P'").select("o_orderkey")
    return out.join(p, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").withColumn("score", F.round("score", 6))


@query("join12_counts", "select c_custkey, coalesce(n, 0) as n, first_date, last_date from customer left join (select o_custkey, count(*) as n, min(o_orderdate) as first_date, max(o_orderdate) as last_date from orders group by 1) on o_custkey = c_custkey")
def counts(t):
    agg = {"n": F.count("*"), "first_date": F.min("o_orderdate"), "last_date": F.max("o_orderdate")}
    return joins.with_counts(t.customer, t.orders, "c_custkey", "o_custkey", agg, ("n",)).select("c_custkey", "n", "first_date", "last_date")


@query("join13_latest", "select c_custkey, k as o_orderkey, s as o_orderstatus from customer left join (select o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as k, arg_max(o_orderstatus, (o_totalprice, o_orderkey)) as s from orders group by 1) on o_custkey = c_custkey")
def latest(t):
    j = joins.with_latest(t.customer, t.orders, "c_custkey", "o_custkey", ["o_orderkey", "o_orderstatus"], [F.col("o_totalprice"), F.col("o_orderkey")])
    return j.select("c_custkey", "latest.o_orderkey", "latest.o_orderstatus")


@query("join14_by_popularity", "select p_partkey, coalesce(n, 0) as n from part left join (select l_partkey, count(*) as n from lineitem group by 1) on l_partkey = p_partkey order by 2 desc, 1 desc limit 40")
def by_popularity(t):
    return joins.with_counts(t.part, t.lineitem, "p_partkey", "l_partkey", {"n": F.count("*")}, ("n",)).select("p_partkey", "n").orderBy(F.desc("n"), F.desc("p_partkey")).limit(40)


@query("join16_lookups", "select event_id, k, p_brand from (select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) left join part on p_partkey = k")
def lookups(t):
    e = t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))
    return e.join(t.part.select("p_partkey", "p_brand"), F.col("k") == F.col("p_partkey"), "left").select("event_id", "k", "p_brand")


@query("join17_details", "select o_orderkey, coalesce(parts, '') as parts, coalesce(n, 0) as n from orders left join (select l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey) as parts, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey")
def details(t):
    j = joins.with_children(t.orders, "o_orderkey", {"lines": (t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey"])})
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return j.select("o_orderkey", F.coalesce(text, F.lit("")).alias("parts"), F.coalesce(F.array_size("lines"), F.lit(0)).cast("long").alias("n"))


@query("join18_relatives", "with e as (select o_custkey as a, o_orderkey + 10000000 as b, 'parent' as type from orders union all select c_custkey, c_custkey + 20000000, 'spouse' from customer), p as (select a, b from e where type = 'parent') select b as id, a as other, 'parent' as kind from p union select a, b, 'child' from p union select a, b, 'spouse' from e where type = 'spouse' union select b, a, 'spouse' from e where type = 'spouse' union select x.b, y.b, 'sibling' from p x join p y on x.a = y.a and x.b <> y.b")
def relatives(t):
    e = t.orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + 10000000).alias("b"), F.lit("parent").alias("type"))
    s = t.customer.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 20000000).alias("b"), F.lit("spouse").alias("type"))
    return joins.relatives(e.unionByName(s))


@query("join20_integrity", "select o_orderkey from orders where o_orderdate > timestamp '1998-01-01' and o_orderkey not in (select l_orderkey from lineitem where l_linenumber > 1)")
def integrity(t):
    return joins.unfulfilled(t.orders.where("o_orderdate > timestamp '1998-01-01'"), t.lineitem.where("l_linenumber > 1"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("agg2_attention", "select count(*) filter (where o_orderstatus = 'P') as partial, count(*) filter (where o_totalprice > 200000) as dear, count(*) filter (where o_orderpriority = '5-LOW' and o_orderstatus = 'O') as low_open from orders")
def attention(t):
    return t.orders.agg(*aggregates.count_where({"partial": F.col("o_orderstatus") == "P", "dear": F.col("o_totalprice") > 200000, "low_open": (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O")}))


@query("agg3_monthly_activity", "with b as (select min(date_trunc('month', ts)) as m from events) select user_id, count(*) filter (where event_type in ('click', 'view')) as looks, count(*) filter (where event_type = 'purchase') as buys, coalesce(sum(try_cast(json_extract_string(props, '$.k') as bigint)), 0)::bigint as k_sum from events, b where ts >= m and ts < m + interval 1 month group by 1 having count(*) filter (where event_type in ('click', 'view', 'purchase')) > 0")
def monthly_activity(t):
    month = t.events.agg(F.date_format(F.min("ts"), "yyyy-MM")).first()[0]
    k = F.coalesce(F.sum(F.try_variant_get(F.try_parse_json("props"), "$.k", "long")), F.lit(0))
    return aggregates.activity(t.events, "user_id", "event_type", "ts", month, {"looks": ["click", "view"], "buys": ["purchase"]}, {"k_sum": k})


@query("agg4_totals", "select (select count(*) from orders where o_orderstatus = 'F') as done, (select count(distinct user_id) from events) as users, (select max(l_quantity) from lineitem) as most, (select count(*) from part) as parts")
def totals(t):
    return aggregates.totals({"done": (t.orders.where("o_orderstatus = 'F'"), F.count("*")), "users": (t.events, F.count_distinct("user_id")), "most": (t.lineitem, F.max("l_quantity")), "parts": (t.part, F.count("*"))})


@query("agg5_by_kind_and_source", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
def by_kind(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("agg6_facets", "select 'status' as facet, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'decade', cast(cast(floor(year(o_orderdate) / 10) * 10 as int) as varchar), count(*) from orders group by 2 union all select 'priority', o_orderpriority, count(*) from orders group by 2")
def facets(t):
    return aggregates.facets(t.orders, {"status": F.col("o_orderstatus"), "decade": aggregates.decade(F.col("o_orderdate")), "priority": F.col("o_orderpriority")})


@query("agg7_distinct", "select l_suppkey, count(distinct l_orderkey) as orders, min(year(l_shipdate)) as first_year, max(year(l_shipdate)) as last_year from lineitem group by 1")
def distinct(t):
    y = F.year("l_shipdate").cast("long")
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.min(y).alias("first_year"), F.max(y).alias("last_year"))


@query("agg8_cover", "select l_orderkey, arg_min(l_partkey, (case when l_linenumber % 2 = 0 then l_linenumber else 1000 end, -l_partkey)) as cover from lineitem group by 1")
def cover(t):
    position = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber"))
    return t.lineitem.groupBy("l_orderkey").agg(aggregates.first_by("l_partkey", [position.isNull(), position, -F.col("l_partkey")]).alias("cover"))


@query("agg9_joined", "select o_custkey, string_agg(distinct o_orderpriority, ' / ' order by o_orderpriority) as priorities from orders group by 1")
def joined(t):
    return t.orders.groupBy("o_custkey").agg(aggregates.joined_distinct("o_orderpriority", " / ").alias("priorities"))


@query("agg10_json", """select l_orderkey, '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ',' order by l_linenumber, l_partkey) || ']' as lines from lineitem group by 1""")
def as_json(t):
    return t.lineitem.groupBy("l_orderkey").agg(aggregates.as_json(["l_linenumber", "l_partkey"]).alias("lines"))


@query("agg11_any_and_latest", "select l_orderkey, bool_or(l_returnflag = 'R') as returned, max(l_shipdate) as latest, count(*) filter (where l_quantity > 40) as large from lineitem group by 1")
def any_and_latest(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.max("l_shipdate").alias("latest"), F.count_if(F.col("l_quantity") > 40).alias("large"))


@query("agg12_roll_up", "select l_orderkey, case when a + r = 0 then 'pending' when a + r < n then 'partial' when a = 0 then 'rejected' else 'approved' end as status from (select l_orderkey, count(*) as n, count(*) filter (where l_returnflag = 'A') as a, count(*) filter (where l_returnflag = 'R') as r from lineitem group by 1)")
def roll_up(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), *aggregates.count_where({"a": F.col("l_returnflag") == "A", "r": F.col("l_returnflag") == "R"}))
    return g.select("l_orderkey", aggregates.status_of(F.col("n"), F.col("a"), F.col("r")).alias("status"))


@query("agg13_completeness", "select c_custkey, cast(case when c_acctbal > 0 then 40 else 0 end + case when c_custkey in (select o_custkey from orders) then 40 else 0 end + case when c_custkey in (select o_custkey from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R') then 20 else 0 end as int) as score from customer")
def completeness(t):
    returned = t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey")
    return aggregates.weighted_flags(t.customer, "c_custkey", {"balance": (F.col("c_acctbal") > 0, 40), "orders": (t.orders.select("o_custkey"), 40), "returns": (returned, 20)}).select("c_custkey", "score")


@query("agg14_members", "select n_nationkey, coalesce(c, 0) as customers, coalesce(s, 0) as suppliers from nation left join (select c_nationkey, count(*) as c from customer group by 1) on c_nationkey = n_nationkey left join (select s_nationkey, count(*) as s from supplier group by 1) on s_nationkey = n_nationkey")
def members(t):
    a = joins.with_counts(t.nation, t.customer, "n_nationkey", "c_nationkey", {"customers": F.count("*")}, ("customers",))
    return joins.with_counts(a, t.supplier, "n_nationkey", "s_nationkey", {"suppliers": F.count("*")}, ("suppliers",)).select("n_nationkey", "customers", "suppliers")


@query("agg15_progress", "select 'open' as job, (select count(*) from orders where o_orderstatus = 'O') as eligible, (select count(*) from orders where o_orderstatus = 'O' and o_orderkey % 2 = 0) as done union all select 'parts', (select count(*) from part), 0")
def progress(t):
    o = t.orders.where("o_orderstatus = 'O'")
    done = o.where("o_orderkey % 2 = 0").select(F.lit("open").alias("job"), F.col("o_orderkey").alias("id"))
    return aggregates.progress({"open": o, "parts": t.part}, done)


@query("agg16_keys", "select k as key, count(*) as n from (select unnest(json_keys(props)) as k from events where props is not null) group by 1")
def keys(t):
    return aggregates.key_frequency(t.events, "props")


@query("agg17_reasons", "select coalesce(case when o_totalprice < 50000 then 'cheap' when o_orderstatus = 'P' then 'partial' end, 'none') as reason, count(*) as n from orders group by 1")
def reason_counts(t):
    why = F.when(F.col("o_totalprice") < 50000, "cheap").when(F.col("o_orderstatus") == "P", "partial")
    return t.orders.groupBy(F.coalesce(why, F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("agg18_distribution", "select lang, quality, count(*) as n from documents join labels using (doc_id) group by 1, 2")
def distribution(t):
    return t.documents.join(t.labels, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))


@query("agg19_spend", "select l_returnflag, cast(sum(cast(coalesce(case when l_linenumber % 2 = 0 then l_tax end, l_discount) as decimal(10, 4))) as decimal(38, 4)) as spent from lineitem where l_linestatus <> 'O' group by 1")
def spend(t):
    v = F.coalesce(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")), F.col("l_discount")).cast("decimal(10,4)")
    return t.lineitem.where("l_linestatus <> 'O'").groupBy("l_returnflag").agg(F.sum(v).cast("decimal(38,4)").alias("spent"))


@query("agg20_status", 'select \'orders\' as "table", count(*) as n, max(o_orderdate)::timestamp as latest from orders union all select \'lineitem\', count(*), max(l_shipdate)::timestamp from lineitem union all select \'events\', count(*), max(ts)::timestamp from events')
def table_status(t):
    return aggregates.table_status({"orders": (t.orders, "o_orderdate"), "lineitem": (t.lineitem, "l_shipdate"), "events": (t.events, "ts")})


@query("agg21_at_least", "select cast(b as double) as bound, count(*) filter (where n >= b) as n from (select l_orderkey, count(*) as n from lineitem group by 1), (select unnest([1, 2, 4, 6, 7]) as b) group by b")
def at_least(t):
    return aggregates.at_least(t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")), "n", [1, 2, 4, 6, 7])


@query("agg22_histogram", "select cast(floor(l_quantity / 5.0) as bigint) as bucket, count(*) as n from lineitem group by 1")
def histogram(t):
    return aggregates.histogram(t.lineitem, F.col("l_quantity"), 5.0)


@query("agg26_estimate", "select count(*) as n, count(*) filter (where size is null) as missing, cast(sum(coalesce(size, 0)) as bigint) as bytes, cast(sum(coalesce(size, 0) * copies) as bigint) as bytes_with_copies from (select case when doc_id % 7 <> 0 then n_chars end as size, 1 + doc_id % 3 as copies from documents)")
def estimate(t):
    d = t.documents.withColumn("size", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")))
    return aggregates.size_estimate(d, "size", 1 + F.col("doc_id") % 3)


@query("win1_accept_newest", "select o_orderkey, case when row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 then 'accepted' else 'superseded' end as decision from orders")
def accept_newest(t):
    return windows.accepted_or_superseded(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "decision")


@query("win2_with_total", "select o_orderkey, (select count(*) from orders where o_orderstatus = 'P') as total from orders where o_orderstatus = 'P' order by o_orderkey limit 50")
def with_total(t):
    return aggregates.with_total(t.orders.where("o_orderstatus = 'P'")).select("o_orderkey", "total").orderBy("o_orderkey").limit(50)


@query("win3_first_per", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1")
def first_per(t):
    return windows.first_per(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("win6_keeper", "select l_orderkey, arg_max(l_linenumber, (l_quantity, l_extendedprice, -l_linenumber)) as keeper from lineitem group by 1")
def keeper(t):
    return windows.keeper(t.lineitem, "l_orderkey", "l_linenumber", [F.col("l_quantity"), F.col("l_extendedprice")])


@query("win7_reasons", """with v as (select l_orderkey as k, l_linenumber as id, (l_returnflag = 'R')::int as r, l_quantity as q, l_tax as t, (l_linestatus = 'O')::int as o from lineitem),
b as (select k, arg_max(id, (r, q, t, o, -id)) as keeper, count(*) as n from v group by 1),
g as (select k, keeper, n, max(r) filter (where id = keeper) as mr, min(r) filter (where id <> keeper) as lr, max(q) filter (where id = keeper) as mq, max(q) filter (where id <> keeper) as hq, max(t) filter (where id = keeper) as mt, max(t) filter (where id <> keeper) as ht, max(o) filter (where id = keeper) as mo, min(o) filter (where id <> keeper) as lo from v join b using (k) group by 1, 2, 3),
c as (select *, concat_ws(' > ', case when mr > 0 and lr <= 0 then 'returned' end, case when mq > hq and hq > 0 then printf('%.1f', round_even(mq / hq, 1)) || 'x quantity' when mq > hq then 'has quantity' end, case when mt > ht and ht > 0 then printf('%.1f', round_even(mt / ht, 1)) || 'x tax' when mt > ht then 'has tax' end) as chain from g)
select k as l_orderkey, keeper, case when n = 1 then 'only member' when chain <> '' then chain when mo > 0 and lo <= 0 then 'open' else 'lower id' end as reasons from c""")
def reasons(t):
    rows = t.lineitem.withColumns({"r": (F.col("l_returnflag") == "R").cast("int"), "o": (F.col("l_linestatus") == "O").cast("int")})
    return windows.reasons(rows, "l_orderkey", "l_linenumber", {"returned": "r"}, {"quantity": "l_quantity", "tax": "l_tax"}, {"open": "o"})


@query("win10_reading_order", "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by round_even(l_quantity / 10, 0), l_extendedprice, l_linenumber) as n from lineitem")
def reading_order(t):
    return windows.numbered(t.lineitem, ["l_orderkey"], [F.bround(F.col("l_quantity") / 10, 0), F.col("l_extendedprice"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", F.col("n").cast("long").alias("n"))


@query("win11_left_to_right", "select l_orderkey, string_agg(cast(l_suppkey as varchar), ' ' order by x, l_suppkey) as people from (select l_orderkey, l_suppkey, min(l_extendedprice) as x from lineitem group by 1, 2) group by 1")
def left_to_right(t):
    g = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_extendedprice").alias("x"))
    people = F.transform(F.array_sort(F.collect_list(F.struct("x", "l_suppkey"))), lambda s: s["l_suppkey"].cast("string"))
    return g.groupBy("l_orderkey").agg(F.array_join(people, " ").alias("people"))


@query("win12_numbering", "select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as n from conversations")
def numbering(t):
    return windows.numbered(t.conversations, ["conv_id", "role"], [F.col("turn")]).select("conv_id", "turn", "role", F.col("n").cast("long").alias("n"))


@query("win13_batches", "select conv_id, count(*) as n, string_agg(role, ',' order by turn) as roles from conversations group by 1")
def batches(t):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(roles, ",").alias("roles"))


@query("src2_scan_order", "select p_partkey, span = 0 as fallback, row_number() over (partition by p_brand order by case when span <> 0 then p_size end, p_partkey) as n from (select *, max(p_size) over (partition by p_brand) - min(p_size) over (partition by p_brand) as span from part)")
def scan_order(t):
    rows = t.part.select("p_partkey", "p_brand", F.timestamp_seconds(F.col("p_size")).alias("at"), F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.lit(".JPG")).alias("name"))
    return windows.scan_order(rows, "p_brand", "name", "at").select("p_partkey", "fallback", F.col("sequence").cast("long").alias("n"))


@query("src3_renumbered", "select l_orderkey, l_linenumber, l_linenumber as old, cast(n as int) as new from (select *, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber) as n from lineitem) where n <> l_linenumber")
def renumbered(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_linenumber").alias("current"))
    return windows.renumbered(rows, ["l_orderkey"], [F.col("l_shipdate"), F.col("l_linenumber")], "current", "l_linenumber")


@query("ops1_trailing_hour", "select event_id, count(*) over (partition by user_id order by epoch(ts)::bigint range between 3600 preceding and current row) as n_recent from events")
def trailing_hour(t):
    return windows.trailing_count(t.events, "user_id", "ts", 3600).select("event_id", "n_recent")


@query("ops2_tumbling", "select user_id, to_timestamp(floor(epoch(ts) / 900) * 900)::timestamp as start, count(*) as n, count(*) > 1 as over from events group by 1, 2")
def tumbling(t):
    return windows.tumbling(t.events, "user_id", "ts", "15 minutes", 1).withColumn("start", F.col("start").cast("timestamp"))


@query("ops6_filmstrip", "select a.conv_id, a.turn, string_agg(b.role, ',' order by b.turn) as near from conversations a join conversations b on a.conv_id = b.conv_id and b.turn between a.turn - 2 and a.turn + 2 group by 1, 2")
def filmstrip(t):
    return windows.around(t.conversations, ["conv_id"], "turn", 2, "role").select("conv_id", "turn", F.array_join("near", ",").alias("near"))


@query("ops16_stratified", "select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by r) as k from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as r, count(*) over (partition by o_orderpriority) as n from orders) where (r - 1) % greatest(n // 10, 1) = 0) where k <= 10 order by k, o_orderpriority limit 35")
def stratified(t):
    return windows.stratified(t.orders, "o_orderpriority", "o_orderkey", 10, 35).select("o_orderkey", "o_orderpriority")


@query("fn15_unique_labels", "with a as (select c_custkey, case when count(*) over (partition by lower(c_mktsegment || c_nationkey)) > 1 then c_mktsegment || c_nationkey || ' (b. ' || c_custkey % 40 || ')' else c_mktsegment || c_nationkey end as l from customer) select c_custkey, case when count(*) over (partition by lower(l)) > 1 then l || ' #' || c_custkey else l end as label from a")
def unique_labels(t):
    c = t.customer.select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), (F.col("c_custkey") % 40).alias("year"))
    return aggregates.unique_labels(c, "name", "year", "c_custkey").select("c_custkey", "label")
