"""Name sources, autocomplete, queues, supersession, regions, activity of recent days, public lists."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import aggregates, graph, joins, merge, paging, predicates, sketches
from ..sources import files
from .registry import query


@query("set2_name_sources", "select distinct id, token from (select c_custkey as id, lower(c_name) as token from customer union all select c_custkey, lower(c_mktsegment) from customer union all select o_custkey, lower(o_orderpriority) from orders) where length(token) >= 7")
def name_sources(t):
    c, o = t.customer, t.orders
    parts = [c.select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("token")), c.select("c_custkey", F.lower("c_mktsegment")), o.select("o_custkey", F.lower("o_orderpriority"))]
    return files.union_all([p.toDF("id", "token") for p in parts]).where(F.length("token") >= 7).distinct()


@query("set3_autocomplete", "select p_partkey as id, min(rank) as rank from (select p_partkey, 0 as rank from part where starts_with(lower(p_type), 'prom') union all select p_partkey, 1 from part where contains(lower(p_type), 'brass') union all select p_partkey, 2 from part where contains(lower(p_name), '17')) group by 1 order by 2, 1 limit 30")
def autocomplete(t):
    p = t.part
    hit = lambda c, r: p.where(c).select(F.col("p_partkey").alias("id"), F.lit(r).alias("rank"))
    u = files.union_all([hit(F.lower("p_type").startswith("prom"), 0), hit(F.lower("p_type").contains("brass"), 1), hit(F.lower("p_name").contains("17"), 2)])
    return u.groupBy("id").agg(F.min("rank").alias("rank")).orderBy("rank", "id").limit(30)


@query("set1_hit_union", "select row_id, layer, count(*) as n from (select l_orderkey as row_id, 'text' as layer from lineitem where l_returnflag = 'R' union all select o_orderkey, 'date' from orders where year(o_orderdate) = 1995 union all select o_orderkey, 'person' from orders where o_custkey < 50) group by 1, 2")
def hit_union(t):
    a = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("row_id"), F.lit("text").alias("layer"))
    b = t.orders.where(F.year("o_orderdate") == 1995).select(F.col("o_orderkey").alias("row_id"), F.lit("date").alias("layer"))
    c = t.orders.where("o_custkey < 50").select(F.col("o_orderkey").alias("row_id"), F.lit("person").alias("layer"))
    return files.union_all([a, b, c]).groupBy("row_id", "layer").agg(F.count("*").alias("n"))


@query("agg1_best_layer", "select row_id, cast(sum(s) as bigint) as score from (select l_orderkey as row_id, l_linenumber as ix, max(case l_returnflag when 'R' then 80 when 'A' then 60 else 40 end) as s from lineitem where l_linenumber <= 2 group by 1, 2) group by 1 having count(*) = 2")
def best_layer(t):
    from .search import scored

    s = F.when(F.col("l_returnflag") == "R", 80).when(F.col("l_returnflag") == "A", 60).otherwise(40)
    hits = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("ix"), F.lit("text").alias("layer"), s.alias("score"), F.col("l_returnflag").alias("detail"))
    return scored(hits, 2).select("row_id", "score")


@query("join6_nearest_hash", "select q_id, r_id, d from (select a.p_partkey as q_id, b.s_suppkey as r_id, bit_count(xor(a.p_partkey * 7919, b.s_suppkey * 7919)) as d, row_number() over (partition by a.p_partkey order by bit_count(xor(a.p_partkey * 7919, b.s_suppkey * 7919)), b.s_suppkey) as n from part a, supplier b) where n = 1 and d <= 3")
def nearest_hash(t):
    q = t.part.select(F.col("p_partkey").alias("q_id"), F.array(F.col("p_partkey") * 7919).alias("x"))
    r = t.supplier.select(F.col("s_suppkey").alias("r_id"), F.array(F.col("s_suppkey") * 7919).alias("y"))
    return joins.nearest_hash_by_bands(q, r, 3).select("q_id", "r_id", F.col("d").cast("long").alias("d"))


@query("join7_exact_then_near", """with known as (select text, n_chars * 7919 as h, doc_id as r from documents where source < 'src2'), q as (select doc_id, text, n_chars * 7919 as h from documents where source >= 'src2'),
e as (select text, min(r) as e from known group by 1), u as (select h, min(r) as r from known group by 1), d as (select doc_id, r, bit_count(xor(q.h, u.h)) as d from q, u), n as (select doc_id, arg_min(r, (d, r)) as near from d where d <= 2 group by 1)
select doc_id, coalesce(e, near) as duplicate_of, case when e is not null then 'exact' when near is not null then 'near' end as how from q left join e using (text) left join n using (doc_id)""")
def exact_then_near(t):
    d = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("sha"), F.array(F.col("n_chars") * 7919).alias("h"))
    known, asked = d.where("source < 'src2'"), d.where("source >= 'src2'")
    exact = known.groupBy("sha").agg(F.min("doc_id").alias("id"))
    near = joins.nearest_hash_by_bands(asked.select(F.col("doc_id").alias("q_id"), F.col("h").alias("x")), known.select(F.col("doc_id").alias("r_id"), F.col("h").alias("y")), 2)
    return joins.exact_then_near(asked.drop("source"), exact, exact.where("false"), near, "doc_id", "sha").select("doc_id", "duplicate_of", "how")


@query("join5_brute_pairs", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_suppkey < b.s_suppkey where bit_count(xor(a.s_suppkey, b.s_suppkey)) <= 2")
def brute_pairs(t):
    h = t.supplier.select("s_suppkey", F.lpad(F.hex("s_suppkey"), 64, "0").alias("h"))
    return graph.brute_pairs(h, "s_suppkey", "h", 2).select("a", "b")


@query("win9_cluster_order", "select l_suppkey, n, cast(row_number() over (order by case when n < 300 then 1 else 0 end, n desc, l_suppkey) as bigint) as place from (select l_suppkey, count(*) as n from lineitem group by 1)")
def cluster_order(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    none = t.spark.createDataFrame([], "place long")
    return merge.next_ids(g, none, "place", [F.col("n") < 300, -F.col("n"), F.col("l_suppkey")], 1).select("l_suppkey", "n", F.col("place").cast("long").alias("place"))


@query("ops11_pairing_decisions", "select l_orderkey, status from (select o_orderkey as l_orderkey, case when o_orderstatus <> 'P' then o_orderstatus when o_orderkey % 2 = 0 then 'accepted' else 'rejected' end as status from orders)")
def pairing_decisions(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    d = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "accepted").otherwise("rejected").alias("status"))
    return merge.decided(rows, d, "o_orderkey", {"status": {"accepted": "accepted", "rejected": "rejected"}})[0].select(F.col("o_orderkey").alias("l_orderkey"), "status")


@query("ops17_bulk_safe", "select event_id from events where event_type = 'click' and json_keys(props) = ['k'] and try_cast(json_extract_string(props, '$.k') as bigint) > 50")
def bulk_safe(t):
    rows = t.events.where(values.json_keys_within(F.col("props"), ["k", "turn"]) & (F.col("event_type") == "click"))
    return rows.where(values.json_number(F.col("props"), "$.k", "long") > 50).select("event_id")


@query("ops18_superseded", "select o_orderkey, case when o_orderstatus in ('O', 'P') and row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) > 1 then 'superseded' else o_orderstatus end as status from orders")
def superseded(t):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus").isin("O", "P") & (n > 1), "superseded").otherwise(F.col("o_orderstatus")).alias("status"))


@query("ops19_region_problems", "with r as (select c_nationkey as k, c_custkey as id, (c_custkey % 90) / 100.0::double as x, (c_custkey % 70) / 100.0::double as y, 0.2::double as w, 0.2::double as h from customer), p as (select a.k, count(*) as n from r a join r b on a.k = b.k and a.id < b.id where greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) > 0.02 * least(a.w * a.h, b.w * b.h) group by 1) select r.k, count(*) < 2 as too_few, bool_or(x + w > 1 or y + h > 1) as outside, coalesce(max(p.n), 0) as overlapping from r left join p on p.k = r.k group by 1")
def region_problems(t):
    c = F.col("c_custkey")
    r = t.customer.select(F.col("c_nationkey").alias("k"), c.alias("id"), values.box(c % 90 / 100.0, c % 70 / 100.0, F.lit(0.2), F.lit(0.2)).alias("b"))
    p = joins.overlapping_pairs(r, "k", "b", 0.02)
    g = r.groupBy("k").agg((F.count("*") < 2).alias("too_few"), F.bool_or((F.col("b.x") + F.col("b.w") > 1) | (F.col("b.y") + F.col("b.h") > 1)).alias("outside"))
    return g.join(p, "k", "left").select("k", "too_few", "outside", F.coalesce("n", F.lit(0)).alias("overlapping"))


@query("set10_merged", "select case when o_custkey = 8 then 7 else o_custkey end as o_custkey, count(*) as n from orders group by 1")
def merged(t):
    faces = t.orders.select("o_orderkey", F.col("o_custkey").alias("person_id"))
    v = t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("variant"))
    return graph.merge_entities(faces, v, 7, 8)[0].groupBy(F.col("person_id").alias("o_custkey")).agg(F.count("*").alias("n"))


@query("api7_selection", "select count(*) as n, round(sum(o_totalprice), 2) as total from orders where year(o_orderdate) = 1994 and o_orderstatus = 'F'")
def selection(t):
    f = predicates.Filters.parse("year=1994")
    chosen = predicates.apply_filters(t.orders, f, predicates.Columns(id="o_orderkey", date="o_orderdate")).where("o_orderstatus = 'F'")
    return chosen.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("api8_gather", "select o_orderkey, c_name, n_name, coalesce(k, 0) as lines from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join (select l_orderkey, count(*) as k from lineitem group by 1) on l_orderkey = o_orderkey where year(o_orderdate) = 1996")
def gather(t):
    rows = t.orders.where(F.year("o_orderdate") == 1996).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(joins.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joins.with_counts(rows, t.lineitem, "o_orderkey", "l_orderkey", {"lines": F.count("*")}, ("lines",)).select("o_orderkey", "c_name", "n_name", "lines")


@query("api10_people", "select c_custkey, c_name, n from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey order by n desc, c_custkey limit 50")
def people(t):
    c = joins.with_counts(t.customer, t.orders, "c_custkey", "o_custkey", {"n": F.count("*")}).where("n is not null")
    return c.select("c_custkey", "c_name", "n").orderBy(F.desc("n"), "c_custkey").limit(50)


@query("api11_unknown", "select o_orderkey, o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') as suggested from orders where o_orderstatus = 'P' and o_orderkey < 40000 order by o_orderkey desc limit 40")
def unknown(t):
    rows = paging.ids_below(t.orders.where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", 40000, 40)
    s = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey").distinct().withColumn("__s", F.lit(True))
    return rows.join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("__s", F.lit(False)).alias("suggested"))


@query("api12_review_queue", "select o_custkey, n, list_has_any(s, ['1-URGENT', '2-HIGH']) as pressing from (select o_custkey, count(*) as n, list(distinct o_orderpriority) as s from orders where o_orderstatus = 'P' group by 1)")
def review_queue(t):
    g = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_set("o_orderpriority").alias("s"))
    return g.select("o_custkey", "n", F.arrays_overlap("s", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("pressing"))


@query("str3_idempotent", "select distinct user_id, event_type from events where (user_id, event_type) not in (select user_id, event_type from events where event_id < 2000) and event_id >= 2000")
def idempotent(t):
    done = t.events.where("event_id < 2000").select("user_id", "event_type")
    return t.events.where("event_id >= 2000").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]).join(done, ["user_id", "event_type"], "left_anti")


@query("str6_resumable", "select event_id, event_type from events where event_type <> 'view' order by case event_type when 'purchase' then 1 when 'click' then 2 else 3 end, event_id")
def resumable(t):
    return t.events.where("event_type <> 'view'").orderBy(paging.priority("event_type", ["purchase", "click"]), "event_id").select("event_id", "event_type")


@query("str22_stale", "select user_id from (select user_id, count(*) as n from events where event_id % 2 = 0 group by 1) where n >= 12 except select user_id from (select user_id, count(*) as n from events group by 1) where n >= 22")
def stale(t):
    was = t.events.where("event_id % 2 = 0").groupBy("user_id").count().where("count >= 12").select("user_id")
    now = t.events.groupBy("user_id").count().where("count >= 22").select("user_id")
    return was.join(now, "user_id", "left_anti")


@query("str23_soft_deleted", "select o_orderkey, o_orderkey % 4 = 0 as is_deleted from orders")
def soft_deleted(t):
    have = t.orders.select("o_orderkey", (F.col("o_orderkey") % 3 == 0).alias("is_deleted"))
    return merge.upsert(have, t.orders.select("o_orderkey", (F.col("o_orderkey") % 4 == 0).alias("is_deleted")), ["o_orderkey"])


@query("fx18_rules", "select doc_id, case when n_chars < 100 then 'tiny' when contains(text, '!!') then 'shout' when contains(text, ' | ') then 'table' end as hint from documents")
def rules(t):
    first, _ = values.first_match([(F.col("n_chars") < 100, "tiny"), (F.col("text").contains("!!"), "shout"), (F.col("text").contains(" | "), "table")])
    return t.documents.select("doc_id", first.alias("hint"))


@query("fx21_levels", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 4) as low, round(quantile_cont(l_extendedprice, 0.5), 4) as mid, round(quantile_cont(l_extendedprice, 0.99), 4) as high from lineitem group by 1")
def levels(t):
    rows = t.lineitem.select("l_returnflag", "l_extendedprice")
    each = [sketches.exact_level(rows, ["l_returnflag"], "l_extendedprice", q).select("l_returnflag", F.round("level", 4).alias(name)) for name, q in (("low", 0.01), ("mid", 0.5), ("high", 0.99))]
    return each[0].join(each[1], "l_returnflag").join(each[2], "l_returnflag")


@query("fx21_sketched")
def sketched_levels(t):
    """Levels and distinct orders of each flag from sketches by day: within their error, see the tests."""
    daily = sketches.sketched(t.lineitem.select("l_returnflag", F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_extendedprice"), ["l_returnflag", "day"], ["l_orderkey"], ["l_extendedprice"])
    q = lambda p: sketches.level("kll_l_extendedprice", p)
    return sketches.merged(daily, ["l_returnflag"]).select("l_returnflag", "n", sketches.distinct_count("hll_l_orderkey").alias("orders"), q(0.01).alias("low"), q(0.5).alias("mid"), q(0.99).alias("high"))


@query("src18_ordered_dump", "select c_custkey, c_name from customer order by c_custkey")
def ordered_dump(t):
    return t.customer.select("c_custkey", "c_name").orderBy("c_custkey")


@query("agg5_open_by_day", "select ts::date as day, event_type, count(*) as n from events group by 1, 2")
def open_by_day(t):
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("agg9_labels", "select l_orderkey, string_agg(distinct l_returnflag, ' / ' order by l_returnflag) as flags from lineitem group by 1")
def flags(t):
    return t.lineitem.groupBy("l_orderkey").agg(aggregates.joined_distinct("l_returnflag", " / ").alias("flags"))
