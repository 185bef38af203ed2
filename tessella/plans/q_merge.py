"""Merges, replays, states, duplicates, vectors, exports."""

import uuid

from pyspark.sql import functions as F

from ..functions import values
from ..operators import aggregates, cluster, deltas, graph, joins, merge, versions
from ..session import spread
from ..sources import files
from .registry import query


def _sides(t):
    """Two versions of orders: ours misses every seventh, theirs has every third with another status and edit time."""
    o = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("edited"))
    ours = o.where("o_orderkey % 7 <> 0")
    move = F.expr("make_interval(0, 0, 0, cast(o_orderkey % 5 - 2 as int))")
    theirs = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 4 != 0, F.col("edited") + move).alias("edited"))
    return ours, theirs


_SIDES = "ours as (select o_orderkey, o_orderstatus, o_orderdate::timestamp as edited from orders where o_orderkey % 7 <> 0), theirs as (select o_orderkey, 'X' as o_orderstatus, case when o_orderkey % 4 <> 0 then o_orderdate::timestamp + to_days(cast(o_orderkey % 5 - 2 as int)) end as edited from orders where o_orderkey % 3 = 0)"


@query("fx10_wins", f"with {_SIDES} select a.o_orderkey, b.edited is not null and (a.edited is null or b.edited >= a.edited) as wins from ours a join theirs b on a.o_orderkey = b.o_orderkey")
def wins(t):
    a, b = _sides(t)
    j = a.select("o_orderkey", F.col("edited").alias("mine")).join(b.select("o_orderkey", F.col("edited").alias("yours")), "o_orderkey")
    return j.select("o_orderkey", merge.incoming_wins(F.col("yours"), F.col("mine")).alias("wins"))


@query("str11_guarded_upsert", f"with {_SIDES} select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null then a.o_orderstatus when a.o_orderkey is null or (b.edited is not null and b.edited >= a.edited) then 'X' else a.o_orderstatus end as o_orderstatus, case when b.o_orderkey is null then a.edited when a.o_orderkey is null or (b.edited is not null and b.edited >= a.edited) then b.edited else a.edited end as edited from ours a full join theirs b on a.o_orderkey = b.o_orderkey")
def guarded_upsert(t):
    return merge.upsert(*_sides(t), ["o_orderkey"], guarded={"o_orderstatus": "edited"})


@query("str12_upsert", f"with {_SIDES} select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) as o_orderstatus from ours a full join theirs b on a.o_orderkey = b.o_orderkey")
def upsert(t):
    return merge.upsert(*_sides(t), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("str13_older_ignored", f"with {_SIDES} select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.o_orderkey is null or (a.o_orderkey is not null and not coalesce(b.edited >= a.edited, false)) then a.o_orderstatus else 'X' end as o_orderstatus from ours a full join theirs b on a.o_orderkey = b.o_orderkey")
def older_ignored(t):
    return merge.upsert(*_sides(t), ["o_orderkey"], newer="edited").select("o_orderkey", "o_orderstatus")


@query("str14_sticky", "select o_orderkey, case when o_orderstatus <> 'O' and o_orderkey % 2 = 0 then o_orderstatus when o_orderkey % 2 = 0 then 'O' else o_orderstatus end as o_orderstatus from orders")
def sticky(t):
    o = t.orders.select("o_orderkey", "o_orderstatus")
    return merge.sticky(o, o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("O")), "o_orderkey", "o_orderstatus", "O")


@query("str5_latest", "select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as o_orderstatus from orders group by 1")
def latest(t):
    return merge.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("set4_reconcile", "with s as (select distinct o_custkey as k, o_orderpriority as v, o_orderpriority < '3' as d from orders where o_custkey % 3 <> 0), l as (select distinct o_custkey as k, upper(o_orderpriority) as v from orders where o_orderstatus = 'F' and o_custkey % 2 = 0) select coalesce(s.k, l.k) as k, coalesce(s.v, l.v) as v, case when coalesce(s.k, l.k) in (select k from l) then l.v is null else d end as is_deleted from s full join l on s.k = l.k and lower(s.v) = lower(l.v)")
def reconcile(t):
    s = t.orders.where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), (F.col("o_orderpriority") < "3").alias("is_deleted")).distinct()
    live = t.orders.where("o_orderstatus = 'F' and o_custkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.upper("o_orderpriority").alias("v")).distinct()
    return merge.reconcile(s, live, "k", "v")


@query("str9_since", "select event_id, ts from events where ts > timestamp '2024-01-10' or (ts = timestamp '2024-01-10' and event_id > 5) order by ts, event_id limit 200")
def since(t):
    return merge.changes_since(t.events.select("event_id", "ts"), "ts", "event_id", ("2024-01-10 00:00:00", 5), 200)


@query("str15_replay", "with f as (select event_id, user_id, event_type, value, case event_type when 'click' then 'look' when 'view' then 'look' when 'purchase' then 'buy' end as family from events) select user_id as entity, family, arg_max(event_type, event_id) as action, arg_max(value, event_id) as value from f where family is not null group by 1, 2")
def replay(t):
    return merge.replay(t.events, "user_id", "event_type", "value", "event_id", {"click": "look", "view": "look", "purchase": "buy"})


_NEW = "replace(p_type, 'A', 'Å')"


@query("str17_correction_log", f"select 'b1' as batch_id, p_partkey as entity_id, p_type as previous, {_NEW} as new from part where {_NEW} <> p_type")
def correction_log(t):
    return merge.correct(t.part, "p_partkey", "p_type", F.replace("p_type", F.lit("A"), F.lit("Å")), "b1")[1]


@query("str16_undo", f"select p_partkey, case when p_partkey % 11 = 0 then 'again' else p_type end as p_type, contains(p_type, 'A') and p_partkey % 11 = 0 as skipped from part")
def undo(t):
    new, log = merge.correct(t.part.select("p_partkey", "p_type"), "p_partkey", "p_type", F.replace("p_type", F.lit("A"), F.lit("Å")), "b1")
    edited = new.withColumn("p_type", F.when(F.col("p_partkey") % 11 == 0, "again").otherwise(F.col("p_type")))
    back, skipped = merge.undo(edited, log, "p_partkey", "p_type")
    s = skipped.select(F.col("entity_id").alias("p_partkey"), F.lit(True).alias("s"))
    return back.join(s, "p_partkey", "left").select("p_partkey", "p_type", F.coalesce("s", F.lit(False)).alias("skipped"))


@query("str18_batches", "select 'b' || p_size % 4 as batch_id, count(*) as n, p_size % 4 = 2 as undone from part group by 1, 3")
def batches(t):
    log = t.part.select(F.concat(F.lit("b"), (F.col("p_size") % 4).cast("string")).alias("batch_id"))
    return merge.batches(log, log.where("batch_id = 'b2'"))


@query("str19_touched", "select o_orderkey from orders where o_orderkey % 9 = 0 or o_orderkey % 13 = 0")
def touched(t):
    old = t.orders.where("o_orderkey % 13 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    return merge.touched(old, new, "o_orderkey", ["o_orderstatus"])


@query("str20_refreshed", "select o_custkey, count(*) as n, sum(case when o_orderkey % 9 = 0 then 1 else 0 end)::bigint as z from orders group by 1")
def refreshed(t):
    view = lambda o: o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("s") == "Z", 1).otherwise(0)).alias("z"))
    old = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("s"))
    new = old.withColumn("s", F.when(F.col("o_orderkey") % 9 == 0, "Z").otherwise(F.col("s")))
    keys = merge.touched(old, new, "o_orderkey", ["s"]).join(new, "o_orderkey").select("o_custkey").distinct()
    return merge.refreshed(view(old), keys, view(new.join(keys, "o_custkey", "left_semi")), "o_custkey")


@query("str24_reordered", "select conv_id, turn, n as new_position from (select conv_id, turn, position, row_number() over (partition by conv_id order by case when turn = 1 then 0 end nulls last, position, turn) as n from (select conv_id, turn, turn + 1 as position from conversations)) where position <> n")
def reordered(t):
    items = t.conversations.select("conv_id", "turn", (F.col("turn") + 1).alias("position"))
    wanted = t.spark.sql("select cast(1 as bigint) as id, 0 as at")
    return merge.reordered(items, ["conv_id"], "turn", wanted).select("conv_id", "turn", F.col("new_position").cast("long").alias("new_position"))


@query("str25_expired", "select event_id from events where ts < timestamp '2024-01-05'")
def expired(t):
    return merge.expired(t.events, "ts", "2024-01-05 00:00:00").select("event_id")


@query("ops3_live_requests", "select c_custkey from customer where c_mktsegment > 'BUILDING' and c_nationkey not in (select c_nationkey from customer where c_mktsegment <= 'BUILDING' and c_acctbal > 9500)")
def live_requests(t):
    """Requests of two segments are there already, live or expired; of the others each is asked for unless its nation has a live one."""
    c = t.customer.select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("email"), F.when(F.col("c_acctbal") > 9500, F.to_timestamp(F.lit("2030-01-01"))).otherwise(F.to_timestamp(F.lit("2000-01-01"))).alias("expires"))
    return merge.live_request(c.where("c_mktsegment > 'BUILDING'"), c.where("c_mktsegment <= 'BUILDING'"), "email", "expires", "2024-01-01").select("c_custkey")


def _versioned(t):
    """Orders as a versioned table: created, then changed by what was edited since, then without the orders of one status."""
    ours, theirs = _sides(t)
    table = versions.VersionedTable(t.spark, f"{graph.shared_folder(t.spark)}/orders-{uuid.uuid4().hex}", ["o_orderkey"])
    table.create(ours)
    table.upsert(theirs.where("edited is not null"), newer="edited")
    return table


@query(
    "str11_snapshot_upsert",
    f"""with {_SIDES} select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when b.edited is null or b.edited <= a.edited then a.o_orderstatus else 'X' end as o_orderstatus, case when b.edited is null or b.edited <= a.edited then a.edited else b.edited end as edited
    from ours a full join (select * from theirs where edited is not null) b on a.o_orderkey = b.o_orderkey where not (a.o_orderkey is null and b.edited is null)""",
)
def snapshot_upsert(t):
    return _versioned(t).read()


@query("str20_maintained", "select o_custkey, count(*) as n, cast(sum(o_orderkey) as bigint) as keys, min(o_totalprice) as least, max(o_totalprice) as most from orders where o_orderstatus = 'P' or o_orderpriority <> '5-LOW' group by 1")
def maintained(t):
    """Figures by customer, kept up by deltas: orders of low priority are taken out of what was there, pending ones are added."""
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    held, low = F.col("o_orderstatus") != "P", F.col("o_orderpriority") == "5-LOW"
    ends = {"min": "o_totalprice", "max": "o_totalprice"}
    view = graph.kept_table(deltas.built(o.where(held), ["o_custkey"], ["o_orderkey"], ends), "view")
    changes = o.where(held & low).withColumn("sign", F.lit(-1)).unionByName(o.where(~held).withColumn("sign", F.lit(1)))
    now = o.where(~(held & low))
    refill = lambda keys: now.join(keys.withColumnRenamed("o_custkey", "k"), F.col("o_custkey") == F.col("k"), "left_semi")
    out = deltas.folded(view, changes, ["o_custkey"], ["o_orderkey"], ends, refill)
    return out.select("o_custkey", "n", F.col("sum_o_orderkey").alias("keys"), F.col("min_o_totalprice").alias("least"), F.col("max_o_totalprice").alias("most"))


@query("str16_snapshot_undo", f"with {_SIDES} select * from ours")
def snapshot_undo(t):
    """A delete and the upsert undone: the last version is the first again."""
    table = _versioned(t)
    table.delete(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"))
    table.undo(0)
    return table.read()


@query("ops8_decided", "select o_orderkey, case when o_orderkey % 10 = 0 then 'junk' when o_orderkey % 10 = 1 then 'keep' else 'untriaged' end as status, o_orderkey % 10 = 0 as is_deleted, case when o_orderkey % 10 < 2 then 2 else 1 end as version from orders")
def decided(t):
    rows = t.orders.select("o_orderkey", F.lit("untriaged").alias("status"), F.lit(False).alias("is_deleted"), F.lit(1).alias("version"))
    d = t.orders.where("o_orderkey % 10 < 2").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 == 0, "junk").otherwise("keep").alias("status"))
    return merge.decided(rows, d, "o_orderkey", {"status": {"junk": "junk", "keep": "keep"}, "is_deleted": {"junk": True, "keep": False}})[0]


@query("ops9_pick_current", "select o_custkey, arg_max(o_orderkey, (o_orderstatus = 'P', o_orderkey)) as o_orderkey from orders group by 1")
def pick_current(t):
    o = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return merge.pick_current(o, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("ops10_outcomes", "select o_orderkey, case when o_orderkey % 2 = 1 then 'not_a_scan' when o_orderkey % 3 = 0 then 'inserted' when o_orderstatus = 'F' then 'reopened' when o_orderstatus = 'P' then 'already_pending' else 'already_accepted' end as outcome from orders")
def outcomes(t):
    r = t.orders.select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("is_scan"))
    e = t.orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "P", "pending").otherwise("accepted").alias("status"))
    return merge.proposal_outcome(r, e, "o_orderkey", "is_scan").select("o_orderkey", "outcome")


@query("ops12_preferred", "select p_brand, arg_max(p_partkey, (p_size, -p_partkey)) as preferred from part group by 1")
def preferred(t):
    return merge.preferred(t.part, "p_brand", "p_partkey", "p_size")


@query("ops13_set_status", "select o_orderkey, case when o_orderkey % 6 = 0 then 'ignore' else o_orderstatus end as status, o_orderpriority as note from orders")
def set_status(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note"))
    return merge.set_status(rows, t.orders.where("o_orderkey % 6 = 0").select("o_orderkey"), "o_orderkey", "ignore")[0]


@query("ops20_next_ids", "select c_custkey, 5000 + row_number() over (order by c_acctbal, c_custkey) - 1 as id from customer")
def next_ids(t):
    have = t.spark.range(10).select(F.col("id"))
    return merge.next_ids(t.customer.select("c_custkey", "c_acctbal"), have, "id", [F.col("c_acctbal"), F.col("c_custkey")], 5000).select("c_custkey", "id")


@query("api13_accept", "select l_orderkey, l_linenumber, l_partkey as value, case when o_orderkey is null then 'applied' when o_custkey = l_partkey then 'same' else 'conflict' end as outcome from lineitem left join (select * from orders where o_orderkey % 2 = 0) on o_orderkey = l_orderkey")
def accept(t):
    s = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    f = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_partkey"))
    return merge.accept(s, f, "l_orderkey", "l_partkey", ("l_linenumber",)).select("l_orderkey", "l_linenumber", "value", "outcome")


@query("api14_clear_fact", "select c_custkey as entity, case when c_custkey % 4 = 0 then null else c_mktsegment end as now, case when c_custkey % 4 = 0 then c_mktsegment end as kept from customer")
def clear_fact(t):
    f, s = merge.clear_fact(t.customer.select("c_custkey", "c_mktsegment"), t.customer.where("c_custkey % 4 = 0").select("c_custkey"), "c_custkey", "c_mktsegment")
    return f.join(s, "c_custkey", "left").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("now"), F.col("value").alias("kept"))


def _hashes(t):
    return spread(t.documents).select("doc_id", values.simhash256(F.lower("text")).alias("hash"), "n_chars")


@query("join4_hamming_pairs")
def hamming_pairs(t):
    h = graph.kept_table(_hashes(t), "hashes")
    return graph.hamming_pairs(h, "doc_id", "hash", 10)


@query("set5_exact_groups", "select doc_id as id, g as \"group\" from (select doc_id, min(doc_id) over (partition by text) as g, count(*) over (partition by text) as n from documents where text is not null) where n > 1")
def exact_groups(t):
    k = t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = k.groupBy("h").agg(F.min("doc_id").alias("a"))
    pairs = k.join(first, "h").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    return graph.components(pairs)


@query("set6_duplicate_groups")
def duplicate_groups(t):
    h = graph.kept_table(_hashes(t), "hashes")
    return graph.duplicate_groups(graph.hamming_pairs(h, "doc_id", "hash", 10), h.select("doc_id", "n_chars"), "doc_id", [F.col("n_chars")])


@query("ops15_near_misses")
def near_misses(t):
    h = graph.kept_table(_hashes(t), "hashes")
    return graph.first_near_misses(h, "doc_id", "hash", 11, 15, 50)


@query("set7_exclusions", "select distinct l_partkey as a, l_suppkey + 100000 as b from lineitem where l_orderkey % 5 <> 0 and (l_partkey, l_suppkey) not in (select l_partkey, l_suppkey from lineitem where l_orderkey % 50 = 0)")
def exclusions(t):
    """Part and supplier keys overlap in large tables, so a pair's ends are ordered by kind first."""
    end = lambda kind, key: F.when(key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    p = lambda w: t.lineitem.where(w).select(end(0, F.col("l_partkey")).alias("a"), end(1, F.col("l_suppkey") + 100000).alias("b"))
    kept = graph.without_pairs(graph.ordered_pairs(p("l_orderkey % 5 <> 0"), "b", "a"), p("l_orderkey % 50 = 0").select("b", "a"))
    return kept.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


@query("set8_rekeyed", "select distinct case when l_suppkey > 50 then l_suppkey - 50 else l_suppkey end as l_suppkey, l_partkey from lineitem")
def rekeyed(t):
    m = t.supplier.where("s_suppkey > 50").select(F.col("s_suppkey").alias("loser"), (F.col("s_suppkey") - 50).alias("keeper"))
    return graph.rekeyed(t.lineitem.select("l_suppkey", "l_partkey"), m, "l_suppkey", ["l_suppkey", "l_partkey"])


@query("set9_resolve_and_undo", "select s_suppkey, s_suppkey > 50 as gone, s_suppkey % 10 = 0 or (s_suppkey <= 50 and (s_suppkey + 50) % 10 = 0) as shut, s_suppkey % 10 = 0 as undone from supplier")
def resolve_and_undo(t):
    rows = t.supplier.select("s_suppkey", F.lit(False).alias("gone"), (F.col("s_suppkey") % 10 == 0).alias("shut"))
    m = t.supplier.where("s_suppkey > 50").select(F.col("s_suppkey").alias("loser"), (F.col("s_suppkey") - 50).alias("keeper"))
    new, log = graph.resolve(rows, m, "s_suppkey", "gone", "shut")
    back = graph.undo_resolve(new, log, "s_suppkey", "gone", "shut").select("s_suppkey", F.col("shut").alias("undone"))
    return new.join(back, "s_suppkey")


@query("fx15_cosine", "select vec_id, round(greatest(1 - list_dot_product(cast(embedding as double[]), q) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(q, q))), 0.0), 6) as d from embeddings, (select cast(embedding as double[]) as q from embeddings where vec_id = 0)")
def cosine(t):
    q = joins.bounded(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")))
    return t.embeddings.join(q).select("vec_id", F.round(values.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("d"))


@query("join8_nearest", "select query_id, ref_id, rank from (select a.vec_id as query_id, b.vec_id as ref_id, row_number() over (partition by a.vec_id order by 1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 50 = 0) where rank <= 5")
def nearest(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return joins.nearest(e.where("id % 50 = 0"), e, 5).select("query_id", "ref_id", F.col("rank").cast("long").alias("rank"))


@query("join8_probed")
def nearest_probed(t):
    """The same from eight cells of the index: not exact."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return joins.nearest(e.where("id % 50 = 0"), e, 5, probes=8).select("query_id", "ref_id", F.col("rank").cast("long").alias("rank"))


@query("join9_nearest_owner", "select query_id, owner, rank from (select query_id, owner, row_number() over (partition by query_id order by d, owner) as rank from (select a.vec_id as query_id, b.label as owner, min(1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))) as d from embeddings a, embeddings b where a.vec_id % 50 = 0 group by 1, 2)) where rank <= 2")
def nearest_owner(t):
    e = t.embeddings
    p = e.select(F.col("label").alias("owner"), F.col("embedding").alias("vector"))
    return joins.nearest_owner(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), p, 2).select("query_id", "owner", F.col("rank").cast("long").alias("rank"))


@query("agg24_means", "select label, i, round(avg(x), 6) as x from (select label, unnest(range(64)) as i, unnest(cast(embedding as double[])) as x from embeddings) group by 1, 2")
def means(t):
    m = aggregates.mean_vectors(t.embeddings, "label", "embedding")
    return m.select("label", F.posexplode("mean").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("agg25_mean_distance", "select a.label, round(avg(1 - list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))), 6) as mean_distance from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by 1")
def mean_distance(t):
    return aggregates.mean_pairwise_cosine(t.embeddings, "label", "embedding").select("label", F.round("mean_distance", 6).alias("mean_distance"))


@query("set11_clusters")
def clusters(t):
    return cluster.clusters(t.embeddings, "vec_id", "embedding")


@query("set13_prototypes")
def prototypes(t):
    return cluster.prototypes(t.embeddings, "label", "vec_id", "embedding")


@query("set14_likely_owners")
def likely_owners(t):
    p = cluster.prototypes(t.embeddings, "label", "vec_id", "embedding")
    return cluster.likely_owners(t.embeddings.withColumn("c", F.col("vec_id") % 7), "c", "embedding", p, 1.0)


@query("src6_content_hash", "select page_id, sha256(html) as h from pages")
def content_hash(t):
    return t.pages.select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("h"))


@query("src9_ingest", "select page_id, case when page_id % 17 = 0 then 'bad' when html in (select html from pages where page_id % 5 = 0) then 'known' else 'new' end as fate from pages")
def ingest(t):
    p = t.pages.select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    known = t.pages.where("page_id % 5 = 0").select(F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256"))
    decoded = F.struct(F.length("content").alias("value"), F.when(F.col("path").cast("long") % 17 == 0, "cannot decode").alias("error"))
    new, seen, bad = files.ingest(p, known, decoded)
    mark = lambda d, x: d.select(F.col("path").cast("long").alias("page_id"), F.lit(x).alias("fate"))
    return mark(new, "new").unionByName(mark(seen, "known")).unionByName(mark(bad, "bad"))


@query("src13_manifest_diff", "select cast(p_partkey as varchar) as path, case when p_partkey % 7 = 0 then 'added' when p_partkey % 5 = 0 then 'removed' else 'changed' end as change from part where p_partkey % 7 = 0 and p_partkey % 5 <> 0 or p_partkey % 5 = 0 and p_partkey % 7 <> 0 or p_partkey % 5 <> 0 and p_partkey % 3 = 0")
def manifest_diff(t):
    k = F.col("p_partkey")
    a = t.part.where("p_partkey % 7 <> 0").select(k.cast("string").alias("path"), F.sha2("p_name", 256).alias("sha256"))
    b = t.part.where("p_partkey % 5 <> 0").select(k.cast("string").alias("path"), F.sha2(F.concat("p_name", F.when(k % 3 == 0, "!").otherwise("")), 256).alias("sha256"))
    return files.manifest_diff(a, b)


@query("src11_folder_hints", "select 'r/' || p_brand || '/x_' || (1960 + p_size) || '-05' as folder, 'date' as kind, (1960 + p_size) || '-05' as value from part group by all")
def folder_hints(t):
    f = t.part.select(F.concat(F.lit("r/"), "p_brand", F.lit("/x_"), (1960 + F.col("p_size")).cast("string"), F.lit("-05")).alias("folder"))
    return files.folder_hints(f, "folder").where("kind = 'date'").select("folder", "kind", "value")


@query("src19_csv_rows", "select c_custkey || ',' || c_name || ',\"a, \"\"' || c_mktsegment || '\"\"\"' as value from customer")
def csv_rows(t):
    return files.csv_rows(t.customer.select("c_custkey", "c_name", F.concat(F.lit('a, "'), "c_mktsegment", F.lit('"')).alias("q")), ["c_custkey", "c_name", "q"])


@query("src20_export_plan", "select o_orderkey, strftime(o_orderdate, '%Y/%m') || '/' || lpad(cast(o_orderkey as varchar), 8, '0') || '.jpg' as destination, o_totalprice <= 100000 as missing, coalesce(s, '') as suppliers from orders left join (select l_orderkey, string_agg(distinct cast(l_linenumber as varchar), '; ' order by cast(l_linenumber as varchar)) as s from lineitem group by 1) on l_orderkey = o_orderkey")
def export_plan(t):
    path = F.concat(F.date_format("o_orderdate", "yyyy/MM"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".jpg"))
    rows = t.orders.withColumn("has", F.col("o_totalprice") > 100000)
    out = files.export_plan(rows, "o_orderkey", path, {"suppliers": (t.lineitem.withColumn("n", F.col("l_linenumber").cast("string")), "l_orderkey", "n")}, "has")
    return out.select("o_orderkey", "destination", "missing", F.array_join("suppliers", "; ").alias("suppliers"))
