"""Filters, visibility, scopes, pages and selectors. Orders stand for rows, customers' nations for groups, segments
for users' groups."""

from pyspark.sql import functions as F

from ..functions import values
from ..operators import paging, predicates
from ..operators.predicates import Access, Columns, Filters
from .registry import query


def _access(t):
    c = t.customer.select("c_custkey", "c_nationkey")
    groups = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("long").alias("group_id"))
    members = t.supplier.select(F.col("s_nationkey").cast("long").alias("group_id"), F.col("s_suppkey").alias("user_id"))
    return Access(groups, members)


VISIBLE = "o_orderkey in (select o_orderkey from orders join customer on o_custkey = c_custkey where c_nationkey in (select s_nationkey from supplier where s_suppkey = 3))"


@query("flt1_browse", "select o_orderkey, cast(o_totalprice as double) as o_totalprice, o_orderstatus from orders where year(o_orderdate) between 1994 and 1996 and o_orderkey in (select l_orderkey from lineitem where l_partkey = 7)")
def browse(t):
    c = Columns(id="o_orderkey", date="o_orderdate", people=t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("key")))
    return predicates.apply_filters(t.orders, Filters.parse("from=1994&to=1996&person=7&nonsense=1"), c).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("flt1_decade_text", "select doc_id, lang from documents where contains(lower(text), 'worthless') and lang = 'en'")
def text_filter(t):
    return predicates.apply_filters(t.documents.where("lang = 'en'"), Filters.parse("q=worthless"), Columns(id="doc_id", texts=("text",))).select("doc_id", "lang")


@query("flt3_visible", f"select o_orderkey from orders where o_orderstatus <> 'P' and {VISIBLE}")
def visible(t):
    return predicates.visible(t.orders, _access(t), 3, "o_orderkey", deleted=F.col("o_orderstatus") == "P").select("o_orderkey")


@query("flt4_point_check", f"select o_orderkey, {VISIBLE} as seen from orders")
def point_check(t):
    some = t.orders.select("o_orderkey")
    seen = predicates.visible(some, _access(t), 3, "o_orderkey").withColumn("__s", F.lit(True))
    return some.join(seen, "o_orderkey", "left").select("o_orderkey", F.coalesce("__s", F.lit(False)).alias("seen"))


@query("flt5_unfiled", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def unfiled(t):
    a = Access(t.orders.select(F.col("o_custkey").alias("id"), F.lit(1).alias("group_id")), t.supplier)
    return predicates.scoped(t.customer, a, "c_custkey", "unfiled").select("c_custkey")


@query("flt5_one_group", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def one_group(t):
    a = Access(t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("group_id")), t.supplier)
    return predicates.scoped(t.customer, a, "c_custkey", "1-URGENT").select("c_custkey")


@query("flt6_bulk", "select o_orderkey from orders where year(o_orderdate) = 1995 and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def bulk(t):
    rows = predicates.apply_filters(t.orders, Filters(year=1995), Columns(id="o_orderkey", date="o_orderdate"))
    return predicates.none_of(rows, [t.lineitem.where("l_returnflag = 'R'").select("l_orderkey")], "o_orderkey").select("o_orderkey")


@query("flt8_prefix", "select event_type, count(*) as n from events where starts_with(event_type, 'p') or event_type = 'click' group by 1")
def prefix(t):
    return t.events.where(predicates.exact_or_prefix("event_type", "p*") | predicates.exact_or_prefix("event_type", "click")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt9_targets", "select 'part.p_name' as target, p_partkey as id, p_name as value, p_brand as context from part where contains(lower(p_name), 'a1') union all select 'documents.lang', doc_id, lang, source from documents where contains(lower(lang), 'a1') union all select 'supplier.s_name', s_suppkey, s_name, cast(s_nationkey as varchar) from supplier where contains(lower(s_name), 'a1') union all select 'customer.c_name', c_custkey, c_name, c_mktsegment from customer where contains(lower(c_name), '#00000001')")
def targets(t):
    a, b = predicates.Targets(), predicates.Targets()
    a.add("part", "p_name", "p_brand", "p_partkey")
    a.add("documents", "lang", "source", "doc_id")
    a.add("supplier", "s_name", "s_nationkey", "s_suppkey")
    b.add("customer", "c_name", "c_mktsegment", "c_custkey")
    read = lambda n: getattr(t, n)
    return predicates.search_targets(read, a, "A1").unionByName(predicates.search_targets(read, b, "#00000001"))


@query("flt11_eligible", "select doc_id from documents left join (select doc_id as d, case when quality = 1 then 'done' end as status, case when toxic = 1 then 'old' else 'm1' end as model from labels) on doc_id = d where d is null or coalesce(status, '') <> 'done' or coalesce(model, '') <> 'm1'")
def eligible(t):
    jobs = t.labels.select(F.col("doc_id").alias("id"), F.lit("classify").alias("job"), F.when(F.col("quality") == 1, "done").alias("status"), F.when(F.col("toxic") == 1, "old").otherwise("m1").alias("model"), F.lit("v1").alias("version"))
    return predicates.eligible(t.documents.select("doc_id"), jobs, "doc_id", "classify", "m1", "v1")


@query("flt12_two_anti", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R') and p_partkey not in (select l_partkey from lineitem where l_quantity > 48)")
def two_anti(t):
    return predicates.none_of(t.part, [t.lineitem.where("l_returnflag = 'R'").select("l_partkey"), t.lineitem.where("l_quantity > 48").select("l_partkey")], "p_partkey").select("p_partkey")


@query("flt13_newest_and_max", "select c_custkey, last_status, dearest from customer left join (select o_custkey, arg_max(o_orderstatus, o_orderkey) as last_status, max(o_totalprice) as dearest from orders group by 1) on o_custkey = c_custkey")
def newest_and_max(t):
    o = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("last_status"), F.max("o_totalprice").alias("dearest"))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_status", "dearest")


@query("flt14_json_keys", "select event_id from events where props is not null and json_keys(props) = ['k']")
def json_keys(t):
    return t.events.where(values.json_keys_within(F.col("props"), ["k"])).select("event_id")


@query("flt15_tombstones", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey % 2 = 0 and (o_orderkey % 5 <> 0 or o_orderkey % 10 = 0)")
def tombstones(t):
    when = lambda c, d: F.when(c, F.to_timestamp(F.lit(d)))
    k = F.col("o_orderkey")
    o = t.orders.select("o_orderkey", when(F.col("o_orderstatus") == "F", "2001-02-01").alias("gone"), when(k % 2 == 0, "2001-01-01").alias("synced"), F.when(k % 5 == 0, F.when(k % 10 == 0, F.to_timestamp(F.lit("2001-01-15"))).otherwise(F.to_timestamp(F.lit("2001-03-01")))).alias("told"))
    return predicates.tombstones(o, "gone", "synced", "told").select("o_orderkey")


@query("flt16_never_set", "select c_custkey, coalesce(m, timestamp '1900-01-01') as since from customer left join (select o_custkey, min(o_orderdate) as m from orders group by 1) on o_custkey = c_custkey where c_custkey not in (select o_custkey from orders where o_orderpriority = '5-LOW')")
def never_set(t):
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("m"))
    rows = predicates.none_of(t.customer, [t.orders.where("o_orderpriority = '5-LOW'").select("o_custkey")], "c_custkey")
    return rows.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.col("m").cast("timestamp"), F.to_timestamp(F.lit("1900-01-01"))).alias("since"))


@query("flt17_not_absolute", r"select page_id from pages where not regexp_matches(url, '^([A-Za-z]:\\|/)') and not regexp_matches(url, 'https')")
def not_absolute(t):
    return t.pages.where(predicates.not_absolute("url") & ~F.col("url").contains("https")).select("page_id")


@query("flt18_items", "select o_orderkey, '/orders/' || o_orderkey || '/full' as url, o_totalprice > 100000 as has_file from orders where o_orderstatus = 'O'")
def items(t):
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string"), F.lit("/full")).alias("url"), (F.col("o_totalprice") > 100000).alias("has_file"))


BY_PRICE = paging.Sort("price", id="o_orderkey")


def _priced(t):
    """A third of the values are null, to end the list."""
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.floor(F.col("o_totalprice") / 1000).cast("long")).alias("price"))


PRICED = "(select o_orderkey, case when o_orderkey % 3 <> 0 then cast(floor(o_totalprice / 1000) as bigint) end as price from orders)"


@query("sort1_page", f"select o_orderkey, price from {PRICED} order by price desc nulls last, o_orderkey desc limit 50")
def first_page(t):
    return paging.page(_priced(t), BY_PRICE, 50)


@query("sort2_keyset", f"select o_orderkey, price from {PRICED} where price < 200 or (price = 200 and o_orderkey < 5000) or price is null order by price desc nulls last, o_orderkey desc limit 40")
def keyset(t):
    return paging.page(_priced(t), BY_PRICE, 40, "200~5000")


@query("sort2_null_block", f"select o_orderkey, price from {PRICED} where price is null and o_orderkey < 900 order by o_orderkey desc limit 40")
def null_block(t):
    return paging.page(_priced(t), BY_PRICE, 40, "~900")


@query("sort2_backwards", f"select o_orderkey, price from {PRICED} where price > 200 or (price = 200 and o_orderkey > 5000) order by price asc nulls first, o_orderkey asc limit 40")
def backwards(t):
    return paging.page(_priced(t), BY_PRICE, 40, "200~5000", reverse=True)


@query("sort4_list", f"select o_orderkey, price from {PRICED} where {VISIBLE} and price is not null order by price desc nulls last, o_orderkey desc limit 30")
def listed(t):
    return paging.page(predicates.visible(_priced(t).where("price is not null"), _access(t), 3, "o_orderkey"), BY_PRICE, 30)


@query("sort5_neighbours", f"select o_orderkey, lead(o_orderkey) over w as next_id, lag(o_orderkey) over w as previous_id from (select o_orderkey, o_custkey, o_totalprice from orders) window w as (partition by o_custkey order by o_totalprice desc, o_orderkey desc)")
def neighbours(t):
    return paging.all_neighbours(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderkey")], "o_orderkey").select("o_orderkey", "next_id", "previous_id")


@query("sort6_ids_below", "select o_orderkey from orders where o_orderkey < 700 order by o_orderkey desc limit 60")
def ids_below(t):
    return paging.ids_below(t.orders.select("o_orderkey"), "o_orderkey", 700, 60)


@query("sort7_row_compare", "select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_linenumber) > (300, 2)")
def row_compare(t):
    return t.lineitem.where(paging.after(["l_orderkey", "l_linenumber"], [300, 2], ["long", "int"])).select("l_orderkey", "l_linenumber")


@query("sort8_queue_order", "select l_orderkey, n, least_price from (select l_orderkey, count(*) as n, min(l_extendedprice) as least_price from lineitem group by 1) order by n desc, least_price, l_orderkey limit 25")
def queue_order(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("least_price"))
    return g.orderBy(F.desc("n"), "least_price", "l_orderkey").limit(25)


@query("sort9_priority", "select o_orderkey, case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end as rank from orders order by 2, 1 limit 20")
def by_priority(t):
    return t.orders.select("o_orderkey", paging.priority("o_orderstatus", ["P", "O"]).cast("int").alias("rank")).orderBy("rank", "o_orderkey").limit(20)


@query("sort10_distinct_types", "select distinct event_type from events")
def distinct_types(t):
    return t.events.select("event_type").distinct()


@query("src22_export_page", "select * from nation order by n_nationkey limit 10 offset 5")
def export_page(t):
    return paging.exported(t.nation, "n_nationkey", 5, 10)


@query("join15_missing_pairs", "select c_custkey, cast(g as bigint) as g from customer, (select unnest([1, 2, 3]) as g) where not exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 3 + 1 = g)")
def missing_pairs(t):
    have = t.orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3 + 1).alias("g")).distinct()
    return predicates.missing_pairs(t.customer, [1, 2, 3], have, "c_custkey", "g").select("c_custkey", "g")


@query("ops14_subset", "select o_custkey, bool_and(o_orderstatus in ('O', 'F')) as within from orders group by 1")
def subset(t):
    g = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return g.select("o_custkey", (F.size(F.array_except("s", F.array(F.lit("O"), F.lit("F")))) == 0).alias("within"))


@query("ops5_filter_options", "select 'status' as facet, o_orderstatus as value from orders union select 'year', cast(year(o_orderdate) as varchar) from orders union select 'year', regexp_extract(url, '(19|20)[0-9][0-9]') from pages where regexp_extract(url, '(19|20)[0-9][0-9]') <> ''")
def filter_options(t):
    y = F.regexp_extract("url", "((19|20)[0-9][0-9])", 1)
    a = t.orders.select(F.explode(F.array(F.struct(F.lit("status").alias("facet"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("year").alias("facet"), F.year("o_orderdate").cast("string").alias("value")))).alias("x")).select("x.facet", "x.value")
    return a.unionByName(t.pages.where(y != "").select(F.lit("year").alias("facet"), y.alias("value"))).distinct()


@query("ops4_triage_list", "select o_orderkey, coalesce(q, -1) as hint, case when year(o_orderdate) >= 1997 then 'taken' else 'folder' end as source from orders left join (select doc_id as d, quality as q from labels) on d = o_orderkey where year(o_orderdate) >= 1997 or o_orderpriority like '1%' order by coalesce(q, -1) desc, o_orderkey limit 100")
def triage_list(t):
    hints = t.labels.select(F.col("doc_id").alias("d"), F.col("quality").alias("q"))
    y = F.year("o_orderdate") >= 1997
    rows = t.orders.where(y | F.col("o_orderpriority").startswith("1")).join(hints, F.col("d") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("q", F.lit(-1)).alias("hint"), F.when(y, "taken").otherwise("folder").alias("source")).orderBy(F.desc("hint"), "o_orderkey").limit(100)


@query("ops7_proposal_queue", "select o_orderkey, 'first' as queue, c_name as who from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P' union all select o_orderkey, 'second', c_name from orders left join customer on o_custkey = c_custkey where o_orderpriority = '2-HIGH' and o_orderstatus <> 'P'")
def proposal_queue(t):
    c = t.customer.select("c_custkey", "c_name")
    part = lambda rows, name: rows.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.lit(name).alias("queue"), F.col("c_name").alias("who"))
    return part(t.orders.where("o_orderstatus = 'P'"), "first").unionByName(part(t.orders.where("o_orderpriority = '2-HIGH' and o_orderstatus <> 'P'"), "second"))
