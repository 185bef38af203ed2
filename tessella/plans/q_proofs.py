"""Queries for operators that work below others elsewhere, and SQL for the stateful ones."""

from pyspark.sql import functions as F

from ..functions import sql, text, values
from ..operators import cluster, graph, joins, merge, predicates, windows
from ..sources import datasource, files
from ..streaming import keyed
from .registry import query


@query("flt2_parsed", "select o_orderkey from orders where year(o_orderdate) between 1990 and 1999 and year(o_orderdate) >= 1994 and year(o_orderdate) <= 1996")
def parsed(t):
    f = predicates.Filters.parse("decade=1990&from=1994&to=1996&year=x&colour=red")
    return predicates.apply_filters(t.orders, f, predicates.Columns(id="o_orderkey", date="o_orderdate")).select("o_orderkey")


@query("flt7_unfiled", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 30)")
def unfiled(t):
    some = t.lineitem.where("l_returnflag = 'R' and l_quantity > 30").select(F.col("l_partkey").alias("id"), F.lit(1).alias("group_id"))
    return predicates.scoped(t.part, predicates.Access(some, t.supplier), "p_partkey", "unfiled").select("p_partkey")


@query("flt19_list_keys", "select o_orderkey from orders where year(o_orderdate) = 1995")
def list_keys(t):
    f, _ = predicates.parse_list_key(predicates.list_key(predicates.Filters(year=1995), "date"))
    return predicates.apply_filters(t.orders, f, predicates.Columns(id="o_orderkey", date="o_orderdate")).select("o_orderkey")


_GRAMS = """a as (select distinct lower(p_type) as x from part), p as (select a.x as x, b.x as y from a, a b where a.x < b.x),
g as (select x, unnest(list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))) as g from (select x, unnest(regexp_split_to_array(x, '[^a-z0-9]+')) as w from a) where w <> ''),
d as (select distinct x, g from g), n as (select x, count(*) as n from d group by 1), k as (select d.x, e.x as y, count(*) as c from d join d e using (g) group by 1, 2)"""


@query("join2_look_alikes", f"with {_GRAMS} select p.x, p.y from p join n n1 on n1.x = p.x join n n2 on n2.x = p.y left join k on k.x = p.x and k.y = p.y where coalesce(c, 0) / (n1.n + n2.n - coalesce(c, 0)) >= 0.3 or (length(p.x) >= 5 and length(p.y) >= 5 and substr(p.x, 1, 4) = substr(p.y, 1, 4))")
def look_alikes(t):
    return joins.look_alike_pairs(t.part.select(F.lower("p_type").alias("x")))


@query("join19_assigned", """with f as (select c_nationkey as k, c_custkey as id, (c_custkey % 80) / 100.0::double as x, (c_custkey % 60) / 100.0::double as y from customer), r as (select s_nationkey as k, s_suppkey as rid, (s_suppkey % 70) / 100.0::double as x, (s_suppkey % 50) / 100.0::double as y from supplier),
j as (select k, id, rid, greatest(least(f.x + 0.2, r.x + 0.3) - greatest(f.x, r.x), 0) * greatest(least(f.y + 0.2, r.y + 0.3) - greatest(f.y, r.y), 0) / (0.2::double * 0.2::double) as share from f join r using (k)),
o as (select *, row_number() over (partition by k, id order by share desc, rid) as n from j), g as (select k, id, max(rid) filter (where n = 1) as rid, max(share) filter (where n = 1) as s1, max(share) filter (where n = 2) as s2 from o group by 1, 2)
select k, id, case when s1 >= 0.5 and coalesce(s2, 0) < 0.2 then rid end as r_id, round(s1, 6) as share from g""")
def assigned(t):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    faces = t.customer.select(F.col("c_nationkey").alias("k"), c.alias("id"), values.box(c % 80 / 100.0, c % 60 / 100.0, F.lit(0.2), F.lit(0.2)).alias("box"))
    regions = t.supplier.select(F.col("s_nationkey").alias("k"), s.alias("r_id"), values.box(s % 70 / 100.0, s % 50 / 100.0, F.lit(0.3), F.lit(0.3)).alias("r_box"))
    return joins.assigned(faces, regions, "k").withColumn("share", F.round("share", 6))


_WALK = """recursive e as (select user_id, ts::date as d, event_id, ts, value, row_number() over (partition by user_id, ts::date order by ts, event_id) as i from events),
r as (select *, max(i) over (partition by user_id, d order by ts range between current row and interval 1 hour following) as j from e),
walk(user_id, d, i) as (select distinct user_id, d, 1::bigint from e union all select r.user_id, r.d, case when r.j > r.i then r.j + 1 else r.i + 1 end from walk w join r on r.user_id = w.user_id and r.d = w.d and r.i = w.i),
a as (select r.* from walk w join r on r.user_id = w.user_id and r.d = w.d and r.i = w.i where r.j > r.i),
b as (select m.event_id as id, a.event_id as burst, a.j - a.i + 1 as size, (epoch_us(z.ts) - epoch_us(a.ts)) / 1e6 as span, m.value from a join e m on m.user_id = a.user_id and m.d = a.d and m.i between a.i and a.j join e z on z.user_id = a.user_id and z.d = a.d and z.i = a.j)"""


def _bursts(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    return windows.bursts(e, ["user_id", "day"], "ts", "event_id", window=3600.0, least=2)


@query("win4_bursts", f"with {_WALK} select id, burst, size, round(span, 6) as span from b")
def bursts(t):
    return _bursts(t).withColumn("span", F.round("span", 6))


@query("win5_burst_keepers", f"with {_WALK} select burst, arg_max(id, (value, -id)) as keeper from b group by 1")
def burst_keepers(t):
    b = _bursts(t).join(t.events.select(F.col("event_id").alias("id"), "value"), "id")
    return windows.keeper(b, "burst", "id", [F.col("value")])


@query("win8_by_centroid", """with m as (select label, list(x order by i) as mean from (select label, i, avg(x) as x from (select label, unnest(range(64)) as i, unnest(cast(embedding as double[])) as x from embeddings) group by 1, 2) group by 1)
select label, vec_id as id, row_number() over (partition by label order by round(greatest(1 - list_cosine_similarity(cast(embedding as double[]), mean), 0.0), 9), vec_id) as rank from embeddings join m using (label)""")
def by_centroid(t):
    return cluster.by_centroid(t.embeddings.select("label", "vec_id", "embedding"), "label", "vec_id", "embedding").select("label", "id", F.col("rank").cast("long").alias("rank"))


_ADMITTED = """with recursive e as (select user_id, event_id, ts, epoch_us(ts) / 1e6 as s, row_number() over (partition by user_id order by ts, event_id) as i from events),
walk as (select user_id, event_id, i, s as a, null::double as b, null::double as c, true as ok, 0::bigint as retry_after from e where i = 1
union all select e.user_id, e.event_id, e.i, case when w.c is null or w.c <= e.s - 86400 then e.s else w.a end, case when w.c is null or w.c <= e.s - 86400 then w.a else w.b end, case when w.c is null or w.c <= e.s - 86400 then w.b else w.c end, w.c is null or w.c <= e.s - 86400, case when w.c is null or w.c <= e.s - 86400 then 0 else cast(ceil(w.c + 86400 - e.s) as bigint) end from walk w join e on e.user_id = w.user_id and e.i = w.i + 1)
select user_id, event_id as id, ok, retry_after from walk"""


@query("ops1_admitted", _ADMITTED)
def admitted(t):
    return windows.admitted(t.events, "user_id", "ts", "event_id", 3, 86400)


@query("ops1_limited_stream", _ADMITTED)
def limited_stream(t):
    e = keyed.replayed(t.spark, f"{t.path}/events.parquet", t.events.schema)
    return keyed.drained(keyed.limited(e, "user_id", "ts", "event_id", 3, 86400), "limited")


@query("str3_once_stream", "select user_id, event_type, min(ts) as ts from events where (user_id, event_type) not in (select user_id, event_type from events where event_type = 'purchase' and value > 100) group by 1, 2")
def once_stream(t):
    """What a target holds starts the state; the rest comes through once a key."""
    keys, seen = ["user_id", "event_type"], t.events.where("event_type = 'purchase' and value > 100").select("user_id", "event_type", "ts")
    e = keyed.replayed(t.spark, f"{t.path}/events.parquet", t.events.schema).select(*keys, "ts")
    return keyed.drained(keyed.once(e, keys, "ts", 10_000 * 86400, seen=seen), "once")


@query("str5_newest_stream", "select user_id, max(ts) as ts from events group by 1")
def newest_stream(t):
    e = keyed.replayed(t.spark, f"{t.path}/events.parquet", t.events.schema).select("user_id", "ts")
    return keyed.drained(keyed.newest(e, ["user_id"], "ts"), "newest")


@query("fx17_aspect", "select l_orderkey, l_linenumber, l_partkey, abs(l_quantity - l_linenumber * 8) / greatest(l_quantity, l_linenumber * 8) <= 0.15 as close from lineitem")
def aspect(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", values.aspect_close(F.col("l_quantity"), F.col("l_linenumber") * 8).alias("close"))


@query("fn10_like", "select event_id from events where contains(props, '\"k\": 1') or contains(event_type, '_') or contains(props, '%')")
def like(t):
    p = lambda c, needle: F.col(c).like(text.like_pattern(needle))
    return t.events.where(p("props", '"k": 1') | p("event_type", "_") | p("props", "%")).select("event_id")


@query("str10_pages", "select event_id, ts from events order by ts, event_id limit 400")
def two_pages(t):
    e = t.events.select("event_id", "ts")
    first = graph.kept_table(merge.changes_since(e, "ts", "event_id", None, 200), "page")
    last = first.orderBy(F.desc("ts"), F.desc("event_id")).first()
    return first.unionByName(merge.changes_since(e, "ts", "event_id", (str(last.ts), last.event_id), 200))


@query("str21_rebuilt", """with full_view as (select o_custkey, count(*) as n from orders group by 1), old as (select o_custkey, count(*) as n from orders where o_orderstatus <> 'F' group by 1), stale as (select distinct o_custkey from orders where o_orderpriority = '1-URGENT')
select o_custkey, f.n from full_view f where o_custkey in (select o_custkey from stale) union all select o_custkey, n from old where o_custkey not in (select o_custkey from stale)""")
def rebuilt(t):
    """Keys that are told to be stale are rebuilt, the others keep what they have."""
    view = lambda o: o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return merge.refreshed(view(t.orders.where("o_orderstatus <> 'F'")), t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct(), view(t.orders), "o_custkey")


@query("src14_line_source", "select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n, min(event_id) as first from events where event_type <> 'error' group by 1, 2")
def line_source(t):
    """Events as lines in folders by day, read again by the line source."""
    from uuid import uuid4

    path = f"{graph.shared_folder(t.spark)}/lines-{uuid4().hex}"
    lines = t.events.select(F.to_date("ts").cast("string").alias("day"), F.to_json(F.struct("event_id", "event_type")).alias("value"))
    lines.repartition("day").write.partitionBy("day").text(path)
    datasource.register(t.spark)
    found = t.spark.read.format("line_json").schema("day string, event_id long, event_type string").option("path", path).option("suffix", ".txt").load()
    return found.where("event_type <> 'error'").groupBy("day", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("src12_manifest", "select 'c' || c_custkey as file, o_orderkey as group_id from customer join orders on o_custkey = c_custkey")
def manifest(t):
    from uuid import uuid4

    root = graph.shared_folder(t.spark)
    groups = F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), F.array_sort(F.collect_list("o_orderkey")).alias("groups"))
    path = f"{root}/manifest-{uuid4().hex}"
    each = t.orders.groupBy("o_custkey").agg(groups.alias("f")).groupBy(F.pmod("o_custkey", F.lit(50)).alias("part")).agg(F.collect_list("f").alias("files"))
    each.repartition(8).select("files").write.json(path)
    return files.manifest_groups(t.spark, path, lines=True)


@query("src16_replayed", "select event_id as line, event_type from events where event_id > 50")
def replayed(t):
    from uuid import uuid4

    path = f"{graph.shared_folder(t.spark)}/results-{uuid4().hex}"
    e = t.events.select(F.col("event_id").alias("line"), "event_type", F.lit(None).cast("boolean").alias("summary"))
    e.unionByName(t.spark.createDataFrame([(None, None, True)], e.schema)).write.json(path)
    return files.read_results(t.spark, path, "line long, event_type string", after=50)


@query("api3_sql_functions", "select c_custkey, lower(c_mktsegment) as token, make_date(cast(1990 + c_custkey % 9 as int), 1, 1) as lo, make_date(cast(1990 + c_custkey % 9 as int), 12, 31) as hi, bit_count(xor(c_custkey, 12345)) as bits from customer")
def sql_functions(t):
    sql.register(t.spark)
    t.customer.createOrReplaceTempView("tessella_customers")
    return t.spark.sql("""select c_custkey, search_token(c_mktsegment) as token, s.lo, s.hi, cast(bits as bigint) as bits from
        (select *, date_span(make_date(cast(1990 + c_custkey % 9 as int), 6, 1), 'year') as s, hamming_bits(c_custkey, 12345L) as bits from tessella_customers)""")


@query("api4_sql_table_function", "select p_partkey, cast(i as int) as band, substr(sha256(p_name), cast(4 * i + 1 as int), 4) as value from part, (select unnest(range(16)) as i)")
def sql_table_function(t):
    sql.register(t.spark)
    t.part.createOrReplaceTempView("tessella_parts")
    return t.spark.sql("select p_partkey, b.band, b.value from tessella_parts, lateral hash_bands(sha2(p_name, 256)) b")
