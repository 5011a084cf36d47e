"""Filter, join, ordered-row, set, snapshot and identity queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facets as A
from ..operators import identity as I
from ..operators import mentions as M
from ..operators import profile as P
from ..operators import relations as R
from ..operators import sampling as G
from .bind import WITH

#: A small reference dimension over collections, and the domains that products link.
METHODS = [("SMALL", "survey", "longitudinal"), ("ECONOMY", "survey", "longitudinal"), ("STANDARD", "admin", "cross-sectional"), ("PROMO", "admin", "longitudinal"), ("MEDIUM", "survey", "cross-sectional"), ("LARGE", "admin", "longitudinal")]


def _dim(t):
    rows = [(name, method, time) for name, method, time in METHODS]
    return t.spark.createDataFrame(rows, "collection string, method string, temporal string")


DIM_SQL = "dim as (select * from (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in METHODS) + ") v(collection, method, temporal))"


def old_and_new(t):
    """Two snapshots: orders before 1998, and all with one column changed for some."""
    base = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("d"))
    old = base.filter("d < date '1998-01-01'").drop("d")
    new = base.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))).filter("o_orderkey % 17 <> 3").drop("d")
    return old, new


SNAP = "with o as (select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderdate < date '1998-01-01'), n as (select o_orderkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end o_orderstatus, o_orderpriority from orders where o_orderkey % 17 <> 3)"
DIFF = SNAP + ", d as (select coalesce(o.o_orderkey, n.o_orderkey) o_orderkey, case when n.o_orderkey is null then 'removed' when o.o_orderkey is null then 'added' when o.o_orderstatus <> n.o_orderstatus then 'changed' else 'same' end status, case when o.o_orderstatus <> n.o_orderstatus then 'o_orderstatus' else '' end \"columns\" from o full join n on o.o_orderkey = n.o_orderkey)"


def multi_filter(t):
    r = t.records.join(t.customer.select(F.col("c_custkey").alias("official_id"), "c_name", "c_mktsegment"), "official_id")
    chosen = t.mentions.filter(F.col("product").endswith("1")).select("record_id").distinct()
    p = R.conjunction([F.col("environment") == "1-URGENT", None, R.search("000000", ["c_name", "environment"])])
    return r.filter(p).join(chosen, "record_id", "left_semi").select("record_id", "c_name")


def tiers(t):
    """Events as records that repeat by user and type: same day -> merged, else kept."""
    rows = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"), F.round("value", 0).cast("string").alias("v"))
    return I.duplicate_tiers(rows, ["user_id", "event_type"], "day", ["v"], [], "event_id").select("event_id", "group_size", "tier", "keep")


TIERS = """with e as (select event_id, user_id, event_type, cast(ts as date) as day, cast(round(value, 0) as varchar) v from events),
g as (select user_id, event_type, count(*) n, count(distinct day) d, count(distinct v) k, min(event_id) f from e group by all)
select e.event_id, g.n group_size, cast(case when n = 1 then 0 when d > 1 then 3 when k = 1 then 1 else 2 end as int) tier, (n = 1 or d > 1 or e.event_id = g.f) keep from e join g using (user_id, event_type)"""


def facets(t):
    vocabulary = {"method": ["survey", "admin"], "temporal": ["cross-sectional", "longitudinal"]}
    kept = t.mentions.withColumn("collection", F.regexp_extract("collection", "^[A-Z]+", 0))
    return A.facet_sets(kept, _dim(t), "collection", vocabulary)


FACETS = f"""{WITH}, {DIM_SQL}, h as (select distinct record_id, method, temporal from (select record_id, regexp_extract(collection, '^[A-Z]+') collection from mention) join dim using (collection))
select record_id, concat_ws('; ', max(case when method = 'survey' then 'survey' end), max(case when method = 'admin' then 'admin' end)) as method, concat_ws('; ', max(case when temporal = 'cross-sectional' then temporal end), max(case when temporal = 'longitudinal' then temporal end)) temporal from h group by record_id"""


def component_query(t):
    """Customers and suppliers linked through their nations: components of all three tables, each with its size."""
    node = lambda key, kind: F.col(key).cast("long") * 3 + kind
    e = t.customer.select(node("c_custkey", 0).alias("a"), node("c_nationkey", 2).alias("b"))
    e = e.unionByName(t.supplier.select(node("s_suppkey", 1).alias("a"), node("s_nationkey", 2).alias("b")))
    return I.connected(e).groupBy("component").agg(F.count("*").alias("nodes"))


#: Links go through nations only, so a nation's customers, suppliers and itself are one component.
COMPONENTS = """with e as (select c_custkey * 3 a, c_nationkey n from customer union all select s_suppkey * 3 + 1, s_nationkey from supplier)
select cast(least(min(a), n * 3 + 2) as bigint) component, count(distinct a) + 1 nodes from e group by n"""


def greedy(t):
    """Suppliers that cover most parts, greedily."""
    rows = I.greedy_cover(t.lineitem, "l_suppkey", "l_partkey", 5)
    return t.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "step int, l_suppkey long, new long, covered long")


_STEP = """b{i} as materialized (select l_suppkey s, count(*) n from e{p} join t using (l_suppkey) group by l_suppkey, total order by n desc, total desc, l_suppkey limit 1),
e{i} as materialized (select * from e{p} where l_partkey not in (select l_partkey from e0 where l_suppkey = (select s from b{i})))"""
GREEDY = (
    "with e0 as materialized (select distinct l_suppkey, l_partkey from lineitem), t as (select l_suppkey, count(*) total from e0 group by 1), "
    + ", ".join(_STEP.format(i=i, p=i - 1) for i in range(1, 6))
    + ", r as ("
    + " union all ".join(f"select {i} step, s, n from b{i}" for i in range(1, 6))
    + ') select cast(step as int) step, s l_suppkey, n "new", cast(sum(n) over (order by step) as bigint) covered from r'
)


def quantity_gate(t):
    """Order keys of lines without an order, and the reverse: the difference of key sets both ways."""
    return R.key_sets(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k")), "k")


QUERIES = [
    ("f01_required_rows", lambda t: R.required(t.records, "d", "environment", "basis", "o")[0].select("record_id"), "select o_orderkey record_id from orders where o_orderdate is not null and o_orderpriority is not null and lower(o_orderstatus) like '%o%'"),
    ("f01_step_counts", lambda t: R.required(t.records, "d", "environment", "basis", "o")[1], "select count(*) \"loaded\", count(*) filter (o_orderdate is not null and o_orderpriority is not null) dated, count(*) filter (o_orderdate is not null and o_orderpriority is not null and lower(o_orderstatus) like '%o%') kept from orders"),
    ("f02_multi_filter", multi_filter, f"{WITH} select record_id, c_name from rec join customer on c_custkey = official_id where environment = '1-URGENT' and (c_name ilike '%000000%' or environment ilike '%000000%') and record_id in (select record_id from mention where product like '%1')"),
    ("f03_search", lambda t: t.part.filter(R.search("brand#1", ["p_name", "p_brand"])).select("p_partkey"), "select p_partkey from part where contains(lower(p_name), 'brand#1') or contains(lower(p_brand), 'brand#1')"),
    ("f04_member", lambda t: t.part.select("p_partkey", F.regexp_replace("p_name", " ", "; ").alias("names")).filter(R.has_member("names", "blue")).select("p_partkey"), "select p_partkey from part where list_contains(string_split(p_name, ' '), 'blue')"),
    ("f10_flags", lambda t: R.flags(t.orders, {"large": F.col("o_totalprice") > 400000, "urgent": F.col("o_orderpriority") == "1-URGENT", "open": F.col("o_orderstatus") == "O"}).filter("n_flags > 1").select("o_orderkey", F.array_join("flags", ",").alias("flags"), "n_flags"), "with f as (select o_orderkey, concat_ws(',', case when o_totalprice > 400000 then 'large' end, case when o_orderpriority = '1-URGENT' then 'urgent' end, case when o_orderstatus = 'O' then 'open' end) flags, cast((o_totalprice > 400000)::int + (o_orderpriority = '1-URGENT')::int + (o_orderstatus = 'O')::int as int) n_flags from orders) select * from f where n_flags > 1"),
    ("f11_subset", lambda t: R.subset(t.orders, t.orders.filter("o_orderkey % 7 = 0").select("o_orderkey"), "o_orderkey").select("o_orderkey", "o_custkey"), "select o_orderkey, o_custkey from orders where o_orderkey % 7 = 0"),
    ("j01_fill_join", lambda t: R.fill_join(t.records.select("record_id"), facets(t), "record_id", ["method", "temporal"]), f"with f as ({FACETS}) select o_orderkey record_id, coalesce(method, '') as method, coalesce(temporal, '') temporal from orders left join f on o_orderkey = record_id"),
    ("j03_overlay", lambda t: R.overlay(t.customer.select("c_custkey", "c_mktsegment"), t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey"), ["c_custkey"], ["c_mktsegment"], ["o_orderkey"]), "with r as (select o_custkey, arg_min(o_orderpriority, o_orderkey) p from orders where o_totalprice > 450000 group by 1) select c_custkey, coalesce(p, c_mktsegment) c_mktsegment from customer left join r on c_custkey = o_custkey"),
    ("j04_outer_origin", lambda t: R.outer_with_origin(*[x.select("o_orderkey") for x in old_and_new(t)], "o_orderkey").groupBy("origin").agg(F.count("*").alias("n")), SNAP + " select case when n.o_orderkey is null then 'left_only' when o.o_orderkey is null then 'right_only' else 'both' end origin, count(*) n from o full join n on o.o_orderkey = n.o_orderkey group by 1"),
    ("j05_semi", lambda t: t.customer.join(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"), "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')"),
    ("j06_anti", lambda t: t.customer.join(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"), "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')"),
    ("j07_marked", lambda t: R.marked(t.part.select("p_partkey"), t.lineitem.filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "bulk"), "select p_partkey, p_partkey in (select l_partkey from lineitem where l_quantity = 50) bulk from part"),
    ("j08_key_sets", quantity_gate, "with a as (select distinct l_orderkey k from lineitem), b as (select o_orderkey k from orders) select (select count(*) from a where k not in (from b)) only_a, (select count(*) from b where k not in (from a)) only_b, (select count(*) from a where k in (from b)) common"),
    ("j09_fallback_lookup", lambda t: R.fallback_lookup(t.part.select("p_partkey", "p_type"), F.array("p_type", F.regexp_extract("p_type", "^[A-Z]+", 0)), _dim(t), "collection", "method", "method"), f"with {DIM_SQL} select p_partkey, p_type, coalesce(a.method, b.method) as method from part left join dim a on p_type = a.collection left join dim b on regexp_extract(p_type, '^[A-Z]+') = b.collection"),
    ("j12_left_clip", lambda t: t.records.select("record_id", "basis", "d").join(t.records.groupBy("basis").agg(F.min("d").alias("start")), "basis").filter("d >= date_add(start, 365)").groupBy("basis").agg(F.count("*").alias("n")), "with s as (select o_orderstatus basis, min(cast(o_orderdate as date)) start from orders group by 1) select basis, count(*) n from orders join s on o_orderstatus = basis where cast(o_orderdate as date) >= start + 365 group by 1"),
    ("j13_pattern_lookup", lambda t: R.pattern_lookup(t.part, "p_name", t.spark.createDataFrame([(1, "blue", "cold"), (2, "^red|red$", "warm"), (3, "e", "other")], "priority int, pattern string, value string")), "select distinct p_name, case when p_name like '%blue%' then 'cold' when p_name like 'red%' or p_name like '%red' then 'warm' when p_name like '%e%' then 'other' end as \"value\" from part"),
    ("j14_longest_prefix", lambda t: R.longest_prefix(t.part, "p_type", t.spark.createDataFrame([("ECONOMY",), ("ECON",), ("STANDARD",), ("S",)], "prefix string"), "prefix"), "with p as (select unnest(['ECONOMY', 'ECON', 'STANDARD', 'S']) prefix), d as (select distinct p_type from part) select p_type, arg_max(prefix, length(prefix)) prefix from d join p on starts_with(p_type, prefix) and length(p_type) > length(prefix) group by 1"),
    ("j16_one_to_one", lambda t: R.one_to_one(t.customer.select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("old")), t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"), F.col("s_suppkey").alias("new")), ["c_nationkey", "c_mktsegment"], "old", "new").groupBy("status").agg(F.count("*").alias("n")), "with a as (select c_nationkey k, c_mktsegment m, c_custkey old, count(*) over (partition by c_nationkey, c_mktsegment) n from customer), b as (select s_nationkey k, 'BUILDING' m, count(*) c, min(s_suppkey) \"new\" from supplier group by 1) select case when b.c is null then 'unmatched' when b.c > 1 or n > 1 then 'ambiguous' when old = \"new\" then 'kept' else 'rekeyed' end status, count(*) n from a left join b using (k, m) group by 1"),
    ("j17_mismatches", lambda t: R.mismatches(*old_and_new(t), "o_orderkey", ["o_orderstatus", "o_orderpriority"]).groupBy("field").agg(F.count("*").alias("n")), DIFF + " select case status when 'removed' then 'left_only' when 'added' then 'right_only' else 'o_orderstatus' end field, count(*) n from d where status <> 'same' group by 1"),
    ("w01_first_row", lambda t: R.first_rows(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey"), "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1"),
    ("w02_ranked_suffix", lambda t: M.ranked_suffix(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "record_key"), "with r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) r, count(*) over (partition by o_custkey) n from orders) select o_orderkey, case when n = 1 then o_custkey::varchar else o_custkey || '/' || case when r > 26 then chr(cast(96 + (r - 1) // 26 as int)) else '' end || chr(cast(97 + (r - 1) % 26 as int)) end record_key from r"),
    ("w03_row_ids", lambda t: t.nation.withColumn("row_id", F.concat(F.lit("rec-"), F.lpad(F.row_number().over(Window.orderBy("n_nationkey")).cast("string"), 4, "0"))).select("n_nationkey", "row_id"), "select n_nationkey, 'rec-' || lpad(row_number() over (order by n_nationkey)::varchar, 4, '0') row_id from nation"),
    ("w06_previous_snapshot", lambda t: R.previous_distinct(t.events, "event_type", "event_id"), "with f as (select event_type, min(event_id) first_seen from events group by 1) select event_type, first_seen, lag(event_type) over (order by first_seen, event_type) previous from f"),
    ("w08_period_share", lambda t: t.events.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("day"))), "with n as (select cast(ts as date) as day, event_type, count(*) n from events group by all) select day, event_type, n, n / cast(sum(n) over (partition by day) as double) share from n"),
    ("w10_period_index", lambda t: P.indexed_periods(t.records.groupBy("q").agg(F.count("*").alias("n")), "q"), "with n as (select cast(date_trunc('quarter', o_orderdate) as date) q, count(*) n from orders group by 1) select q, n, cast(row_number() over (order by q) - 1 as int) t from n"),
    ("o02_top_k", lambda t: P.top_values(t.lineitem, "l_partkey", 20), "select l_partkey, count(*) n from lineitem group by 1 order by n desc, l_partkey limit 20"),
    ("u01_union_distinct", lambda t: t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"))).distinct(), "select c_nationkey k from customer union select s_nationkey from supplier"),
    ("u03_ordered_union", lambda t: R.ordered_union(t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").withColumn("pos", F.struct("l_linenumber", "l_partkey")), "l_orderkey", "p_brand", "pos", F.lower("p_brand"), ","), "with f as (select l_orderkey, p_brand, min((l_linenumber, l_partkey)) pos from lineitem join part on l_partkey = p_partkey group by 1, 2) select l_orderkey, string_agg(p_brand, ',' order by pos) p_brand, count(*) \"values\" from f group by 1"),
    ("u04_in_all", lambda t: R.in_all(t.lineitem, "l_partkey", "l_returnflag", 3), "select l_partkey from lineitem group by 1 having count(distinct l_returnflag) = 3"),
    ("u06_set_difference", lambda t: t.part.select(F.col("p_partkey").alias("k")).exceptAll(t.lineitem.filter("l_quantity = 50").select(F.col("l_partkey").alias("k")).distinct()), "select p_partkey k from part except select l_partkey from lineitem where l_quantity = 50"),
    ("d07_snapshot_diff", lambda t: R.snapshot_diff(*old_and_new(t), "o_orderkey", ["o_orderstatus", "o_orderpriority"]), DIFF + " select * from d where status <> 'same'"),
    ("d07_impact", lambda t: R.impact(R.snapshot_diff(*old_and_new(t), "o_orderkey", ["o_orderstatus", "o_orderpriority"])), DIFF + " select count(*) filter (status = 'added') added, count(*) filter (status = 'removed') removed, count(*) filter (status = 'changed') changed, case when count(*) filter (status <> 'same') = 0 then 'none' else 'changed' end impact from d"),
    ("d07_multiset_diff", lambda t: R.multiset_diff(t.orders.filter("o_orderkey % 5 <> 0").select("o_custkey", "o_orderstatus"), t.orders.select("o_custkey", "o_orderstatus"), "o_custkey", ["o_orderstatus"]), "with o as (select o_custkey, string_agg(o_orderstatus, '' order by o_orderstatus) s from orders where o_orderkey % 5 <> 0 group by 1), n as (select o_custkey, string_agg(o_orderstatus, '' order by o_orderstatus) s from orders group by 1) select n.o_custkey, case when o.s is null then 'added' else 'changed' end status, case when o.s is null then '' else 'o_orderstatus' end \"columns\" from n left join o using (o_custkey) where o.s is null or o.s <> n.s"),
    ("v14_observations", lambda t: R.new_observations(t.events.filter("event_id % 3 = 0").select("user_id", "event_type", F.col("ts").cast("date").alias("day")), t.events.filter("event_id % 2 = 0").select("user_id", "event_type", F.col("ts").cast("date").alias("day")), ["user_id", "event_type", "day"], "user_id").groupBy("action").agg(F.count("*").alias("n")), "with e as (select *, cast(ts as date) as day from events), k as (select distinct user_id, event_type, day from e where event_id % 2 = 0), u as (select distinct user_id from k) select case when k.user_id is not null then 'repeat' when u.user_id is not null then 'observation' else 'new' end \"action\", count(*) n from (from e where event_id % 3 = 0) i left join k using (user_id, event_type, day) left join u on u.user_id = i.user_id group by 1"),
    ("v18_work_status", lambda t: R.work_status(t.orders.select("o_orderkey", T.fingerprint("o_orderpriority", "o_orderstatus").alias("fp")), old_and_new(t)[1].select("o_orderkey", T.fingerprint("o_orderpriority", "o_orderstatus").alias("fp")), "o_orderkey", "fp").groupBy("status").agg(F.count("*").alias("n")), SNAP + " select case when n.o_orderkey is null then 'missing' when n.o_orderstatus = a.o_orderstatus then 'cached' else 'stale' end status, count(*) n from orders a left join n using (o_orderkey) group by 1"),
    ("i01_duplicate_tiers", tiers, TIERS),
    ("i03_bad_ids", lambda t: I.bad_ids(t.orders.select(F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit(" "), F.col("o_custkey"))).otherwise(F.col("o_orderkey").cast("string")).alias("k")), "k").groupBy("problem").agg(F.count("*").alias("n")), "with k as (select case when o_orderkey % 50 = 0 then ' ' || o_custkey else o_orderkey::varchar end k from orders), c as (select k, count(*) over (partition by k) n from k) select case when trim(k) <> k then 'untrimmed' else 'repeated' end problem, count(*) n from c where trim(k) <> k or n > 1 group by 1"),
    ("i06_components", component_query, COMPONENTS),
    ("h01_greedy_cover", greedy, GREEDY),
    ("h04_incidence", lambda t: I.incidence_rows(t.lineitem, "l_suppkey", "l_partkey"), "with e as (select distinct l_suppkey, l_partkey from lineitem) select substr(sha256(l_suppkey::varchar), 1, 16) owner_key, l_partkey, count(*) over (partition by l_suppkey) degree from e"),
    ("a31_degrees", lambda t: I.degree_distribution(t.lineitem, "l_suppkey", "l_partkey"), "with d as (select l_suppkey, count(distinct l_partkey) degree from lineitem group by 1) select degree, count(*) owners from d group by 1"),
    ("a23_coverage", lambda t: A.coverage(t.mentions, "dataset", t.part.filter("p_size < 25").select("p_name"), "p_name"), f"{WITH}, k as (select distinct p_name from part where p_size < 25) select count(*) mentions, count(*) filter (dataset in (from k)) matched_mentions, count(distinct dataset) entities, count(distinct dataset) filter (dataset in (from k)) matched_entities from mention"),
    ("a24_review", lambda t: A.review(t.mentions, "product", t.part.filter("p_size < 10").select("p_brand"), "p_brand").select("product", "mentions", "records", "first_record", "examples", "matched"), f"{WITH}, p as (select product, record_id, count(*) c, row_number() over (partition by product order by record_id) r from mention group by 1, 2) select product, cast(sum(c) as bigint) mentions, count(*) records, min(record_id) first_record, string_agg(record_id::varchar, ',' order by record_id) filter (r <= 10) examples, product in (select p_brand from part where p_size < 10) matched from p group by 1"),
    ("a25_alias_audit", lambda t: A.alias_audit(t.part, "p_name", "p_brand"), "select p_brand, count(distinct p_name) forms, count(*) \"rows\", min(p_name) first_form from part group by 1 having count(distinct p_name) > 1"),
    ("a26_facets", facets, FACETS),
    ("a26_span", lambda t: A.span(t.mentions, t.part.filter("p_size > 40").select(F.col("p_brand").alias("product"), F.col("p_type").alias("domain")), "product", "domain").groupBy("span").agg(F.count("*").alias("n")), f"{WITH}, w as (select p_brand product, count(distinct p_type) w from part where p_size > 40 group by 1), b as (select record_id, max(coalesce(w, 0)) w from mention left join w using (product) group by 1) select case when w = 0 then 'none' when w = 1 then 'within' else 'cross' end span, count(*) n from b group by 1"),
    ("a27_label_histogram", lambda t: A.label_count_histogram(t.labels, t.records, "domain"), f"{WITH}, k as (select record_id, count(*) k from lab group by 1) select coalesce(k, 0) \"labels\", count(*) records from rec left join k using (record_id) group by 1"),
    ("a27_modal_partner", lambda t: A.modal_partner(t.labels, t.records, "domain", "environment", 3), f"{WITH}, p as (select domain, environment, count(*) n from lab join rec using (record_id) group by all), tot as (select domain, count(*) total from lab group by 1 order by total desc, domain limit 3) select tot.domain, p.environment, p.n, tot.total, p.n * 2 > tot.total coupled from tot join p using (domain) qualify row_number() over (partition by tot.domain order by p.n desc, p.environment) = 1"),
    ("a28_column_profile", lambda t: P.column_profile(t.documents, ["lang", "source", "text"]), "select 'lang' as \"column\", count(*) \"rows\", count(*) filter (lang is null) nulls, count(*) filter (trim(lang) = '') blanks, count(distinct lang) \"values\", quantile_cont(length(lang), 0.5) median_length, cast(max(length(lang)) as int) longest from documents union all select 'source', count(*), count(*) filter (source is null), count(*) filter (trim(source) = ''), count(distinct source), quantile_cont(length(source), 0.5), cast(max(length(source)) as int) from documents union all select 'text', count(*), count(*) filter (text is null), count(*) filter (trim(text) = ''), count(distinct text), quantile_cont(length(text), 0.5), cast(max(length(text)) as int) from documents"),
    ("a28_json_keys", lambda t: P.json_key_profile(t.events, "props"), "with k as (select unnest(json_keys(props::json)) \"key\" from events) select \"key\", count(*) \"rows\" from k group by 1"),
    ("a29_duplicate_texts", lambda t: P.duplicate_profile(t.documents, F.col("text")), "with g as (select text, count(*) c from documents where text is not null group by 1 having count(*) > 1) select count(*) \"groups\", cast(coalesce(sum(c), 0) as bigint) records, cast(coalesce(sum(c - 1), 0) as bigint) excess from g"),
    ("a30_shared_targets", lambda t: P.shared_targets(t.lineitem, "l_orderkey", "l_partkey"), "with d as (select l_partkey, count(distinct l_orderkey) degree from lineitem group by 1) select degree, count(*) targets from d group by 1"),
    ("g04_stratified", lambda t: G.stratified(t.orders, "o_orderpriority", "o_orderkey", 20, 7).select("o_orderkey", "o_orderpriority", "draw"), None),
    ("g08_assignments", lambda t: G.assignments(t.nation, t.region, "n_nationkey", "r_regionkey", 11), None),
]
