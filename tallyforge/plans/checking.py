"""Validation, review, replay and register queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as G
from ..operators import register as Reg
from ..operators import relations as R
from ..operators import validation as V
from .bind import PAIRS, RATINGS, WITH
from .relating import SNAP, old_and_new


def raw_register(t):
    """Orders as raw register rows: customers as projects, order months as titles."""
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("Project Number"), F.date_format("o_orderdate", "yyyy").alias("Project Name"), F.col("c_name").alias("Accredited Researchers"), F.concat(F.lit("Digital Economy Act "), "o_orderstatus").alias("Legal Gateway"),
        F.concat(F.lit("P: "), "o_orderpriority").alias("Protected Data Accessed"), F.lit("E").alias("Processing Environment"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Accreditation Date"), F.col("o_orderkey").alias("row_ix"),
    )


REGISTER = """with g as (select o_custkey k, year(o_orderdate) y, count(*) n, count(distinct cast(o_orderdate as date)) d, count(distinct o_orderstatus) s, count(distinct o_orderpriority) p from orders group by all)
select count(*) filter (tier = 0) alone, count(*) filter (tier = 1) first_kept, count(*) filter (tier = 2) merged, count(*) filter (tier = 3) flagged from (select case when n = 1 then 0 when d > 1 or s > 1 then 3 when p = 1 then 1 else 2 end tier, case when n > 1 and not (d > 1 or s > 1) then 1 else n end rows_left from g) x, range(cast(rows_left as bigint))"""


def register_tiers(t):
    c = Reg.cleaned(raw_register(t))
    return c.agg(*[F.count_if(F.col("tier") == i).alias(n) for i, n in enumerate(("alone", "first_kept", "merged", "flagged"))])


def owners(t):
    f = t.lineitem.join(t.records.select(F.col("record_id").alias("l_orderkey"), "official_id", "yr"), "l_orderkey")
    return V.owner_summary(f, "l_suppkey", "l_orderkey", "official_id", "yr")


OWNERS = """with f as (select l_suppkey, l_orderkey, o_custkey, cast(year(o_orderdate) as int) yr from lineitem join orders on o_orderkey = l_orderkey), d as (select distinct l_suppkey, l_orderkey from f),
p as (select a.l_suppkey, count(distinct b.l_suppkey) c from d a join d b on a.l_orderkey = b.l_orderkey and a.l_suppkey <> b.l_suppkey group by 1)
select f.l_suppkey, count(distinct l_orderkey) records, count(distinct o_custkey) projects, min(yr) first_year, max(yr) last_year, coalesce(max(p.c), 0) shared_with from f left join p using (l_suppkey) group by 1"""


def prefixes(t):
    order = t.supplier.select(F.col("s_suppkey").cast("int").alias("pos"), F.col("s_suppkey").alias("l_suppkey"))
    big = t.part.filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return V.prefix_concentration(order, "pos", "l_suppkey", t.lineitem, "l_partkey", big, [5, 20, 80])


PREFIX = """with c as (select l_partkey, min(l_suppkey) p from lineitem group by 1), m as (select c.*, (p_size > 40)::int m from c join part on p_partkey = l_partkey), s as (select cast(unnest([5, 20, 80]) as int) "prefix")
select "prefix", count(*) filter (p <= "prefix") covered, cast(coalesce(sum(m) filter (p <= "prefix"), 0) as bigint) marked, (select count(*) from m) items, (select cast(sum(m) as bigint) from m) marked_items from s, m group by 1"""


def chosen(t):
    """A register-like filter over orders: environment, text, dataset of a collection."""
    r = t.records.select(F.col("record_id").cast("string").alias("record_id"), F.col("environment"), F.col("basis").alias("title"), F.col("official_id").cast("string").alias("researchers"))
    m = t.mentions.select(F.col("record_id").cast("string").alias("record_id"), "dataset", "provider")
    c = t.part.select(F.col("p_name").alias("dataset"), F.col("p_type").alias("collection")).distinct()
    return Reg.filtered(r, m, c, environment="2-HIGH", dataset="collection::PROMO", text="1").select("record_id")


QUERIES = [
    ("i04_register_tiers", register_tiers, REGISTER),
    ("f06_combined_filter", chosen, f"{WITH} select record_id::varchar record_id from rec where environment = '2-HIGH' and (contains(record_id::varchar, '1') or contains(lower(basis), '1') or contains(official_id::varchar, '1')) and record_id in (select record_id from mention where dataset in (select p_name from part where p_type = 'PROMO'))"),
    ("d02_date_keys", lambda t: t.orders.select("o_orderkey", Reg.date_key(F.when(F.col("o_orderkey") % 3 == 0, F.lit(" Soon ")).otherwise(F.col("o_orderdate").cast("string"))).alias("k")), "select o_orderkey, case when o_orderkey % 3 = 0 then 'soon' else strftime(o_orderdate, '%Y-%m-%d') end k from orders"),
    ("r04_collection_rows", lambda t: Reg.collection_rows(t.part.select(F.col("p_name").alias("dataset"), F.when(F.col("p_size") > 25, F.array("p_type", "p_brand")).alias("collections"))).groupBy("shown").agg(F.count("*").alias("n")), "select shown, count(*) n from (select unnest(case when p_size > 25 then [p_type, p_brand] else [p_name] end) shown from part) group by 1"),
    ("r11_cell_differences", lambda t: V.cell_differences(*[x.join(t.orders.filter("o_orderdate < timestamp '1998-01-01'").select("o_orderkey"), "o_orderkey", "left_semi") for x in old_and_new(t)], "o_orderkey", {"blanked": F.col("b") == "X"}).groupBy("column", "verdict").agg(F.count("*").alias("n")), SNAP + ", d as (select o.o_orderkey k, o.o_orderstatus a, n.o_orderstatus b, n.o_orderkey is null gone from o left join n using (o_orderkey)), x as (select 'o_orderstatus' as \"column\", case when gone then 'unaccepted' else 'blanked' end verdict from d where gone or a <> b union all select 'o_orderpriority', 'unaccepted' from d where gone) select \"column\", verdict, count(*) n from x group by all"),
    ("m12_usable", lambda t: V.usable(t.labels.select("record_id", "domain"), "record_id", "domain", ["ASIA", "EUROPE"]).groupBy("usable").agg(F.count("*").alias("n")), f"{WITH}, v as (select record_id, count(*) filter (domain in ('ASIA', 'EUROPE')) >= 2 usable from mention group by 1) select usable, count(*) n from v group by 1"),
    ("m13_owner_patterns", lambda t: V.owner_patterns(t.ratings.withColumn("v", F.array_join("labels", "|")), "record_id", "rater", "v").groupBy("pattern").agg(F.count("*").alias("n")), f"with {RATINGS}, k as (select record_id, count(distinct rater) o, count(distinct array_to_string(labels, '|')) v from ratings group by 1) select case when o = 1 then 'one' when v = 1 then 'concordant' else 'mixed' end \"pattern\", count(*) n from k group by 1"),
    ("m20_review_agreement", lambda t: V.review_agreement(G.paired(t.run(1, 3), t.run(2, 7), "record_id", ["domains"]), "domains_a", "domains_b"), PAIRS + " select count(*) reviewed, count(*) filter (a = b) exact, count(*) filter (i > 0) overlapping from pr"),
    ("v05_issues", lambda t: V.issues(t.orders, "o_orderkey", {"cheap": ("warning", F.col("o_totalprice") < 5000), "open": ("fatal", F.col("o_orderstatus") == "P")}).groupBy("issue", "severity").agg(F.count("*").alias("n")), "select 'cheap' issue, 'warning' severity, count(*) n from orders where o_totalprice < 5000 having count(*) > 0 union all select 'open', 'fatal', count(*) from orders where o_orderstatus = 'P' having count(*) > 0"),
    ("v07_complete_panels", lambda t: V.complete_panels(t.ratings, "record_id", "rater", t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("record_id"))), f"with {RATINGS} select record_id from ratings where record_id not in (select o_orderkey from orders where o_orderstatus = 'P') group by 1 having count(*) = 3 and count(distinct rater) = 3"),
    ("v08_adjudication", lambda t: V.adjudication(t.lineitem, "l_partkey", "l_orderkey", "l_returnflag", {"bulk": F.col("l_quantity") >= 50}).select("l_partkey", F.array_join("reasons", ",").alias("reasons"), "records", "streams", "supported"), "select l_partkey, case when bool_or(l_quantity >= 50) then 'bulk' else '' end reasons, count(distinct l_orderkey) records, count(distinct l_returnflag) streams, count(distinct l_orderkey) >= 2 or count(distinct l_returnflag) >= 2 supported from lineitem group by 1"),
    ("v09_anomalies", lambda t: V.anomalies(t.orders.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p")), {"few": (True, F.col("n") < 10), "partial": (False, F.col("p") > 0)}), "select 'partial' anomaly, false blocking where exists (select 1 from orders where o_orderstatus = 'P')"),
    ("o06_queue", lambda t: V.queue(t.part.groupBy("p_name").agg(F.count("*").alias("n")), "n", "p_name", 10), "with n as (select p_name, count(*) n from part group by 1) select p_name, n, cast(row_number() over (order by n desc, p_name) as int) place, greatest(count(*) over () - 10, 0) more from n qualify place <= 10"),
    ("a32_owner_summary", owners, OWNERS),
    ("a33_prefix_concentration", prefixes, PREFIX),
    ("v02_same_keys", lambda t: R.key_sets(t.records.select(F.col("record_id").alias("k")), t.labels.select(F.col("record_id").alias("k")), "k"), f"{WITH}, l as (select distinct record_id from mention) select (select count(*) from rec where record_id not in (from l)) only_a, (select count(*) from l where record_id not in (select record_id from rec)) only_b, (select count(*) from rec where record_id in (from l)) common"),
]
