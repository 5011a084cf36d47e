"""Counting, cross-tabulation and uptake queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import crosstabs as X
from ..operators import relations as R
from ..operators import uptake as U
from .bind import REGIONS, WITH

TREND = f"""{WITH}, tot as (select yr, count(*) total from rec group by yr), cell as (select t.yr, d.domain, t.total from tot t cross join (select distinct domain from mention) d),
cnt as (select rec.yr, lab.domain, count(*) n from rec join lab using (record_id) group by all)
select cell.yr, cell.domain, coalesce(cnt.n, 0) n, cell.total, coalesce(cnt.n, 0) / cast(cell.total as double) share from cell left join cnt using (yr, domain)"""
COOC = f"""{WITH}, pair as (select a.domain a, b.domain b, count(*) n from lab a join lab b on a.record_id = b.record_id and a.domain <> b.domain group by all),
solo as (select min(domain) a, min(domain) b from lab group by record_id having count(*) = 1), diag as (select a, b, count(*) n from solo group by all)"""
CLOSED = f"""{WITH}, k as (select * from lab where domain <> 'EUROPE'), s as (select record_id, count(*) c from k group by 1), v as (select unnest({REGIONS}) r),
n as (select x.domain a, y.domain b, count(*) n from k x join k y using (record_id) join s using (record_id) where x.domain <> y.domain or c = 1 group by all)
select p.r a, q.r b, coalesce(n, 0) n from v p cross join v q left join n on a = p.r and b = q.r"""
ADOPT = f"""{WITH}, cal as (select cast(unnest(generate_series(cast((select min(q) from rec) as timestamp), cast((select max(q) from rec) as timestamp), interval 3 month)) as date) period),
tot as (select q period, count(*) total from rec group by all), use as (select distinct record_id, collection line, product from mention),
n as (select line, q period, count(distinct record_id) projects, count(*) requests from use join rec using (record_id) group by all), st as (select line, min(period) start from n group by all)
select st.line, cal.period, coalesce(n.projects, 0) projects, coalesce(n.requests, 0) requests, coalesce(tot.total, 0) total, coalesce(n.projects, 0) / cast(nullif(coalesce(tot.total, 0), 0) as double) share
from cal join st on cal.period >= st.start left join n on n.line = st.line and n.period = cal.period left join tot on tot.period = cal.period"""


def label_trend(t):
    return C.label_trend(t.records, t.labels, "domain", "yr")


def adoption(t):
    return U.adoption(t.products.select("record_id", F.col("collection").alias("line"), "product"), t.records, "line", "product", "d")


def demand(t):
    m = t.products.select("record_id", F.col("product").alias("line"))
    return U.demand(m, t.records, "line", "d", "1996-01-01")


def quarter_counts(t):
    return C.period_counts(t.records, "q")


def year_growth(t):
    return U.growth(C.period_counts(t.records, "yr"), "yr", "n")


def complete_year_summary(t):
    """Years that have all four quarters: sum, quarters."""
    q = quarter_counts(t).withColumn("yr", F.year("q"))
    return C.series_summary(q, "yr", "n").filter("periods = 4").select("yr", "total", "periods")


def zero_filled_linkage(t):
    """Records by year and basis over the full grid; blank bases leave the total."""
    r = t.records.filter(F.trim("basis") != "")
    total = r.groupBy("yr").agg(F.count("*").alias("total"))
    grid = total.crossJoin(r.select("basis").distinct())  # years x statuses
    n = r.groupBy("yr", "basis").agg(F.count("*").alias("n"))
    return grid.join(n, ["yr", "basis"], "left").na.fill(0, ["n"]).select("yr", "basis", "n", "total")


def tag_share(t):
    urgent = F.col("environment").startswith("1")
    return C.tag_prevalence(t.records, t.labels, urgent, "domain")


def running_coverage(t):
    """Customers first seen by year, and seen so far."""
    return U.running_coverage(t.records, "yr", "official_id")


def coverage_thresholds(t):
    total = t.records.select("official_id").distinct().count()
    return U.thresholds(running_coverage(t), "yr", total, [0.5, 0.9, 1.0]).withColumn("threshold", F.col("threshold").cast("double"))


def rollup(t):
    r = t.records.select("yr", "basis")
    return r.rollup("yr", "basis").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def dense_days(t):
    """Events by day and type over every day, zero-filled."""
    e = t.events.select(F.col("ts").cast("date").alias("day"), "event_type")
    days = U.calendar(e, "day", "interval 1 day", "day").withColumnRenamed("period", "day")
    n = e.groupBy("day", "event_type").agg(F.count("*").alias("n"))
    return days.crossJoin(e.select("event_type").distinct()).join(n, ["day", "event_type"], "left").na.fill(0, ["n"])


EVENTS_SQL = """with e as (select cast(ts as date) as day, event_type from events), days as (select cast(unnest(generate_series(cast((select min(day) from e) as timestamp), cast((select max(day) from e) as timestamp), interval 1 day)) as date) as day)
select days.day, k.event_type, count(e.event_type) n from days cross join (select distinct event_type from e) k left join e on e.day = days.day and e.event_type = k.event_type group by all"""

QUERIES = [
    ("a01_year_counts", lambda t: C.period_counts(t.records, "yr"), "select cast(year(o_orderdate) as int) yr, count(*) n from orders group by all"),
    ("a01_quarter_counts", quarter_counts, "select cast(date_trunc('quarter', o_orderdate) as date) q, count(*) n from orders group by all"),
    ("a02_environment_share", lambda t: C.shares(t.records, "environment"), "select trim(o_orderpriority) environment, count(*) n, cast(sum(count(*)) over () as bigint) total, count(*) / cast(sum(count(*)) over () as double) share from orders where trim(o_orderpriority) <> '' group by 1"),
    ("a03_entity_records", lambda t: C.distinct_records(t.products, "dataset"), f"{WITH} select dataset, count(distinct record_id) records, count(*) mentions from mention group by all"),
    ("a04_top_entities_by_year", lambda t: C.top_entities_by_period(t.products.join(t.records.select("record_id", "yr"), "record_id"), "product", "yr", 5), f"{WITH}, m as (select product, yr, record_id from mention join rec using (record_id)), top as (select product from m group by all order by count(distinct record_id) desc, product limit 5) select product, yr, count(distinct record_id) records from m where product in (from top) group by all"),
    ("a05_headline", lambda t: C.headline(t.records, t.products), f"{WITH}, a as (select official_id, count(*) c, min(yr) lo, max(yr) hi from rec group by all) select cast((select sum(c) from a) as bigint) records, (select count(*) from a) official_ids, (select count(*) from a where c > 1) repeated_ids, (select min(lo) from a) first_year, (select max(hi) from a) last_year, (select count(*) from mention) mentions, (select count(distinct record_id) from mention) records_with_mentions, (select count(*) from (select distinct record_id, product from mention)) requests"),
    ("a06_label_totals", lambda t: C.label_totals(t.labels, "domain"), f"{WITH} select domain, count(*) n from lab group by all"),
    ("a06_label_items", lambda t: C.label_totals(t.labels, "domain", once=False), f"{WITH} select domain, count(*) n from mention group by all"),
    ("a07_label_trend", label_trend, TREND),
    ("a08_ordered_totals", lambda t: C.ordered_totals(t.records, "environment", ["5-LOW", "1-URGENT"]), "with n as (select o_orderpriority environment, count(*) n from orders group by all) select environment, n, cast(row_number() over (order by case environment when '5-LOW' then 1 when '1-URGENT' then 2 else 3 end, environment) as int) place from n"),
    ("a09_zero_filled_linkage", zero_filled_linkage, "with r as (select cast(year(o_orderdate) as int) yr, o_orderstatus basis from orders where trim(o_orderstatus) <> ''), g as (select y.yr, b.basis, y.total from (select yr, count(*) total from r group by all) y cross join (select distinct basis from r) b) select g.yr, g.basis, count(r.basis) n, g.total from g left join r on r.yr = g.yr and r.basis = g.basis group by all"),
    ("a10_crosstab", lambda t: X.crosstab(t.labels, t.products, "domain", "collection").select("domain", "collection", "n"), f"{WITH} select domain, collection, count(*) n from lab join (select distinct record_id, collection from mention) using (record_id) group by all"),
    ("a10_crosstab_wide", lambda t: X.crosstab_wide(t.labels, t.records, "domain", "basis", ["F", "O", "P"]), f"{WITH} select domain, count(*) filter (basis = 'F') as \"F\", count(*) filter (basis = 'O') as \"O\", count(*) filter (basis = 'P') as \"P\" from lab join rec using (record_id) group by all"),
    ("a11_row_share", lambda t: X.crosstab(t.labels, t.records, "domain", "environment"), f"{WITH}, n as (select domain, environment, count(*) n from lab join rec using (record_id) group by all) select domain, environment, n, cast(sum(n) over (partition by domain) as bigint) row_total, n / cast(sum(n) over (partition by domain) as double) row_share from n"),
    ("a12_cooccurrence", lambda t: X.cooccurrence(t.labels, "domain"), COOC + " select * from pair union all select * from diag"),
    ("a13_closed_cooccurrence", lambda t: X.cooccurrence(t.labels, "domain", ("EUROPE",), t.spark.createDataFrame([(r,) for r in REGIONS], "domain string")), CLOSED),
    ("a14_conditional_share", lambda t: X.conditional_share(t.labels, "domain"), COOC + ", tot as (select domain a, count(*) total from lab group by all) select a, b, n, total, n / cast(total as double) p from pair join tot using (a)"),
    ("h05_served_pairs", lambda t: X.served_pairs(t.mentions, "product", "domain"), f"{WITH}, u as (select distinct product, domain from mention) select x.domain a, y.domain b, count(*) units from u x join u y on x.product = y.product and x.domain < y.domain group by all"),
    ("a15_tag_prevalence", tag_share, f"{WITH} select domain, count(*) filter (environment like '1%') tagged, count(*) total, count(*) filter (environment like '1%') / cast(count(*) as double) share from lab join rec using (record_id) group by all having count(*) filter (environment like '1%') > 0"),
    ("a16_tag_by_year", lambda t: C.label_trend(t.records, t.records.select("record_id", "environment"), "environment", "yr").select("yr", "environment", "n", "total"), "with r as (select cast(year(o_orderdate) as int) yr, o_orderpriority environment from orders) select y.yr, e.environment, count(r.yr) n, y.total from (select yr, count(*) total from r group by all) y cross join (select distinct environment from r) e left join r on r.yr = y.yr and r.environment = e.environment group by all"),
    ("a17_first_seen", lambda t: C.first_seen(t.products.join(t.records.select("record_id", "d"), "record_id"), "product", "d"), f"{WITH} select product, min(d) first_seen from mention join rec using (record_id) group by all"),
    ("a18_adoption", adoption, ADOPT),
    ("a19_demand", demand, f"{WITH}, m as (select distinct record_id, product line from mention), n as (select line, count(*) projects, min(d) start from m join rec using (record_id) group by all), x as (select line, projects, cast(greatest(date_diff('day', greatest(start, date '1996-01-01'), (select max(d) from rec)), 0) as int) \"days\" from n) select line, projects, \"days\", projects * 365.25e0 / nullif(\"days\", 0) per_year from x"),
    ("a20_top_and_other", lambda t: C.top_n_and_other(C.distinct_records(t.products, "dataset").select("dataset", "mentions"), "dataset", "mentions", 15), f"{WITH}, n as (select dataset, count(*) mentions, row_number() over (order by count(*) desc, dataset) r from mention group by dataset) select case when r <= 15 then dataset else 'Other' end dataset, cast(sum(mentions) as bigint) mentions from n group by 1"),
    ("a21_pivot_total", lambda t: C.pivoted(t.records.select(F.col("q").cast("string").alias("q"), "basis"), "q", "basis", ["F", "O", "P"]), "select strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') q, count(*) filter (o_orderstatus = 'F') as \"F\", count(*) filter (o_orderstatus = 'O') as \"O\", count(*) filter (o_orderstatus = 'P') as \"P\", count(*) filter (o_orderstatus in ('F', 'O', 'P')) as \"Total\" from orders group by all"),
    ("a21_rollup", rollup, "select cast(year(o_orderdate) as int) yr, o_orderstatus basis, count(*) n, cast(grouping_id(cast(year(o_orderdate) as int), o_orderstatus) as int) as \"level\" from orders group by rollup (cast(year(o_orderdate) as int), o_orderstatus)"),
    ("a22_year_summary", complete_year_summary, "with q as (select date_trunc('quarter', o_orderdate) q, count(*) n from orders group by all) select cast(year(q) as int) yr, cast(sum(n) as bigint) total, count(*) periods from q group by 1 having count(*) = 4"),
    ("w07_year_growth", year_growth, "with n as (select cast(year(o_orderdate) as int) yr, count(*) n from orders group by all) select yr, n, lag(n) over (order by yr) \"before\", (n - lag(n) over (order by yr)) / cast(lag(n) over (order by yr) as double) growth from n"),
    ("w04_running_coverage", running_coverage, "with f as (select o_custkey, min(cast(year(o_orderdate) as int)) yr from orders group by 1), n as (select y.yr, count(f.o_custkey) \"new\" from (select distinct cast(year(o_orderdate) as int) yr from orders) y left join f using (yr) group by all) select yr, \"new\", cast(sum(\"new\") over (order by yr) as bigint) covered from n"),
    ("w05_thresholds", coverage_thresholds, "with f as (select o_custkey, min(cast(year(o_orderdate) as int)) yr from orders group by 1), n as (select yr, count(*) c from f group by all), r as (select yr, sum(c) over (order by yr) covered from n), t as (select cast(unnest([0.5, 0.9, 1.0]) as double) threshold) select threshold, (select min(yr) from r where covered >= threshold * (select count(*) from f)) first_position from t"),
    ("d06_dense_days", dense_days, EVENTS_SQL),
    ("d01_time_fields", lambda t: t.records.select("record_id", "yr", F.quarter("d").alias("qn"), F.concat(F.lit("Q"), F.quarter("d"), F.lit(" "), F.col("yr")).alias("label"), "q", F.dayofyear("d").alias("doy")), "select o_orderkey record_id, cast(year(o_orderdate) as int) yr, cast(quarter(o_orderdate) as int) qn, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) \"label\", cast(date_trunc('quarter', o_orderdate) as date) q, cast(dayofyear(o_orderdate) as int) doy from orders"),
    ("d05_exposure_days", lambda t: t.records.agg(F.max("d").alias("last")).crossJoin(t.records.select("record_id", "d")).select("record_id", U.exposure_days(F.col("d"), F.lit("1997-01-01").cast("date"), F.col("last")).alias("days")), "select o_orderkey record_id, cast(greatest(date_diff('day', greatest(cast(o_orderdate as date), date '1997-01-01'), (select max(cast(o_orderdate as date)) from orders)), 0) as int) \"days\" from orders"),
    ("d08_year_fraction", lambda t: t.records.select("record_id", U.year_fraction(F.col("d")).alias("fraction")), "select o_orderkey record_id, cast(year(o_orderdate) as double) + (dayofyear(o_orderdate) - 1) / cast(365.25 as double) fraction from orders"),
    ("d03_mixed_dates", lambda t: t.records.select("record_id", U.mixed_date(F.when(F.col("record_id") % 4 == 0, F.col("yr").cast("string")).when(F.col("record_id") % 4 == 1, F.concat("yr", F.lit("-Q"), F.quarter("d"))).when(F.col("record_id") % 4 == 2, F.date_format("d", "yyyy-MM")).otherwise(F.col("d").cast("string"))).alias("parsed")), "select o_orderkey record_id, cast(case o_orderkey % 4 when 0 then date_trunc('year', o_orderdate) when 1 then date_trunc('quarter', o_orderdate) when 2 then date_trunc('month', o_orderdate) else cast(o_orderdate as date) end as date) parsed from orders"),
    ("f13_partial_year", lambda t: R.last_period_partial(t.records, "d"), "select cast(year(max(o_orderdate)) as int) \"year\", month(max(o_orderdate)) < 12 is_partial from orders"),
]
