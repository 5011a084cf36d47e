"""Agreement queries: two runs and three raters over the domains of order lines; labels against a text rule; trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as G
from ..operators import counts as C
from ..operators import profile as P
from .bind import PAIRS, RATINGS, REGIONS, run_sql


def pairs(t):
    return G.paired(t.run(1, 3), t.run(2, 7), "record_id", ["domains"])


def flat_ratings(t):
    """(record_id, rater, value): label sets as texts."""
    return t.ratings.select("record_id", "rater", F.array_join("labels", "|").alias("value"))


def alpha(t, distance):
    return G.krippendorff(flat_ratings(t), "record_id", "value", distance).select("units", "ratings", "alpha", "reason")


def masi_text(a, b):
    return G.masi_distance(F.split(a, r"\|"), F.split(b, r"\|"))


ALPHA = f"""with {RATINGS}, c as (select record_id, array_to_string(labels, '|') v, count(*) c from ratings group by 1, 2), m as (select record_id, sum(c) m from c group by 1 having sum(c) >= 2),
k as (select record_id, v, c, m from c join m using (record_id)),
o as (select sum(x) o from (select sum(dist(a.v, b.v) * a.c * b.c) / (max(a.m) - 1) x from k a join k b using (record_id) group by record_id)),
f as (select v, sum(c) n from k group by v), e as (select sum(dist(a.v, b.v) * a.n * b.n) e from f a join f b on a.v <> b.v), t as (select cast(sum(m) as double) n, count(*) u from m)
select u \"units\", cast(n as bigint) ratings, 1 - (o / n) / (e / (n * (n - 1))) alpha, cast(null as varchar) reason from o, e, t"""
NOMINAL = ALPHA.replace("dist(a.v, b.v)", "(case when a.v = b.v then 0e0 else 1e0 end)")
_I, _A, _B = "len(list_intersect(string_split(a.v, '|'), string_split(b.v, '|')))", "len(string_split(a.v, '|'))", "len(string_split(b.v, '|'))"
MASI = ALPHA.replace("dist(a.v, b.v)", f"(1 - {_I} / cast({_A} + {_B} - {_I} as double) * case when {_I} = {_A} and {_I} = {_B} then 1e0 when {_I} = 0 then 0e0 when {_I} = least({_A}, {_B}) then 2e0 / 3 else 1e0 / 3 end)")


def panel(t):
    """Records with three raters and a fourth reading as the model's."""
    wide = G.complete_matrix(flat_ratings(t).withColumn("rater", F.col("rater").cast("string")), "record_id", "rater", "value", ["0", "1", "2"])
    model = t.run(1, 2).select("record_id", F.array_join(F.array_sort("domains"), "|").alias("model"))
    return wide.join(model, "record_id")


def metrics(t, by=()):
    d = t.documents.select("doc_id", "lang", F.coalesce(F.lower("text").rlike("idiot|moron|clown|loser|stupid"), F.lit(False)).alias("p"))
    rows = t.spark.read.parquet(f"{t.dir}/labels.parquet").join(d, "doc_id")
    return G.binary_metrics(rows, F.col("toxic") == 1, F.col("p"), list(by))


_T = "with x as (select lang, toxic = 1 t, regexp_matches(lower(text), 'idiot|moron|clown|loser|stupid') p from labels join documents using (doc_id)), c as (select {g} count(*) filter (t and p) tp, count(*) filter (not t and p) fp, count(*) filter (t and not p) fn, count(*) filter (not t and not p) tn from x {h})"
_M = " select {g} tp, fp, fn, tn, (tp + fn) / cast(nullif(tp + fp + fn + tn, 0) as double) prevalence, tp / cast(nullif(tp + fp, 0) as double) as precision, tp / cast(nullif(tp + fn, 0) as double) recall, 2 * tp / cast(nullif(2 * tp + fp + fn, 0) as double) f1, ((tp + fp + fn + tn) * (tp + tn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))) / cast(nullif((tp + fp + fn + tn) * (tp + fp + fn + tn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)), 0) as double) kappa from c"
BIN, BIN_BY = (_T + _M).format(g="", h=""), (_T + _M).format(g="lang, ", h="group by lang")


def wilson(t):
    c = metrics(t, ["lang"]).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    lo, hi = G.wilson(F.col("tp") + F.col("fn"), F.col("n"))
    return c.select("lang", (F.col("tp") + F.col("fn")).alias("k"), "n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


WILSON = """with c as (select lang, count(*) filter (toxic = 1) k, count(*) n from labels join documents using (doc_id) group by 1), z as (select *, k / cast(n as double) p, 1.959963984540054e0 z from c)
select lang, k, n, round(case when k = 0 then 0e0 else ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4e0 * n * n))) / (1 + z * z / n) end, 9) lo, round(case when k = n then 1e0 else ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4e0 * n * n))) / (1 + z * z / n) end, 9) hi from z"""


def trials(t):
    r = None
    for i, (a, b) in enumerate(((1, 3), (2, 4), (1, 4))):
        x = t.run(a, b).select("record_id", F.lit(i).alias("trial"), "domains")
        r = x if r is None else r.unionAll(x)
    return G.trial_consistency(r, "record_id", "trial", "domains", 3)


TRIALS = "with " + ", ".join(f"t{i} as (select l.l_orderkey record_id, list_sort(list(distinct r.r_name)) s from lineitem l join supplier s on l.l_suppkey=s.s_suppkey join nation n on s.s_nationkey=n.n_nationkey join region r on n.n_regionkey=r.r_regionkey where l.l_linenumber between {a} and {b} group by 1)" for i, (a, b) in enumerate(((1, 3), (2, 4), (1, 4)))) + ", x as (select (t0.s = t1.s)::int + (t0.s = t2.s)::int + (t1.s = t2.s)::int q from t0 join t1 using (record_id) join t2 using (record_id)) select count(*) records, count(*) * 3 pairs, cast(sum(q) as bigint) agreeing, count(*) filter (q = 3) unanimous from x"


def bootstrap(t):
    """Percentile interval of the mean order value over 200 replicates of all orders."""
    means = G.poisson_bootstrap(t.orders, "o_orderkey", "o_totalprice", 200, 20260714)
    return G.bootstrap_interval(means, "mean", 200)


INSTABILITY = PAIRS + f""", {run_sql('rc', 1, 2)}, {run_sql('rd', 3, 7)}, x as (select coalesce(p.record_id, q.record_id) k, coalesce(p.a <> p.b, false) p, coalesce(q.f, false) q from pr p full join (select rc.record_id, rc.s <> rd.s f from rc join rd using (record_id)) q on p.record_id = q.record_id)
select count(*) filter (p) intra, count(*) filter (q) inter, count(*) filter (p and q) "both", count(*) filter (p or q) either, count(*) filter (p and q) / cast(nullif(count(*) filter (p or q), 0) as double) jaccard from x"""

QUERIES = [
    ("r05_set_algebra", lambda t: pairs(t).select("record_id", "domains_exact", "domains_jaccard", F.round(G.masi_distance(F.col("domains_a"), F.col("domains_b")), 9).alias("masi")), PAIRS + " select record_id, a = b domains_exact, i / cast(u as double) domains_jaccard, round(1 - i / cast(u as double) * case when i = u then 1e0 when i = 0 then 0e0 when i = least(len(a), len(b)) then 2e0 / 3 else 1e0 / 3 end, 9) masi from pr"),
    ("m14_agreement_rates", lambda t: G.agreement_rates(pairs(t), "domains").withColumn("mean_jaccard", F.round("mean_jaccard", 9)), PAIRS + " select count(*) n, count(*) filter (a = b) exact, round(avg(i / cast(u as double)), 9) mean_jaccard, count(*) filter (a = b) / cast(count(*) as double) exact_rate from pr"),
    ("u05_flips", lambda t: G.flips(pairs(t), "domains"), PAIRS + ", f as (select unnest(list_filter(a, lambda x: not list_contains(b, x))) \"label\", 1 x, 0 y from pr union all select unnest(list_filter(b, lambda x: not list_contains(a, x))), 0, 1 from pr) select \"label\", cast(sum(x) as bigint) only_a, cast(sum(y) as bigint) only_b from f group by 1"),
    ("m16_substitutions", lambda t: G.substitutions(pairs(t), "domains"), PAIRS + " select array_to_string(a, '; ') a, array_to_string(b, '; ') b, count(*) n from pr where a <> b group by all"),
    ("m17_contested", lambda t: G.contested(pairs(t), "domains", t.spark.createDataFrame([(r,) for r in [*REGIONS, "NOWHERE"]], "label string"), "label"), PAIRS + f", v as (select unnest({[*REGIONS, 'NOWHERE']}) \"label\"), x as (select \"label\", count(*) filter (list_contains(a, \"label\") and list_contains(b, \"label\")) \"both\", count(*) filter (list_contains(a, \"label\") and not list_contains(b, \"label\")) only_a, count(*) filter (not list_contains(a, \"label\") and list_contains(b, \"label\")) only_b, count(*) n from v, pr group by 1) select \"label\", \"both\", only_a, only_b, n - \"both\" - only_a - only_b neither, (only_a + only_b) / cast(nullif(\"both\" + only_a + only_b, 0) as double) contested from x"),
    ("m18_confusion", lambda t: G.confusion(pairs(t), "domains"), PAIRS + " select case when len(a) = 1 and len(b) = 1 then a[1] end a, case when len(a) = 1 and len(b) = 1 then b[1] end b, count(*) n from pr group by 1, 2"),
    ("m15_instability", lambda t: G.instability(pairs(t).select("record_id", (~F.col("domains_exact")).alias("flag")), G.paired(t.run(1, 2), t.run(3, 7), "record_id", ["domains"]).select("record_id", (~F.col("domains_exact")).alias("flag")), "record_id"), INSTABILITY),
    ("m19_trials", trials, TRIALS),
    ("m09_majority_labels", lambda t: G.majority_labels(t.ratings, "record_id", "rater", "labels"), f"with {RATINGS}, x as (select record_id, unnest(labels) \"label\" from ratings) select record_id, \"label\", count(*) votes from x group by all having count(*) >= 2"),
    ("m10_set_patterns", lambda t: G.set_pattern(t.ratings, "record_id", "rater", "labels").groupBy("pattern").agg(F.count("*").alias("n")), f"with {RATINGS}, k as (select record_id, count(distinct rater) r, count(distinct array_to_string(labels, '|')) k from ratings group by 1) select case k when 1 then 'unanimous' when 2 then 'two_vs_one' else 'all_distinct' end \"pattern\", count(*) n from k where r = 3 group by 1"),
    ("m09_categorical_majority", lambda t: G.categorical_majority(flat_ratings(t), "record_id", "value").groupBy("majority").agg(F.count("*").alias("n")), f"with {RATINGS}, c as (select record_id, array_to_string(labels, '|') v, count(*) c from ratings group by 1, 2), m as (select record_id, arg_max(v, (c, v)) v, max(c) c from c group by 1) select case when c >= 2 then v else 'no majority' end majority, count(*) n from m group by 1"),
    ("m11_complete_matrix", lambda t: panel(t).select("record_id", F.col("0").alias("r0"), F.col("1").alias("r1"), F.col("2").alias("r2")), f"with {RATINGS}, w as (select record_id, max(array_to_string(labels, '|')) filter (rater = 0) r0, max(array_to_string(labels, '|')) filter (rater = 1) r1, max(array_to_string(labels, '|')) filter (rater = 2) r2 from ratings group by 1) select w.* from w where r0 is not null and r1 is not null and r2 is not null and record_id in (select l_orderkey from lineitem where l_linenumber <= 2)"),
    ("m01_alpha_nominal", lambda t: alpha(t, G.nominal_distance).withColumn("alpha", F.round("alpha", 9)), NOMINAL.replace("1 - (o / n) / (e / (n * (n - 1))) alpha", "round(1 - (o / n) / (e / (n * (n - 1))), 9) alpha")),
    ("m01_alpha_masi", lambda t: alpha(t, masi_text).withColumn("alpha", F.round("alpha", 9)), MASI.replace("1 - (o / n) / (e / (n * (n - 1))) alpha", "round(1 - (o / n) / (e / (n * (n - 1))), 9) alpha")),
    ("m02_replacement", lambda t: G.replacement(panel(t), ["0", "1", "2"], "model", G.nominal_distance), None),
    ("m03_bootstrap", bootstrap, None),
    ("m04_wilson", wilson, WILSON),
    ("m05_binary_metrics", metrics, BIN),
    ("m07_metrics_by_language", lambda t: metrics(t, ["lang"]), BIN_BY),
    ("m08_support_bands", lambda t: t.documents.groupBy("source").agg(F.count("*").alias("n")).select("source", G.support_band(F.col("n")).alias("band")), "select source, case when count(*) < 10 then '<10' when count(*) < 30 then '10-29' else '>=30' end band from documents group by 1"),
    ("m22_percentiles", lambda t: t.orders.groupBy("o_orderstatus").agg(F.percentile("o_totalprice", F.lit(0.5)).alias("p50"), F.percentile("o_totalprice", F.lit(0.9)).alias("p90")).withColumns({"p50": F.round("p50", 6), "p90": F.round("p90", 6)}), "select o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 6) p50, round(quantile_cont(o_totalprice, 0.9), 6) p90 from orders group by 1"),
    ("m23_linear_trend", lambda t: P.linear_trend(P.indexed_periods(C.period_counts(t.records, "q"), "q"), "t", "n").select("n", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"), F.round("r2", 9).alias("r2")), "with q as (select date_trunc('quarter', o_orderdate) q, count(*) n from orders group by 1), x as (select row_number() over (order by q) - 1 t, n from q) select count(*) n, round(regr_slope(n, t), 9) slope, round(regr_intercept(n, t), 9) intercept, round(regr_r2(n, t), 9) r2 from x"),
    ("m23_poisson_trend", lambda t: t.spark.createDataFrame([tuple(float(v) for v in P.poisson_trend(P.indexed_periods(C.period_counts(t.records, "q"), "q"), "t", "n").values())], "slope double, intercept double, deviance double, aic double"), None),
    ("m24_tf_idf_rows", lambda t: P.tf_idf(t.benchmark, "item_id", "text").groupBy("item_id").agg(F.count("*").alias("terms"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm")), None),
    ("m24_clusters", lambda t: P.text_clusters(t.benchmark, "item_id", "text", 4), None),
    ("m25_correlation", lambda t: t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 9).alias("correlation")), "select round(corr(l_quantity, l_extendedprice), 9) correlation from lineitem"),
]
