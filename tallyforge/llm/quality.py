"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each document gets a few rates, as whole millionths. For every (language, source) a sketch of each rate is kept: counts
of bins whose width is at most 1/32 of their value. Such sketches merge by adding counts, need no order and give the
same answer for any partitioning; all their arithmetic is on whole numbers. A group's sketch is merged with that of its
language, scaled to `prior` rows, and that of all documents, scaled alike, so small groups lean on their parents and
large ones on themselves, without a switch. The limit of a rate comes from the merged sketch alone: the larger of its far-out fence,
q75 + 3 * (q75 - q25), and of the cut between its two classes, the middle of the means of the two parts with the largest
variance between them (where one holds junk, the cut lies in the gap; where none does, the fence is the larger one).
A document fails where a rate lies above the limit of its group.

Nulls: a null text has no words (base_failed); null language or source are groups of their own. Repeated rows are
judged alike and count each. Ties: a rate equal to its limit passes; of cuts that are equally good the lowest holds.
Very long texts are held whole, with one hash a word, in one row. Empty tables give empty results. Other columns pass
through the stage untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, null_safe_key, packed, unpacked, words

RATES = ("symbols_per_word", "upper_share", "dup_line_share", "word_length")
UNIT = 1_000_000
WINDOW = 8
#: Rows of the language's and of all documents' sketch that a group's own sketch is merged with.
PRIOR = 50


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and RATES, in millionths (symbols_per_word at most 1)."""
    kept = docs.columns
    a = docs.select(*kept, words(F.col(text)).alias("_w"), F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    solid = F.array_join("_w", "")
    b = a.select(
        *kept, "_w", F.size("_w").cast("long").alias("n_words"), F.length(solid).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(solid, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.length(F.regexp_replace(solid, r"[^\p{Lu}]+", "")).alias("_upper"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size("_lines").alias("_n_lines"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(WINDOW)]))
    rest = [c for c in b.columns if c not in ("_w", "_h")]
    c = b.select(*rest, F.when(F.size("_h") >= WINDOW, windows).alias("_win"))
    # only texts in which a window occurs twice are sorted
    twice = F.size(F.array_distinct("_win")) < F.size("_win")
    d = c.select(*rest, F.when(twice, F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    hit = F.filter(F.transform("_s", lambda x, i: F.when((F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())
    e = d.select(*rest, F.array_sort(hit).alias("_m"))
    covered = F.aggregate("_m", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")))["n"]
    f = e.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    f = f.withColumns({"base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))})
    rate = lambda x, y: F.when(F.col(y) > 0, F.expr(f"cast({x} as bigint) * {UNIT} div {y}")).otherwise(F.lit(0))
    rates = {"symbols_per_word": F.least(rate("n_symbols", "n_words"), F.lit(UNIT)), "upper_share": rate("_upper", "word_chars"), "dup_line_share": rate("n_dup_lines", "_n_lines"), "word_length": rate("word_chars", "n_words")}
    return f.withColumns({k: v.cast("long") for k, v in rates.items()}).drop("_upper", "_n_lines")


def binned(x: str) -> str:
    """SQL for the lower end of the bin that a whole number x >= 0 lies in: its six leading binary digits."""
    return f"{x} - {x} % cast(power(2, greatest(length(bin({x})) - 6, 0)) as bigint)"


def sketches(measured: DataFrame, by: list[str], rates=RATES) -> DataFrame:
    """(by..., metric, bin, n): the sketches of all rates; merging is adding n."""
    named = F.explode(F.array(*[F.struct(F.lit(r).alias("metric"), F.expr(binned(r)).alias("bin")) for r in rates])).alias("_x")
    return measured.select(*by, named).select(*by, "_x.metric", "_x.bin").groupBy(*by, "metric", "bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """One row per (by, metric) of sketches: rows and the quantile for each name in at, the rows of a bin lying evenly in it."""
    group = Window.partitionBy(*by, "metric")
    run = sketch.withColumns({"_run": F.sum("n").over(group.orderBy("bin")), "rows": F.sum("n").over(group)})
    wide = F.expr("power(2, greatest(length(bin(cast(bin as bigint))) - 6, 0))")
    value = lambda p: F.col("bin") + wide * (F.col("rows") * p - F.col("_run") + F.col("n")) / F.col("n")
    return run.groupBy(*by, "metric").agg(F.max("rows").alias("rows"), *[F.min(F.when(F.col("_run") >= F.col("rows") * p, value(p))).alias(name) for name, p in at.items()])


def merged_with_parents(sketch: DataFrame, prior: int = PRIOR, scale: int = 1000) -> DataFrame:
    """(lang_key, source_key, metric, bin, n) -> the same for every group, n in parts of `scale`, with `prior` rows of each parent."""
    parts = [sketch.select("lang_key", "source_key", "metric", "bin", (F.col("n") * scale).alias("n"))]
    groups = sketch.select("lang_key", "source_key", "metric").distinct()
    for by in (["lang_key"], []):
        parent = sketch.groupBy(*by, "metric", "bin").agg(F.sum("n").alias("n"))
        rows = F.sum("n").over(Window.partitionBy(*by, "metric"))
        parent = parent.withColumn("_rows", rows).select(*by, "metric", "bin", F.expr(f"n * {scale * prior} div _rows").alias("n"))
        parts.append(groups.join(parent, [*by, "metric"]).select("lang_key", "source_key", "metric", "bin", "n"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("lang_key", "source_key", "metric", "bin").agg(F.sum("n").alias("n")).filter("n > 0")


def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, limit) of sketches: the larger of the far-out fence and the cut between two classes."""
    group = Window.partitionBy(*by, "metric")
    run = sketch.select(*by, "metric", "bin", F.col("n").cast("decimal(38,0)").alias("n"))
    run = run.withColumns({"_c": F.sum("n").over(group.orderBy("bin")), "_s": F.sum(F.expr("cast(n * bin as decimal(38,0))")).over(group.orderBy("bin"))})
    run = run.withColumns({"_n": F.max("_c").over(group), "_t": F.max("_s").over(group)})
    run = run.withColumns({"_low": F.expr("cast(_s as double) / cast(_c as double)"), "_high": F.expr("case when _n > _c then cast(_t - _s as double) / cast(_n - _c as double) end")})
    run = run.withColumn("_between", F.expr("cast(_c as double) * cast(_n - _c as double) * ((_high - _low) * (_high - _low))"))
    quartile = lambda k: F.min(F.when(F.col("_c") * 4 >= F.col("_n") * k, F.col("bin")))
    best = F.min(F.when(F.col("_between").isNotNull(), F.struct((-F.col("_between")).alias("b"), "bin", ((F.col("_low") + F.col("_high")) / 2).alias("cut"))))
    found = run.groupBy(*by, "metric").agg(quartile(1).alias("q25"), quartile(3).alias("q75"), best.alias("_best"))
    fence = (4 * F.col("q75") - 3 * F.col("q25")).cast("double")
    return found.select(*by, "metric", F.greatest(fence, F.coalesce("_best.cut", fence)).alias("limit"))


def thresholds(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang_key, source_key, limit_<rate>...) for every group of measured."""
    base = materialize(sketches(measured, ["lang_key", "source_key"]), "quality-sketches")
    found = limits(merged_with_parents(base, prior), ["lang_key", "source_key"])
    return found.groupBy("lang_key", "source_key").agg(*[F.max(F.when(F.col("metric") == r, F.col("limit"))).alias(f"limit_{r}") for r in RATES])


def judged(measured: DataFrame, prior: int = PRIOR, salts: int = 8) -> DataFrame:
    """measured (with base_failed and rates) plus kept. The group limits are joined on salted keys, as a source may hold a third of all rows."""
    keyed = measured.withColumns({"lang_key": null_safe_key(F.col("lang")), "source_key": null_safe_key(F.col("source"))})
    found = materialize(thresholds(keyed, prior), "quality-limits")
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = keyed.withColumn("_salt", F.pmod(F.hash("doc_id", "n_words", "word_chars"), F.lit(salts))).join(found, ["lang_key", "source_key", "_salt"])
    passes = ~F.col("base_failed")
    for r in RATES:
        passes = passes & (F.col(r) <= F.col(f"limit_{r}"))
    return both.withColumn("kept", passes).drop("_salt", "lang_key", "source_key", *[f"limit_{r}" for r in RATES])


def op4_adaptive_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    measured = materialize(with_metrics(docs).drop("text"), "quality-metrics")
    return judged(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    measured = materialize(with_metrics(packed(docs)), "quality-documents")
    return unpacked(judged(measured).filter("kept"), docs.columns)


def _sql() -> str:
    """The whole operator for DuckDB."""
    space = r"\x20\x09-\x0D"
    rates = {"symbols_per_word": f"least(case when n_words > 0 then n_symbols * {UNIT} // n_words else 0 end, {UNIT})", "upper_share": f"case when word_chars > 0 then n_upper * {UNIT} // word_chars else 0 end", "dup_line_share": f"case when n_lines > 0 then n_dup_lines * {UNIT} // n_lines else 0 end", "word_length": f"case when n_words > 0 then word_chars * {UNIT} // n_words else 0 end"}
    named = " union all ".join(f"select lang, source, '{r}' as metric, {r} - {r} % (1::bigint << greatest(length(bin({r})) - 6, 0)) as bin from measured" for r in RATES)
    passes = " and ".join(f"m.{r} <= l.limit_{r}" for r in RATES)
    pivot = ", ".join(f"max(case when metric = '{r}' then lim end) as limit_{r}" for r in RATES)
    return f"""
with docs as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
cut as (select *, regexp_extract_all(t, '[^{space}]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as lines from docs),
windows as (select rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as x from (select rid, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from cut where len(w) >= {WINDOW})),
twice as (select rid, i, lag(i) over (partition by rid order by i) as p from (select rid, i, count(*) over (partition by rid, x) as c from windows) where c > 1),
repeats as (select rid, sum(least({WINDOW}, i - coalesce(p, i - {WINDOW}))) as n from twice group by rid),
counted as (select c.rid, doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g'))::bigint as n_upper, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from cut c left join repeats r on c.rid = r.rid),
measured as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {", ".join(f"{v} as {k}" for k, v in rates.items())} from counted),
base as (select lang, source, metric, bin, count(*) as n from ({named}) group by all),
groups as (select distinct lang, source, metric from base),
by_lang as (select lang, metric, bin, sum(n) as n, sum(sum(n)) over (partition by lang, metric) as rows_ from base group by lang, metric, bin),
by_all as (select metric, bin, sum(n) as n, sum(sum(n)) over (partition by metric) as rows_ from base group by metric, bin),
merged as (select lang, source, metric, bin, sum(n)::hugeint as n from (
  select lang, source, metric, bin, n * 1000 as n from base
  union all select g.lang, g.source, g.metric, p.bin, p.n * {1000 * PRIOR} // p.rows_ from groups g join by_lang p on g.lang is not distinct from p.lang and g.metric = p.metric
  union all select g.lang, g.source, g.metric, p.bin, p.n * {1000 * PRIOR} // p.rows_ from groups g join by_all p on g.metric = p.metric) group by all having sum(n) > 0),
run as (select *, (sum(n) over up)::hugeint as c, (sum(n * bin) over up)::hugeint as s, (sum(n) over whole)::hugeint as nn, (sum(n * bin) over whole)::hugeint as tt from merged
  window up as (partition by lang, source, metric order by bin), whole as (partition by lang, source, metric)),
means as (select *, s::double / c::double as low, case when nn > c then (tt - s)::double / (nn - c)::double end as high from run),
cuts as (select *, c::double * (nn - c)::double * ((high - low) * (high - low)) as between_ from means),
best as (select lang, source, metric, (low + high) / 2 as cut from cuts where between_ is not null qualify row_number() over (partition by lang, source, metric order by between_ desc, bin) = 1),
quart as (select lang, source, metric, min(case when c * 4 >= nn then bin end) as q25, min(case when c * 4 >= nn * 3 then bin end) as q75 from run group by all),
lim as (select q.lang, q.source, q.metric, greatest((4 * q75 - 3 * q25)::double, coalesce(b.cut, (4 * q75 - 3 * q25)::double)) as lim from quart q left join best b on q.lang is not distinct from b.lang and q.source is not distinct from b.source and q.metric = b.metric),
wide as (select lang, source, {pivot} from lim group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {passes} as kept
from measured m join wide l on m.lang is not distinct from l.lang and m.source is not distinct from l.source"""


OP4_SQL = _sql()
