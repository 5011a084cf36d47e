"""Decoding of wide exports, typed issues, panel and batch gates, adjudication, cost and replay checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relations import GateError, gate, outer_with_origin


def checkbox_set(rows: DataFrame, prefix: str, codes: dict[str, str], out: str, required: bool = False) -> DataFrame:
    """Columns prefix___code of 0/1 to a set of labels; a selected code without a label raises; all blank is null or empty."""
    columns = [c for c in rows.columns if c.startswith(f"{prefix}___")]
    unknown = [c for c in columns if c.split("___", 1)[1] not in codes]
    on = lambda c: F.coalesce(F.col(c).cast("string") == "1", F.lit(False))
    if unknown:
        gate(rows.filter(reduce(lambda a, b: a | b, map(on, unknown))).select(*unknown), "selected code without a label")
    known = [c for c in columns if c not in unknown]
    if not known:
        raise GateError(f"no columns {prefix}___")
    got = F.array_sort(F.array_compact(F.array(*[F.when(on(c), F.lit(codes[c.split("___", 1)[1]])) for c in known])))
    blank = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in columns])
    return rows.withColumn(out, F.when(blank, F.lit(None) if required else F.array().cast("array<string>")).otherwise(got))


def typed(rows: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows with strict casts, and (row number, column) of non-blank texts that don't cast."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    cast = {c: F.when(~blank(c), F.col(c).try_cast(t)) for c, t in types.items()}
    bad = F.array_compact(F.array(*[F.when(~blank(c) & cast[c].isNull(), F.lit(c)) for c in types]))
    marked = rows.withColumn("_bad", bad)
    return rows.withColumns(cast), marked.select(*[c for c in rows.columns if c not in types], F.explode("_bad").alias("column"))


def masked(rows: DataFrame, branches: dict[str, tuple[str, Column]]) -> DataFrame:
    """Blanks answers whose branch isn't open (column -> (parent, condition)); ignored lists those that held a value."""
    hidden = {c: ~F.coalesce(cond, F.lit(False)) for c, (_, cond) in branches.items()}
    ignored = F.array_compact(F.array(*[F.when(h & F.col(c).isNotNull(), F.lit(c)) for c, h in hidden.items()]))
    return rows.withColumn("ignored", ignored).withColumns({c: F.when(~h, F.col(c)) for c, h in hidden.items()})


def repeats_joined(rows: DataFrame, owner: str, instrument: str, columns: list[str]) -> DataFrame:
    """A long export split in parents (no instrument) and repeats, each repeat with its parent's columns and a state."""
    parents = rows.filter(F.coalesce(F.col(instrument), F.lit("")) == "").select(owner, *[F.col(c).alias(f"parent_{c}") for c in columns], F.lit(True).alias("_p"))
    repeats = rows.filter(F.coalesce(F.col(instrument), F.lit("")) != "")
    return repeats.join(parents, owner, "left").withColumn("state", F.when(F.col("_p"), "linked").otherwise("orphan")).drop("_p")


def cell_differences(a: DataFrame, b: DataFrame, row: str, accepted: dict[str, Column]) -> DataFrame:
    """(row, column, a, b, verdict) of cells that differ; accepted: name -> condition on columns a and b."""
    columns = [c for c in a.columns if c != row]
    long = lambda df: df.select(row, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(row, columns, "column", "value")
    both = long(a).withColumnRenamed("value", "a").join(long(b).withColumnRenamed("value", "b"), [row, "column"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    verdict = F.lit("unaccepted")
    for name, condition in reversed(accepted.items()):
        verdict = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(verdict)
    return both.withColumn("verdict", verdict)


def renamed_ids(rows: DataFrame, column: str, mapping: DataFrame, separator: str = ";") -> DataFrame:
    """Ids in a separated list replaced by mapping(old, new); order and leading spaces stay."""
    parts = rows.withColumn("_r", F.monotonically_increasing_id()).select("_r", F.posexplode(F.split(F.coalesce(column, F.lit("")), separator)).alias("_p", "_x"))
    named = parts.withColumn("old", F.trim("_x")).join(mapping.select("old", "new"), "old", "left")
    text = F.when(F.col("new").isNull(), F.col("_x")).otherwise(F.concat(F.regexp_extract("_x", r"^\s*", 0), F.col("new")))
    back = named.groupBy("_r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", text.alias("t")))), lambda s: s["t"]), separator).alias("_new"))
    return rows.withColumn("_r", F.monotonically_increasing_id()).join(back, "_r").withColumn(column, F.when(F.col(column).isNotNull(), F.col("_new"))).drop("_r", "_new")


def table_gate(rows: DataFrame, columns: list[str], date: str, least_rows: int, bad_share: float = 0.05) -> None:
    """Columns are there, rows haven't shrunk, at most bad_share of the dates don't parse. One aggregate."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise GateError(f"columns missing: {missing}")
    r = rows.agg(F.count("*").alias("n"), F.count_if(F.try_to_timestamp(F.col(date).cast("string")).isNull()).alias("bad")).first()
    if r["n"] < least_rows:
        raise GateError(f"{r['n']} rows, at least {least_rows} expected")
    if r["bad"] > bad_share * r["n"]:
        raise GateError(f"{r['bad']} of {r['n']} dates don't parse")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """Both tables have the same keys; examples of either side otherwise."""
    both = outer_with_origin(a.select(key).distinct(), b.select(key).distinct(), key)
    gate(both.filter("origin <> 'both'").select(key, "origin"), "key sets differ")


def batch_gate(requested: DataFrame, returned: DataFrame, key: str) -> None:
    gate(returned.groupBy(key).count().filter("count > 1").select(key), "returned twice")
    same_keys(requested, returned, key)


def issues(rows: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, issue, severity) for every rule (issue -> (severity, condition)) that a row breaks."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("issue"), F.lit(s).alias("severity"))) for k, (s, c) in rules.items()]))
    return rows.select(key, F.explode(found).alias("x")).select(key, "x.issue", "x.severity")


def complete_panels(ratings: DataFrame, project: str, rater: str, bad: DataFrame, raters: int = 3) -> DataFrame:
    """Projects without a fatal issue that exactly `raters` different raters have rated once each."""
    ok = ratings.join(bad.select(project).distinct(), project, "left_anti").groupBy(project).agg(F.count("*").alias("_n"), F.countDistinct(rater).alias("_r"))
    return ok.filter((F.col("_n") == raters) & (F.col("_r") == raters)).select(project)


def adjudication(cases: DataFrame, case: str, record: str, stream: str, reasons: dict[str, Column]) -> DataFrame:
    """Cases with their reasons and whether two records or two independent streams support them."""
    found = cases.withColumn("_x", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in reasons.items()])))
    out = found.groupBy(case).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_x")))).alias("reasons"), F.countDistinct(record).alias("records"), F.countDistinct(stream).alias("streams"))
    return out.withColumn("supported", (F.col("records") >= 2) | (F.col("streams") >= 2))


def anomalies(measures: DataFrame, rules: dict[str, tuple[bool, Column]]) -> DataFrame:
    """(anomaly, blocking) of the rules that a one-row table of measures breaks."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("anomaly"), F.lit(b).alias("blocking"))) for k, (b, c) in rules.items()]))
    return measures.select(F.explode(found).alias("x")).select("x.*")


def metric_targets(measures: DataFrame, targets: dict[str, float], digits: int = 3) -> None:
    """Recomputed metrics equal the published ones at so many digits."""
    got = measures.first().asDict()
    off = {k: (got.get(k), v) for k, v in targets.items() if got.get(k) is None or round(got[k], digits) != round(v, digits)}
    if off:
        raise GateError(f"metrics differ: {off}")


def usable(ratings: DataFrame, record: str, value: str, good: list[str], least: int = 2) -> DataFrame:
    """Records that at least `least` raters put in one of the good classes."""
    return ratings.groupBy(record).agg(F.count_if(F.col(value).isin(*good)).alias("votes")).withColumn("usable", F.col("votes") >= least)


def owner_denominators(reviews: DataFrame, owner: str, record: str, complete: str, verdict: str) -> DataFrame:
    """One row: owners, reviews, complete reviews, reviewed records, records with several owners."""
    per = reviews.groupBy(record).agg(F.countDistinct(owner).alias("o"))
    a = reviews.agg(F.countDistinct(owner).alias("owners"), F.count("*").alias("reviews"), F.count_if(complete).alias("complete"), F.count_if(F.col(verdict).isNotNull()).alias("with_verdict"))
    return a.crossJoin(per.agg(F.count("*").alias("records"), F.count_if(F.col("o") > 1).alias("shared_records")))  # one row each


def owner_patterns(reviews: DataFrame, record: str, owner: str, verdict: str) -> DataFrame:
    """Records as one, concordant or mixed by the verdicts of their owners."""
    k = reviews.groupBy(record).agg(F.countDistinct(owner).alias("o"), F.countDistinct(verdict).alias("v"))
    return k.select(record, F.when(F.col("o") == 1, "one").when(F.col("v") == 1, "concordant").otherwise("mixed").alias("pattern"))


def review_agreement(reviews: DataFrame, model: str, human: str) -> DataFrame:
    """Among reviewed records: exact matches and any overlap of label arrays."""
    r = reviews.filter(F.col(human).isNotNull())
    same = F.array_sort(F.array_distinct(model)) == F.array_sort(F.array_distinct(human))
    return r.agg(F.count("*").alias("reviewed"), F.count_if(same).alias("exact"), F.count_if(F.arrays_overlap(model, human)).alias("overlapping"))


def cost(telemetry: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Cache hit rate and price of a run from token counters and prices per million."""
    total = reduce(lambda a, b: a + b, [F.sum(c) * p / 1e6 for c, p in prices.items()])
    hit = F.sum("cache_read") / F.nullif((F.sum("cache_read") + F.sum("cache_created")).cast("double"), F.lit(0.0))
    return telemetry.agg(hit.alias("hit_rate"), total.alias("price"))


def replay(log: DataFrame, recomputed: list[tuple], step: str, name: str) -> None:
    """A recorded order equals the recomputed one."""
    spark = log.sparkSession
    want = spark.createDataFrame([(i + 1, r[0]) for i, r in enumerate(recomputed)], log.select(step, name).schema)
    gate(log.select(step, name).exceptAll(want).union(want.exceptAll(log.select(step, name))), "the recorded order differs")


def reachable_cover(incidence: DataFrame, owner: str, item: str, unreachable: DataFrame, admitted: int, searched: int) -> list[tuple]:
    """Greedy cover with dispositions: (owner, newly covered, admitted?); unreachable owners take a step but cover nothing."""
    edges = incidence.select(owner, item).distinct()
    total = edges.groupBy(owner).agg(F.count("*").alias("t"))
    left, out, good, used = edges, [], 0, []
    while len(out) < searched and good < admitted:
        rest = left.filter(~F.col(owner).isin(used)) if used else left
        best = rest.groupBy(owner).agg(F.count("*").alias("n")).join(total, owner).orderBy(F.desc("n"), F.desc("t"), owner).first()
        if best is None:
            break
        used.append(best[owner])
        ok = unreachable.filter(F.col(owner) == best[owner]).isEmpty()  # asked of picked owners only
        out.append((best[owner], best["n"] if ok else 0, ok))
        if ok:
            good += 1
            left = left.join(edges.filter(F.col(owner) == best[owner]).select(item), item, "left_anti")
    return out


def variant_pairs(people: DataFrame, key: str, name: str) -> DataFrame:
    """Pairs with one surname and initial but different names, both ways; to be reviewed, never merged."""
    parts = F.split(F.lower(F.trim(name)), r"\s+")
    p = people.select(key, F.col(name).alias("n"), F.element_at(parts, -1).alias("s"), F.substring(parts[0], 1, 1).alias("i"))
    q = p.select(F.col(key).alias("other"), F.col("n").alias("m"), "s", "i")
    return p.join(q, ["s", "i"]).filter((F.col(key) != F.col("other")) & (F.col("n") != F.col("m"))).select(key, "other")


def owner_summary(frame: DataFrame, owner: str, record: str, project: str, year: str) -> DataFrame:
    """By owner: records, projects, first and last year, and distinct people they share a record with."""
    base = frame.groupBy(owner).agg(F.countDistinct(record).alias("records"), F.countDistinct(project).alias("projects"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    sets = frame.groupBy(record).agg(F.collect_set(owner).alias("_all")).filter(F.size("_all") > 1)
    pairs = sets.select(F.explode("_all").alias(owner), "_all").select(owner, F.explode("_all").alias("with")).filter(F.col(owner) != F.col("with")).distinct()
    return base.join(pairs.groupBy(owner).agg(F.count("*").alias("shared_with")), owner, "left").na.fill(0, ["shared_with"])


def prefix_concentration(order: DataFrame, position: str, owner: str, incidence: DataFrame, item: str, marker: DataFrame, sizes: list[int]) -> DataFrame:
    """For each prefix of an order: items covered, how many carry the marker, and the same for all items."""
    covered = order.select(position, owner).join(incidence.select(owner, item).distinct(), owner).groupBy(item).agg(F.min(position).alias("p"))
    marked = covered.join(marker.select(item, F.lit(1).alias("m")).distinct(), item, "left")
    rows = marked.select(F.explode(F.array(*[F.struct(F.lit(s).alias("prefix"), (F.col("p") <= s).cast("int").alias("c"), ((F.col("p") <= s).cast("int") * F.coalesce("m", F.lit(0))).alias("k")) for s in sizes])).alias("x"))
    every = incidence.select(item).distinct().join(marker.select(item, F.lit(1).alias("m")).distinct(), item, "left").agg(F.count("*").alias("items"), F.count("m").alias("marked_items"))
    return rows.groupBy("x.prefix").agg(F.sum("x.c").cast("long").alias("covered"), F.sum("x.k").cast("long").alias("marked")).crossJoin(every)


def queue(rows: DataFrame, count: str, name: str, limit: int = 30) -> DataFrame:
    """The largest rows (ties by name) with how many more there are."""
    w = Window.orderBy(F.desc(count), name)  # a queue of distinct names
    n = F.count("*").over(Window.partitionBy())
    return rows.withColumn("place", F.row_number().over(w)).withColumn("more", F.greatest(n - limit, F.lit(0))).filter(F.col("place") <= limit)
