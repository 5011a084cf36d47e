"""Agreement of labels between runs and raters: set algebra, pair and panel statistics, alpha, binary metrics, intervals.

Label sets are sorted distinct arrays. Undefined values are null, with a reason where a statistic has one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]


def label_set(c: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Sizes of intersection and union."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def jaccard(a: Column, b: Column, both_empty: float | None = 1.0) -> Column:
    i, u = overlap(a, b)
    return F.when(u == 0, F.lit(both_empty).cast("double")).otherwise(i / u)


def masi_weight(a: Column, b: Column) -> Column:
    """1 for equal sets, 2/3 where one holds the other, 1/3 for overlap, 0 for none."""
    i, u = overlap(a, b)
    return F.when(i == u, F.lit(1.0)).when(i == F.least(F.size(a), F.size(b)), F.when(i == 0, F.lit(0.0)).otherwise(F.lit(2) / F.lit(3))).when(i > 0, F.lit(1) / F.lit(3)).otherwise(F.lit(0.0))


def masi_distance(a: Column, b: Column) -> Column:
    return 1 - jaccard(a, b) * masi_weight(a, b)


def nominal_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(0.0)).otherwise(F.lit(1.0))


def paired(a: DataFrame, b: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """Runs side by side: for each field sets _a and _b, exact, jaccard; rows in both runs only."""
    x = a.select(record, *[label_set(f).alias(f"{f}_a") for f in fields])
    y = b.select(record, *[label_set(f).alias(f"{f}_b") for f in fields])
    both = x.join(y, record)
    cols = {}
    for f in fields:
        p, q = F.col(f"{f}_a"), F.col(f"{f}_b")
        cols |= {f"{f}_exact": p == q, f"{f}_jaccard": jaccard(p, q)}
    return both.withColumns(cols)


def agreement_rates(pairs: DataFrame, field: str) -> DataFrame:
    """Records, exact matches and their rate, mean Jaccard, disagreement in percentage points."""
    out = pairs.agg(F.count("*").alias("n"), F.count_if(f"{field}_exact").alias("exact"), F.avg(f"{field}_jaccard").alias("mean_jaccard"))
    return out.withColumn("exact_rate", F.col("exact") / F.nullif(F.col("n"), F.lit(0).cast("long")))


def flips(pairs: DataFrame, field: str) -> DataFrame:
    """Labels that only one run gave: label, only_a, only_b."""
    a, b = F.col(f"{field}_a"), F.col(f"{field}_b")
    one = pairs.select(F.explode(F.array_except(a, b)).alias("label"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    two = pairs.select(F.explode(F.array_except(b, a)).alias("label"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    return one.unionAll(two).groupBy("label").agg(F.sum("x").cast("long").alias("only_a"), F.sum("y").cast("long").alias("only_b"))


def substitutions(pairs: DataFrame, field: str, joiner: str = "; ") -> DataFrame:
    """Different set pairs and how often they stand against each other."""
    d = pairs.filter(~F.col(f"{field}_exact"))
    return d.groupBy(F.array_join(f"{field}_a", joiner).alias("a"), F.array_join(f"{field}_b", joiner).alias("b")).agg(F.count("*").alias("n"))


def contested(pairs: DataFrame, field: str, vocabulary: DataFrame, label: str) -> DataFrame:
    """By label: records with it in both runs, one, neither, and the contested share of those with it at all."""
    side = lambda c, k: pairs.select(F.explode(c).alias(label), F.lit(k).alias("k"))
    both = F.array_intersect(f"{field}_a", f"{field}_b")
    named = side(both, "both").unionAll(side(F.array_except(f"{field}_a", f"{field}_b"), "a")).unionAll(side(F.array_except(f"{field}_b", f"{field}_a"), "b"))
    n = named.groupBy(label).agg(*[F.count_if(F.col("k") == k).alias(x) for k, x in (("both", "both"), ("a", "only_a"), ("b", "only_b"))])
    out = vocabulary.select(label).join(n, label, "left").na.fill(0).crossJoin(pairs.agg(F.count("*").alias("_n")))
    some = F.col("both") + F.col("only_a") + F.col("only_b")
    return out.select(label, "both", "only_a", "only_b", (F.col("_n") - some).alias("neither"), ((F.col("only_a") + F.col("only_b")) / F.nullif(some, F.lit(0).cast("long"))).alias("contested"))


def confusion(pairs: DataFrame, field: str) -> DataFrame:
    """Single-label records by label of either run; records with several labels under a null pair."""
    a, b = F.col(f"{field}_a"), F.col(f"{field}_b")
    single = (F.size(a) == 1) & (F.size(b) == 1)
    return pairs.groupBy(F.when(single, a[0]).alias("a"), F.when(single, b[0]).alias("b")).agg(F.count("*").alias("n"))


def instability(intra: DataFrame, inter: DataFrame, record: str) -> DataFrame:
    """intra(record, flag), inter(record, flag): counts of either, both, union, and Jaccard."""
    x = intra.select(record, F.col("flag").alias("p")).join(inter.select(record, F.col("flag").alias("q")), record, "full_outer")
    p, q = F.coalesce("p", F.lit(False)), F.coalesce("q", F.lit(False))
    out = x.agg(F.count_if(p).alias("intra"), F.count_if(q).alias("inter"), F.count_if(p & q).alias("both"), F.count_if(p | q).alias("either"))
    return out.withColumn("jaccard", F.col("both") / F.nullif(F.col("either"), F.lit(0).cast("long")))


def trial_consistency(trials: DataFrame, record: str, trial: str, labels: str, n_trials: int) -> DataFrame:
    """Over records in every trial: pairwise exact agreement (agreeing pairs, pairs) and unanimous records."""
    sets = trials.groupBy(record).agg(F.collect_list(F.struct(trial, label_set(labels).alias("s"))).alias("x")).filter(F.size("x") == n_trials)
    pairs = F.filter(F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p["a"][trial] < p["b"][trial])
    agree = F.size(F.filter(pairs, lambda p: p["a"]["s"] == p["b"]["s"]))
    return sets.select(F.size(pairs).alias("p"), agree.alias("q")).agg(F.count("*").alias("records"), F.sum("p").cast("long").alias("pairs"), F.sum("q").cast("long").alias("agreeing"), F.count_if(F.col("p") == F.col("q")).alias("unanimous"))


def majority_labels(ratings: DataFrame, record: str, rater: str, labels: str, least: int = 2) -> DataFrame:
    """Labels that at least `least` raters of a record gave."""
    return ratings.select(record, rater, F.explode(label_set(labels)).alias("label")).groupBy(record, "label").agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)


def set_pattern(ratings: DataFrame, record: str, rater: str, labels: str, raters: int = 3) -> DataFrame:
    """Records with all raters: unanimous, two_vs_one or all_distinct (more sets than that: mixed)."""
    kinds = ratings.groupBy(record).agg(F.countDistinct(rater).alias("r"), F.countDistinct(F.array_join(label_set(labels), "\x1f")).alias("k")).filter(F.col("r") == raters)
    return kinds.select(record, F.when(F.col("k") == 1, "unanimous").when(F.col("k") == raters, "all_distinct").when(F.lit(raters) == 3, "two_vs_one").otherwise("mixed").alias("pattern"))


def categorical_majority(ratings: DataFrame, record: str, value: str, least: int = 2, none: str = "no majority") -> DataFrame:
    """The value that at least `least` ratings of a record have, else none."""
    n = ratings.groupBy(record, value).agg(F.count("*").alias("c")).groupBy(record).agg(F.max(F.struct("c", value)).alias("m"))
    return n.select(record, F.when(F.col("m.c") >= least, F.col(f"m.{value}")).otherwise(none).alias("majority"))


def complete_matrix(ratings: DataFrame, record: str, rater: str, value: str, raters: list[str]) -> DataFrame:
    """One column a rater; only records rated exactly once by each expected rater and by nobody else."""
    ok = ratings.groupBy(record).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col(rater).cast("string"))).alias("r"))
    ok = ok.filter((F.col("n") == len(raters)) & (F.col("r") == F.array(*[F.lit(x) for x in sorted(raters)])))
    return ratings.join(ok.select(record), record, "left_semi").groupBy(record).pivot(rater, raters).agg(F.first(value))


def krippendorff(ratings: DataFrame, unit: str, value: str, distance: Distance) -> DataFrame:
    """Alpha over units with two or more ratings: units, ratings, observed, expected, alpha, reason.

    Both disagreements are worked out from counts of distinct values, within a unit and overall, so the cost follows the
    number of different values and not the square of the ratings.
    """
    kept = ratings.filter(F.col(value).isNotNull()).select(unit, F.col(value).alias("v"))
    cells = kept.groupBy(unit, "v").agg(F.count("*").alias("c"))
    per = cells.groupBy(unit).agg(F.sum("c").alias("m"), F.collect_list(F.struct("v", "c")).alias("x")).filter("m >= 2")
    nominal = distance is nominal_distance  # then both sums are a square less the sum of squares: no pairs at all
    weight = lambda a, b: distance(a["v"], b["v"]) * a["c"] * b["c"]
    within = F.aggregate(F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: weight(a, b)))), F.lit(0.0), lambda s, d: s + d)
    within = F.col("m") * F.col("m") * F.lit(1.0) - F.aggregate("x", F.lit(0.0), lambda s, a: s + a["c"] * a["c"]) if nominal else within
    units = per.select("m", (within / (F.col("m") - 1)).alias("d"))
    observed = units.agg(F.count("*").alias("units"), F.sum("m").alias("ratings"), F.sum("d").alias("_d"))
    values = per.select(F.explode("x").alias("x")).groupBy(F.col("x.v").alias("v")).agg(F.sum("x.c").alias("c"))
    other = values.select(F.col("v").alias("w"), F.col("c").alias("k"))
    squares = F.sum("c").cast("double") * F.sum("c") - F.sum(F.col("c").cast("double") * F.col("c"))
    expected = values.agg(squares.alias("_e")) if nominal else values.join(other, F.col("v") != F.col("w")).agg(F.sum(distance(F.col("v"), F.col("w")) * F.col("c") * F.col("k")).alias("_e"))
    both = observed.crossJoin(expected)
    n = F.col("ratings")
    both = both.withColumns({"observed": F.col("_d") / n, "expected": F.coalesce("_e", F.lit(0.0)) / (n * (n - 1))})
    alpha = F.when((F.col("units") > 0) & (F.col("expected") > 0), 1 - F.col("observed") / F.col("expected"))
    reason = F.when(F.col("units") == 0, "no pairable units").when(F.col("expected") == 0, "no expected disagreement")
    return both.select("units", F.coalesce("ratings", F.lit(0)).cast("long").alias("ratings"), "observed", "expected", alpha.alias("alpha"), reason.alias("reason"))


def replacement(panels: DataFrame, raters: list[str], model: str, distance: Distance) -> DataFrame:
    """Alpha of the raters and with the model in each rater's place, over complete cases; delta to the raters' own."""
    full = panels.na.drop(subset=[*raters, model]).withColumn("_u", F.monotonically_increasing_id())
    runs = {"raters": raters} | {f"model_for_{r}": [model if x == r else x for x in raters] for r in raters}
    out = None
    for name, columns in runs.items():
        long = full.select("_u", F.explode(F.array(*columns)).alias("v"))
        one = krippendorff(long, "_u", "v", distance).select(F.lit(name).alias("panel"), "units", "alpha")
        out = one if out is None else out.unionAll(one)
    base = out.filter("panel = 'raters'").select(F.col("alpha").alias("_base"))
    return out.crossJoin(base).withColumn("delta", F.col("alpha") - F.col("_base")).drop("_base")


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the Wilson interval; null for no trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(successes == 0, F.lit(0.0)).otherwise(middle - half), F.when(successes == n, F.lit(1.0)).otherwise(middle + half)


def binary_metrics(rows: DataFrame, truth: Column, predicted: Column, by: list[str] = ()) -> DataFrame:
    """Counts, prevalence, precision, recall, F1 and Cohen's kappa; null where a denominator is 0."""
    t, p = truth.cast("boolean"), predicted.cast("boolean")
    c = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    d = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = (tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)
    return c.withColumns({"prevalence": d(tp + fn, n), "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn), "kappa": d(n * (tp + tn) - chance, n * n - chance)})


def support_band(n: Column) -> Column:
    return F.when(n < 10, "<10").when(n < 30, "10-29").otherwise(">=30")


def joint_bootstrap(records: DataFrame, record: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, record, times): how often each replicate of a block bootstrap draws each record.

    Draws are hashes of (seed, replicate, position) into the ranks of the records, made and counted on the executors.
    """
    ranked = records.select(record).distinct().withColumn("_i", F.row_number().over(Window.orderBy(record)) - 1)  # a panel
    n = ranked.count()
    draws = records.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("pos"))
    picked = draws.select("replicate", F.pmod(F.xxhash64(F.lit(seed), "replicate", "pos"), F.lit(max(n, 1))).cast("int").alias("_i")).groupBy("replicate", "_i").agg(F.count("*").alias("times"))
    return picked.join(ranked, "_i").select("replicate", record, "times")


def poisson_bootstrap(records: DataFrame, record: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean): means of replicates in which each record weighs as a hashed Poisson(1) draw of (seed, replicate, record).

    One pass over whole tables: rows are not ranked or shuffled, only sums of the replicates are.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "replicate", record), 11) / F.lit(2.0**53)
    bounds = list(accumulate(exp(-1) / factorial(k) for k in range(18)))  # what lies above has probability 6e-17
    times = reduce(lambda c, k: c.when(u < bounds[k], k), range(1, 18), F.when(u < bounds[0], 0)).otherwise(18)
    rows = records.select(record, value, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    return rows.filter(F.col(value).isNotNull()).select("replicate", value, times.alias("times")).groupBy("replicate").agg((F.sum(F.col("times") * F.col(value)) / F.nullif(F.sum("times"), F.lit(0))).alias("mean"))


def bootstrap_interval(replicates: DataFrame, statistic: str, attempted: int, least: float = 0.9) -> DataFrame:
    """Type-7 percentile interval of the valid replicates; null below the least valid share."""
    out = replicates.agg(F.count(statistic).alias("valid"), F.percentile(statistic, F.lit(0.025)).alias("lo"), F.percentile(statistic, F.lit(0.975)).alias("hi"))
    ok = F.col("valid") >= least * attempted
    return out.select(F.lit(attempted).alias("attempted"), "valid", F.when(ok, F.col("lo")).alias("lo"), F.when(ok, F.col("hi")).alias("hi"))
