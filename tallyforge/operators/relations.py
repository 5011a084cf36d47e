"""Filters, joins with gates, ordered first rows, set operations and snapshot differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class GateError(ValueError):
    """A constraint on data doesn't hold."""


def gate(bad: DataFrame, message: str, examples: int = 5) -> None:
    """Raises with a few examples where bad has rows."""
    rows = bad.limit(examples).collect()
    if rows:
        raise GateError(f"{message}: {[tuple(r) for r in rows]}")


# filters


def conjunction(predicates: list[Column | None]) -> Column:
    """All given predicates; None means no restriction."""
    kept = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, kept, F.lit(True))


def search(text: str | None, columns: list[str]) -> Column | None:
    """Literal case-insensitive search in any of the columns; null matches nothing."""
    if not text or not text.strip():
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(text.strip().lower()), F.lit(False)) for c in columns])


def has_member(column: str, value: str, separator: str = ";") -> Column:
    """Exact trimmed member of a separated list."""
    return F.array_contains(F.transform(F.split(F.coalesce(column, F.lit("")), separator), F.trim), value)


def all_present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def required(rows: DataFrame, date: str, title: str, basis: str, words: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a parseable date, a title and a basis that contains words; and one row of step counts."""
    parsed = rows.withColumn(date, F.coalesce(F.try_to_timestamp(F.col(date).cast("string")).cast("date"), F.lit(None)))
    a = F.col(date).isNotNull() & F.col(title).isNotNull()
    b = a & F.coalesce(F.lower(basis).contains(words.lower()), F.lit(False))
    return parsed.filter(b), parsed.agg(F.count("*").alias("loaded"), F.count_if(a).alias("dated"), F.count_if(b).alias("kept"))


def subset(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; listed keys without a row raise."""
    gate(ids.join(rows, key, "left_anti"), f"ids without a row in {key}")
    return rows.join(ids, key, "left_semi")


def flags(rows: DataFrame, rules: dict[str, Column], name: str = "flags") -> DataFrame:
    """Rows that break at least one rule, with the names of the rules broken."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return rows.withColumn(name, found).filter(F.size(name) > 0).withColumn("n_flags", F.size(name))


def last_period_partial(records: DataFrame, date: str) -> DataFrame:
    """Last year, and whether it ends before December."""
    last = records.agg(F.max(date).alias("d"))
    return last.select(F.year("d").alias("year"), (F.month("d") < 12).alias("is_partial"))


# ordered first rows


def first_rows(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# joins


def fill_join(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join of columns that replace older ones of the same name; no match gives ''."""
    base = left.drop(*[c for c in columns if c in left.columns])
    return base.join(right.select(key, *columns), key, "left").na.fill("", columns)


def overlay(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], order: list) -> DataFrame:
    """Columns of right win where not null; right is first cut to one row a key, so no rows multiply."""
    one = first_rows(right, keys, order).select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    out = left.join(one, keys, "left")
    return out.withColumns({c: F.coalesce(f"_r_{c}", c) if c in left.columns else F.col(f"_r_{c}") for c in columns}).drop(*[f"_r_{c}" for c in columns])


def outer_with_origin(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join on key with origin both, left_only or right_only; other columns get suffixes _a and _b."""
    x = a.select(F.col(key), F.lit(1).alias("_a"), *[F.col(c).alias(f"{c}_a") for c in a.columns if c != key])
    y = b.select(F.col(key), F.lit(1).alias("_b"), *[F.col(c).alias(f"{c}_b") for c in b.columns if c != key])
    origin = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    return x.join(y, key, "full_outer").withColumn("origin", origin).drop("_a", "_b")


def marked(population: DataFrame, ids: DataFrame, key: str, marker: str) -> DataFrame:
    """population with a marker for listed keys. Blank, repeated or unknown listed keys raise."""
    gate(ids.filter(F.col(key).isNull()), f"blank {key}")
    gate(ids.groupBy(key).count().filter("count > 1"), f"repeated {key}")
    gate(ids.join(population, key, "left_anti"), f"unknown {key}")
    return population.join(ids.select(key, F.lit(True).alias(marker)), key, "left").withColumn(marker, F.coalesce(marker, F.lit(False)))


def fallback_lookup(rows: DataFrame, keys: Column, dim: DataFrame, dim_key: str, value: str, out: str) -> DataFrame:
    """Looks up the keys of each row (an array, best first) in dim; the first hit wins, none gives null."""
    r = rows.withColumn("_keys", keys)
    distinct = r.select("_keys").distinct().select("_keys", F.posexplode("_keys").alias("_pos", "_key"))
    hits = distinct.join(dim.select(F.col(dim_key).alias("_key"), F.col(value).alias("_v")), "_key").groupBy("_keys").agg(F.min(F.struct("_pos", "_v"))["_v"].alias(out))
    return r.join(hits, "_keys", "left").drop("_keys")


def pattern_lookup(names: DataFrame, name: str, patterns: DataFrame) -> DataFrame:
    """Distinct names with the value of the first of the ordered patterns(priority, pattern, value) that matches.

    Patterns are a reference table; each distinct name is matched once and joined back by the caller.
    """
    d = names.select(name).filter(F.col(name).isNotNull()).distinct()
    hit = d.join(patterns, F.expr(f"{name} rlike pattern"), "left")
    return hit.groupBy(name).agg(F.min(F.when(F.col("pattern").isNotNull(), F.struct("priority", "value")))["value"].alias("value"))


def longest_prefix(names: DataFrame, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Distinct names with the longest of the prefixes that starts them and leaves a rest."""
    d = names.select(name).filter(F.col(name).isNotNull()).distinct()
    hit = d.join(prefixes.select(prefix), F.expr(f"startswith({name}, {prefix}) and length({name}) > length({prefix})"))
    return hit.groupBy(name).agg(F.max(F.struct(F.length(prefix).alias("n"), F.col(prefix).alias("p")))["p"].alias("prefix"))


def one_to_one(rows: DataFrame, reference: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """Maps old ids to new by composite keys that occur once on either side; the status of other rows says why not."""
    a = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    b = reference.groupBy(*keys).agg(F.count("*").alias("_m"), F.min(new).alias(new))
    out = a.join(b, keys, "left")
    status = F.when(F.col("_m").isNull(), "unmatched").when((F.col("_m") > 1) | (F.col("_n") > 1), "ambiguous").when(F.col(old) == F.col(new), "kept").otherwise("rekeyed")
    return out.withColumn("status", status).select(*keys, old, F.when(status.isin("kept", "rekeyed"), F.col(new)).alias(new), "status")


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field) of every difference between two tables, missing rows included."""
    both = outer_with_origin(a.select(key, *columns), b.select(key, *columns), key)
    fields = [F.when(F.col("origin") != "both", F.col("origin"))] + [F.when((F.col("origin") == "both") & ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), F.lit(c)) for c in columns]
    return both.select(key, F.explode(F.array_compact(F.array(*fields))).alias("field"))


# set operations


def in_all(rows: DataFrame, key: str, trial: str, trials: int) -> DataFrame:
    """Keys that occur in every one of the trials."""
    return rows.groupBy(key).agg(F.countDistinct(trial).alias("_n")).filter(F.col("_n") == trials).select(key)


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of keys only in a, only in b, and in both."""
    both = a.select(key, F.lit(1).alias("x")).distinct().join(b.select(key, F.lit(1).alias("y")).distinct(), key, "full_outer")
    return both.agg(F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("common"))


def ordered_union(rows: DataFrame, key: str, value: str, order: str, norm: Column, joiner: str = "\n") -> DataFrame:
    """Distinct values (by norm) of a key in first-appearance order and form, joined to one text."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(key, norm.alias("_k")).agg(F.min(F.struct(order, value)).alias("_f"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_f")), lambda x: x[value]), joiner).alias(value), F.count("*").alias("values"))


# change data


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key added, removed or changed, with the names of the changed columns; null and '' are equal."""
    both = outer_with_origin(old.select(key, *columns), new.select(key, *columns), key)
    norm = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(?U)\s+", " "))
    changed = F.array_compact(F.array(*[F.when(norm(f"{c}_a") != norm(f"{c}_b"), F.lit(c)) for c in columns]))
    status = F.when(F.col("origin") == "left_only", "removed").when(F.col("origin") == "right_only", "added").when(F.size(changed) > 0, "changed").otherwise("same")
    return both.select(key, status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).otherwise("").alias("columns")).filter("status <> 'same'")


def multiset_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """As snapshot_diff for keys with several rows: a column changes where its multiset of values does."""
    bags = lambda df: df.groupBy(key).agg(*[F.array_join(F.array_sort(F.collect_list(F.coalesce(F.col(c).cast("string"), F.lit("")))), "\x1f").alias(c) for c in columns])
    return snapshot_diff(bags(old), bags(new), key, columns)


def impact(diff: DataFrame) -> DataFrame:
    n = diff.agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "removed").alias("removed"), F.count_if(F.col("status") == "changed").alias("changed"))
    return n.withColumn("impact", F.when(F.col("added") + F.col("removed") + F.col("changed") == 0, "none").otherwise("changed"))


def previous_distinct(observations: DataFrame, snapshot: str, position: str) -> DataFrame:
    """Snapshots in order of first observation, each with the one before it."""
    first = observations.groupBy(snapshot).agg(F.min(position).alias("first_seen"))
    return first.withColumn("previous", F.lag(snapshot).over(Window.orderBy("first_seen", snapshot)))  # one row a snapshot


def new_observations(incoming: DataFrame, known: DataFrame, identity: list[str], content: str) -> DataFrame:
    """Incoming rows as repeat (no-op), observation (known content under a new identity) or new."""
    seen = known.select(*identity, F.lit(True).alias("_same")).distinct()
    have = known.select(content, F.lit(True).alias("_have")).distinct()
    out = incoming.join(seen, identity, "left").join(have, content, "left")
    return out.withColumn("action", F.when(F.col("_same"), "repeat").when(F.col("_have"), "observation").otherwise("new")).drop("_same", "_have")


def work_status(rows: DataFrame, cache: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """rows with status cached, stale (fingerprint differs) or missing."""
    c = cache.select(key, F.col(fingerprint).alias("_fp"))
    return rows.join(c, key, "left").withColumn("status", F.when(F.col("_fp").isNull(), "missing").when(F.col("_fp") == F.col(fingerprint), "cached").otherwise("stale")).drop("_fp")
