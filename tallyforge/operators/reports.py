"""Evidence tables: pairwise rater statistics, human-model assembly, pilot findings, state records, institution status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .agreement import jaccard, label_set
from .relations import GateError, gate


def rater_pairs(ratings: DataFrame, record: str, rater: str, labels: str) -> DataFrame:
    """For each pair of raters: records both rated, exact matches, mean, median, least and greatest Jaccard."""
    sets = ratings.groupBy(record).agg(F.collect_list(F.struct(F.col(rater).cast("string").alias("r"), label_set(labels).alias("s"))).alias("x"))
    pairs = F.filter(F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p["a"]["r"] < p["b"]["r"])
    one = sets.select(F.explode(pairs).alias("p")).select(F.col("p.a.r").alias("a"), F.col("p.b.r").alias("b"), (F.col("p.a.s") == F.col("p.b.s")).alias("e"), jaccard(F.col("p.a.s"), F.col("p.b.s")).alias("j"))
    return one.groupBy("a", "b").agg(F.count("*").alias("records"), F.count_if("e").alias("exact"), F.avg("j").alias("mean"), F.percentile("j", F.lit(0.5)).alias("median"), F.min("j").alias("least"), F.max("j").alias("greatest"))


def against_majority(ratings: DataFrame, record: str, rater: str, labels: str, least: int = 2) -> DataFrame:
    """By rater: labels missing from, and beyond, the labels that at least `least` raters gave; records with both are mixed."""
    each = ratings.select(record, rater, label_set(labels).alias("s"))
    votes = each.select(record, F.explode("s").alias("l")).groupBy(record, "l").agg(F.count("*").alias("c")).filter(F.col("c") >= least)
    top = votes.groupBy(record).agg(F.array_sort(F.collect_set("l")).alias("m"))
    d = each.join(top, record, "left").withColumn("m", F.coalesce("m", F.array().cast("array<string>")))
    d = d.select(rater, F.size(F.array_except("m", "s")).alias("missing"), F.size(F.array_except("s", "m")).alias("extra"))
    return d.groupBy(rater).agg(F.count("*").alias("records"), F.sum("missing").cast("long").alias("missing"), F.sum("extra").cast("long").alias("extra"), F.count_if((F.col("missing") > 0) & (F.col("extra") > 0)).alias("mixed"))


def human_model_rows(human: DataFrame, model: DataFrame, record: str, rater: str, labels: str, majority: int = 2) -> DataFrame:
    """Long table (record, source, labels, to_model): each rater, the raters' majority, and their Jaccard to the model."""
    m = model.select(record, label_set(labels).alias("_m"))
    each = human.select(record, F.col(rater).cast("string").alias("source"), label_set(labels).alias("labels"))
    votes = each.select(record, F.explode("labels").alias("l")).groupBy(record, "l").agg(F.count("*").alias("c")).filter(F.col("c") >= majority)
    top = each.select(record).distinct().join(votes.groupBy(record).agg(F.array_sort(F.collect_set("l")).alias("labels")), record, "left")
    top = top.select(record, F.lit("majority").alias("source"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    return each.unionByName(top).join(m, record).select(record, "source", "labels", jaccard(F.col("labels"), F.col("_m")).alias("to_model"))


def pilot_findings(assignments: DataFrame, record: str, rater: str, frozen: DataFrame, version: str, expected: str, raters: int) -> DataFrame:
    """(severity, finding, subject) of an instrument check: other versions, unknown or missing records, too few or repeated raters."""
    say = lambda df, severity, finding, subject: df.select(F.lit(severity).alias("severity"), F.lit(finding).alias("finding"), subject.cast("string").alias("subject"))
    per = assignments.groupBy(record).agg(F.countDistinct(rater).alias("_raters"), F.count("*").alias("_n"))
    parts = [
        say(assignments.filter(~F.col(version).eqNullSafe(F.lit(expected))), "error", "instrument version", F.col(record)),
        say(per.join(frozen, record, "left_anti"), "error", "unknown record", F.col(record)),
        say(frozen.join(per, record, "left_anti"), "error", "missing record", F.col(record)),
        say(per.filter(F.col("_raters") < raters), "warning", "too few raters", F.col(record)),
        say(per.filter(F.col("_n") > F.col("_raters")), "error", "repeated rating", F.col(record)),
    ]
    return reduce(lambda a, b: a.unionAll(b), parts)


def production_links(run: DataFrame, production: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(key, problem) of run rows that production lacks or labels otherwise; order of labels doesn't matter."""
    p = production.select(key, *[label_set(c).alias(f"_{c}") for c in labels], F.lit(True).alias("_in"))
    both = run.select(key, *[label_set(c).alias(c) for c in labels]).join(p, key, "left")
    different = F.array_compact(F.array(*[F.when(F.col(c) != F.col(f"_{c}"), F.lit(c)) for c in labels]))
    problem = F.when(F.col("_in").isNull(), "no production row").when(F.size(different) > 0, F.concat(F.lit("labels differ: "), F.array_join(different, ",")))
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def equal_members(named: dict[str, DataFrame], key: str) -> None:
    """All tables hold the same ids; the first that doesn't is named."""
    names = list(named)
    for n in names[1:]:
        a, b = named[names[0]].select(key).distinct(), named[n].select(key).distinct()
        gate(a.exceptAll(b).union(b.exceptAll(a)), f"{names[0]} and {n} hold different ids")


def linked_state(states: list[dict], source: str, content: str, rows: int) -> tuple[list[dict], dict]:
    """States of a manifest with one for this content: an existing one gets the source, a new one is appended.

    The same content with another number of rows raises.
    """
    out = [dict(s) for s in states]
    for s in out:
        if s["content_sha256"] == content:
            if s["rows"] != rows:
                raise GateError(f"{content[:12]} has {s['rows']} rows, not {rows}")
            s["sources"] = list(dict.fromkeys([*s["sources"], source]))
            return out, s
    out.append({"state_id": f"state-{len(out) + 1}", "content_sha256": content, "rows": rows, "sources": [source]})
    return out, out[-1]


def frozen_binding(manifest: dict, pointer: str, expected: dict[str, str]) -> None:
    """A protected pointer names the snapshot with exactly these hashes."""
    target = manifest.get("pointers", {}).get(pointer)
    found = next((s for s in manifest.get("content_snapshots", []) if s.get("snapshot_id") == target), None)
    if found is None or any(found.get(k) != v for k, v in expected.items()):
        raise GateError(f"{pointer} isn't bound as expected")


def changed_files(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, state) of files(path, sha256) against tracked(path, sha256, restricted): changed, missing or new; restricted ones are left out."""
    t = tracked.filter("path is not null and not coalesce(restricted, false)").select("path", F.col("sha256").alias("_s"), F.lit(True).alias("_t"))
    both = files.select("path", "sha256").join(t, "path", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("_t").isNull(), "new").when(F.col("sha256") != F.col("_s"), "changed")
    return both.select("path", state.alias("state")).filter("state is not null")


def institutions(names: DataFrame, name: str, aliases: DataFrame, organisation: list[str]) -> DataFrame:
    """Distinct names with canonical, status and needs_review: alias, alias with a person after it (parser_cleanup), identity.

    aliases(alias, canonical): exact by folded text, else the longest alias that starts the name and leaves a person's name.
    """
    d = names.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("_k", T.casefold(T.collapse(name)))
    a = aliases.select(T.casefold(T.collapse("alias")).alias("_a"), "canonical")
    exact = d.join(a, F.col("_k") == F.col("_a"), "left").select(name, "_k", F.col("canonical").alias("_exact"))
    first = a.withColumn("_w", F.split("_a", " ")[0])  # prefixes are looked up by their first word
    prefix = exact.filter("_exact is null").withColumn("_w", F.split("_k", " ")[0]).join(first, "_w").filter(F.expr("startswith(_k, concat(_a, ' '))"))
    rest = T.strip(F.expr(f"substring({name}, length(_a) + 1)"))
    prefix = prefix.filter(rest.rlike(r"^(?U)\p{Lu}[\p{L}'’.-]*(\s+\p{Lu}[\p{L}'’.-]*){1,4}$"))
    best = prefix.groupBy(name).agg(F.max(F.struct(F.length("_a").alias("n"), F.col("canonical").alias("c")))["c"].alias("_prefix"))
    out = exact.join(best, name, "left")
    known = F.col(name).rlike(rf"(?i)\b(?:{'|'.join(organisation)})\b")
    status = F.when(F.col("_exact").isNotNull(), "alias").when(F.col("_prefix").isNotNull(), "parser_cleanup").otherwise("identity")
    return out.select(name, F.coalesce("_exact", "_prefix", name).alias("canonical"), status.alias("status"), ((status == "identity") & ~known).cast("int").alias("needs_review"))


def unresolved(raw: str, canonical: str, match_type: str, suffixes: list[str], cleared: list[str] = ()) -> Column:
    """Whether a name needs review: unresolved type, leftover separators, or a suspicious end, unless it was cleared."""
    odd = (F.col(match_type) == "unresolved") | F.col(canonical).rlike(r"[;:/]\s*\S") | F.col(canonical).rlike(rf"(?i)(?:{'|'.join(suffixes)})$")
    return odd & ~F.col(raw).isin(*cleared) if cleared else odd


def active(dimension: DataFrame, layer: str) -> DataFrame:
    """Categories of a layer that are in use, in order."""
    return dimension.filter((F.col("layer") == layer) & F.col("include_in_prompt") & (F.coalesce("status", F.lit("active")) != "removed")).orderBy("ord")


def display_orders(rows: DataFrame, rater: str, record: str, seed: int) -> DataFrame:
    return rows.withColumn("display_order", F.row_number().over(Window.partitionBy(rater).orderBy(F.xxhash64(F.lit(seed), rater, record), record)))
