"""Duplicates, identities, groups, greedy cover."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relations import gate


def duplicate_tiers(rows: DataFrame, keys: list[str], date: str, merged: list[str], other: list[str], order: str) -> DataFrame:
    """rows with group_size, tier and keep.

    0: alone. 3: dates or other columns differ, all stay and are flagged. 1: merged columns equal too, the first stays.
    2: merged columns differ, the first stays for their ordered union (merge_group). Null and '' are equal.
    """
    w = Window.partitionBy(*keys)
    different = lambda c: F.size(F.collect_set(T.duplicate_key(F.col(c).cast("string"))).over(w)) > 1
    some = lambda cs: F.exists(F.array(*[different(c) for c in cs]), lambda x: x) if cs else F.lit(False)
    out = rows.withColumn("group_size", F.count("*").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(order)))
    tier = F.when(F.col("group_size") == 1, 0).when(different(date) | some(other), 3).when(~some(merged), 1).otherwise(2)
    out = out.withColumn("tier", tier)
    return out.withColumn("keep", (F.col("tier").isin(0, 3)) | (F.col("_rank") == 1)).drop("_rank")


def merge_group(tiered: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """Ordered union of the lines of a column over each tier-2 group."""
    parts = tiered.filter("tier = 2").select(*keys, F.col(order).alias("_o"), F.posexplode(T.lines(column)).alias("_p", "_v"))
    first = parts.groupBy(*keys, T.duplicate_key("_v").alias("_k")).agg(F.min(F.struct("_o", "_p", "_v")).alias("f"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["_v"]), "\n").alias(column))


def apply_rulings(rows: DataFrame, rulings: DataFrame, key: str, order: str) -> DataFrame:
    """rulings(key, ruling): 'duplicate' keeps the first row, 'collision' keeps all. Every repeated key needs one ruling and the reverse."""
    repeated = rows.groupBy(key).count().filter("count > 1").select(key)
    gate(repeated.join(rulings, key, "left_anti"), "repeated keys without a ruling")
    gate(rulings.join(repeated, key, "left_anti"), "rulings without a repeated key")
    gate(rulings.groupBy(key).count().filter("count > 1"), "several rulings")
    ranked = rows.join(rulings.select(key, "ruling"), key, "left").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.filter("ruling is null or ruling <> 'duplicate' or _r = 1").drop("_r", "ruling")


def bad_ids(rows: DataFrame, key: str, pattern: str | None = None) -> DataFrame:
    """(key, problem) of ids that are null, untrimmed, hold control or non-breaking characters, repeat, or miss the pattern."""
    w = F.count("*").over(Window.partitionBy(key))
    problem = F.when(F.col(key).isNull(), "null").when(T.strip(key) != F.col(key), "untrimmed").when(F.col(key).rlike(r"[\p{Cntrl} ]"), "characters")
    problem = problem.when(F.col("_n") > 1, "repeated")
    problem = problem.when(~F.col(key).rlike(pattern), "pattern") if pattern else problem
    return rows.withColumn("_n", w).select(key, problem.alias("problem")).filter("problem is not null")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable, by label propagation with pointer jumping; checkpoints cut the lineage."""
    spark = edges.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        conf = spark.sparkContext.getConf()
        shared = conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp())  # a folder of its own in tests only
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    e = e.union(e.select("y", "x")).distinct().checkpoint()
    labels = e.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("c")).withColumnRenamed("x", "node").checkpoint()
    while True:
        near = e.join(labels, e.y == labels.node).groupBy("x").agg(F.min("c").alias("m"))
        new = labels.join(near, labels.node == near.x).select("node", F.least("c", "m").alias("c"))
        jump = new.join(new.select(F.col("node").alias("c"), F.col("c").alias("d")), "c", "left").select("node", F.least("c", F.coalesce("d", "c")).alias("c")).checkpoint()
        if jump.join(labels.withColumnRenamed("c", "old"), "node").filter("c <> old").isEmpty():
            return jump.withColumnRenamed("c", "component")
        labels = jump


def clique_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """connected, but a component of three or more that isn't a clique falls apart into single nodes."""
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    c = connected(e)
    size = c.groupBy("component").agg(F.count("*").alias("n"))
    inner = e.join(c.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("m"))
    whole = size.join(inner, "component").select("component", ((F.col("n") < 3) | (F.col("m") * 2 == F.col("n") * (F.col("n") - 1))).alias("ok"))
    return c.join(whole, "component").select("node", F.when(F.col("ok"), F.col("component")).otherwise(F.col("node")).alias("component"))


def blocked_pairs(rows: DataFrame, key: str, blocks: list[str], keep) -> DataFrame:
    """Pairs (a, b), a < b, of rows that agree on all blocks and satisfy keep(left alias l, right alias r)."""
    cols = [key, *blocks, *[c for c in rows.columns if c not in (key, *blocks)]]
    left, right = rows.select(*cols).alias("l"), rows.select(*cols).alias("r")
    on = F.col(f"l.{key}") < F.col(f"r.{key}")
    for b in blocks:
        on = on & (F.col(f"l.{b}") == F.col(f"r.{b}"))
    return left.join(right, on).filter(keep).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))


def greedy_cover(incidence: DataFrame, owner: str, item: str, steps: int) -> list[tuple]:
    """Greedy maximum cover: (owner, newly covered, covered so far) for each step; ties by total, then by name.

    One aggregate a step; only the best owner of a step reaches the driver.
    """
    edges = incidence.select(owner, item).distinct()
    total = edges.groupBy(owner).agg(F.count("*").alias("t"))
    left, out, covered = edges, [], 0
    for _ in range(steps):
        best = left.groupBy(owner).agg(F.count("*").alias("n")).join(total, owner).orderBy(F.desc("n"), F.desc("t"), owner).first()
        if best is None:
            break
        covered += best["n"]
        out.append((best[owner], best["n"], covered))
        gone = edges.filter(F.col(owner) == best[owner]).select(item)
        left = left.join(gone, item, "left_anti")
        if len(out) % 8 == 0:
            left = left.repartition(owner)
    return out


def incidence_rows(pairs: DataFrame, owner: str, item: str) -> DataFrame:
    """Edges with a hashed owner key and the owner's degree."""
    e = pairs.select(owner, item).distinct()
    return e.select(F.substring(F.sha2(F.col(owner).cast("string"), 256), 1, 16).alias("owner_key"), item, F.count("*").over(Window.partitionBy(owner)).alias("degree"))


def degree_distribution(pairs: DataFrame, owner: str, item: str) -> DataFrame:
    """degree, owners."""
    return pairs.select(owner, item).distinct().groupBy(owner).agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("owners"))


def append_only(old: DataFrame, new: DataFrame, step: str) -> DataFrame:
    """Steps of old that new lacks or changes, and gaps in new's steps: empty where new only appends."""
    columns = [c for c in old.columns if c != step]
    kept = old.join(new.select(step, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_in")), step, "left")
    same = F.col("_in").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = kept.filter(~same).select(F.col(step).alias("step"), F.lit("changed").alias("problem"))
    steps = new.select(F.col(step).alias("step")).filter("step is not null")
    first = steps.agg(F.min("step").alias("_first"))  # one row
    alone = steps.join(steps.select((F.col("step") + 1).alias("step")).distinct(), "step", "left_anti")
    repeated = steps.groupBy("step").agg(F.count("*").alias("_n")).filter("_n > 1").select("step")
    gaps = alone.distinct().crossJoin(F.broadcast(first)).filter("step <> _first").select("step").unionAll(repeated).select("step", F.lit("gap").alias("problem"))
    return changed.unionAll(gaps)
