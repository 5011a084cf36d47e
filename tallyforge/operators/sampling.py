"""Seeded samples and orders.

Draws that must be the same for any row order and partitioning are hashes of (seed, id); registered_draw repeats a
NumPy generator's stream on the driver for small frames, as such a stream has one order only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relations import gate


def order_key(seed: int, *ids: str) -> Column:
    return F.xxhash64(F.lit(seed), *ids)


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int, forced: Column | None = None) -> DataFrame:
    """n rows of each stratum by hash order, forced rows first; with their place."""
    first = F.when(forced, 0).otherwise(1) if forced is not None else F.lit(0)
    w = Window.partitionBy(stratum).orderBy(first, order_key(seed, key), key)
    return rows.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= n)


def proportional(rows: DataFrame, cell: list[str], key: str, n: int, seed: int) -> DataFrame:
    """About n rows in proportion to cell sizes, at least one a cell."""
    total = rows.agg(F.count("*").alias("_all"))
    size = rows.groupBy(*cell).agg(F.count("*").alias("_c")).crossJoin(total)
    quota = size.select(*cell, F.greatest(F.lit(1), F.floor(F.col("_c") * n / F.col("_all"))).alias("_q"))
    w = Window.partitionBy(*cell).orderBy(order_key(seed, key), key)
    return rows.withColumn("_r", F.row_number().over(w)).join(quota, cell).filter("_r <= _q").drop("_r", "_q")


def registered_draw(ids: DataFrame, key: str, n: int, seed: int, limit: int = 1_000_000) -> list:
    """n ids without replacement by PCG64 over the sorted ids; for frames of at most limit rows."""
    found = [r[0] for r in ids.select(key).distinct().orderBy(key).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"a registered draw is for at most {limit} ids")
    rng = np.random.Generator(np.random.PCG64(seed))
    return [found[i] for i in rng.choice(len(found), size=min(n, len(found)), replace=False)]


def quota_split(available: dict[str, int], target: int, seed: int) -> dict[str, int]:
    """target over strata as evenly as they allow; what a short one lacks goes round the others in random order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    names = sorted(available)
    out = dict.fromkeys(names, 0)
    order = [names[i] for i in rng.permutation(len(names))]
    left = min(target, sum(available.values()))
    while left:
        for s in order:
            if left and out[s] < available[s]:
                out[s] += 1
                left -= 1
    return out


def assert_disjoint(samples: DataFrame, key: str, sample: str) -> None:
    gate(samples.groupBy(key).agg(F.countDistinct(sample).alias("n")).filter("n > 1"), "ids in several samples")


def audit(done: DataFrame, mandatory: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """A random share of the finished ids (rounded up) and all mandatory ones, with how each came in."""
    import math

    ids = done.select(key).distinct()
    picked = ids.orderBy(order_key(seed, key), key).limit(math.ceil(ids.count() * share)).select(key, F.lit(True).alias("random"))
    out = picked.join(mandatory.select(key, F.lit(True).alias("mandatory")).distinct(), key, "full_outer")
    return out.na.fill(False, ["random", "mandatory"])


def assignments(records: DataFrame, raters: DataFrame, record: str, rater: str, seed: int) -> DataFrame:
    """Every record for every rater, each rater in an order of their own."""
    both = records.select(record).crossJoin(raters.select(rater))  # records x a handful of raters
    return both.withColumn("display_order", F.row_number().over(Window.partitionBy(rater).orderBy(order_key(seed, rater, record), record)))


def masked_labels(sets: DataFrame, key: str, labels: str, seed: int) -> DataFrame:
    """Distinct label sets of a record in seeded order under opaque numbers, without their source."""
    d = sets.select(key, F.array_join(F.array_sort(labels), "; ").alias("set")).distinct()
    return d.withColumn("option", F.row_number().over(Window.partitionBy(key).orderBy(order_key(seed, key, "set"), "set")))


def position_correlation(rows: DataFrame, position: str, shuffled: str) -> DataFrame:
    return rows.agg(F.corr(position, shuffled).alias("correlation"))


def diverse(rows: list[dict], fields: list[str], quotas: dict[tuple, int], target: int, key: str) -> list[dict]:
    """Quota-greedy sample of a small candidate list: unmet quotas first, then unseen values, ties by key."""
    left, out, seen = sorted(rows, key=lambda r: r[key]), [], {f: {} for f in fields}
    need = dict(quotas)
    while left and len(out) < target:
        score = lambda r: (sum(need.get((f, r[f]), 0) > 0 for f in fields), sum(r[f] not in seen[f] for f in fields), -sum(seen[f].get(r[f], 0) for f in fields))
        best = max(left, key=lambda r: (score(r), [-ord(c) for c in str(r[key])]))
        left.remove(best)
        out.append(best)
        for f in fields:
            seen[f][best[f]] = seen[f].get(best[f], 0) + 1
            need[f, best[f]] = need.get((f, best[f]), 0) - 1
    return out
