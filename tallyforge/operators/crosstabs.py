"""Cross-tabulation and co-occurrence of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def crosstab(left: DataFrame, right: DataFrame, row: str, column: str, record: str = "record_id") -> DataFrame:
    """Records by pair of a row label and a column label, with the row's share of each column."""
    pairs = left.select(record, row).distinct().join(right.select(record, column).distinct(), record)
    n = pairs.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.withColumn("row_total", F.sum("n").over(Window.partitionBy(row))).withColumn("row_share", F.col("n") / F.col("row_total"))


def crosstab_wide(left: DataFrame, right: DataFrame, row: str, column: str, columns: list[str], record: str = "record_id") -> DataFrame:
    pairs = left.select(record, row).distinct().join(right.select(record, column).distinct(), record)
    return pairs.groupBy(row).pivot(column, columns).count().na.fill(0)


def cooccurrence(labels: DataFrame, label: str, exclude: tuple[str, ...] = (), vocabulary: DataFrame | None = None, record: str = "record_id") -> DataFrame:
    """Symmetric pair counts; on the diagonal the records that have that label alone. Excluded labels take no part.

    Labels of a record are gathered once and paired inside the row: no self-join on the record.
    """
    sets = labels.filter(F.col(label).isNotNull() & ~F.col(label).isin(*exclude) if exclude else F.col(label).isNotNull()).groupBy(record).agg(F.array_sort(F.collect_set(label)).alias("s"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    pairs = F.when(F.size("s") == 1, F.array(pair(F.col("s")[0], F.col("s")[0]))).otherwise(F.filter(F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: pair(a, b)))), lambda p: p["a"] != p["b"]))
    n = sets.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    if vocabulary is None:
        return n
    v = vocabulary.select(F.col(label).alias("a"))
    grid = v.crossJoin(v.withColumnRenamed("a", "b"))  # a closed vocabulary
    return grid.join(n, ["a", "b"], "left").na.fill(0, ["n"])


def conditional_share(labels: DataFrame, label: str, record: str = "record_id") -> DataFrame:
    """P(b | a) for different labels: pair count over the records of a."""
    total = labels.select(record, label).distinct().groupBy(label).agg(F.count("*").alias("total")).withColumnRenamed(label, "a")
    return cooccurrence(labels, label, record=record).filter("a <> b").join(total, "a").withColumn("p", F.col("n") / F.col("total"))


def served_pairs(mentions: DataFrame, unit: str, label: str) -> DataFrame:
    """Unordered pairs of labels that some unit serves, with how many units do."""
    sets = mentions.groupBy(unit).agg(F.array_sort(F.collect_set(label)).alias("s"))
    pairs = F.filter(F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p["a"] < p["b"])
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("units"))
