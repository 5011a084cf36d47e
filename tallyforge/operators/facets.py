"""Facets of records from reference dimensions, coverage and audit tables, quality diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relations import gate


def check_reference(dim: DataFrame, key: str, closed: dict[str, list[str]]) -> None:
    """Keys are unique and not blank, closed columns hold their vocabulary only; else raises."""
    gate(dim.filter(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")), "blank key")
    gate(dim.groupBy(key).count().filter("count > 1"), "repeated key")
    for column, values in closed.items():
        gate(dim.filter(~F.col(column).isin(*values)).select(key, column), f"value outside the vocabulary of {column}")


def facet_sets(mentions: DataFrame, dim: DataFrame, key: str, facets: dict[str, list[str]], record: str = "record_id", joiner: str = "; ") -> DataFrame:
    """By record and facet: the distinct values of its mentions in vocabulary order, joined to a text."""
    hit = mentions.select(record, key).distinct().join(dim, key)
    def gathered(f: str, order: list[str]):
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(f)).cast("int")
        return F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col(f).isNotNull(), F.struct(place.alias("p"), F.col(f).alias("v"))))), lambda x: x["v"]), joiner).alias(f)
    return hit.groupBy(record).agg(*[gathered(f, order) for f, order in facets.items()])


def span(mentions: DataFrame, product_domains: DataFrame, product: str, domain: str, record: str = "record_id") -> DataFrame:
    """Linkage span: the widest product of a record decides - none, within (one domain) or cross (several); never the union over products."""
    width = product_domains.groupBy(product).agg(F.countDistinct(domain).alias("w"))
    best = mentions.select(record, product).distinct().join(width, product, "left").groupBy(record).agg(F.max(F.coalesce("w", F.lit(0))).alias("w"))
    return best.select(record, F.when(F.col("w") == 0, "none").when(F.col("w") == 1, "within").otherwise("cross").alias("span"))


def coverage(mentions: DataFrame, entity: str, dim: DataFrame, key: str) -> DataFrame:
    """Mentions and distinct entities, all and matched by the dimension."""
    per = mentions.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("c"))
    m = per.join(dim.select(F.col(key).alias(entity), F.lit(True).alias("hit")).distinct(), entity, "left")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return m.agg(s("c").alias("mentions"), s(F.when(F.col("hit"), F.col("c"))).alias("matched_mentions"), F.count("*").alias("entities"), F.count_if("hit").alias("matched_entities"))


def review(mentions: DataFrame, entity: str, dim: DataFrame, key: str, examples: int = 10, record: str = "record_id") -> DataFrame:
    """By entity: mentions, records, whether matched, and its first record ids."""
    per = mentions.filter(F.col(entity).isNotNull()).groupBy(entity, record).agg(F.count("*").alias("c"))
    out = per.groupBy(entity).agg(F.sum("c").cast("long").alias("mentions"), F.count("*").alias("records"), F.min(record).alias("first_record"))
    ranked = per.join(out.select(entity), entity).withColumn("_r", F.row_number().over(_first(entity, record))).filter(F.col("_r") <= examples)
    shown = ranked.groupBy(entity).agg(F.array_join(F.transform(F.array_sort(F.collect_list(record)), lambda x: x.cast("string")), ",").alias("examples"))
    return out.join(shown, entity).join(dim.select(F.col(key).alias(entity), F.lit(True).alias("_h")).distinct(), entity, "left").withColumn("matched", F.coalesce("_h", F.lit(False))).drop("_h")


def _first(entity: str, record: str):
    from pyspark.sql import Window

    return Window.partitionBy(entity).orderBy(record)


def alias_audit(rows: DataFrame, raw: str, canonical: str) -> DataFrame:
    """Canonical names with several raw forms: forms, rows, and the first form."""
    per = rows.groupBy(canonical, raw).agg(F.count("*").alias("c"))
    return per.groupBy(canonical).agg(F.count("*").alias("forms"), F.sum("c").cast("long").alias("rows"), F.min(raw).alias("first_form")).filter("forms > 1")


def label_count_histogram(labels: DataFrame, records: DataFrame, label: str, record: str = "record_id") -> DataFrame:
    """How many records have how many labels, 0 included."""
    n = labels.select(record, label).distinct().groupBy(record).agg(F.count("*").alias("k"))
    return records.select(record).join(n, record, "left").groupBy(F.coalesce("k", F.lit(0)).alias("labels")).agg(F.count("*").alias("records"))


def modal_partner(left: DataFrame, right: DataFrame, a: str, b: str, top: int, record: str = "record_id") -> DataFrame:
    """For the top labels of a: the label of b met most (ties by name), its share, and whether that is over one half."""
    pairs = left.select(record, a).distinct().join(right.select(record, b).distinct(), record).groupBy(a, b).agg(F.count("*").alias("n"))
    total = left.select(record, a).distinct().groupBy(a).agg(F.count("*").alias("total")).orderBy(F.desc("total"), a).limit(top)
    best = pairs.groupBy(a).agg(F.max("n").alias("n")).join(pairs, [a, "n"]).groupBy(a, "n").agg(F.min(b).alias(b))
    return total.join(best, a).select(a, b, "n", "total", (F.col("n") * 2 > F.col("total")).alias("coupled"))
