"""Counting: periods, entities, multi-valued labels, zero-filled panels, top-N and summary rows.

A record counts once per label, so shares of labels can add up to more than 1. Denominators are taken before labels are
exploded. Panels are filled with zeros: every label and period gets a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_counts(records: DataFrame, period: str) -> DataFrame:
    """Records in each period; records without one are left out."""
    return records.filter(F.col(period).isNotNull()).groupBy(period).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, value: str) -> DataFrame:
    """Rows by trimmed non-blank value, and the total they are shares of."""
    kept = rows.withColumn(value, F.trim(value)).filter(F.col(value) != "")
    total = F.sum("n").over(Window.partitionBy())
    return kept.groupBy(value).agg(F.count("*").alias("n")).withColumn("total", total).withColumn("share", F.col("n") / F.col("total"))


def distinct_records(mentions: DataFrame, entity: str, record: str = "record_id", extra: list[str] = ()) -> DataFrame:
    """Distinct records and mentions by entity."""
    return mentions.filter(F.col(entity).isNotNull()).groupBy(entity, *extra).agg(F.countDistinct(record).alias("records"), F.count("*").alias("mentions"))


def top_entities_by_period(mentions: DataFrame, entity: str, period: str, n: int, record: str = "record_id") -> DataFrame:
    """Distinct records by entity and period for the n entities with most records overall (ties by name)."""
    best = distinct_records(mentions, entity, record).orderBy(F.desc("records"), entity).limit(n).select(entity)
    return mentions.join(best, entity, "left_semi").groupBy(entity, period).agg(F.countDistinct(record).alias("records"))


def label_totals(labels: DataFrame, label: str, once: bool = True, record: str = "record_id") -> DataFrame:
    """Records (once) or list items (not once) by label."""
    return labels.filter(F.col(label).isNotNull()).groupBy(label).agg((F.countDistinct(record) if once else F.count("*")).alias("n"))


def label_trend(records: DataFrame, labels: DataFrame, label: str, period: str, record: str = "record_id", labelled_only: bool = False, vocabulary: DataFrame | None = None) -> DataFrame:
    """Zero-filled label x period panel: n, total, share. labelled_only: the total leaves out records without a label."""
    pairs = labels.select(record, label).filter(F.col(label).isNotNull()).distinct()
    base = records.filter(F.col(period).isNotNull()).select(record, period)
    counted = base.join(pairs.select(record).distinct(), record, "left_semi") if labelled_only else base
    total = counted.groupBy(period).agg(F.count("*").alias("total"))
    names = (vocabulary if vocabulary is not None else pairs).select(label).distinct()
    panel = total.crossJoin(names)  # periods x labels: both are vocabularies, not data
    n = base.join(pairs, record).groupBy(period, label).agg(F.count("*").alias("n"))
    return panel.join(n, [period, label], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("share", F.col("n") / F.col("total")).select(period, label, "n", "total", "share")


def ordered_totals(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Rows by non-blank value with its place: vocabulary order first, other values after it by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(value)).cast("int")
    n = rows.withColumn(value, F.trim(value)).filter(F.col(value) != "").groupBy(value).agg(F.count("*").alias("n"))
    known = F.when(place > 0, place).otherwise(len(order) + 1)
    return n.withColumn("place", F.row_number().over(Window.orderBy(known, value)))


def top_n_and_other(counts: DataFrame, name: str, n: str, keep: int, other: str = "Other") -> DataFrame:
    """The keep largest rows (ties by name) and the sum of the rest."""
    ranked = counts.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(n), name)))  # an aggregate, not data
    return ranked.groupBy(F.when(F.col("_r") <= keep, F.col(name)).otherwise(F.lit(other)).alias(name)).agg(F.sum(n).cast("long").alias(n))


def summary_rollup(rows: DataFrame, period: str, column: str) -> DataFrame:
    """Counts by period and column with totals of either and of all (null: total)."""
    return rows.rollup(period, column).count().unionByName(rows.groupBy(column).count().withColumn(period, F.lit(None)).select(period, column, "count")).withColumnRenamed("count", "n")


def series_summary(counts: DataFrame, group: str, n: str) -> DataFrame:
    """Sum, mean, sample deviation and periods of a series by group."""
    return counts.groupBy(group).agg(F.sum(n).cast("long").alias("total"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("deviation"), F.count("*").alias("periods"))


def pivoted(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Row x column counts as columns in fixed order, with a Total column."""
    wide = rows.groupBy(row).pivot(column, values).count().na.fill(0, values)
    return wide.withColumn("Total", sum((F.col(f"`{v}`") for v in values), F.lit(0)).cast("long"))


def tag_prevalence(records: DataFrame, groups: DataFrame, tagged: Column, group: str, record: str = "record_id") -> DataFrame:
    """By group: records with the tag, all records, and their ratio; groups without a tagged record are left out."""
    marked = groups.select(record, group).distinct().join(records.select(record, tagged.alias("_t")), record)
    out = marked.groupBy(group).agg(F.count_if("_t").alias("tagged"), F.count("*").alias("total"))
    return out.filter("tagged > 0").withColumn("share", F.col("tagged") / F.col("total"))


def first_seen(mentions: DataFrame, entity: str, date: str) -> DataFrame:
    return mentions.groupBy(entity).agg(F.min(date).alias("first_seen"))


def headline(records: DataFrame, mentions: DataFrame, official: str = "official_id") -> DataFrame:
    """One row: records, official ids, ids with several records, mentions, records with a mention, first and last year."""
    a = records.groupBy(official).agg(F.count("*").alias("c"), F.min("yr").alias("lo"), F.max("yr").alias("hi"))
    a = a.agg(F.sum("c").cast("long").alias("records"), F.count("*").alias("official_ids"), F.count_if(F.col("c") > 1).alias("repeated_ids"), F.min("lo").alias("first_year"), F.max("hi").alias("last_year"))
    b = mentions.agg(F.count("*").alias("mentions"), F.countDistinct("record_id").alias("records_with_mentions"), F.countDistinct("record_id", "product").alias("requests"))
    return a.crossJoin(b)  # one row each
