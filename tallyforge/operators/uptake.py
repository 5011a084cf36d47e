"""Adoption over time: dense calendars, left-clipped series, exposure-normalised demand, growth and running coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(rows: DataFrame, date: str, step: str = "interval 3 months", unit: str = "quarter") -> DataFrame:
    """Every period from the first to the last date."""
    ends = rows.agg(F.min(F.date_trunc(unit, date)).alias("a"), F.max(F.date_trunc(unit, date)).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr(step))).alias("p")).select(F.col("p").cast("date").alias("period"))


def adoption(mentions: DataFrame, records: DataFrame, line: str, product: str, date: str, unit: str = "quarter", record: str = "record_id") -> DataFrame:
    """For each line and period from its first use on: projects (distinct records), requests (distinct record x product), total, share."""
    dated = records.withColumn("period", F.date_trunc(unit, date).cast("date"))
    total = dated.groupBy("period").agg(F.count("*").alias("total"))
    used = mentions.select(record, line, product).distinct().join(dated.select(record, "period"), record)
    n = used.groupBy(line, "period").agg(F.countDistinct(record).alias("projects"), F.count("*").alias("requests"))
    start = n.groupBy(line).agg(F.min("period").alias("start"))
    cells = calendar(records, date, unit=unit).crossJoin(start).filter("period >= start")  # periods x lines
    out = cells.join(n, [line, "period"], "left").join(total, "period", "left").na.fill(0, ["projects", "requests", "total"])
    return out.select(line, "period", "projects", "requests", "total", (F.col("projects") / F.nullif(F.col("total"), F.lit(0).cast("long"))).alias("share"))


def exposure_days(start: Column, window_start: Column, end: Column) -> Column:
    """Whole days from the later of start and window_start to end, at least 0; divided by 365.25 they are years."""
    return F.greatest(F.datediff(end, F.greatest(start, window_start)), F.lit(0))


def demand(mentions: DataFrame, records: DataFrame, line: str, date: str, window_start: str, record: str = "record_id") -> DataFrame:
    """Projects by line, days of exposure from first use, and projects a year; null where there was no exposure."""
    used = mentions.select(record, line).distinct().join(records.select(record, date), record)
    n = used.groupBy(line).agg(F.count("*").alias("projects"), F.min(date).alias("start"))
    last = records.agg(F.max(date).alias("last"))
    days = exposure_days(F.col("start"), F.lit(window_start).cast("date"), F.col("last"))
    out = n.crossJoin(last).withColumn("days", days)  # one row
    return out.select(line, "projects", "days", (F.col("projects") * 365.25 / F.nullif(F.col("days"), F.lit(0))).alias("per_year"))


def mixed_date(text: Column) -> Column:
    """Dates written YYYY, YYYY-Qn, YYYY-MM or ISO; anything else is null."""
    t = F.trim(text)
    year = F.try_to_number(F.substring(t, 1, 4), F.lit("9999")).cast("int")
    quarter = F.try_to_number(F.substring(t, 7, 1), F.lit("9")).cast("int")
    out = F.when(t.rlike(r"^[0-9]{4}$"), F.make_date(year, F.lit(1), F.lit(1)))
    out = out.when(t.rlike(r"^[0-9]{4}-Q[1-4]$"), F.make_date(year, quarter * 3 - 2, F.lit(1)))
    out = out.when(t.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.try_to_date(F.concat(t, F.lit("-01"))))
    return out.otherwise(F.try_to_date(t))


def year_fraction(date: Column) -> Column:
    return F.year(date) + (F.dayofyear(date) - 1) / F.lit(365.25)


def growth(counts: DataFrame, period: str, n: str) -> DataFrame:
    """Change against the period before it: ratio - 1 from integer parts; null for the first."""
    before = F.lag(n).over(Window.orderBy(period))  # one row a period
    return counts.withColumn("before", before).withColumn("growth", (F.col(n) - F.col("before")) / F.col("before"))


def running_coverage(pairs: DataFrame, position: str, item: str) -> DataFrame:
    """By position: items first covered there, and all covered so far."""
    first = pairs.groupBy(item).agg(F.min(position).alias(position)).groupBy(position).agg(F.count("*").alias("new"))
    every = pairs.select(position).distinct().join(first, position, "left").na.fill(0, ["new"])
    return every.withColumn("covered", F.sum("new").over(Window.orderBy(position)).cast("long"))


def thresholds(coverage: DataFrame, position: str, total: int | Column, shares: list[float]) -> DataFrame:
    """First position at which the covered share reaches each threshold; null where it never does."""
    rows = F.array(*[F.struct(F.lit(s).alias("threshold"), F.when(F.col("covered") >= total * s, F.col(position)).alias("p")) for s in shares])
    return coverage.select(F.explode(rows).alias("x")).groupBy("x.threshold").agg(F.min("x.p").alias("first_position"))
