"""The driver's tables as records, mentions and label sets."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

MENTION = """mention as (select l.l_orderkey record_id, l.l_linenumber line_no, p.p_name dataset, p.p_brand product, p.p_type collection, s.s_name provider, r.r_name domain
 from lineitem l join part p on l.l_partkey=p.p_partkey join supplier s on l.l_suppkey=s.s_suppkey join nation n on s.s_nationkey=n.n_nationkey join region r on n.n_regionkey=r.r_regionkey)"""
REC = """rec as (select o_orderkey record_id, o_custkey official_id, o_orderpriority environment, o_orderstatus basis, cast(o_orderdate as date) d, cast(year(o_orderdate) as int) yr, cast(date_trunc('quarter', o_orderdate) as date) q from orders)"""
LAB = "lab as (select distinct record_id, domain from mention)"
WITH = f"with {MENTION}, {REC}, {LAB}"


class Tables:
    """Tables of a folder as attributes, and relations over them. Nothing is read until a query runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        o = self.orders
        return o.select(
            F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("official_id"), F.col("o_orderpriority").alias("environment"), F.col("o_orderstatus").alias("basis"),
            F.col("o_orderdate").cast("date").alias("d"), F.year("o_orderdate").alias("yr"), F.date_trunc("quarter", F.col("o_orderdate").cast("date")).cast("date").alias("q"), F.col("o_totalprice").alias("amount"),
        )

    @cached_property
    def mentions(self) -> DataFrame:
        s = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        m = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        return m.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("line_no"), F.col("p_name").alias("dataset"), F.col("p_brand").alias("product"), F.col("p_type").alias("collection"), F.col("s_name").alias("provider"), F.col("r_name").alias("domain"))

    @cached_property
    def products(self) -> DataFrame:
        """mentions without provider and domain: only parts are joined."""
        m = self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
        return m.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("line_no"), F.col("p_name").alias("dataset"), F.col("p_brand").alias("product"), F.col("p_type").alias("collection"))

    @cached_property
    def labels(self) -> DataFrame:
        """(record_id, domain): which domains a record touches; only keys are joined."""
        s = self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return self.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("record_id"), F.col("r_name").alias("domain"), F.col("l_linenumber").alias("line_no"))

    def run(self, low: int, high: int) -> DataFrame:
        """(record_id, domains): the label sets that the lines low to high of a record give."""
        return self.labels.filter(F.col("line_no").between(low, high)).groupBy("record_id").agg(F.collect_set("domain").alias("domains"))

    @cached_property
    def ratings(self) -> DataFrame:
        """(record_id, rater, labels): three raters, each sees a third of the lines."""
        return self.labels.groupBy("record_id", (F.col("line_no") % 3).alias("rater")).agg(F.array_sort(F.collect_set("domain")).alias("labels"))


RATINGS = "ratings as (select l.l_orderkey record_id, l.l_linenumber % 3 rater, list_sort(list(distinct r.r_name)) labels from lineitem l join supplier s on l.l_suppkey=s.s_suppkey join nation n on s.s_nationkey=n.n_nationkey join region r on n.n_regionkey=r.r_regionkey group by 1, 2)"


def run_sql(name: str, low: int, high: int) -> str:
    return f"{name} as (select l.l_orderkey record_id, list_sort(list(distinct r.r_name)) s from lineitem l join supplier s on l.l_suppkey=s.s_suppkey join nation n on s.s_nationkey=n.n_nationkey join region r on n.n_regionkey=r.r_regionkey where l.l_linenumber between {low} and {high} group by 1)"


PAIRS = f"with {run_sql('ra', 1, 3)}, {run_sql('rb', 2, 7)}, pr as (select ra.record_id, ra.s a, rb.s b, len(list_intersect(ra.s, rb.s)) i, len(ra.s)+len(rb.s)-len(list_intersect(ra.s, rb.s)) u from ra join rb using (record_id))"
