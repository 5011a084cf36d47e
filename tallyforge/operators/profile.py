"""Profiles of tables, texts and links; trends; term weights and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """By column: rows, nulls, blanks, distinct values, and the median and longest length. One aggregate, then unpivoted."""
    aggs = []
    for c in columns:
        t = F.col(c).cast("string")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.trim(t) == "").alias("blanks"), F.countDistinct(c).alias("values"), F.percentile(F.length(t), F.lit(0.5)).alias("median_length"), F.max(F.length(t)).alias("longest")))
    return rows.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def variant_profile(rows: DataFrame, json: str) -> DataFrame:
    """Schema of a JSON column over all rows, and how many rows don't parse."""
    v = rows.select(F.try_parse_json(json).alias("v"), F.col(json).alias("j"))
    return v.agg(F.schema_of_variant_agg("v").alias("schema"), F.count_if(F.col("v").isNull() & F.col("j").isNotNull()).alias("broken"))


def json_key_profile(rows: DataFrame, json: str) -> DataFrame:
    """Keys of the JSON objects of a column: rows that have them."""
    keys = rows.select(F.explode(F.json_object_keys(json)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("rows"))


def duplicate_profile(rows: DataFrame, key) -> DataFrame:
    """Groups of equal keys: how many, their rows, and the rows beyond one each."""
    g = rows.groupBy(key.alias("k")).agg(F.count("*").alias("c")).filter("k is not null and c > 1")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return g.agg(F.count("*").alias("groups"), s("c").alias("records"), s(F.col("c") - 1).alias("excess"))


def shared_targets(links: DataFrame, source: str, target: str) -> DataFrame:
    """Degree distribution of targets: sources that link to them, and how many targets have so many."""
    return links.select(source, target).distinct().groupBy(target).agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("targets"))


def top_values(rows: DataFrame, column: str, n: int = 25) -> DataFrame:
    """Most frequent values, ties by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def links_in_html(pages: DataFrame, key: str, html: str, pattern: str = r"""(?i)href\s*=\s*["']([^"']+)["']""") -> DataFrame:
    """(key, position, url): distinct link targets of each page in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))
    return pages.select(key, F.posexplode(found).alias("position", "url"))


def linear_trend(points: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares y ~ x: n, slope, intercept, r2."""
    return points.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def poisson_trend(points: DataFrame, x: str, y: str) -> dict:
    """Poisson GLM y ~ x with log link: coefficients, deviance, AIC."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = VectorAssembler(inputCols=[x], outputCol="features").transform(points.select(F.col(x).cast("double"), F.col(y).cast("double").alias("label")))
    model = GeneralizedLinearRegression(family="poisson", link="log").fit(data)
    return {"slope": model.coefficients[0], "intercept": model.intercept, "deviance": model.summary.deviance, "aic": model.summary.aic}


def indexed_periods(counts: DataFrame, period: str) -> DataFrame:
    return counts.withColumn("t", F.row_number().over(Window.orderBy(period)) - 1)  # one row a period


def tf_idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): smoothed idf ln((1+n)/(1+df)) + 1 times count, rows of length 1."""
    terms = docs.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("term")).filter("length(term) > 1")
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    w = tf.join(df, "term").crossJoin(n).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def top_terms(weights: DataFrame, groups: DataFrame, key: str, group: str, n: int = 10) -> DataFrame:
    """Terms of the greatest mean weight by group."""
    size = groups.groupBy(group).agg(F.count("*").alias("_n"))
    mean = weights.join(groups.select(key, group), key).groupBy(group, "term").agg(F.sum("weight").alias("s")).join(size, group).select(group, "term", (F.col("s") / F.col("_n")).alias("mean"))
    return mean.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("mean"), "term"))).filter(F.col("place") <= n)


def text_clusters(docs: DataFrame, key: str, text: str, k: int, features: int = 1 << 14, seed: int = 1) -> DataFrame:
    """(key, cluster) by k-means over hashed TF-IDF."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    steps = [RegexTokenizer(inputCol=text, outputCol="_t", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_t", outputCol="_f", numFeatures=features), IDF(inputCol="_f", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_n"), KMeans(featuresCol="_n", predictionCol="cluster", k=k, seed=seed)]
    data = docs.filter(F.col(text).isNotNull())
    return Pipeline(stages=steps).fit(data).transform(data).select(key, "cluster")
