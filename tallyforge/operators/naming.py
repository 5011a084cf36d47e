"""Names that look alike: lossless candidate search, then the exact rules; clusters of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .identity import connected

# Words that may close a name without telling it from another.
TRAILING_WORDS = ["Data", "Dataset", "Statistics", "Survey", "Residents", "Register", "Records", "Service", "System", "Database", "Programme", "Project", "Collection", "Information"]


def _grams(form: str, q: int):
    n = F.length(form)
    pieces = F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(F.col(form), i, F.lit(q)))
    return F.when(n >= q, pieces).otherwise(F.array().cast("array<string>"))


def _forms(names: DataFrame, form: str) -> DataFrame:
    """(form, lo, hi): distinct forms with the first and last name that has each."""
    return names.filter(F.col(form) != "").groupBy(F.col(form).alias("form")).agg(F.min("name").alias("lo"), F.max("name").alias("hi"))


def _equal(names: DataFrame, forms: DataFrame, form: str) -> DataFrame:
    """Each name with the first name of the same form: a star, not all pairs."""
    return names.join(forms.select(F.col("form").alias(form), "lo"), form).filter("lo <> name").select(F.col("lo").alias("a"), F.col("name").alias("b"))


def _contained(forms: DataFrame) -> DataFrame:
    """Forms inside other forms. Whatever contains a form has all its grams, so its rarest gram finds all of them."""
    grams = F.array_distinct(F.concat(*[_grams("form", q) for q in (1, 2, 3)]))
    every = forms.select("form", "lo", F.explode(grams).alias("g"))
    often = every.groupBy("g").agg(F.count("*").alias("n"))
    own = every.filter(F.length("g") == F.least(F.lit(3), F.length("form"))).join(often, "g")
    rarest = own.groupBy("form", "lo").agg(F.min(F.struct("n", "g"))["g"].alias("g"))
    around = every.select(F.col("form").alias("outer"), F.col("lo").alias("b"), "g")
    return rarest.join(around, "g").filter((F.col("form") != F.col("outer")) & F.contains("outer", "form")).select(F.col("lo").alias("a"), "b")


def _close(forms: DataFrame, ratio: float) -> DataFrame:
    """Forms whose sequence ratio 2M/T is above the limit (M matched of T characters in both).

    M matched characters lie in at most 1 + T - 2M blocks, so the two share more than (1.5 ratio - 1) T - 1 bigrams, and
    T is more than 2 / (2 - ratio) lengths of either. Forms that share that many bigrams share one of their rarest
    (length - 1) - bound + 1, so joining on those loses no pair. Forms of one or two characters have no partner at 0.8.
    """
    import pandas as pd

    def best(x, y, forward, back):
        from difflib import SequenceMatcher

        score = lambda a, b, asked: SequenceMatcher(None, a, b).ratio() if asked else 0.0
        return pd.Series([max(score(a, b, f), score(b, a, r)) for a, b, f, r in zip(x, y, forward, back, strict=True)], dtype="float64")

    best.__annotations__ = {"x": pd.Series, "y": pd.Series, "forward": pd.Series, "back": pd.Series, "return": pd.Series}
    score = F.pandas_udf(best, "double")

    least = 2 / (2 - ratio) * (1.5 * ratio - 1)
    bound = F.floor(F.length("form") * F.lit(least) - 1 - 1e-9) + 1
    counted = forms.filter(F.length("form") > 2).select("form", F.explode(_grams("form", 2)).alias("g")).groupBy("form", "g").agg(F.count("*").alias("c"))
    tokens = counted.select("form", "g", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("k"))
    ranked = tokens.join(tokens.groupBy("g", "k").agg(F.count("*").alias("n")), ["g", "k"])
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("form").orderBy("n", "g", "k")))
    prefix = ranked.filter(F.col("r") <= F.length("form") - 1 - bound + 1).select("form", "g", "k")
    near = F.least(F.length("x"), F.length("y")) * (2 - ratio) > F.greatest(F.length("x"), F.length("y")) * ratio - 1e-9
    found = prefix.withColumnRenamed("form", "x").join(prefix.withColumnRenamed("form", "y"), ["g", "k"]).filter((F.col("x") < F.col("y")) & near).select("x", "y").distinct()
    side = lambda form, lo, hi: forms.select(F.col("form").alias(form), F.col("lo").alias(lo), F.col("hi").alias(hi))
    # The ratio depends on which name comes first, and names are compared in their own order.
    scored = found.join(side("x", "a", "ah"), "x").join(side("y", "b", "bh"), "y").withColumn("ratio", score("x", "y", F.col("a") < F.col("bh"), F.col("b") < F.col("ah")))
    return scored.filter(F.col("ratio") > ratio).select("a", "b")


def similar_names(rows: DataFrame, name: str, ratio: float = 0.85, trailing: list[str] = TRAILING_WORDS) -> DataFrame:
    """Links (a, b), a < b, between different names that look alike; null and blank names take no part.

    Two names are alike where one contains the other (case ignored), where they are equal without trailing words, or where
    the sequence ratio of either form is above the limit. Names of equal form are linked through the first of them, so
    the links have the same components as all pairs that are alike, but not each such pair.
    """
    if ratio < 0.8:
        raise ValueError("the candidate search loses no pair from a ratio of 0.8")
    names = rows.select(F.col(name).alias("name")).filter(T.strip(name) != "").distinct()
    names = names.withColumn("low", F.lower("name")).withColumn("plain", T.strip(T.without_tail(T.collapse("low"), trailing)))
    low, plain = _forms(names, "low"), _forms(names, "plain")
    links = _equal(names, low, "low").unionByName(_equal(names, plain, "plain")).unionByName(_contained(low)).unionByName(_close(low, ratio)).unionByName(_close(plain, ratio))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def name_clusters(rows: DataFrame, name: str, ratio: float = 0.85, trailing: list[str] = TRAILING_WORDS) -> DataFrame:
    """(name, cluster) of names that look like another one; the cluster is its first name."""
    return connected(similar_names(rows, name, ratio, trailing)).select(F.col("node").alias("name"), F.col("component").alias("cluster"))


def renamed(rows: DataFrame, name: str, approved: DataFrame) -> DataFrame:
    """rows with the approved form of a name, where approved(name, shown) has one; else as it is."""
    known = approved.select(F.col("name").alias(name), F.col("shown").alias("_shown"))
    return rows.join(known, name, "left").withColumn(name, F.coalesce("_shown", name)).select(*rows.columns)


def review_order(rows: DataFrame, kind: str, first: list[str], count: str, name: str) -> DataFrame:
    """Rows by rank of their kind (others last), then the larger count, then name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in first]), F.col(kind)), F.lit(0).cast("long")), F.lit(len(first) + 1).cast("long"))
    return rows.withColumn("rank", rank.cast("int")).orderBy("rank", F.desc(count), name)
