"""A register from raw rows to a clean, identified, filtered table: composition of the smaller operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import identity as I
from . import mentions as M
from . import relations as R

#: Raw column -> name used here.
NAMES = {"Project Number": "project_id", "Project Name": "title", "Accredited Researchers": "researchers", "Legal Gateway": "basis", "Protected Data Accessed": "datasets", "Processing Environment": "environment", "Accreditation Date": "date"}


def time_fields(rows: DataFrame, date: str = "date") -> DataFrame:
    q = F.quarter(date)
    return rows.withColumns({"year": F.year(date), "quarter": F.concat(F.lit("Q"), q), "quarter_label": F.concat(F.lit("Q"), q, F.lit(" "), F.year(date)), "quarter_date": F.date_trunc("quarter", date).cast("date")})


def date_key(x: str | Column) -> Column:
    """ISO date where it parses, else the folded text."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.date_format(F.try_to_timestamp(c.cast("string")), "yyyy-MM-dd"), T.duplicate_key(c.cast("string")))


def cleaned(raw: DataFrame, rulings: DataFrame | None = None, words: str = "digital economy act", order: str = "row_ix") -> DataFrame:
    """Rename, filter, duplicate tiers, rulings, ids, clean texts, time fields - in this order.

    order is the source order of the rows. Tier-2 groups keep their first row with the ordered union of their dataset
    and researcher lines. Ids don't depend on row order.
    """
    rows = raw.withColumnsRenamed({k: v for k, v in NAMES.items() if k in raw.columns})
    rows, _ = R.required(rows, "date", "title", "basis", words)
    keyed = rows.withColumn("_title", T.strip("title"))
    tiered = I.duplicate_tiers(keyed, ["project_id", "_title"], "date", ["datasets", "researchers"], ["basis", "environment"], order)
    for column in ("datasets", "researchers"):
        union = I.merge_group(tiered, ["project_id", "_title"], column, order).withColumnRenamed(column, "_u")
        tiered = tiered.join(union, ["project_id", "_title"], "left").withColumn(column, F.when(F.col("tier") == 2, F.col("_u")).otherwise(F.col(column))).drop("_u")
    kept = tiered.filter("keep").drop("keep", "group_size")
    if rulings is not None:
        kept = I.apply_rulings(kept, rulings, "project_id", order)
    ids = M.ranked_suffix(kept, "project_id", ["date", "title", "datasets", "researchers", "basis", "environment"], "record_id")
    shown = ids.withColumns({c: T.single_line(c) for c in ("title", "basis", "environment")}).drop("_title")
    return time_fields(shown)


def filtered(records: DataFrame, mentions: DataFrame, collections: DataFrame | None = None, *, text: str | None = None, dataset: str | None = None, provider: str | None = None, environment: str | None = None, members: dict[str, str] | None = None, present: list[str] = ()) -> DataFrame:
    """Records that meet all given conditions, with shown and total counts.

    dataset may be 'collection::X': any dataset of that collection. members: column -> member of its ';' list.
    """
    base = records.filter(R.all_present(list(present))) if present else records
    p = R.conjunction([R.search(text, ["record_id", "title", "researchers"]), F.col("environment") == environment if environment else None, *[R.has_member(c, v) for c, v in (members or {}).items()]])
    out = base.filter(p)
    if dataset and dataset.startswith("collection::") and collections is not None:
        names = collections.filter(F.col("collection") == dataset.split("::", 1)[1]).select("dataset")
        out = out.join(mentions.join(names, "dataset", "left_semi").select("record_id").distinct(), "record_id", "left_semi")
    elif dataset:
        out = out.join(mentions.filter(F.col("dataset") == dataset).select("record_id").distinct(), "record_id", "left_semi")
    if provider:
        out = out.join(mentions.filter(F.col("provider") == provider).select("record_id").distinct(), "record_id", "left_semi")
    return out


def collection_rows(mentions: DataFrame, labels: str = "collections", name: str = "dataset") -> DataFrame:
    """A row for each collection of a mention; mentions without one stay under their own name."""
    shown = F.when(F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0, F.col(labels)).otherwise(F.array(name))
    return mentions.withColumn("shown", F.explode(shown))


def product_matches(mentions: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """All products whose alias (exact or without acronym) a mention has, each once, in reference order; aliases(alias, product, place)."""
    keys = mentions.select(F.col(name)).distinct().withColumn("_k", F.explode(T.lookup_keys(name)))
    known = aliases.select(T.casefold(T.collapse("alias")).alias("_k"), "product", "place")
    return keys.join(known, "_k").groupBy(name, "product").agg(F.min("place").alias("place"))


def providers(names: DataFrame, name: str, aliases: DataFrame, environments: DataFrame, environment: str) -> DataFrame:
    """names with provider: alias by folded key, else by the environment, else the collapsed name."""
    a = aliases.select(T.casefold(T.collapse("alias")).alias("_k"), F.col("provider").alias("_a"))
    e = environments.select(F.col("environment").alias("_env"), F.col("provider").alias("_b"))
    out = names.withColumn("_k", T.casefold(T.collapse(name))).join(a, "_k", "left").join(e, F.col(environment) == F.col("_env"), "left")
    unknown = F.col(name).isNull() | (T.strip(name) == "") | (F.col("_k") == "unknown")
    return out.withColumn("provider", F.coalesce("_a", F.when(unknown, F.col("_b")), T.collapse(name))).drop("_k", "_a", "_b", "_env")


def mention_table(records: DataFrame, key: str, text: str, environment: str, aliases: DataFrame, provider_aliases: DataFrame, environments: DataFrame, blocked: list[str], allowed: list[str] = (), protected: list[str] = ()) -> DataFrame:
    """(key, line, header, part, dataset, match_type, needs_review, provider): one row for each valid mention in a record's text.

    Lines are parsed under their headers, parts take their canonical name, invalid names go, and providers come from the
    header or, where that is unknown, from the record's environment. key is unique in records.
    """
    found = M.header_mentions(records, key, text, protected)
    named = found.join(M.canonical(found, "part", aliases), "part").withColumnRenamed("canonical", "dataset")
    valid = named.filter(M.valid_part("dataset", blocked, allowed)).join(records.select(key, F.col(environment).alias("_where")), key)
    return providers(valid, "header", provider_aliases, environments, "_where").select(key, "line", "header", "part", "dataset", "match_type", "needs_review", "provider")
