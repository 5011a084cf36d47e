"""One record to many mentions: header-carry parsing, validity, canonical names, institutions and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def header_mentions(rows: DataFrame, key: str, text: str, protected: list[str] = (), separators: str = r"[,;]| & ") -> DataFrame:
    """(key, line, header, part) of texts whose lines read 'header: parts'; a header holds until the next one.

    Lines are carried inside the row: higher-order functions fold them, so nothing is shuffled. Names in `protected`
    keep their separators.
    """
    arr = T.lines(text)
    kind = "array<struct<line:int,header:string,rest:string>>"
    start = F.struct(F.lit(None).cast("string").alias("h"), F.lit(0).alias("n"), F.array().cast(kind).alias("out"))

    def step(s, line):
        head = F.regexp_extract(line, r"^([^:]+):", 1)
        has = head != ""
        h = F.when(has, T.strip(head)).otherwise(s["h"])
        rest = F.when(has, T.strip(F.regexp_replace(line, r"^[^:]+:", ""))).otherwise(line)
        one = F.array(F.struct(s["n"].alias("line"), h.alias("header"), rest.alias("rest")))
        return F.struct(h.alias("h"), (s["n"] + 1).alias("n"), F.concat(s["out"], one).alias("out"))

    carried = rows.select(key, F.explode(F.aggregate(arr, start, step)["out"]).alias("x")).select(key, "x.*")
    hidden = F.col("rest")
    for i, name in enumerate(protected):
        hidden = F.replace(hidden, F.lit(name), F.lit(f"\x01{i}\x02"))
    parts = carried.select(key, "line", "header", F.explode(F.split(hidden, separators)).alias("part"))
    shown = F.col("part")
    for i, name in enumerate(protected):
        shown = F.replace(shown, F.lit(f"\x01{i}\x02"), F.lit(name))
    return parts.withColumn("part", T.strip(shown)).filter("part <> ''")


def valid_part(part: str, blocked: list[str], allowed: list[str] = ()) -> Column:
    """Not blocked, not a bare year, not one short word unless allowed."""
    p = T.casefold(T.collapse(part))
    short = ~p.contains(" ") & (F.length(p) <= 3) & ~p.isin(*allowed)
    return ~p.isin(*blocked) & ~p.rlike(r"^[0-9]{4}$") & ~short


def canonical(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Distinct names with canonical, match_type (identity, alias, unresolved) and needs_review.

    aliases(priority, pattern, value): the first pattern that matches the start decides; a null value strips the match.
    """
    d = names.select(name).filter(F.col(name).isNotNull()).distinct()
    hits = d.join(aliases, F.expr(f"{name} rlike concat('^(?:', pattern, ')')"))
    best = hits.groupBy(name).agg(F.min(F.struct("priority", "pattern", "value")).alias("b"))
    out = d.join(best, name, "left")
    stripped = F.nullif(T.strip(F.expr(f"regexp_replace({name}, concat('^(?:', b.pattern, ')'), '')")), F.lit(""))
    new = F.when(F.col("b").isNull(), F.col(name)).otherwise(F.coalesce("b.value", stripped, F.col(name)))
    kind = F.when(F.col("b").isNull(), F.when(F.col(name).rlike("[;/]"), "unresolved").otherwise("identity")).when(new == F.col(name), "identity").otherwise("alias")
    return out.select(name, new.alias("canonical"), kind.alias("match_type"), (kind == "unresolved").cast("int").alias("needs_review"))


def dropped_lines(rows: DataFrame, key: str, text: str, mentions: DataFrame) -> DataFrame:
    """Lines of a text that gave no mention."""
    every = rows.select(key, F.posexplode(T.lines(text)).alias("line", "value"))
    return every.join(mentions.select(key, "line").distinct(), [key, "line"], "left_anti")


def counts_from_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Headers and parts of each text, without exploding: (key, n_headers, n_parts)."""
    arr = T.lines(text)
    heads = F.size(F.array_distinct(F.filter(F.transform(arr, lambda x: F.regexp_extract(x, r"^([^:]+):", 1)), lambda h: h != "")))
    parts = F.size(F.filter(F.flatten(F.transform(arr, lambda x: F.split(F.regexp_replace(x, r"^[^:]+:", ""), "[,;]"))), lambda p: T.strip(p) != ""))
    return rows.select(key, heads.alias("n_headers"), parts.alias("n_parts"))


def entity_kind(name: str | Column, organisation: list[str], aliases: list[str] = ()) -> Column:
    """person, organisation or ambiguous by aliases, organisation words, digits, capitals and word count."""
    n = F.col(name) if isinstance(name, str) else name
    words = F.size(F.split(T.collapse(n), " "))
    out = F.when(T.casefold(T.collapse(n)).isin(*[a.lower() for a in aliases]), "organisation") if aliases else F.when(F.lit(False), "")
    out = out.when(n.rlike(rf"(?i)\b(?:{'|'.join(organisation)})\b"), "organisation")
    return out.when(n.rlike("[0-9]") | (n == F.upper(n)) | (words == 1), "ambiguous").otherwise("person")


def looks_like_name(x: Column) -> Column:
    """Two to five capitalised words, particles allowed."""
    return x.rlike(r"^(?U)\p{Lu}[\p{L}'’.-]*(?:\s+(?:de|van|von|der|la|le|bin|al)\b)*(?:\s+\p{Lu}[\p{L}'’.-]*){1,4}$")


def institution_mentions(rows: DataFrame, key: str, text: str, organisation: list[str]) -> DataFrame:
    """(key, institution): tokens after names and before the next name, once for each record.

    Tokens of a line are read in order; those that look like a person's name and carry no organisation word are names.
    """
    org = rf"(?i)\b(?:{'|'.join(organisation)})\b"
    tokens = F.filter(F.flatten(F.transform(T.lines(text), lambda x: F.transform(F.split(x, ","), T.strip))), lambda t: t != "")
    kept = F.filter(tokens, lambda t: (F.length(t) > 2) & (t.rlike(org) | ~looks_like_name(t)) & ~t.rlike(r"^[0-9\W]+$"))
    return rows.select(key, F.explode(F.array_distinct(kept)).alias("institution"))


def people(rows: DataFrame, key: str, text: str, organisation: list[str]) -> DataFrame:
    """(key, name, kind): names by folded key, the best kind of equal keys first (person, ambiguous, organisation)."""
    each = rows.select(key, F.explode(F.flatten(F.transform(T.lines(text), lambda x: F.split(x, "[,;]")))).alias("raw")).withColumn("name", T.collapse("raw")).filter("name <> ''")
    each = each.withColumn("kind", entity_kind("name", organisation)).withColumn("name_key", T.casefold("name"))
    rank = F.when(F.col("kind") == "person", 0).when(F.col("kind") == "ambiguous", 1).otherwise(2)
    return each.groupBy(key, "name_key").agg(F.min(F.struct(rank.alias("r"), "name", "kind")).alias("b")).select(key, "b.name", "b.kind")


def compound(rows: DataFrame, name: str, splits: DataFrame) -> DataFrame:
    """Rows of compound names become one row for each part; splits(compound, part)."""
    hit = rows.join(splits, F.col(name) == F.col("compound"), "left")
    return hit.withColumn(name, F.coalesce("part", name)).drop("compound", "part")


def ranked_suffix(rows: DataFrame, official: str, order: list[str], out: str = "record_key") -> DataFrame:
    """Row-order-free ids: the official id, with /a, /b ... by content rank where it repeats."""
    w = Window.partitionBy(official)
    rank = F.row_number().over(w.orderBy(*order))
    many = F.count("*").over(w) > 1
    return rows.withColumn(out, F.when(many, F.concat(F.col(official).cast("string"), F.lit("/"), T.row_suffix(rank))).otherwise(F.col(official).cast("string")))


def plain_name_counts(rows: DataFrame, key: str, text: str, aliases: dict[str, str], stop: list[str]) -> DataFrame:
    """(name, mentions, records) by the plain split: folded, cut at newlines and ';', 'provider:' dropped, cut at ','."""
    pieces = F.transform(F.split(F.lower(text), "[\n;]"), lambda p: F.regexp_replace(p, "^[^:]*:", ""))
    parts = F.flatten(F.transform(pieces, lambda p: F.transform(F.split(p, ","), T.strip)))
    found = rows.select(key, F.explode(parts).alias("name"))
    shown = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in aliases.items()], F.col("name"))
    kept = found.withColumn("name", shown).filter((F.col("name") != "") & ~F.col("name").isin(*stop))
    return kept.groupBy("name").agg(F.count("*").alias("mentions"), F.countDistinct(key).alias("records"))


def collection_records(mentions: DataFrame, records: DataFrame, collection: str, chosen: list[str], date: str, before: str, record: str = "record_id") -> DataFrame:
    """Distinct records dated before a day that mention each of the chosen collections."""
    old = records.filter(F.col(date) < F.lit(before).cast("date")).select(record)
    kept = mentions.filter(F.col(collection).isin(*chosen)).select(record, collection)
    return kept.join(old, record, "left_semi").groupBy(collection).agg(F.countDistinct(record).alias("records"))
