"""Mention tables, similar names and review lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mentions as M
from ..operators import naming as N
from ..operators import register as Reg
from .bind import WITH
from .texts import PARTS, turns


def talk(t):
    """Conversations as records: turns as lines under their role, users without a known name; two environments."""
    c = t.conversations.withColumn("role", F.when(F.col("role") == "user", "Unknown").otherwise(F.col("role")))
    one = F.struct("turn", F.concat("role", F.lit(": "), F.translate("text", "\n:", "  ")).alias("x"))
    r = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]), "\n").alias("t"))
    return r.withColumn("place", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"))


def mention_table(t):
    """Mentions and records by provider and dataset."""
    frame = t.spark.createDataFrame
    aliases = frame([(1, "the", "The"), (2, "la ", None)], "priority int, pattern string, value string")
    known = frame([("Assistant", "Machine")], "alias string, provider string")
    places = frame([("even", "North"), ("odd", "South")], "environment string, provider string")
    m = Reg.mention_table(talk(t), "conv_id", "t", "place", aliases, known, places, ["pour"], ["que"])
    return m.groupBy("provider", "dataset").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("records"), F.max("needs_review").alias("review"))


MENTIONS = PARTS + r""", c as (select conv_id, part, case role when 'user' then if(conv_id % 2 = 0, 'North', 'South') when 'assistant' then 'Machine' else role end provider,
case when starts_with(part, 'the') then 'The' when starts_with(part, 'la ') then coalesce(nullif(regexp_replace(part[4:], '^\\s+|\\s+$', '', 'g'), ''), part) else part end dataset,
not starts_with(part, 'the') and not starts_with(part, 'la ') and regexp_matches(part, '[;/]') review from p where part <> ''), k as (select *, regexp_replace(replace(lower(dataset), 'ß', 'ss'), '\\s+', ' ', 'g') f from c)
select provider, dataset, count(*) n, count(distinct conv_id) records, max(review::int) review from k where f <> 'pour' and not regexp_full_match(f, '[0-9]{4}') and (contains(f, ' ') or length(f) > 3 or f = 'que') group by 1, 2"""


def names(t):
    """Names of parts, of parts with their type, and of either with a trailing word."""
    n = t.part.select("p_name").distinct()
    return n.unionByName(n.select(F.concat("p_name", F.lit(" Data")).alias("p_name"))).unionByName(t.part.select(F.concat_ws(" ", "p_type", "p_name").alias("p_name")).distinct())


def review(t):
    n = t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return N.review_order(n, "p_type", ["PROMO", "SMALL"], "n", "p_brand")


QUERIES = [
    ("e02_mention_table", mention_table, MENTIONS),
    ("j15_name_clusters", lambda t: N.name_clusters(names(t), "p_name"), None),
    ("p08_titles", lambda t: t.part.select("p_partkey", T.title_text(F.concat(F.lit("  "), "p_name", F.lit(" &amp; Co  Ltd\n"), "p_type"), {"Ltd": "Limited"}).alias("title")), "select p_partkey, p_name || ' & Co Limited ' || p_type title from part"),
    ("p18_renamed", lambda t: N.renamed(t.part.select("p_brand"), "p_brand", t.spark.createDataFrame([("Brand#2", "Brand Two (B2)"), ("Brand#X", "None")], "name string, shown string")).groupBy("p_brand").agg(F.count("*").alias("n")), "select case p_brand when 'Brand#2' then 'Brand Two (B2)' else p_brand end p_brand, count(*) n from part group by 1"),
    ("r03_ordered_distinct", lambda t: t.part.select("p_partkey", F.array_join(T.ordered_distinct(F.concat_ws("; ", "p_type", "p_name", "p_type", "p_brand", "p_name")), "|").alias("k")), "select p_partkey, p_type || '|' || p_name || '|' || p_brand k from part"),
    ("o05_review_order", review, "select p_type, p_brand, count(*) n, cast(case p_type when 'PROMO' then 1 when 'SMALL' then 2 else 3 end as int) \"rank\" from part group by p_type, p_brand"),
    ("z01_plain_names", lambda t: M.plain_name_counts(turns(t), "conv_id", "t", {"la": "LA"}, ["le", "the"]), r"with q as (select conv_id, regexp_replace(unnest(string_split_regex(lower(replace(replace(text, chr(10), ' '), ':', ' ')), '[;,]')), '^\s+|\s+$', '', 'g') x from conversations) select case x when 'la' then 'LA' else x end as name, count(*) mentions, count(distinct conv_id) records from q where x not in ('', 'le', 'the') group by 1"),
    ("z02_collections_before", lambda t: M.collection_records(t.products, t.records, "collection", ["PROMO", "SMALL"], "d", "1996-07-01"), f"{WITH} select collection, count(distinct record_id) records from mention join rec using (record_id) where collection in ('PROMO', 'SMALL') and d < date '1996-07-01' group by 1"),
]
