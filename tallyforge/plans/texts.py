"""Text, mention, key and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mentions as M
from ..operators import profile as P

#: Conversation turns as header: text lines of one record.
TURNS = "turns as (select conv_id, string_agg(role || ': ' || replace(replace(text, chr(10), ' '), ':', ' '), chr(10) order by turn) t from conversations group by 1)"


def turns(t):
    one = F.struct("turn", F.concat("role", F.lit(": "), F.translate("text", "\n:", "  ")).alias("x"))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]), "\n").alias("t"))


def carried(t):
    """Mentions by role of the header line they stand under."""
    return M.header_mentions(turns(t), "conv_id", "t").groupBy("header").agg(F.count("*").alias("parts"), F.countDistinct("conv_id").alias("records"))


def links(t):
    return P.links_in_html(t.pages, "page_id", "html")


def dated_links(t):
    """Latest link by a date in its path, by host."""
    d = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "/([0-9]+)(?:[/?]|$)", 1).alias("n")).filter("n <> ''")
    return d.groupBy("host").agg(F.max(F.struct(F.col("n").cast("long").alias("n"), "page_id")).alias("m")).select("host", "m.n", "m.page_id")


_S = r"[ \t\n\r\x0B\f]"  # what the cleaned column treats as space in these tables
#: Parts of the text of each turn.
PARTS = r"""with p as (select conv_id, role, regexp_replace(unnest(string_split_regex(replace(replace(text, chr(10), ' '), ':', ' '), '[,;]| & ')), '^\s+|\s+$', '', 'g') part from conversations)"""
_BITS = [f"('0x' || substr(h, {i * 5 // 4 + 1}, 3))::int >> {7 - i * 5 % 4} & 31" for i in range(12)]
TOKENS = f"with d as (select n_nationkey, sha256('ns' || chr(31) || n_name) h from nation) select n_nationkey, {' || '.join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({b}) + 1, 1)" for b in _BITS)} as token from d"

QUERIES = [
    ("p02_duplicate_key", lambda t: t.part.select("p_partkey", T.duplicate_key(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" <b>x</b>\r\n"))).alias("k")), "select p_partkey, lower(p_name) || ' x' k from part"),
    ("p03_single_line", lambda t: t.documents.select("doc_id", F.sha2(T.single_line("text"), 256).alias("h")), f"select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '_x000D_', ' ', 'g'), '<[^>]*>', ' ', 'g'), '{_S}+', ' ', 'g'))) h from documents"),
    ("p10_basic_name", lambda t: t.part.select("p_partkey", T.basic_name(F.concat("p_name", F.lit(" – ‘a’ .; "))).alias("k")), "select p_partkey, p_name || ' - ''a''' k from part"),
    ("p11_without_tail", lambda t: t.part.select("p_partkey", T.without_tail(F.concat("p_name", F.lit(" data Dataset  ")), ["data", "dataset", "survey"]).alias("k")), "select p_partkey, p_name k from part"),
    ("p12_canonical_names", lambda t: M.canonical(t.part, "p_name", t.spark.createDataFrame([(1, "blue.*", "Blue"), (2, "red ", None), (3, "[a-f]", "early")], "priority int, pattern string, value string")), "with d as (select distinct p_name from part), c as (select p_name, case when regexp_matches(p_name, '^blue') then 'Blue' when p_name like 'red %' then nullif(trim(substr(p_name, 5)), '') when regexp_matches(p_name, '^[a-f]') then 'early' else p_name end canonical from d) select p_name, canonical, case when canonical = p_name then 'identity' else 'alias' end match_type, cast(0 as int) needs_review from c"),
    ("p13_first_case", lambda t: t.part.select("p_partkey", T.first_case("p_type", [("^ECONOMY", "E"), ("ANODIZED", "A"), ("^S", "S")], "other").alias("family")), "select p_partkey, case when p_type like 'ECONOMY%' then 'E' when p_type like '%ANODIZED%' then 'A' when p_type like 'S%' then 'S' else 'other' end family from part"),
    ("p19_lookup_keys", lambda t: t.customer.select("c_custkey", F.array_join(T.lookup_keys(F.concat("c_name", F.lit(" (ABC)"))), "|").alias("keys")), "select c_custkey, lower(c_name) || ' (abc)|' || lower(c_name) \"keys\" from customer"),
    ("p21_project_key", lambda t: t.customer.select("c_custkey", T.project_key(F.concat("c_name", F.lit("  Closed"))).alias("k")), "select c_custkey, c_name k from customer"),
    ("p22_display", lambda t: t.orders.select("o_orderkey", T.display_date(F.col("o_orderdate").cast("date")).alias("shown"), T.display_list(F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderstatus", F.lit("; x y;")))).alias("list")), "select o_orderkey, strftime(o_orderdate, '%d %b %Y') shown, case when o_orderkey % 2 = 0 then o_orderstatus || '; X y' else '—' end list from orders"),
    ("p23_prompt_safe", lambda t: t.documents.select("doc_id", F.length(T.prompt_safe("text")).alias("n")), f"select doc_id, cast(case when length(trim(regexp_replace(text, '{_S}+', ' ', 'g'))) > 600 then 603 else length(trim(regexp_replace(text, '{_S}+', ' ', 'g'))) end as int) n from documents"),
    ("p24_fingerprint", lambda t: t.documents.select("doc_id", T.fingerprint("source", "text").alias("fp")), "select doc_id, substr(sha256(source || chr(10) || text), 1, 16) fp from documents"),
    ("p25_vocabulary_labels", lambda t: t.orders.select("o_orderkey", F.lower("o_orderpriority").alias("k")).join(t.spark.createDataFrame([("1-urgent", "Urgent"), ("2-high", "High")], "k string, label string"), "k", "left").groupBy(F.coalesce("label", F.lit("Unclear")).alias("label")).agg(F.count("*").alias("n")), "select case lower(o_orderpriority) when '1-urgent' then 'Urgent' when '2-high' then 'High' else 'Unclear' end \"label\", count(*) n from orders group by 1"),
    ("p26_question_key", lambda t: t.benchmark.select("item_id", T.question_key(F.concat(F.lit("1.2. "), "text")).alias("k")), "select item_id, trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '[^\\p{L}\\p{N}]+', ' ', 'g')) k from benchmark"),
    ("p28_entity_kind", lambda t: t.supplier.select(M.entity_kind("s_name", ["supplier"]).alias("kind")).unionAll(t.nation.select(M.entity_kind("n_name", ["supplier"]))).groupBy("kind").agg(F.count("*").alias("n")), "select case when s_name ilike '%supplier%' then 'organisation' else 'ambiguous' end kind, count(*) n from (select s_name from supplier union all select n_name from nation) group by 1"),
    ("p29_tokens", lambda t: t.nation.select("n_nationkey", T.token("n_name", namespace="ns").alias("token")), TOKENS),
    ("p30_text_counts", lambda t: M.counts_from_text(turns(t), "conv_id", "t").select("conv_id", "n_headers"), f"with {TURNS} select conv_id, cast(len(list_distinct(list_transform(string_split(t, chr(10)), lambda x: split_part(x, ':', 1)))) as int) n_headers from turns"),
    ("e01_header_mentions", carried, PARTS + " select role \"header\", count(*) parts, count(distinct conv_id) records from p where part <> '' group by 1"),
    ("e01_lines_of_turns", lambda t: M.header_mentions(turns(t), "conv_id", "t", separators="\x00").groupBy("header").agg(F.countDistinct("conv_id", "line").alias("lines")), "select role \"header\", count(*) \"lines\" from conversations where trim(replace(replace(text, chr(10), ' '), ':', ' ')) <> '' group by 1"),
    ("e07_people", lambda t: M.people(t.customer.select("c_custkey", F.concat(F.lit("Ann Lee, "), "c_name", F.lit("\nBo Ek; ann lee")).alias("c_name")), "c_custkey", "c_name", ["customer"]).groupBy("kind").agg(F.count("*").alias("n")), "select kind, count(*) n from (select unnest(['person', 'person', 'organisation']) kind from customer) group by 1"),
    ("r01_members", lambda t: t.part.select("p_partkey", F.array_join(T.members(F.replace("p_name", F.lit(" "), F.lit(" ; ; "))), "|").alias("m")), "select p_partkey, replace(p_name, ' ', '|') m from part"),
    ("r02_explode_usage", lambda t: t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "select word, count(*) n from (select unnest(string_split(p_name, ' ')) word from part) group by 1"),
    ("r08_json_body", lambda t: t.events.select("event_id", T.json_body(F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).alias("j")), "select event_id, trim(props) j from events"),
    ("r10_list_literal", lambda t: t.part.select("p_partkey", F.array_join(T.list_literal(F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))), "|").alias("m")), "select p_partkey, replace(p_name, ' ', '|') m from part"),
    ("r12_melt", lambda t: t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"), F.length("s_name").cast("long").alias("letters")).unpivot("s_suppkey", ["nation", "letters"], "field", "value"), "select s_suppkey, 'nation' field, cast(s_nationkey as bigint) as \"value\" from supplier union all select s_suppkey, 'letters', length(s_name) from supplier"),
    ("s05_links", lambda t: links(t).groupBy("page_id").agg(F.count("*").alias("links")), "select page_id, len(list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1))) links from pages where len(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) > 0"),
    ("s06_latest_by_host", dated_links, "with d as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) host, regexp_extract(url, '/([0-9]+)(?:[/?]|$)', 1) n from pages) select host, max(cast(n as bigint)) n, arg_max(page_id, (cast(n as bigint), page_id)) page_id from d where n <> '' group by 1"),
    ("o03_most_common_words", lambda t: P.top_values(t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''"), "word", 10), "select word, count(*) n from (select unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) word from benchmark) where word <> '' group by 1 order by n desc, word limit 10"),
    ("p07_entities", lambda t: t.pages.select("page_id", F.length(T.html_text()(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))).alias("n")), None),
    ("p16_unicode_key", lambda t: t.supplier.select("s_suppkey", T.unicode_key()(F.concat("s_name", F.lit("﹣①"))).alias("k")), "select s_suppkey, s_name || '-1' k from supplier"),
]
