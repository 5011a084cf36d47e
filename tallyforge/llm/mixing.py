"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, block permutations.

The words of each source form one stream, its documents in a hash order. The stream is cut into blocks of a fixed
number of words; only its last block may be short. A source with target T gets as many slots as hold T words: whole
passes over its blocks, then a part of one more pass. Every pass reads the blocks in a pseudorandom permutation of its
own; the place of the short block in the last pass is known from the inverse permutation, so the words it lacks come
from the next slot and each source gives exactly T words.

The output is a row of shards of shard_slots slots. Each slot draws its source with probability slots of the source /
all slots, so the counts of a shard are a multinomial draw, independent of other shards. The draws of a source are
numbered in output order and read its slots in that order. Over all shards a source is drawn a little too often or too
seldom (about the root of its slots); the last draws beyond a source's slots go to the sources that were drawn too
seldom, so totals are exact. Slots meet blocks in an equi-join on (source, block).

Nulls: a null source is a source of its own, last in order; a null text has no words and takes none. Sources without
words get target 0. Repeated rows count each on its own. Very long texts span many blocks, each a row of its own. Ties
(equal ids) are ordered by size, and rows alike in both are interchangeable. Empty tables give empty results. Names of
other columns can't clash. Reruns agree: all draws are hashes of slot, doc_id, source and a seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, null_safe_key, packed, permuted, unpacked, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(by_source: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """by_source(key, source, source_size) with weight and target: min(limit * size, level * weight) summing to share of all sizes.

    Closed form of resharing the excess: with sources ordered by limit * size / weight, the level is the first
    (total - capped so far) / (weight left) that is not above the ratio of its own source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = by_source.withColumn("weight", w).withColumn("_cap", F.col("source_size") * float(limit)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    up = Window.orderBy("_ratio", "key")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = base.withColumn("_total", F.sum("source_size").over(everything) * float(share)).withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    # levels rise above no ratio from the first fitting one on, and fall after it, so the largest that fits is the first
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    target = F.least("_cap", F.coalesce(level * F.col("weight"), F.col("_cap")))
    return levels.select("key", "source", "source_size", "weight", target.alias("target"))


def laid_out(docs: DataFrame, buckets: int = 4096) -> DataFrame:
    """docs(doc_id, source, size) with key, ordinal and offset in the stream of their source."""
    rows = docs.withColumn("key", null_safe_key(F.col("source"))).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit("mix")), F.lit(buckets)).cast("int"))
    parts = rows.groupBy("key", "_bucket").agg(F.count("*").alias("_n"), F.sum("size").alias("_w"))
    before = Window.partitionBy("key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows a source
    starts = parts.select("key", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"))
    inside = Window.partitionBy("key", "_bucket").orderBy("doc_id", "size")
    placed = rows.withColumn("_i", F.row_number().over(inside) - 1).withColumn("_o", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = placed.join(starts, ["key", "_bucket"])
    return out.select("doc_id", "key", "source", "size", (F.col("_n0") + F.col("_i")).alias("ordinal"), (F.col("_w0") + F.col("_o")).alias("offset"))


def _prepared(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    placed = materialize(laid_out(materialize(sized, "mix-sizes")), "mix-placed")  # words are counted once
    sources = placed.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    return placed, materialize(source_targets(sources), "mix-targets")


def source_slots(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """targets with the layout of each source: blocks, short (words of the last block), passes, rest (words of the part pass), at_short, slots, first."""
    t = targets.filter("source_size > 0").withColumn("_t", F.round("target").cast("long")).filter("_t > 0")
    t = t.withColumns({"blocks": F.ceil(F.col("source_size") / block).cast("long"), "passes": F.expr("_t div source_size")})
    t = t.withColumns({"short": F.col("source_size") - (F.col("blocks") - 1) * block, "rest": F.col("_t") - F.col("passes") * F.col("source_size")})
    t = t.withColumn("at_short", permuted(F.col("blocks") - 1, F.col("blocks"), _pass_key(F.col("passes"), seed), inverse=True))
    plain = F.ceil(F.col("rest") / block)
    part = F.when(F.col("at_short") < plain, F.ceil((F.col("rest") + block - F.col("short")) / block)).otherwise(plain)
    t = t.withColumn("slots", (F.col("passes") * F.col("blocks") + part).cast("long"))
    return t.withColumn("first", F.sum("slots").over(Window.orderBy("key")) - F.col("slots")).drop("_t")  # a row a source


def _pass_key(number, seed: int):
    return F.xxhash64(F.col("key"), number.cast("long"), F.lit(seed))


def _owner(points: DataFrame, at: str, ranges: DataFrame, first: str, size: str, width: int) -> DataFrame:
    """points with the key of the range [first, first + size) that `at` lies in, by an equi-join on stretches of `width`."""
    cut = ranges.filter(f"{size} > 0").select("key", F.col(first).alias("_first"), (F.col(first) + F.col(size)).alias("_end"))
    cut = cut.withColumn("_cell", F.explode(F.sequence(F.expr(f"_first div {width}"), F.expr(f"(_end - 1) div {width}"))))
    both = points.withColumn("_cell", F.expr(f"{at} div {width}")).join(cut, "_cell")
    return both.filter(f"{at} >= _first and {at} < _end").drop("_cell", "_end")


def drawn_slots(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, key, t): the source of every output slot and which of the source's slots it reads."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2_000_000)
    rows = spark.range(0, total, 1, parts).withColumn("_r", F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(max(1, total))))
    found = _owner(rows, "_r", sources, "first", "slots", max(4096, total // 100_000))  # at most 100,000 cells and a few a source
    draws = materialize(found.select("id", F.expr(f"id div {shard_slots}").alias("shard"), "key"), "mix-draws")
    # number of a draw among those of its source: sums over groups of shards, over shards, and inside the shard
    counts = draws.groupBy("key", "shard").agg(F.count("*").alias("n")).withColumn("_g", F.expr("shard div 1024"))
    groups = counts.groupBy("key", "_g").agg(F.sum("n").alias("n"))
    upto = lambda part, order: F.sum("n").over(Window.partitionBy(*part).orderBy(order)) - F.col("n")
    groups = groups.select("key", "_g", upto(["key"], "_g").alias("_before"))
    counts = counts.withColumn("_inner", upto(["key", "_g"], "shard")).join(groups, ["key", "_g"])
    counts = counts.select("key", "shard", (F.col("_before") + F.col("_inner")).alias("_start"))
    numbered = draws.withColumn("_i", F.row_number().over(Window.partitionBy("shard", "key").orderBy("id")) - 1)
    numbered = numbered.join(counts, ["shard", "key"]).select("id", "shard", "key", (F.col("_start") + F.col("_i")).alias("t"))
    made = draws.groupBy("key").agg(F.count("*").alias("drawn"))
    balance = sources.select("key", "slots").join(made, "key", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    balance = balance.withColumns({"over": F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), "under": F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))})
    order = Window.orderBy("key")  # a row a source
    balance = balance.withColumns({"over_first": F.sum("over").over(order) - F.col("over"), "under_first": F.sum("under").over(order) - F.col("under")})
    placed = numbered.join(balance.select("key", F.col("slots").alias("_n"), "over_first"), "key")
    fine = placed.filter("t < _n").select("id", "shard", "key", "t")
    moved = placed.filter("t >= _n").select("id", "shard", (F.col("over_first") + F.col("t") - F.col("_n")).alias("_e"))
    moved = _owner(moved, "_e", balance.select("key", "under", "under_first"), "under_first", "under", 1024).join(balance.select("key", "drawn"), "key")
    moved = moved.select("id", "shard", "key", (F.col("drawn") + F.col("_e") - F.col("_first")).alias("t"))
    return fine.unionByName(moved).select("shard", F.pmod("id", F.lit(shard_slots)).alias("slot"), "key", "t")


def slots(targets: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, key, pass, block, take): what each slot of the output reads, `take` words from the start of the block."""
    sources = materialize(source_slots(targets, block, seed), "mix-sources")
    both = drawn_slots(sources, shard_slots, seed).join(sources.select("key", "blocks", "passes", "short", "rest", "at_short"), "key")
    both = both.withColumns({"pass": F.expr("t div blocks"), "_q": F.expr("t % blocks")})
    lacking = F.when(F.col("_q") > F.col("at_short"), F.lit(block) - F.col("short")).otherwise(0)
    left = F.col("rest") - F.col("_q") * block + lacking
    take = F.when(F.col("pass") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), left)).cast("long")
    return both.select("shard", "slot", "key", "pass", permuted(F.col("_q"), F.col("blocks"), _pass_key(F.col("pass"), seed)).alias("block"), take.alias("take"))


def taken_pieces(placed: DataFrame, chosen: DataFrame, block: int) -> DataFrame:
    """(key, ordinal, pass, shard, slot, from, words): the words of a document that a slot reads, counted from its first word."""
    parts = placed.filter("size > 0").select("key", "ordinal", "size", "offset", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))).alias("block"))
    both = parts.join(chosen.hint("merge"), ["key", "block"])  # its size isn't known to the planner, so never broadcast
    start = F.greatest(F.col("offset"), F.col("block") * block)
    end = F.least(F.col("offset") + F.col("size"), F.col("block") * block + F.col("take"))
    return both.select("key", "ordinal", "pass", "shard", "slot", (start - F.col("offset")).alias("from"), (end - start).alias("words")).filter("words > 0")


def mix(docs: DataFrame, block: int = 64, shard_slots: int = 4096, seed: int = 20260714) -> DataFrame:
    """docs(doc_id, source, size) -> doc_id, size, source_size, target, taken, and the first and last output shard of its words (null: none)."""
    placed, targets = _prepared(docs)
    pieces = taken_pieces(placed, slots(targets, block, shard_slots, seed), block)
    taken = pieces.groupBy("key", "ordinal").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    out = placed.join(taken, ["key", "ordinal"], "left").join(targets.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mix(docs)


def stage_mix(spark, docs: DataFrame, sf_dir: str, block: int = 512, shard_slots: int = 256, seed: int = 20260714) -> DataFrame:
    """The mixture as documents: for each pass over a document one row with the words taken in that pass, in order.

    A document taken whole keeps its text as it is; of one taken in part the taken runs of words are joined by spaces.
    Within each file rows lie by output shard, that of their first words.
    """
    w = words(F.col("text"))
    rid = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("lang"), F.col("source"))
    placed, targets = _prepared(docs.select(rid.alias("doc_id"), "source", F.size(w).cast("long").alias("size")))
    pieces = taken_pieces(placed, slots(targets, block, shard_slots, seed), block)
    runs = F.array_sort(F.collect_list(F.struct("from", "words", "shard")))
    per_pass = pieces.groupBy("key", "ordinal", "pass").agg(runs.alias("runs"), F.sum("words").alias("taken"))
    named = per_pass.join(placed.select("key", "ordinal", "doc_id", "size"), ["key", "ordinal"])
    copies = F.row_number().over(Window.partitionBy("doc_id", "pass").orderBy("ordinal"))
    plan = named.select(F.col("doc_id").alias("_rid"), "pass", "runs", (F.col("taken") == F.col("size")).alias("whole"), copies.alias("_copy"))
    same = Window.partitionBy("_rid").orderBy("doc_id")
    numbered = packed(docs).withColumn("_rid", rid).withColumn("_copy", F.row_number().over(same))
    text = F.when(F.col("whole"), F.col("text")).otherwise(F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, (r["from"] + 1).cast("int"), r["words"].cast("int")))), " "))
    out = numbered.join(plan, ["_rid", "_copy"]).withColumn("text", text).withColumn("_shard", F.col("runs")[0]["shard"]).drop("runs")
    out = unpacked(out.sortWithinPartitions("_shard"), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
