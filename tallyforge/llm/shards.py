"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

Each level is decided by weighted hash draws: child i draws -ln(u_i) / w_i with u_i from a hash of the key and the
child's name, and the smallest draw wins, so each child gets its share of weight. A leaf that is added later keeps a
weight piece and a draw of its own beside the draws of the original subtrees. It competes at the root with that draw:
where it wins, the descent follows its path; where it loses, every older decision stays as it was. Rows therefore move
only into the added leaf, and siblings of a changed subtree never exchange rows.

Nulls: a null key draws like a value of its own; a null text has no bytes. Repeated rows get the same shard and
different slots. An empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, unpacked


@dataclass(frozen=True)
class HashTree:
    """leaves: (region, rack, weight) in shard order; added: the same for leaves that came later, numbered after them."""

    leaves: tuple[tuple[str, str, float], ...]
    added: tuple[tuple[str, str, float], ...] = ()

    @staticmethod
    def regular(shards: int, regions: int = 3, racks: int = 4) -> "HashTree":
        return HashTree(tuple((f"region{i % regions}", f"rack{i // regions % racks}", 1.0) for i in range(shards)))

    def grow(self, region: str, rack: str, weight: float = 1.0) -> "HashTree":
        return replace(self, added=(*self.added, (region, rack, weight)))

    @property
    def size(self) -> int:
        return len(self.leaves) + len(self.added)

    def shard_of(self, key: Column) -> Column:
        """Shard number of each key, by draws at the region, rack and shard level."""
        tree: dict[str, dict[str, list[int]]] = {}
        for i, (region, rack, _) in enumerate(self.leaves):
            tree.setdefault(region, {}).setdefault(rack, []).append(i)
        weight = lambda leaves: sum(self.leaves[i][2] for i in leaves)

        def pick(children: list[tuple[str, float, int]]) -> Column:
            draws = [F.struct((-F.log(_unit(key, name)) / F.lit(float(w))).alias("draw"), F.lit(v).alias("won")) for name, w, v in children if w > 0]
            return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])["won"]

        by_region = []
        for region, racks in tree.items():
            by_rack = [pick([(f"{region}/{rack}/{i}", self.leaves[i][2], i) for i in leaves]) for rack, leaves in racks.items()]
            rack = pick([(f"{region}/{name}", weight(leaves), j) for j, (name, leaves) in enumerate(racks.items())])
            by_region.append(_choose(rack, by_rack))
        top = [(region, sum(weight(x) for x in racks.values()), j) for j, (region, racks) in enumerate(tree.items())]
        late = [(f"{region}/{rack}/+{i}", w, -1 - i) for i, (region, rack, w) in enumerate(self.added)]
        won = pick(top + late)
        return F.when(won < 0, F.lit(len(self.leaves) - 1) - won).otherwise(_choose(won, by_region)).cast("int")


def _unit(key: Column, name: str) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(2**53))


def _choose(index: Column, options: list[Column]) -> Column:
    out = F.when(index == 0, options[0])
    for j, option in enumerate(options[1:], 1):
        out = out.when(index == j, option)
    return out


def with_slots(df: DataFrame, keyed: DataFrame, shards: int, key: str = "doc_id", order: tuple[str, ...] = (), buckets: int = 1024) -> DataFrame:
    """Adds slot, gapless from 0 within each shard, without gathering a shard in one task.

    Rows of a shard are dealt over hash buckets of the key. keyed holds (key, shard) of the same rows and is only
    counted: at most shards x buckets counts, whose running sums give each bucket its first slot. Rows are then
    numbered inside their bucket.
    """
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(buckets)).cast("int")
    counts = keyed.select("shard", bucket.alias("_bucket")).groupBy("shard", "_bucket").count()
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("_shard"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    if shards * buckets <= 100_000:
        first = F.broadcast(first)  # at most shards x buckets rows, whatever the input
    inside = Window.partitionBy("shard", "_bucket").orderBy(key, *order)
    numbered = df.withColumn("_bucket", bucket).withColumn("_in", F.row_number().over(inside) - 1)
    joined = numbered.join(first, (F.col("shard") == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_first") + F.col("_in")).cast("long")).drop("_bucket", "_in", "_shard", "_b", "_first")


def shard_documents(docs: DataFrame, tree: HashTree, grown: HashTree | None = None, keep: tuple[str, ...] = ("doc_id",), extra: dict[str, Column] | None = None) -> DataFrame:
    """docs with shard, slot and (where a grown tree is given) grown_shard."""
    key = F.col("doc_id")
    shard = tree.shard_of(key)
    late = grown.shard_of(key) if grown else F.lit(None).cast("int")
    rows = docs.select(*keep, *[c.alias(n) for n, c in (extra or {}).items()], shard.alias("shard"), late.alias("grown_shard"))
    return with_slots(rows, docs.select("doc_id", shard.alias("shard")), tree.size, order=tuple(extra or ()))


def op1_hash_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tree = HashTree.regular(24)
    extra = {"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8, "text_crc32": F.crc32(F.encode("text", "UTF-8")).cast("long"), "law": F.lit("key")}
    out = shard_documents(docs, tree, tree.grow("region0", "rack0"), extra=extra)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def stage_shard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the documents with their shard and their slot in it."""
    tree = HashTree.regular(24)
    rows = packed(docs)
    out = shard_documents(rows, tree, tree.grow("region0", "rack0"), keep=tuple(rows.columns))
    return unpacked(out, docs.columns, "shard", "slot", "grown_shard")
