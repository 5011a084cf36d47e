"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import made, materialize, release
from tallyforge.llm.decontaminate import stage_decontaminate
from tallyforge.llm.mixing import stage_mix
from tallyforge.llm.neardup import stage_near_dedup
from tallyforge.llm.quality import stage_quality
from tallyforge.llm.shards import stage_shard

#: (name, function(spark, docs, sf_dir) -> DataFrame); each works on what the one before it kept.
STAGES = [
    ("quality", stage_quality),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("shard", stage_shard),
]

#: No stage after the first joins on values that SQL can compute (signatures, latent vectors, seeded hashes).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result but the last is written and read again, and what it was made from is deleted."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since=mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
