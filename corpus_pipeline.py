"""A training corpus from documents: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored, temporary
from newsloom.llm import decontaminate, mixing, near_dups, quality, sharding


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null, blank and short texts go. Each row is judged alone, so that equal rows fare alike."""
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by four-word shingles: that with the least doc_id. Of ties, rows with
    one doc_id are one document and stay together; null and blank texts are like nothing and stay."""
    return near_dups.representatives(docs, shingle=4, pct=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of weight. Null texts hold none; without benchmark items all stay."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says. Texts without a word have any rate; without labels all rates are 1 but for chance."""
    return mixing.apply_mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in random order over 16 shards; every row, also a repeated or null one, is dealt once."""
    return sharding.shard(docs, 16)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: The random order, the classifier and the divergence rules are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again before the next; what a stage stored for itself
    is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as kept:
            kept.append(name.replace(" ", "-"))
            docs = stored(stage(spark, docs, sf_dir), kept[0])
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.select("doc_id", sharding.text_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source", "shard", "slot")
