"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm.common import new_path, ship
from nilas.llm.decontaminate import decontaminate
from nilas.llm.mixing import mix
from nilas.llm.ngram_join import jaccard_components
from nilas.llm.quality import quality_filter
from nilas.llm.sharding import shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule. Null and empty texts fail the rule on words and go; texts of any length are measured whole; rows that repeat stand or fall alike."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and a similarity of 0.8: the one with the smallest doc_id.

    Null and empty texts have no shingles and stay, and so do rows without doc_id; rows that repeat a kept doc_id are one document and all stay.
    """
    groups = jaccard_components(docs, 5, (8, 10))
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without four fifths of the five-word shingles of any benchmark item. Texts without a shingle stay, a long text goes for an item anywhere in it, a repeated row goes with its like."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the domains' tokens meet the target weights. Null and empty texts have no tokens and the rate of their domains; a row is kept once at most; equal rows share their draw."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, shard and slot; shards are near equal in bytes. Null texts have size 1, equal texts go together unless they outgrow a shard, repeated rows have slots of their own."""
    return shard(docs, 8).withColumns({"shard": F.col("shard").cast("int"), "slot": F.col("slot").cast("long")})


def _stage(stage):
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return apply


STAGES = [(stage.__name__, _stage(stage)) for stage in (quality, near_duplicates, decontamination, mixing, sharding)]
#: The order in which vectors are packed and the fitted models can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
