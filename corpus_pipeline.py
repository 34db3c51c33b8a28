"""A corpus from raw documents: stages of the operators in `letterflow.llm`, each kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from letterflow.llm.decontaminate import remove
from letterflow.llm.kd_shards import document_shards
from letterflow.llm.language_hd import recognised
from letterflow.llm.mixing import mixed
from letterflow.llm.superminhash import keep_one
from letterflow.llm.tables import Workspace

SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and long ones that resemble no language learnt here, go."""
    return recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of `benchmark` go."""
    return remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it: not at all, once or twice."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard they go to and their slot there."""
    return document_shards(docs, shards=SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shard", shard),
]
#: The stages score, sign and schedule texts in ways SQL has no words for; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's table is written and read again by the next.

    What a stage kept for itself, and the table before it, are deleted once its own is written: in the
    end there is the last table alone, in a folder below `spark.checkpoint.dir` that `inputFiles` names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space, before = Workspace(spark, "corpus-pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        with space.holding(f"{k}-{name}-work"):
            docs = space.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        for done in (f"{k}-{name}-work", before):
            if done:
                space.remove(done)
        before = f"{k}-{name}"
    return docs
