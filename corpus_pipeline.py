"""A corpus pipeline over `documents`: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes all rows that the one before kept. All but the last return the columns of `documents`; the last returns
where each document goes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake.llm import decontaminate, language, mixing, sharding, simhash
from placelake.llm.queries import domains

#: Domains that keep the tokens they have, whatever their share; all others, the toxic ones, shall have none.
WANTED = {"good clean", "plain clean"}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go: null texts and texts without a letter."""
    return language.keep_identified(docs, language.fit(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal fingerprints, the one of the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with a test item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose rate in the mixture is under a half: toxic ones. Clean domains' targets are the tokens they have, so that their rates stay near 1."""
    return mixing.drop_unwanted(docs, domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), WANTED)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document left."""
    return sharding.ring_shards(docs, n_shards=16, per_shard=64).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again in the shared folder, which also cuts the lineage."""
    from placelake.llm.common import shared_dir

    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{at}/{k}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{at}/{k}-{name}")
    return docs


#: Stages with language models, union-find and alignment aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None
