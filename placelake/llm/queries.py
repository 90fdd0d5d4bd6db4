"""Queries of this subpackage, one for each operator; __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake.llm import chat, covertree, decontaminate, language, mixing, paragraphs, secrets, sharding, simhash, tokens


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Shares of expected tokens: text that is good and clean mostly, some that is plain, none that is toxic.
WEIGHTS = {"good clean": 0.85, "plain clean": 0.15}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table; a null in either label leaves a row out."""
    name = F.concat_ws(" ", F.when(F.col("quality") == 1, "good").otherwise("plain"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    return labels.where("quality is not null and toxic is not null").select("doc_id", name.alias("domain"))


def op1_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation over itself with another's last reply: the common prompt once, both completions and their masks. Null roles count as user, null texts as empty; rows without conv_id are left out; an empty table gives none."""
    return chat.format_preferences(chat.against_neighbour(read(spark, sf_dir, "conversations")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and test item whose best alignment scores half of a full copy's or more, with the score and the place. Null and wordless texts match nothing; rows without doc_id group together."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base and all spans, and how many of its values one owner alone holds (n_live) or three and more (n_copied); source stands for the owner. A null text counts as empty."""
    docs = read(spark, sf_dir, "documents").withColumn("repository", F.concat_ws("/", "source", "lang"))
    found = secrets.scan(docs, owner="source", repository="repository")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), F.col("all_spans").alias("spans"), "n_live", "n_copied")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: how many others it links with, and the smallest vec_id that links reach. Null, zero and non-finite vectors link with nothing."""
    return covertree.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id that links of three bits or fewer reach. Null, empty and wordless texts have fingerprint zero."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, from the files written: where its ids start, how many there are, and their checksum. Null text: the end id alone."""
    import public_tokenizers

    return tokens.read_tokens(spark, tokens.write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: words, posterior by domain, rate, and copies to take. Texts without words get the posterior of such a text."""
    rated, names = mixing.mix(read(spark, sf_dir, "documents"), domains(read(spark, sf_dir, "labels")), WEIGHTS)
    columns = [F.round(F.col("p")[k], 6).alias("p_" + d.replace(" ", "_")) for k, d in enumerate(names)]
    return rated.select("doc_id", "tokens", *columns, F.round("rate", 6).alias("rate"), "copies")


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage that repeats: where it is, how many of its words go, who keeps them, and its clusters. Texts without words have none; equal rows count each."""
    return paragraphs.repeated_passages(read(spark, sf_dir, "documents")).drop("row_id", "copy")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: size, checksum, shard and slot under the law `rows`. Null texts have size 1; equal rows get slots of their own."""
    dealt = sharding.ring_shards(read(spark, sf_dir, "documents"), n_shards=16, per_shard=64)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it was held out, the language of the largest share, that share, and all shares. `und` where the text is null or has no letter."""
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs.select("doc_id", "text", "lang")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_preference_chat, op2_decontamination, op3_secret_scan, op4_embedding_dedup, op5_simhash_dedup, op6_token_output, op7_soft_mixing, op8_paragraph_dedup, op9_sharding, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {}
