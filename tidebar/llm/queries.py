"""The text operators bound to the standard tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, licenses, lm, merkle, mixing, neighbours, phrases, pieces, rules, sharding, simhash, sketch, suffixes

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_table(docs, pieces.read_model(MODEL_PATH))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edit_check(_table(spark, sf_dir, "documents"))


def op4_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm.score(docs, lm.fit_labelled(docs, _table(spark, sf_dir, "labels")))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, _table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.plan(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), merkle.lowered_fifth())


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_fingerprints": op3_fingerprints,
    "op4_attention": op4_attention,
    "op5_licenses": op5_licenses,
    "op6_sharding": op6_sharding,
    "op7_lm": op7_lm,
    "op8_suffixes": op8_suffixes,
    "op9_rules": op9_rules,
    "op10_mixing": op10_mixing,
    "op11_neighbours": op11_neighbours,
    "op12_merkle": op12_merkle,
    "op13_phrases": op13_phrases,
}
