"""A corpus cleaning pipeline in five stages, each an operator of ``tidebar.llm``.

Quality filter, near-duplicate groups, repeated passages, source mix, tokenizing.
Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``. Between
stages the rows are written as Parquet and reread.

Defined results: rows with a null or empty text are scored as empty texts; of all of
them, and of those without words, at most one passes the second stage. A null id
is like any other but comes last in its group, and its rows draw by their text in the
mix. Rows that the mix takes more than once come out as often, alike. Very long
texts are whole. Columns other than those of ``documents`` are dropped, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import attention, mixing, nearcopies, pieces, suffixes
from tidebar.llm.common import written
from tidebar.llm.labelled import held_out

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows that go to a Python worker at once, where the session sets no number: whole texts are large.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, in batches that fit small workers."""
    if spark.conf.get(BATCH) == "10000":  # Spark's own
        spark.conf.set(BATCH, BATCH_ROWS)
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier scores at 0.5 or more stay. It learns from labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = _documents(spark, docs)
    model = attention.fit(docs, labels, usable=~held_out(F.col("doc_id")))
    return attention.score(docs, model, name="_score").filter("_score >= 0.5").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash links, completed and verified by five-word similarity of 0.8 or more."""
    return nearcopies.one_of_each(_documents(spark, docs)).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of over 50 words that start elsewhere too are cut out; documents of which nothing is left go."""
    marked = _documents(spark, docs).withColumn("_before", F.octet_length("text"))
    cut = suffixes.remove_passages(marked).filter("_before is null or _before = 0 or octet_length(text) > 0")
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mix(_documents(spark, docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, and the text's pieces under merge-dropout with their number and round trip."""
    return pieces.encode_table(_documents(spark, docs), pieces.read_model(MODEL_PATH))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("passages", passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL cannot express the first and third stages; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
