"""The corpus pipeline: five stages, each a corpus operator, over ``documents``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and reads again as the next stage's docs. All but the
last return the columns of documents. Rows stay or go one by one, not by their id:
a null or repeated id neither saves a copy or leak nor takes another row with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm import bpe_codec, decontam, langid, pii, simhash
from recspark.llm.common import table
from recspark.llm.components import stored
from recspark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is rejected below this mean probability, or without any letter.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found stay, with ``lang`` as predicted."""
    docs = docs.select(*COLUMNS)
    return langid.annotate(docs, langid.train(docs)).where(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    ).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows under a generated key, written: read again, a row has the same key."""
    return stored(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()), "keyed-documents")[0]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the first of its smallest id, null ids last."""
    docs = keyed(docs)
    groups = simhash.near_duplicates(docs, key="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    first = groups.join(docs.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(F.min(order).alias("first"))
    return docs.join(first.select("first.row_key"), "row_key", "left_semi").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is a document of its own here."""
    return decontam.clean(keyed(docs), table(spark, sf_dir, "benchmark"), key="row_key").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced in the texts and ``n_chars`` follows; no row goes."""
    masked = pii.mask(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, checked by decoding them."""
    coded = bpe_codec.round_trip(docs.select("doc_id", "text"), vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe_codec.digests(coded)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("bpe_codec", encode_tokens),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
