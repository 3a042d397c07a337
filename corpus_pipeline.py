"""Corpus pipeline: quality, near-duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
:func:`run` writes to the shared checkpoint folder and reads again as the next
stage's documents. All stages but the last return the columns of
``documents``. No stage can be expressed in SQL as a whole, so the pipeline is
tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.llm import ngram_join, packing, quality, secrets
from pallium.llm.common import cut
from pallium.llm.queries import vocabulary
from pallium.session import table

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Null and empty texts score the share of good labels, and stay if that is
    enough; a null id has no label; rows that repeat an id are judged each by
    its own text. An empty table, or one without labels of both kinds, loses
    only what such a score rejects. Other columns pass as they are.
    """
    network = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.accepted(F.col("text"), network))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join keep one document, that
    with the smallest id.

    Rows that repeat an id and rows with a null id are documents of their own:
    they are dropped only for a link, or as a repeat of id and text. Of the
    rows with a component's smallest id the longest text stays, then the one
    with the least SHA-256; a null id comes after all others.
    """
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        found = ngram_join.jaccard_components(docs)
        kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    key = "row"
    while key in docs.columns:
        key += "_"
    rows = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    found = ngram_join.jaccard_components(rows, key).select(
        F.col("doc_id").alias(key), F.col("n_shingles").alias("found_n"), F.col("component_id").alias("found_component"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", -F.coalesce(F.length("text"), F.lit(0)), digest, F.xxhash64(*docs.columns), key)
    ranked = rows.select(key, "doc_id", digest.alias("found_digest"), order.alias("found_order")).join(found, key)
    # Texts without words link with nothing: repeats of id and text are one.
    wordless = (F.col("found_n") == 0) & F.col("doc_id").isNotNull()
    group = [F.when(~wordless, F.col("found_component")), F.when(wordless, F.col("doc_id")), F.when(wordless, F.col("found_digest"))]
    kept = ranked.groupBy(*group).agg(F.min("found_order").alias("first")).select(F.col(f"first.{key}").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts; all documents stay.

    A null text stays null, repeated rows and null ids are rows like others,
    and ``n_chars``, where there is one, follows the new text.
    """
    made = docs.withColumn("text", secrets.redacted(F.col("text")))
    if "n_chars" not in docs.columns:
        return made
    kind = docs.schema["n_chars"].dataType
    return made.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences.

    A null or empty text is its closing id alone; repeated rows and null ids
    are packed like others; an empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
