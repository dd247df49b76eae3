"""The corpus pipeline: language ID, near-duplicate removal, pseudonyms, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet
and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import common, jaccard_join, language_crf, packing, pseudonyms, word_ids

#: A text whose words are less sure of any language (mean of each word's largest marginal) is rejected. Texts that switch between known languages stay.
LEAST_SURE = 0.5
#: Near duplicates: shingles of five words, similarity of 80 of 100 or more.
NEAR = (5, 80, 100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts of no known language. A missing lang is filled in. If no row is labelled, only texts without a letter go."""
    model = language_crf.fit(language_crf.training_sample(docs))
    if not model.languages:
        return docs.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    lang, score, sure = (common.free_name(docs, n) for n in ("predicted", "predicted_score", "predicted_sure"))
    found = language_crf.predict(docs, model, lang, score, sure).where((F.col(lang) != language_crf.UNKNOWN) & (F.col(sure) >= LEAST_SURE))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts the row with the smallest doc_id stays (a null one before all, ties by a hash of the text).

    Rows are linked by their texts, whatever their doc_ids: unlike texts under one doc_id, or under none, all stay. Rows equal in doc_id and
    text are one. Texts without words are linked with nothing, and stay once for each doc_id.
    """
    key, first, nth = (common.free_name(docs, n) for n in ("row_key", "row_hash", "row_nth"))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text"))
    found = jaccard_join.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), *NEAR)  # a written table
    smallest = keyed.select(key, "doc_id").join(found.select(F.col("doc_id").alias(key), "component_id").distinct(), key)
    stay = smallest.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("best")).select(F.col("best")[key].alias(key))
    # should two rows that differ have one key, both stay
    kept = keyed.join(stay, key, "left_semi").withColumn(first, F.xxhash64("text", F.lit(1)))
    return kept.withColumn(nth, F.row_number().over(Window.partitionBy(key, first).orderBy(first))).where(F.col(nth) == 1).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, with the key that pseudonyms.secret_key() finds; n_chars follows the text. Null texts stay null."""
    count = common.free_name(docs, "values")
    found = pseudonyms.pseudonymise(docs, count=count).drop(count)
    return (found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 2048 ids; a null or empty text is its end id alone, a long one is cut."""
    return packing.pack(docs, word_ids.default_path(), end_id=1)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Training and tokenisation have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.temporary(spark):  # the stages' tables go once the last one is written
        for name, stage in STAGES[:-1]:
            docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return common.kept(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
