"""Postings and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import small


def tokens(docs: DataFrame, words=T.tok_regex, *keep: str) -> DataFrame:
    """One row for each token: doc_id, the kept columns, term."""
    return docs.select("doc_id", *keep, F.explode(words(F.col("text"))).alias("term"))


def postings(docs: DataFrame, words=T.tok_regex, *keep: str) -> DataFrame:
    """doc_id, the kept columns, term, tf. Counted within a task before the shuffle."""
    return tokens(docs, words, *keep).groupBy("doc_id", *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def postings_of(docs: DataFrame, terms: DataFrame, words=T.tok_regex, *keep: str) -> DataFrame:
    """doc_id, the kept columns, dl, term, tf for the terms of `terms` only: other tokens go before anything shuffles, and each text is cut once for its length and its tokens."""
    cut = docs.select("doc_id", *keep, words(F.col("text")).alias("w"))
    rows = cut.select("doc_id", *keep, F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    rows = rows.join(small(terms.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("doc_id", *keep, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


#: A term that no text has: the posting that every document has.
EVERY = ""


def postings_and_lengths(docs: DataFrame, terms: DataFrame, words=T.tok_regex, *keep: str) -> DataFrame:
    """postings_of() with one more posting for every document, of the term EVERY: numbers and lengths of all documents come from the same rows, each text cut once."""
    cut = docs.select("doc_id", *keep, F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("w"))
    rows = cut.select("doc_id", *keep, F.size("w").cast("long").alias("dl"), F.explode(F.array_append("w", F.lit(EVERY))).alias("term"))
    wanted = terms.select("term").unionByName(terms.sparkSession.createDataFrame([(EVERY,)], "term string")).distinct()
    rows = rows.join(small(wanted), "term", "left_semi")
    return rows.groupBy("doc_id", *keep, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(posts: DataFrame, *by: str) -> DataFrame:
    """by, n, avgdl from postings_and_lengths(). No filter, so that the shuffle of the postings stays the same and Spark makes it once."""
    of_doc = F.when(F.col("term") == EVERY, F.col("dl"))
    return posts.groupBy(*by).agg(F.count(of_doc).alias("n"), F.avg(of_doc).alias("avgdl"))


def lengths(docs: DataFrame, words=T.tok_regex, *keep: str) -> DataFrame:
    """doc_id, the kept columns, dl: tokens of every document, also of those without any."""
    return docs.select("doc_id", *keep, F.greatest(F.coalesce(F.size(words(F.col("text"))), F.lit(0)), F.lit(0)).cast("long").alias("dl"))


def doc_frequency(docs: DataFrame, words=T.tok_regex, *by: str) -> DataFrame:
    """by, term, df: each document gives its distinct terms, so one shuffle of partial counts is all."""
    return docs.select(*by, F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))


def frequency_in(posts: DataFrame, *by: str) -> DataFrame:
    """by, term, df of postings. Counting by tf keeps the shuffle of the postings the same, so that Spark makes it once."""
    return posts.groupBy(*by, "term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def query_terms(queries: DataFrame, words=T.tok_regex) -> DataFrame:
    """qid, term, qtf of queries (qid, text)."""
    return queries.select("qid", F.explode(words(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def idf_smooth(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)
