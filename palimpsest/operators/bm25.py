"""BM25 rankings from postings.

Only postings of query terms are joined: terms of queries against the corpus shuffle by term (or are broadcast while
small, as Spark decides by their size), documents without a query term never appear. Scores are rounded to DIGITS
places before ranking, so that equal documents tie however sums are ordered; ties go to the smaller doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import materialise
from . import postings as P

DIGITS = 8


def ranked(scores: DataFrame, k: int, by: str = "qid", item: str = "doc_id") -> DataFrame:
    """The k best items of each query, with their rank."""
    keys = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def zero_filled(hits: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """hits and, for queries with fewer than k, documents with score 0 in order of doc_id.

    Of the 2k smallest doc_ids at least k aren't among fewer than k hits, so no more are needed.
    """
    few = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    short = queries.select("qid").distinct().join(few, "qid", "left").where(F.coalesce("n", F.lit(0)) < k).select("qid")
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)  # 2k rows
    fill = short.join(F.broadcast(first)).join(hits.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    return hits.unionByName(fill.withColumn("score", F.lit(0.0)))


def smooth_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, doc_id, score of documents with a query term; idf = ln((N - df + 0.5) / (df + 0.5) + 1)."""
    terms = P.query_terms(queries)
    posts = materialise(P.postings_and_lengths(docs, terms), "postings")  # read three times
    stats = P.corpus_stats(posts)  # one row
    hits = posts.join(P.frequency_in(posts), "term").join(terms, "term").join(F.broadcast(stats))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    part = F.col("qtf") * P.idf_smooth(F.col("n"), F.col("df")) * tf
    return hits.groupBy("qid", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def smooth(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, doc_id, score, rank: exactly k documents a query where there are so many, those without a query term last."""
    hits = materialise(ranked(smooth_scores(docs, queries), k).drop("rank"), "hits")  # k rows a query
    return ranked(zero_filled(hits, docs, queries, k), k).select("qid", "doc_id", "score", "rank")


def by_group(docs: DataFrame, queries: DataFrame, group: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """group, qid, doc_id, score with N, df and average length of each group."""
    terms = P.query_terms(queries)
    posts = materialise(P.postings_and_lengths(docs, terms, T.tok_regex, group), "postings")
    stats = P.corpus_stats(posts, group)
    hits = posts.join(P.frequency_in(posts, group), [group, "term"]).join(terms, "term").join(stats, group)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    part = F.col("qtf") * P.idf_smooth(F.col("n"), F.col("df")) * tf
    return hits.groupBy(group, "qid", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def okapi(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """qid, doc_id, score, rank with white-space tokens; idf = ln(N - df + 0.5) - ln(df + 0.5), negative ones replaced by epsilon times the mean idf of the vocabulary; top k, then only scores above 0."""
    words = lambda c: T.tok_ws(c, lower=True)
    terms = P.query_terms(queries, words)
    posts = materialise(P.postings_and_lengths(docs, terms, words), "postings")
    stats = P.corpus_stats(posts)  # one row
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = P.doc_frequency(docs, words).join(F.broadcast(stats)).withColumn("raw", raw)
    mean = df.agg(F.avg("raw").alias("mean_idf"))
    used = df.join(terms.select("term").distinct(), "term", "left_semi").join(F.broadcast(mean))
    used = used.select("term", "avgdl", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    hits = posts.join(used, "term").join(terms, "term")
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * tf), DIGITS).alias("score"))
    return ranked(scores, k).where("score > 0").select("qid", "doc_id", "score", "rank")
