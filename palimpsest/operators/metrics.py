"""Ranking metrics, paired tests and answer metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking


def gain(rel: Column, rank: Column) -> Column:
    """Linear gain with a logarithmic discount; ranks from 1."""
    return rel / F.log2(rank + 1)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Every ranked row of a judged query with its relevance, 0 where not judged."""
    return run.join(qrels.select("qid").distinct(), "qid", "left_semi").join(qrels, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def dcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    return judged(run, qrels).where(F.col("rank") <= k).groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, ndcg, mrr, recall of every judged query; a query without a run has zeros."""
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rel").desc(), "doc_id"))
    ideal = qrels.withColumn("r", ideal_rank)
    ideal = ideal.groupBy("qid").agg(F.sum(F.when(F.col("r") <= k, gain(F.col("rel"), F.col("r")))).alias("idcg"), F.sum((F.col("rel") > 0).cast("int")).alias("relevant"))
    rows = judged(run, qrels)
    hit = F.col("rel") > 0
    got = rows.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("rel"), F.col("rank")))).alias("dcg"),
        F.max(F.when(hit, 1.0 / F.col("rank"))).alias("mrr"),
        F.sum((hit & (F.col("rank") <= k)).cast("int")).alias("found"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(F.lit(0.0))
    return ideal.join(got, "qid", "left").select("qid", ratio("dcg", "idcg").alias("ndcg"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"), ratio("found", "relevant").alias("recall"))


def stratified(scores: DataFrame, meta: DataFrame, names: tuple[str, ...] = ("ndcg", "mrr", "recall")) -> DataFrame:
    """Mean and population deviation of each metric, overall (tier null becomes 'overall') and by tier of meta (qid, tier)."""
    rows = scores.join(meta, "qid", "left").withColumn("tier", F.coalesce("tier", F.lit("unknown")))
    aggs = [f(n).alias(f"{n}_{label}") for n in names for f, label in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    by = rows.rollup("tier").agg(F.count(F.lit(1)).alias("n_queries"), *aggs)
    return by.withColumn("tier", F.coalesce("tier", F.lit("overall")))


def paired_t(pairs: DataFrame) -> DataFrame:
    """n, mean_diff, t of pairs (a, b); t is null for fewer than three pairs or no spread."""
    d = F.col("a") - F.col("b")
    rows = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    return rows.select("n", "mean_diff", F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """n (pairs that differ), w: the smaller sum of average ranks of |a - b|, and z of the normal approximation with ties.

    Ranks come from counts of equal differences, which are aggregated first and run up by ranges.
    """
    rows = pairs.select(F.round(F.col("a") - F.col("b"), 9).alias("d")).where("d <> 0").select(F.abs("d").alias("size"), (F.col("d") > 0).cast("int").alias("plus"))
    ranks = ranking.before(rows, "size", "plus").select(F.col("n").alias("c"), "plus", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    total = ranks.agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("plus"))).alias("w_minus"), F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("ties"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    w = F.least("w_plus", "w_minus")
    return total.select(F.coalesce(n, F.lit(0)).alias("n"), w.alias("w"), F.when(spread > 0, (w - n * (n + 1) / 4) / spread).alias("z"))


def t_p_value(t: float, n: int) -> float:
    """Two-sided p of a paired t statistic: the regularised incomplete beta function by its continued fraction."""
    df = n - 1
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x else 0.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def z_p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def answer_metrics(predicted: Column, truth: Column) -> dict[str, Column]:
    """exact, contains, precision, recall, f1, abstained, hallucination; an empty prediction is contained in any truth."""
    p, g = T.strip(F.lower(predicted)), T.strip(F.lower(truth))
    a, b = F.array_distinct(T.tok_ws(p)), F.array_distinct(T.tok_ws(g))
    both = F.size(F.array_intersect(a, b))
    there = (F.size(a) > 0) & (F.size(b) > 0)
    precision, recall = F.when(there, both / F.size(a)).otherwise(0.0), F.when(there, both / F.size(b)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    contains = p.contains(g) | g.contains(p)
    abstained = p.contains("insufficient_context") | p.contains("not enough")
    return {"exact_match": p == g, "contains_match": contains, "token_precision": precision, "token_recall": recall, "token_f1": f1, "is_abstained": abstained, "is_hallucination": ~contains & ~abstained & (f1 < 0.3)}


def answers(rows: DataFrame) -> DataFrame:
    """rows (prediction, answer, ...) with the metrics beside their columns."""
    return rows.withColumns(answer_metrics(F.col("prediction"), F.col("answer")))


def rag_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Rates and confidences over evaluated answers (with confidence), by group."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    given = lambda c: F.avg(F.when(F.col(c), F.col("confidence").cast("double")))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_questions"), rate("exact_match").alias("exact_match_rate"), rate("contains_match").alias("contains_match_rate"),
        F.avg("token_f1").alias("mean_token_f1"), rate("is_hallucination").alias("hallucination_rate"), rate("is_abstained").alias("abstention_rate"),
        F.avg(F.col("confidence").cast("double")).alias("mean_confidence"), given("is_hallucination").alias("hallucinated_mean_confidence"), given("contains_match").alias("correct_mean_confidence"),
    )
    return out.withColumn("confidence_hallucination_gap", F.col("correct_mean_confidence") - F.col("hallucinated_mean_confidence"))
