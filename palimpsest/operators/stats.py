"""Describing a corpus: counts, percentiles, histograms, vocabulary, Zipf fit, tf-idf, vocabulary algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import materialise
from . import postings as P
from . import ranking

#: Stop words of the era and collection analyses, and those that the corpus statistics add.
STOPWORDS_SHORT = (
    "the a an and or but in on at to for of with by from is it that this was are be have has had not as if his her their "
    "which who whom will would shall should may can could he she they we you i been were"
).split()
STOPWORDS_LONG = STOPWORDS_SHORT + (
    "my your our its do did him them all no so than when what there also about after upon more other one two three said such same "
    "very most much some any up out into over"
).split()


def with_share(counts: DataFrame) -> DataFrame:
    """counts (..., n) with each row's percentage of all; few rows."""
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all"))), how="cross").withColumn("pct", F.round(100.0 * F.col("n") / F.col("all"), 4)).drop("all")


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, median, std, min, max. Within groups the median is Spark's exact one, which holds a group's distinct values in a task;
    over a whole table it comes from counts of values, with rows read twice."""
    v = F.col(value)
    if not by:
        rest = rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
        return rest.join(F.broadcast(ranking.at_shares(rows.select(value), value, {"median": 0.5})), how="cross").select("n", "mean", "median", "std", "min", "max")  # one row each
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def percentiles_by_index(rows: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """percent, value: the sorted values' element floor(n p / 100), the last at most.

    Counted over distinct values, so the sort is over those and not over rows.
    """
    placed = ranking.before(rows.select(F.col(value).alias("value")), "value")
    upto = placed.select("value", F.col("n").alias("c"), (F.col("before") + F.col("n")).alias("upto"))
    n = upto.agg(F.sum("c").alias("n"))
    asked = rows.sparkSession.createDataFrame([(p,) for p in percents], "percent int")
    at = asked.join(F.broadcast(n), how="cross").withColumn("at", F.least(F.floor(F.col("n") * F.col("percent") / 100), F.col("n") - 1))
    hit = F.broadcast(at).join(upto, (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
    return hit.select("percent", "value")


def percentiles_linear(rows: DataFrame, value: str, percents: list[int], *by: str) -> DataFrame:
    """Exact percentiles with linear interpolation, one column each; over a whole table from counts of values."""
    if not by:
        return ranking.at_shares(rows.select(value), value, {f"p{p}": p / 100 for p in percents})
    return rows.groupBy(*by).agg(*(F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in percents))


def binned(rows: DataFrame, value: str, edges: list[float], last_closed: bool) -> DataFrame:
    """bin, lower, upper, n of half-open bins, empty ones too; values outside are dropped. Compared with the edges, not divided."""
    k = len(edges) - 1

    def place(v: Column) -> Column:
        out = F.when(v.isNull() | F.isnan(v.cast("double")) | (v < edges[0]), None)
        for i in range(k):
            out = out.when(v < edges[i + 1], i)
        return out.when(v == edges[-1], k - 1) if last_closed else out

    index = T.once(F.col(value), place)
    got = rows.select(index.cast("int").alias("bin"), *[c for c in rows.columns if c != "bin"]).where("bin is not null")
    bins = rows.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(k)], "bin int, lower double, upper double")
    extra = [F.avg(c).alias(f"mean_{c}") for c in rows.columns if c not in (value, "bin")]
    return bins.join(got.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *extra), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def length_quality_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Population covariance over sample deviations, as published: r (n - 1) / n; 0 for two rows or fewer or no spread."""
    a = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"))
    return a.select("n", F.when((F.col("n") > 2) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).otherwise(0.0).alias("correlation"))


def term_counts(docs: DataFrame, *by: str) -> DataFrame:
    """by, term, c."""
    return P.tokens(docs, T.tok_regex, *by).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("c"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """Tokens, distinct terms, their ratio, terms that occur once and twice."""
    t = term_counts(docs).agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("vocab"), F.count_if(F.col("c") == 1).alias("hapax"), F.count_if(F.col("c") == 2).alias("dis"))
    return t.withColumn("ttr", F.col("vocab") / F.col("tokens")).withColumn("hapax_ratio", F.col("hapax") / F.col("vocab"))


def doc_ttr(docs: DataFrame) -> DataFrame:
    """Mean, sample deviation and median of documents' type-token ratios."""
    words = T.tok_regex(F.col("text"))
    ratio = docs.select(T.once(words, lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w))).alias("ttr")).where("ttr is not null")
    ratio = materialise(ratio, "type-token-ratios")
    median = ranking.at_shares(ratio, "ttr", {"median_ttr": 0.5})
    return ratio.agg(F.avg("ttr").alias("mean_ttr"), F.stddev_samp("ttr").alias("std_ttr")).join(F.broadcast(median), how="cross")  # one row each


def top_terms(docs: DataFrame, n: int) -> DataFrame:
    """rank, term, c: a limit first, so that only n rows are ranked."""
    return term_counts(docs).orderBy(F.col("c").desc(), "term").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.col("c").desc(), "term"))).select("rank", "term", "c")


def zipf(docs: DataFrame, most: int = 1000) -> DataFrame:
    top = top_terms(docs, most).select(F.log("rank").alias("x"), F.log("c").alias("y"))
    return top.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"))


def tfidf(docs: DataFrame, group: str, top: int, shortest: int, stopwords: list[str]) -> DataFrame:
    """group, rank, term, tfidf, c: tf over all tokens of the group, idf = ln(N / (1 + df)) over all documents."""
    counts = term_counts(docs, group)
    totals = counts.groupBy(group).agg(F.sum("c").alias("total"))
    df = P.doc_frequency(docs)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    kept = counts.where((F.length("term") >= shortest) & ~F.col("term").isin(stopwords))
    score = F.round(F.col("c") / F.col("total") * F.log(F.col("n") / (1 + F.col("df"))), 10)
    rows = kept.join(df, "term").join(totals, group).join(F.broadcast(n), how="cross").withColumn("tfidf", score)
    w = Window.partitionBy(group).orderBy(F.col("tfidf").desc(), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(group, "rank", "term", "tfidf", "c")


def term_queries(ranked_terms: DataFrame, group: str, starts: list[int], size: int = 3) -> DataFrame:
    """group, qid, query: runs of `size` ranked terms from each start (0-based)."""
    lists = ranked_terms.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    made = F.array(*(F.struct(F.lit(i).alias("qid"), F.array_join(F.slice(F.col("t.term"), s + 1, size), " ").alias("query")) for i, s in enumerate(starts)))
    return lists.select(group, F.explode(made).alias("q")).select(group, "q.qid", "q.query").where("query <> ''")


def pairwise_vocabulary(docs: DataFrame, group: str, order: Column | None = None) -> DataFrame:
    """a, b, shared, total, only_a, only_b, jaccard of every two groups, a before b.

    Sets meet by term: each term gives the few groups that have it, and pairs of groups are counted from these, so no vocabulary
    is multiplied with another.
    """
    has = term_counts(docs, group).groupBy("term").agg(F.collect_set(group).alias("groups"))
    position = order if order is not None else None
    sizes = has.select(F.explode("groups").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    if position is not None:
        sizes = sizes.withColumn("at", position)
    else:
        sizes = sizes.withColumn("at", F.col("g"))
    shared = has.select(F.explode("groups").alias("a"), "groups").select("a", F.explode("groups").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    a, b = sizes.select(F.col("g").alias("a"), F.col("size").alias("size_a"), F.col("at").alias("at_a")), sizes.select(F.col("g").alias("b"), F.col("size").alias("size_b"), F.col("at").alias("at_b"))
    # every two groups are the result itself
    pairs = a.join(b, F.col("at_a") < F.col("at_b")).join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    total = F.col("size_a") + F.col("size_b") - F.col("shared")
    return pairs.select("a", "b", "shared", total.alias("total"), (F.col("size_a") - F.col("shared")).alias("only_a"), (F.col("size_b") - F.col("shared")).alias("only_b"), F.round(F.col("shared") / total, 4).alias("jaccard"))


def unique_terms(docs: DataFrame, group: str, top: int) -> DataFrame:
    """group, rank, term, c: the most frequent terms that only one group has."""
    counts = term_counts(docs, group)
    own = counts.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.first(group).alias(group), F.first("c").alias("c")).where("n = 1")
    w = Window.partitionBy(group).orderBy(F.col("c").desc(), "term")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(group, "rank", "term", "c")
