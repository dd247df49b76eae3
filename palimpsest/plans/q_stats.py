"""Queries of corpus statistics, vocabulary and set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import postings, stats
from ..shared import scratch, table
from ..sources import files
from .base import corpus, docs, measures, query

TOK = "WITH @DOCS@, @TOKENS@"
TOKP = "WITH @DOCS@, @TOKENS@, @POSTINGS@, @LENGTHS@"


@query("agg_tier_counts", "WITH @CORPUS@ SELECT tier, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM corpus GROUP BY tier")
def _(spark, d):
    return stats.with_share(corpus(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n")))


DESC = "count({v}) AS n, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(stddev_samp({v}), 6) AS std, round(CAST(min({v}) AS DOUBLE), 6) AS min, round(CAST(max({v}) AS DOUBLE), 6) AS max"


def rounded(rows, *keep):
    return rows.select(*keep, "n", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("mean", "median", "std", "min", "max")))


@query("agg_describe", f"WITH @CORPUS@ SELECT 'words' AS measure, {DESC.format(v='wc')} FROM corpus UNION ALL SELECT 'quality', {DESC.format(v='quality')} FROM corpus")
def _(spark, d):
    c = measures(spark, d)
    one = lambda v, name: rounded(stats.describe(c, v)).withColumn("measure", F.lit(name))
    return one("word_count", "words").unionByName(one("ocr_quality", "quality"))


@query(
    "agg_pct_index",
    "WITH @CORPUS@, r AS (SELECT wc, row_number() OVER (ORDER BY wc) - 1 AS pos, count(*) OVER () AS n FROM corpus), p AS (SELECT CAST(unnest([10, 25, 50, 75, 90, 95, 99]) AS INTEGER) AS percent) SELECT percent, wc AS value FROM r JOIN p ON r.pos = least(n * percent // 100, n - 1)",
)
def _(spark, d):
    return stats.percentiles_by_index(measures(spark, d), "word_count", [10, 25, 50, 75, 90, 95, 99])


@query("agg_pct_linear", "WITH @CORPUS@ SELECT " + ", ".join(f"round(quantile_cont(CAST(wc AS DOUBLE), {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95, 99)) + " FROM corpus")
def _(spark, d):
    out = stats.percentiles_linear(measures(spark, d), "word_count", [5, 25, 50, 75, 95, 99])
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(
    "agg_collection",
    """WITH @CORPUS@, @DOCS@, @TOKENS@, v AS (SELECT lang, count(*) AS tokens, count(DISTINCT term) AS vocab FROM tokens GROUP BY lang),
    a AS (SELECT lang, count(*) AS docs, round(avg(wc), 6) AS mean_length, round(median(wc), 6) AS median_length, round(avg(quality), 6) AS mean_quality, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'medium') AS medium, count(*) FILTER (tier = 'low') AS low, concat(min(year), '-', max(year)) AS dates FROM corpus GROUP BY lang)
    SELECT a.*, tokens, vocab, round(vocab / tokens, 6) AS ttr FROM a JOIN v USING (lang)""",
)
def _(spark, d):
    c = corpus(spark, d)
    terms = stats.term_counts(c, "lang").groupBy("lang").agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("vocab"))
    mean = lambda v, name: F.round(F.avg(v), 6).alias(name)
    a = c.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), mean("word_count", "mean_length"), F.round(F.median("word_count"), 6).alias("median_length"), mean("ocr_quality", "mean_quality"),
        *(F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")), F.concat(F.min("year").cast("string"), F.lit("-"), F.max("year").cast("string")).alias("dates"),
    )
    return a.join(terms, "lang").withColumn("ttr", F.round(F.col("vocab") / F.col("tokens"), 6))


@query("agg_ocr_compare", f"WITH @CORPUS@ SELECT lang, {DESC.format(v='quality')}, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'medium') AS medium, count(*) FILTER (tier = 'low') AS low FROM corpus GROUP BY lang")
def _(spark, d):
    c = measures(spark, d)
    tiers = c.groupBy("lang").agg(*(F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")))
    return rounded(stats.describe(c, "ocr_quality", "lang"), "lang").join(tiers, "lang")


@query(
    "agg_temporal",
    """WITH @DOCS@, r AS (SELECT concat(year // 10 * 10, 's') AS decade, era, lang, year FROM docs)
    SELECT decade, era, lang, count(*) AS n, min(year) AS first, max(year) AS last FROM r GROUP BY GROUPING SETS ((), (decade), (era), (lang, era))""",
)
def _(spark, d):
    docs(spark, d).withColumn("decade", T.decade(F.col("year"))).createOrReplaceTempView("palimpsest_dated")
    return spark.sql("SELECT decade, era, lang, count(*) AS n, min(year) AS first, max(year) AS last FROM palimpsest_dated GROUP BY GROUPING SETS ((), (decade), (era), (lang, era))")


EDGES = [0.5 + 0.025 * i for i in range(21)]


def bins_sql(value, edges, closed, rows, extra=""):
    grid = ", ".join(f"({i}, {edges[i]!r}::DOUBLE, {edges[i + 1]!r}::DOUBLE)" for i in range(len(edges) - 1))
    last = f" OR (b.bin = {len(edges) - 2} AND {value} = b.upper)" if closed else ""
    return f"b AS (SELECT * FROM (VALUES {grid}) AS t(bin, lower, upper)) SELECT b.bin, b.lower, b.upper, count({value}) AS n{extra} FROM b LEFT JOIN {rows} ON ({value} >= b.lower AND {value} < b.upper){last} GROUP BY ALL"


@query("agg_histogram", "WITH @CORPUS@, " + bins_sql("quality", EDGES, True, "corpus"))
def _(spark, d):
    return stats.binned(corpus(spark, d).select("ocr_quality"), "ocr_quality", EDGES, True)


TENTHS = [i / 10 for i in range(11)]


@query("agg_conf_dist", "WITH @CORPUS@, " + bins_sql("quality", TENTHS, True, "corpus"))
def _(spark, d):
    return stats.binned(corpus(spark, d).select("ocr_quality"), "ocr_quality", TENTHS, True)


#: The published length bins; the last has no end.
LENGTHS = [0.0, 1000.0, 5000.0, 20000.0, 50000.0, 100000.0, 1000000000.0]


@query("agg_length_bins", "WITH @CORPUS@, " + bins_sql("wc", LENGTHS, False, "corpus", ", round(avg(quality), 6) AS mean_ocr_quality"))
def _(spark, d):
    out = stats.binned(corpus(spark, d).select("word_count", "ocr_quality"), "word_count", LENGTHS, False)
    return out.withColumn("mean_ocr_quality", F.round("mean_ocr_quality", 6))


@query("agg_corr_bug", "WITH @CORPUS@ SELECT count(*) AS n, round(covar_pop(wc, quality) / (stddev_samp(wc) * stddev_samp(quality)), 6) AS correlation FROM corpus WHERE quality IS NOT NULL")
def _(spark, d):
    return stats.length_quality_correlation(corpus(spark, d), "word_count", "ocr_quality").select("n", F.round("correlation", 6).alias("correlation"))


@query(
    "agg_vocab",
    TOK + """, f AS (SELECT term, count(*) AS c FROM tokens GROUP BY term), t AS (SELECT doc_id, count(DISTINCT term) / count(*) AS ttr FROM tokens GROUP BY doc_id)
    SELECT CAST(sum(c) AS BIGINT) AS tokens, count(*) AS vocab, count(*) FILTER (c = 1) AS hapax, count(*) FILTER (c = 2) AS dis, round(count(*) / sum(c), 6) AS ttr, round(count(*) FILTER (c = 1) / count(*), 6) AS hapax_ratio,
    (SELECT round(avg(ttr), 6) FROM t) AS mean_ttr, (SELECT round(stddev_samp(ttr), 6) FROM t) AS std_ttr, (SELECT round(median(ttr), 6) FROM t) AS median_ttr FROM f""",
)
def _(spark, d):
    rows = docs(spark, d)
    both = stats.vocabulary(rows).join(F.broadcast(stats.doc_ttr(rows)), how="cross")  # one row each
    return both.select("tokens", "vocab", "hapax", "dis", *(F.round(c, 6).alias(c) for c in ("ttr", "hapax_ratio", "mean_ttr", "std_ttr", "median_ttr")))


@query("agg_zipf", TOK + ", f AS (SELECT term, count(*) AS c FROM tokens GROUP BY term), r AS (SELECT ln(row_number() OVER (ORDER BY c DESC, term)) AS x, ln(c) AS y FROM f ORDER BY c DESC, term LIMIT 1000) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM r")
def _(spark, d):
    return stats.zipf(docs(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")), "n")


@query("sort_topterms", TOK + ", f AS (SELECT term, count(*) AS c FROM tokens GROUP BY term) SELECT CAST(row_number() OVER (ORDER BY c DESC, term) AS INTEGER) AS rank, term, c FROM f ORDER BY c DESC, term LIMIT 50")
def _(spark, d):
    return stats.top_terms(docs(spark, d), 50)


def tfidf_sql(group, top, shortest, stop, where=""):
    return (
        f"WITH @DOCS@, @TOKENS@, tk AS (SELECT * FROM tokens {where}), f AS (SELECT {group}, term, count(*) AS c FROM tk GROUP BY ALL), tt AS (SELECT {group}, sum(c) AS total FROM f GROUP BY {group}), "
        f"df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tk GROUP BY term), n AS (SELECT count(*) AS n FROM docs {where}), "
        f"x AS (SELECT {group}, term, c, round(c / total * ln(n / (1 + df)), 10) AS tfidf FROM f JOIN tt USING ({group}) JOIN df USING (term) CROSS JOIN n WHERE length(term) >= {shortest} AND term NOT IN ({stop})), "
        f"tf AS (SELECT {group}, CAST(row_number() OVER (PARTITION BY {group} ORDER BY tfidf DESC, term) AS INTEGER) AS rank, term, tfidf, c FROM x QUALIFY rank <= {top})"
    )


@query("agg_tfidf", tfidf_sql("lang", 15, 3, "@STOP_LONG@") + " SELECT * FROM tf")
def _(spark, d):
    return stats.tfidf(docs(spark, d), "lang", 15, 3, stats.STOPWORDS_LONG)


def queries_sql(group, starts):
    runs = ", ".join(f"[{i}, {s}]" for i, s in enumerate(starts))
    return f", s AS (SELECT unnest([{runs}]) AS q) SELECT {group}, CAST(q[1] AS INTEGER) AS qid, string_agg(term, ' ' ORDER BY rank) AS query FROM tf JOIN s ON rank > q[2] AND rank <= q[2] + 3 GROUP BY {group}, q"


@query("agg_tfidf_era", tfidf_sql("era", 5, 4, "@STOP_SHORT@", "WHERE era <> 'unknown'") + queries_sql("era", [0, 1, 2]))
def _(spark, d):
    known = docs(spark, d).where("era <> 'unknown'")
    return stats.term_queries(stats.tfidf(known, "era", 5, 4, stats.STOPWORDS_SHORT), "era", [0, 1, 2])


@query("agg_tfidf_col", tfidf_sql("lang", 10, 4, "@STOP_SHORT@") + queries_sql("lang", [0, 3, 6]))
def _(spark, d):
    return stats.term_queries(stats.tfidf(docs(spark, d), "lang", 10, 4, stats.STOPWORDS_SHORT), "lang", [0, 3, 6])


# set algebra


def pairs_sql(group, order):
    return (
        f"WITH @DOCS@, @TOKENS@, v AS (SELECT DISTINCT {group} AS g, term FROM tokens), z AS (SELECT g, count(*) AS size, {order} AS pos FROM v GROUP BY g), "
        "sh AS (SELECT a.g AS a, b.g AS b, count(*) AS shared FROM v a JOIN v b USING (term) GROUP BY ALL), "
        "pr AS (SELECT x.g AS a, y.g AS b, x.pos AS pos_a, y.pos AS pos_b, coalesce(shared, 0) AS shared, x.size + y.size - coalesce(shared, 0) AS total, x.size - coalesce(shared, 0) AS only_a, y.size - coalesce(shared, 0) AS only_b, "
        "round(coalesce(shared, 0) / (x.size + y.size - coalesce(shared, 0)), 4) AS jaccard FROM z x JOIN z y ON x.pos < y.pos LEFT JOIN sh ON sh.a = x.g AND sh.b = y.g)"
    )


ERA_POS = "CASE g " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(T.ERA_ORDER)) + " END"


def era_position():
    out = F.lit(None).cast("int")
    for i, e in enumerate(T.ERA_ORDER):
        out = F.when(F.col("g") == e, i).otherwise(out)
    return out


@query("set_jaccard_era", pairs_sql("era", ERA_POS) + " SELECT a, b, shared, total, only_a, only_b, jaccard FROM pr")
def _(spark, d):
    return stats.pairwise_vocabulary(docs(spark, d), "era", era_position())


@query("join_pairs_theta", pairs_sql("era", ERA_POS) + " SELECT a, b FROM pr")
def _(spark, d):
    return stats.pairwise_vocabulary(docs(spark, d), "era", era_position()).select("a", "b")


@query("set_drift", pairs_sql("era", ERA_POS) + " SELECT a, b, round(1 - jaccard, 4) AS drift FROM pr WHERE pos_b = (SELECT min(pos) FROM z WHERE pos > pos_a)")
def _(spark, d):
    from pyspark.sql import Window

    pairs = stats.pairwise_vocabulary(docs(spark, d), "era", era_position())
    at = lambda c: F.array_position(F.array(*map(F.lit, T.ERA_ORDER)), F.col(c))
    nearest = F.row_number().over(Window.partitionBy("a").orderBy(at("b")))  # pairs of a few eras
    return pairs.withColumn("nth", nearest).where("nth = 1").select("a", "b", F.round(1 - F.col("jaccard"), 4).alias("drift"))


@query("set_era_stats", TOK + " SELECT era, count(DISTINCT term) AS vocab, count(*) AS tokens, round(count(DISTINCT term) / count(*), 6) AS ttr FROM tokens GROUP BY era")
def _(spark, d):
    t = stats.term_counts(docs(spark, d), "era").groupBy("era").agg(F.count(F.lit(1)).alias("vocab"), F.sum("c").alias("tokens"))
    return t.withColumn("ttr", F.round(F.col("vocab") / F.col("tokens"), 6))


UNIQUE = ", f AS (SELECT {g}, term, count(*) AS c FROM tokens GROUP BY ALL), o AS (SELECT term FROM f GROUP BY term HAVING count(*) = 1) SELECT {g}, CAST(row_number() OVER (PARTITION BY {g} ORDER BY c DESC, term) AS INTEGER) AS rank, term, c FROM f JOIN o USING (term) QUALIFY rank <= {n}"


@query("set_unique_terms", TOK + UNIQUE.format(g="era", n=20))
def _(spark, d):
    return stats.unique_terms(docs(spark, d), "era", 20)


@query("set_unique_col", TOK + UNIQUE.format(g="lang", n=15))
def _(spark, d):
    return stats.unique_terms(docs(spark, d), "lang", 15)


@query("set_overlap_col", pairs_sql("lang", "g") + " SELECT a, b, shared, total, only_a, only_b, jaccard FROM pr")
def _(spark, d):
    return stats.pairwise_vocabulary(docs(spark, d), "lang")


@query("set_shared_terms", TOK + ", f AS (SELECT lang, term, count(*) AS c FROM tokens GROUP BY ALL), p AS (SELECT x.lang AS a, y.lang AS b, term, x.c + y.c AS c FROM f x JOIN f y USING (term) WHERE x.lang < y.lang) SELECT a, b, CAST(row_number() OVER (PARTITION BY a, b ORDER BY c DESC, term) AS INTEGER) AS rank, term, c FROM p QUALIFY rank <= 15")
def _(spark, d):
    from pyspark.sql import Window

    has = stats.term_counts(docs(spark, d), "lang").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("lang", "c"))).alias("g"))  # a few collections
    pairs = has.select("term", F.explode("g").alias("x"), "g").select("term", "x", F.explode("g").alias("y")).where("x.lang < y.lang")
    rows = pairs.select(F.col("x.lang").alias("a"), F.col("y.lang").alias("b"), "term", (F.col("x.c") + F.col("y.c")).alias("c"))
    w = Window.partitionBy("a", "b").orderBy(F.col("c").desc(), "term")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 15").select("a", "b", "rank", "term", "c")


@query("join_vocab", TOK + ", v AS (SELECT term, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr FROM tokens GROUP BY term) SELECT count(*) FILTER (en > 0 AND fr > 0) AS shared, count(*) FILTER (en > 0 AND fr = 0) AS only_en, count(*) FILTER (en = 0 AND fr > 0) AS only_fr FROM v")
def _(spark, d):
    v = postings.tokens(docs(spark, d), T.tok_regex, "lang").groupBy("term").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "fr").alias("fr"))
    return v.agg(F.count_if((F.col("en") > 0) & (F.col("fr") > 0)).alias("shared"), F.count_if((F.col("en") > 0) & (F.col("fr") == 0)).alias("only_en"), F.count_if((F.col("en") == 0) & (F.col("fr") > 0)).alias("only_fr"))


@query(
    "agg_missing",
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text WHEN doc_id % 2 = 0 THEN ' ' END AS text, lang FROM documents WHERE doc_id % 10 <> 3)
    SELECT count(*) AS records, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty_text, count(*) FILTER (doc_id IS NULL OR text IS NULL OR lang IS NULL) AS incomplete,
    (SELECT count(*) FROM documents WHERE doc_id % 10 = 3) AS malformed, count(*) FILTER (doc_id IS NULL OR text IS NULL OR lang IS NULL OR trim(text) = '') = 0 AND (SELECT count(*) FROM documents WHERE doc_id % 10 = 3) = 0 AS valid FROM r""",
)
def _(spark, d):
    """Documents as JSON lines, some of them cut off, some without text or with a blank one, are written and validated."""
    path = scratch(spark, "records-jsonl")
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text")).when(F.col("doc_id") % 2 == 0, F.lit(" "))
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), F.col("lang").alias("language")))
    cut = F.substring(line, F.lit(1), F.length(line) - 1)
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 3, cut).otherwise(line).alias("value")).write.text(path)
    return files.validated(spark, path, ("doc_id", "text", "language"))


@query("rep_covdrop", "WITH @CORPUS@, p AS (SELECT quantile_disc(wc, 0.25) AS p25, quantile_disc(wc, 0.99) AS p99 FROM corpus) SELECT round((1 - least(1.0::DOUBLE, 5 * 512 / p99) / least(1.0::DOUBLE, 5 * 512 / p25)) * 100, 4) AS drop_pct FROM p")
def _(spark, d):
    from ..operators.chunking import coverage

    # quantile_disc takes the first value whose share reaches p
    p = corpus(spark, d).agg(F.expr("percentile_disc(0.25) within group (order by word_count)").alias("p25"), F.expr("percentile_disc(0.99) within group (order by word_count)").alias("p99"))
    return p.select(F.round((1 - coverage(F.col("p99"), 5) / coverage(F.col("p25"), 5)) * 100, 4).alias("drop_pct"))
