"""Queries of retrieval, ranking metrics and the joins they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25, dense, metrics, postings, robustness
from ..shared import materialise, table
from .base import corpus, described, docs, judgments, query, questions, vector_queries, vectors

PRE = "WITH @DOCS@, @TOKENS@, @POSTINGS@, @LENGTHS@, @TERMS@"
RUN = PRE + ", @BM25@, @QRELS@"
PER = (
    RUN
    + """,
  qs AS (SELECT qid, count(*) AS relevant FROM qrels GROUP BY qid),
  ideal AS (SELECT qid, sum(rel / log2(r + 1)) AS idcg FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM qrels) WHERE r <= 10 GROUP BY qid),
  got AS (SELECT b.qid, sum(coalesce(q.rel, 0) / log2(b.rank + 1)) AS dcg, max(CASE WHEN q.rel > 0 THEN 1.0 / b.rank END) AS mrr, count(q.rel) AS found FROM bm25 b LEFT JOIN qrels q USING (qid, doc_id) GROUP BY b.qid),
  per AS (SELECT qs.qid, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 8) AS ndcg, round(coalesce(mrr, 0), 8) AS mrr, round(coalesce(found, 0) / relevant, 8) AS recall FROM qs JOIN ideal USING (qid) LEFT JOIN got USING (qid))"""
)
#: The tier of a query is that of its first relevant document.
META = "meta AS (SELECT qid, tier FROM (SELECT q.qid, c.tier, row_number() OVER (PARTITION BY q.qid ORDER BY q.doc_id) AS r FROM qrels q JOIN corpus c USING (doc_id)) WHERE r = 1)"
PER_C = PER.replace("WITH @DOCS@", "WITH @CORPUS@, @DOCS@") + ", " + META


def run_bm25(spark, d, k=10):
    return bm25.smooth(docs(spark, d), questions(spark, d), k)


def per_query(spark, d, run=None):
    s = metrics.per_query(run if run is not None else run_bm25(spark, d), judgments(spark, d))
    return s.select("qid", *(F.round(c, 8).alias(c) for c in ("ndcg", "mrr", "recall")))


def query_tiers(spark, d):
    """qid, tier: that of its first relevant document; only such documents' quality is worked out."""
    first = materialise(judgments(spark, d).groupBy("qid").agg(F.min("doc_id").alias("doc_id")), "first-relevant")
    wanted = docs(spark, d).join(first.select("doc_id").distinct(), "doc_id", "left_semi")
    # a table between: else Spark works out the quality before it drops documents
    return first.join(described(materialise(wanted, "judged-documents")).select("doc_id", "tier"), "doc_id").select("qid", "tier")


@query("bm25_smooth", PRE + ", @BM25@ SELECT qid, doc_id, score, rank FROM bm25")
def _(spark, d):
    return run_bm25(spark, d)


@query("join_postings", PRE + " SELECT t.qid, t.term, p.doc_id, p.tf FROM terms t JOIN postings p USING (term)")
def _(spark, d):
    terms = postings.query_terms(questions(spark, d)).select("qid", "term")
    return postings.postings_of(docs(spark, d), terms).join(terms, "term").select("qid", "term", "doc_id", "tf")


@query(
    "bm25_okapi",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '@WS@'), lambda x: x <> '') AS ws FROM documents),
  p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY ALL),
  st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
  df AS (SELECT term, ln(st.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p CROSS JOIN st GROUP BY term, st.n),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
  t AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(list_filter(string_split_regex(lower(text), '@WS@'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
  sc AS (SELECT qid, p.doc_id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * len(ws) / avgdl))), 8) AS score FROM t JOIN p USING (term) JOIN idf USING (term) JOIN w ON w.doc_id = p.doc_id CROSS JOIN st GROUP BY qid, p.doc_id)
  SELECT * FROM (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 10 AND score > 0""",
)
def _(spark, d):
    return bm25.okapi(table(spark, d, "documents").select("doc_id", "text"), questions(spark, d))


@query("flt_score_pos", PRE + ", @BM25@ SELECT qid, doc_id, score FROM bm25 WHERE score > 0")
def _(spark, d):
    return run_bm25(spark, d).where("score > 0").select("qid", "doc_id", "score")


ERA_BM25 = (
    PRE
    + """,
  edf AS (SELECT era, term, count(*) AS df FROM postings GROUP BY ALL), est AS (SELECT era, count(*) AS n, avg(dl) AS avgdl FROM lengths GROUP BY era),
  esc AS (SELECT p.era, t.qid, p.doc_id, round(sum(t.qtf * ln((est.n - edf.df + 0.5) / (edf.df + 0.5) + 1) * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / est.avgdl))), 8) AS score
    FROM terms t JOIN postings p USING (term) JOIN edf ON edf.era = p.era AND edf.term = p.term JOIN est ON est.era = p.era JOIN lengths l ON l.doc_id = p.doc_id GROUP BY p.era, t.qid, p.doc_id)"""
)


@query("bm25_by_era", ERA_BM25 + " SELECT era, qid, doc_id, score FROM esc QUALIFY row_number() OVER (PARTITION BY era, qid ORDER BY score DESC, doc_id) <= 10")
def _(spark, d):
    return bm25.ranked(bm25.by_group(docs(spark, d), questions(spark, d), "era"), 10, ["era", "qid"]).drop("rank")


@query("agg_topscore", ERA_BM25 + ", m AS (SELECT e.era, b.item_id AS qid, coalesce(max(s.score), 0.0) AS top FROM (SELECT DISTINCT era FROM docs) e CROSS JOIN benchmark b LEFT JOIN esc s ON s.era = e.era AND s.qid = b.item_id GROUP BY ALL) SELECT era, round(avg(top), 6) AS mean_top_score FROM m GROUP BY era")
def _(spark, d):
    rows = docs(spark, d)
    top = bm25.by_group(rows, questions(spark, d), "era").groupBy("era", "qid").agg(F.max("score").alias("top"))
    n = questions(spark, d).agg(F.count(F.lit(1)).alias("n"))
    # a query without a hit in an era counts as 0: sums over all queries
    sums = rows.select("era").distinct().join(top.groupBy("era").agg(F.sum("top").alias("s")), "era", "left").join(F.broadcast(n), how="cross")
    return sums.select("era", F.round(F.coalesce("s", F.lit(0.0)) / F.col("n"), 6).alias("mean_top_score"))


@query("agg_bm25_stats", "WITH @DOCS@, @TOKENS@, @POSTINGS@, @LENGTHS@, st AS (SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM lengths) SELECT term, count(*) AS df, n, avgdl FROM postings CROSS JOIN st GROUP BY term, n, avgdl")
def _(spark, d):
    rows = docs(spark, d)
    st = postings.lengths(rows).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))
    return postings.doc_frequency(rows).join(F.broadcast(st), how="cross")


# metrics


@query("m_dcg", RUN + " SELECT b.qid, round(sum(coalesce(q.rel, 0) / log2(b.rank + 1)), 6) AS dcg FROM bm25 b LEFT JOIN qrels q USING (qid, doc_id) WHERE b.qid IN (SELECT qid FROM qrels) GROUP BY b.qid")
def _(spark, d):
    return metrics.dcg(run_bm25(spark, d), judgments(spark, d)).select("qid", F.round("dcg", 6).alias("dcg"))


for _name, _column in (("m_ndcg", "ndcg"), ("m_mrr", "mrr"), ("m_recall", "recall")):

    def _metric(spark, d, column=_column):
        return per_query(spark, d).select("qid", column)

    query(_name, PER + f" SELECT qid, {_column} FROM per")(_metric)


@query("join_run_qrels", RUN + " SELECT b.qid, b.doc_id, b.rank, coalesce(q.rel, 0) AS rel FROM bm25 b LEFT JOIN qrels q USING (qid, doc_id) WHERE b.qid IN (SELECT qid FROM qrels)")
def _(spark, d):
    return metrics.judged(run_bm25(spark, d), judgments(spark, d)).select("qid", "doc_id", "rank", "rel")


@query("join_meta", PER_C + " SELECT qid, ndcg, coalesce(tier, 'unknown') AS tier FROM per LEFT JOIN meta USING (qid)")
def _(spark, d):
    return per_query(spark, d).join(query_tiers(spark, d), "qid", "left").select("qid", "ndcg", F.coalesce("tier", F.lit("unknown")).alias("tier"))


@query("m_strat", PER_C + " SELECT coalesce(tier, 'unknown') AS tier, count(*) AS n, round(max(ndcg), 6) AS best_ndcg FROM per LEFT JOIN meta USING (qid) GROUP BY ALL")
def _(spark, d):
    rows = per_query(spark, d).join(query_tiers(spark, d), "qid", "left").withColumn("tier", F.coalesce("tier", F.lit("unknown")))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("ndcg"), 6).alias("best_ndcg"))


MEANS = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in ("ndcg", "mrr", "recall"))
STRAT = PER_C + f", strat AS (SELECT 'overall' AS tier, count(*) AS n_queries, {MEANS} FROM per UNION ALL SELECT coalesce(tier, 'unknown'), count(*), {MEANS.replace(' AS ndcg_mean', '')} FROM per LEFT JOIN meta USING (qid) GROUP BY 1)"


def stratified(spark, d):
    out = metrics.stratified(per_query(spark, d), query_tiers(spark, d))
    return out.select("tier", "n_queries", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("tier", "n_queries")))


@query("agg_metric_mean", STRAT + " SELECT * FROM strat")
def _(spark, d):
    return stratified(spark, d)


@query("retrieval_eval", STRAT + " SELECT * FROM strat")
def _(spark, d):
    """The flagship: corpus, BM25, judgments, metrics, tiers."""
    return stratified(spark, d)


@query("rep_drop", STRAT + " SELECT round(CASE WHEN h.ndcg_mean > 0 THEN (h.ndcg_mean - l.ndcg_mean) / h.ndcg_mean * 100 ELSE 0.0 END, 4) AS drop_pct FROM (SELECT * FROM strat WHERE tier = 'high') h, (SELECT * FROM strat WHERE tier = 'low') l")
def _(spark, d):
    s = stratified(spark, d)
    both = s.where("tier in ('high', 'low')").agg(F.max(F.when(F.col("tier") == "high", F.col("ndcg_mean"))).alias("h"), F.max(F.when(F.col("tier") == "low", F.col("ndcg_mean"))).alias("l"))
    return both.where("h is not null and l is not null").select(F.round(F.when(F.col("h") > 0, (F.col("h") - F.col("l")) / F.col("h") * 100).otherwise(0.0), 4).alias("drop_pct"))


@query("rep_table1", STRAT + " SELECT 'bm25' AS model, tier, round(ndcg_mean, 3) AS ndcg, round(mrr_mean, 3) AS mrr, round(recall_mean, 3) AS recall FROM strat")
def _(spark, d):
    return stratified(spark, d).select(F.lit("bm25").alias("model"), "tier", *(F.round(f"{m}_mean", 3).alias(m) for m in ("ndcg", "mrr", "recall")))


@query("join_missed", RUN + " SELECT q.qid, q.doc_id FROM qrels q ANTI JOIN bm25 b ON b.qid = q.qid AND b.doc_id = q.doc_id")
def _(spark, d):
    return judgments(spark, d).join(run_bm25(spark, d), ["qid", "doc_id"], "left_anti").select("qid", "doc_id")


@query("join_corpus_lookup", RUN + " SELECT q.qid, q.doc_id, substr(d.text, 1, 300) AS snippet FROM qrels q JOIN documents d USING (doc_id)")
def _(spark, d):
    return judgments(spark, d).join(table(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("snippet")), "doc_id", "left").select("qid", "doc_id", "snippet")


@query("topk_failures", PER_C + " SELECT qid, tier, concat('tier ', tier, ': ', CAST(n AS VARCHAR), ' relevant document(s) not in the first 10') AS reason FROM (SELECT q.qid, count(*) AS n FROM qrels q ANTI JOIN bm25 b ON b.qid = q.qid AND b.doc_id = q.doc_id GROUP BY q.qid) JOIN meta USING (qid) WHERE tier <> 'high' ORDER BY qid LIMIT 5")
def _(spark, d):
    missed = judgments(spark, d).join(run_bm25(spark, d), ["qid", "doc_id"], "left_anti").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    rows = missed.join(query_tiers(spark, d), "qid").where("tier <> 'high'").orderBy("qid").limit(5)
    return rows.select("qid", "tier", F.concat(F.lit("tier "), "tier", F.lit(": "), F.col("n").cast("string"), F.lit(" relevant document(s) not in the first 10")).alias("reason"))


# two systems: BM25 smooth against Okapi

OKAPI = """,
  ow AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '@WS@'), lambda x: x <> '') AS ws FROM documents),
  op AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM ow) GROUP BY ALL),
  ost AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM ow),
  odf AS (SELECT term, ln(ost.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM op CROSS JOIN ost GROUP BY term, ost.n),
  oidf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM odf) ELSE raw END AS idf FROM odf),
  ot AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(list_filter(string_split_regex(lower(text), '@WS@'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
  osc AS (SELECT qid, op.doc_id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * len(ws) / avgdl))), 8) AS score FROM ot JOIN op USING (term) JOIN oidf USING (term) JOIN ow ON ow.doc_id = op.doc_id CROSS JOIN ost GROUP BY qid, op.doc_id),
  okapi AS (SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM osc) WHERE rank <= 10 AND score > 0),
  ogot AS (SELECT b.qid, sum(coalesce(q.rel, 0) / log2(b.rank + 1)) AS dcg FROM okapi b LEFT JOIN qrels q USING (qid, doc_id) GROUP BY b.qid),
  pairs AS (SELECT per.qid, per.ndcg AS a, round(CASE WHEN idcg > 0 THEN coalesce(o.dcg, 0) / idcg ELSE 0 END, 8) AS b FROM per JOIN ideal USING (qid) LEFT JOIN ogot o USING (qid))"""


def pairs(spark, d):
    other = per_query(spark, d, bm25.okapi(table(spark, d, "documents").select("doc_id", "text"), questions(spark, d)))
    return per_query(spark, d).select("qid", F.col("ndcg").alias("a")).join(other.select("qid", F.col("ndcg").alias("b")), "qid")


@query("join_pair_systems", PER + OKAPI + " SELECT qid, a, b FROM pairs")
def _(spark, d):
    return pairs(spark, d)


T_SQL = "CASE WHEN count(*) >= 3 AND stddev_samp(a - b) > 0 THEN round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) END"


@query("st_ttest", PER + OKAPI + f" SELECT count(*) AS n, {T_SQL} AS t FROM pairs")
def _(spark, d):
    return metrics.paired_t(pairs(spark, d)).select("n", F.round("t", 6).alias("t"))


@query("st_meandiff", PER + OKAPI + " SELECT round(avg(a) - avg(b), 6) AS mean_diff FROM pairs")
def _(spark, d):
    return metrics.paired_t(pairs(spark, d)).select(F.round("mean_diff", 6).alias("mean_diff"))


@query(
    "st_wilcoxon",
    PER + OKAPI + ", dd AS (SELECT round(a - b, 9) AS d FROM pairs), rk AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM dd WHERE d <> 0) SELECT count(*) AS n, round(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 6) AS w FROM rk",
)
def _(spark, d):
    return metrics.wilcoxon(pairs(spark, d)).select("n", F.round(F.col("w").cast("double"), 6).alias("w"))


@query("st_pvalues")
def _(spark, d):
    """p values of both tests; from their statistics on the driver."""
    p = pairs(spark, d)
    t, w = metrics.paired_t(p).first(), metrics.wilcoxon(p).first()
    row = (t["n"], metrics.t_p_value(t["t"], t["n"]) if t["t"] is not None else None, metrics.z_p_value(w["z"]) if w["z"] is not None else None)
    return spark.createDataFrame([row], "n long, t_p double, wilcoxon_p double")


# dense retrieval over stored vectors

DENSE = "@VECS@, q AS (SELECT id AS qid, vec AS qvec, label AS qlabel FROM vecs WHERE id % 20 = 0), s AS (SELECT q.qid, q.qlabel, v.id, v.label, round(list_inner_product(q.qvec, v.vec), 6) AS score FROM q CROSS JOIN vecs v), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10), grp AS (SELECT *, CAST(row_number() OVER (PARTITION BY label, qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)"


def dense_top(spark, d, k=10):
    rows = vectors(spark, d)
    return dense.top_k(rows, vector_queries(rows), k)


def dense_groups(spark, d, k=10):
    rows = vectors(spark, d)
    return dense.top_k_by_group(rows, vector_queries(rows), "label", k)


@query("dense_topk", f"WITH {DENSE} SELECT qid, id, score, rank FROM top")
def _(spark, d):
    return dense_top(spark, d)


@query("join_cross_dense", f"WITH {DENSE} SELECT qid, id, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 50")
def _(spark, d):
    return dense_top(spark, d, 50).drop("rank")


@query("flt_idx_valid", f"WITH {DENSE} SELECT label, qid, count(*) AS n FROM grp GROUP BY ALL")
def _(spark, d):
    return dense_groups(spark, d).groupBy("label", "qid").agg(F.count(F.lit(1)).alias("n"))


@query("dense_by_group", f"WITH {DENSE} SELECT label, qid, id, score, rank FROM grp")
def _(spark, d):
    return dense_groups(spark, d)


@query("dense_chunks", f"WITH {DENSE} SELECT qid, id, score, rank FROM top WHERE rank <= 5")
def _(spark, d):
    return dense_top(spark, d, 5)


@query("agg_dense_era", f"WITH {DENSE}, m AS (SELECT label, qid, coalesce(avg(CASE WHEN score > 0 THEN score END), 0.0) AS mean_pos, max(score) AS top1 FROM grp GROUP BY ALL) SELECT label, round(avg(mean_pos), 9) AS mean_positive, round(avg(top1), 9) AS mean_top1 FROM m GROUP BY label")
def _(spark, d):
    per = dense_groups(spark, d).groupBy("label", "qid").agg(F.coalesce(F.avg(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0)).alias("mean_pos"), F.max("score").alias("top1"))
    return per.groupBy("label").agg(F.round(F.avg("mean_pos"), 9).alias("mean_positive"), F.round(F.avg("top1"), 9).alias("mean_top1"))


@query("agg_mean_sim", f"WITH {DENSE} SELECT qlabel AS source, label AS target, round(avg(CASE WHEN rank = 1 THEN score END), 9) AS mean_top1, round(avg(score), 9) AS mean_topk FROM grp GROUP BY ALL")
def _(spark, d):
    q = vector_queries(vectors(spark, d)).select("qid", F.col("qlabel").alias("source"))
    rows = dense_groups(spark, d).join(q, "qid")
    return rows.groupBy("source", F.col("label").alias("target")).agg(F.round(F.avg(F.when(F.col("rank") == 1, F.col("score"))), 9).alias("mean_top1"), F.round(F.avg("score"), 9).alias("mean_topk"))


@query("dense_cross_era", f"WITH {DENSE} SELECT qid, id, qlabel AS source, label AS target, rank FROM top")
def _(spark, d):
    return cross(spark, d)


def cross(spark, d):
    rows = vectors(spark, d)
    q = vector_queries(rows)
    return dense.top_k(rows, q).join(q.select("qid", F.col("qlabel").alias("source")), "qid").join(rows.select("id", F.col("label").alias("target")), "id").select("qid", "id", "source", "target", "rank")


@query("agg_retr_matrix", f"WITH {DENSE}, l AS (SELECT DISTINCT label FROM vecs), src AS (SELECT DISTINCT qlabel FROM q), c AS (SELECT qlabel, label, count(*) AS n FROM top GROUP BY ALL) SELECT src.qlabel AS source, l.label AS target, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY src.qlabel), 6) AS share FROM src CROSS JOIN l LEFT JOIN c ON c.qlabel = src.qlabel AND c.label = l.label")
def _(spark, d):
    counts = cross(spark, d).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    sources, targets = counts.select("source").distinct(), vectors(spark, d).select(F.col("label").alias("target")).distinct()
    grid = F.broadcast(sources).join(F.broadcast(targets), how="cross").join(counts, ["source", "target"], "left")  # a few labels
    total = counts.groupBy("source").agg(F.sum("n").alias("all"))
    return grid.join(total, "source").select("source", "target", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("all"), 6).alias("share"))


@query(
    "chunk_coherence",
    "WITH @VECS@, p AS (SELECT a.label, a.id AS i, b.id AS j, list_inner_product(a.vec, b.vec) AS s FROM (SELECT * FROM vecs QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 50) a JOIN (SELECT * FROM vecs QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 50) b ON a.label = b.label AND a.id <> b.id) SELECT label, round(avg(s), 6) AS coherence FROM p GROUP BY label",
)
def _(spark, d):
    return coherence(vectors(spark, d), "label", 50)


def coherence(rows, group, most):
    """Mean inner product of different chunks among each document's first `most`; 1 for one chunk.

    By sums: |sum of vectors|^2 less the sum of squares is the sum over pairs, so no pairs are made.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(group).orderBy("id"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    parts = first.select(group, "id", F.posexplode("vec").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("q").alias("own"), F.max("n").alias("n"))
    return sums.select(group, F.round(F.when(F.col("n") > 1, (F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0), 6).alias("coherence"))


LETTERS = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz")


@query("embed", f"WITH t AS (SELECT doc_id, lower(substr(text, 1, 8192)) AS t FROM documents), c AS (SELECT doc_id, [{LETTERS}] AS c FROM t), n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM c) SELECT doc_id AS id, CAST(len(c) AS INTEGER) AS dimensions, "
    + ", ".join(f"round(CASE WHEN n > 0 THEN c[{ord(x) - 96}] / n ELSE 0 END, 6) AS {x}" for x in "aentz") + " FROM n")
def _(spark, d):
    """The hook for an embedding model, with a stand-in that counts letters; models read 8192 characters. The vectors' size and five of their numbers."""
    from ..operators.embed import embed

    rows = embed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 8192).alias("text")))
    return rows.select("id", F.size("vec").alias("dimensions"), *(F.round(F.get("vec", F.lit(ord(x) - 97)), 6).alias(x) for x in "aentz"))


@query("snk_figures", STRAT + ", c AS (SELECT CASE tier WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.8 WHEN 'low' THEN 0.6 END::DOUBLE AS x, ndcg_mean AS y FROM strat) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM c WHERE x IS NOT NULL")
def _(spark, d):
    """What the tier figure computes: the linear trend of nDCG over the tiers' centres."""
    x = F.when(F.col("tier") == "high", 0.95).when(F.col("tier") == "medium", 0.8).when(F.col("tier") == "low", 0.6)
    rows = stratified(spark, d).select(x.alias("x"), F.col("ndcg_mean").alias("y")).where("x is not null")
    return rows.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"))


# robustness: rankings of all documents against those of the same with a systematic misreading (an e at the end of a word reads as c),
# which SQL can repeat; noise_experiment draws errors at random

MISREAD = "e([ .,])"


def noise_runs(spark, d):
    base = docs(spark, d)
    noisy = base.withColumn("text", F.regexp_replace("text", MISREAD, "c$1"))
    return bm25.smooth(base, questions(spark, d)), bm25.smooth(noisy, questions(spark, d))


def error_rate(spark, d):
    """Misread characters of all."""
    return docs(spark, d).agg(F.round(F.sum(F.regexp_count("text", F.lit(MISREAD))) / F.sum(F.length("text")), 6).alias("cer"))


TWO = (
    PRE
    + ", @BM25@, "
    + """
  cdocs AS (SELECT doc_id, regexp_replace(text, 'e([ .,])', 'c\\1', 'g') AS text FROM docs),
  cpost AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '@TOKEN@')) AS term FROM cdocs) GROUP BY ALL),
  clen AS (SELECT doc_id, len(regexp_extract_all(lower(text), '@TOKEN@')) AS dl FROM cdocs),
  cdf AS (SELECT term, count(*) AS df FROM cpost GROUP BY term), cst AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM clen),
  csc AS (SELECT t.qid, p.doc_id, round(sum(t.qtf * ln((cst.n - cdf.df + 0.5) / (cdf.df + 0.5) + 1) * (p.tf * 2.2) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * l.dl / cst.avgdl))), 8) AS score FROM terms t JOIN cpost p USING (term) JOIN cdf USING (term) JOIN clen l ON l.doc_id = p.doc_id CROSS JOIN cst GROUP BY t.qid, p.doc_id),
  cal AS (SELECT b.item_id AS qid, d.doc_id, coalesce(s.score, 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN csc s ON s.qid = b.item_id AND s.doc_id = d.doc_id),
  cut AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM cal QUALIFY rank <= 10)"""
)


@query("agg_overlap", TWO + " SELECT round(avg(share), 6) AS overlap FROM (SELECT a.qid, count(c.doc_id) / count(*) AS share FROM bm25 a LEFT JOIN cut c USING (qid, doc_id) GROUP BY a.qid)")
def _(spark, d):
    return robustness.overlap(*noise_runs(spark, d)).select(F.round("overlap", 6).alias("overlap"))


@query("agg_degradation", TWO + " SELECT round(coalesce(avg((a.score - c.score) / a.score), 0), 6) AS degradation FROM bm25 a JOIN cut c USING (qid) WHERE a.rank = 1 AND c.rank = 1 AND a.score > 0")
def _(spark, d):
    return robustness.degradation(*noise_runs(spark, d)).select(F.round("degradation", 6).alias("degradation"))


@query("join_baseline_noisy", TWO + " SELECT a.qid, a.score AS base_top, c.score AS noisy_top FROM bm25 a JOIN cut c USING (qid) WHERE a.rank = 1 AND c.rank = 1")
def _(spark, d):
    base, noisy = noise_runs(spark, d)
    return base.where("rank = 1").select("qid", F.col("score").alias("base_top")).join(noisy.where("rank = 1").select("qid", F.col("score").alias("noisy_top")), "qid")


@query("set_union_runs", TWO + ", er AS (SELECT round(sum(len(regexp_extract_all(text, 'e[ .,]'))) / sum(length(text)), 6) AS cer FROM docs) SELECT 0.0::DOUBLE AS cer, qid, doc_id, rank FROM bm25 UNION ALL SELECT er.cer, qid, doc_id, CAST(rank AS INTEGER) FROM cut CROSS JOIN er")
def _(spark, d):
    base, noisy = noise_runs(spark, d)
    rate = F.broadcast(error_rate(spark, d))  # one row
    tag = lambda run: run.select("cer", "qid", "doc_id", "rank")
    return tag(base.withColumn("cer", F.lit(0.0))).unionByName(tag(noisy.join(rate, how="cross")))
