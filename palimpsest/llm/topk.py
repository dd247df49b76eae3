"""Exact top-k inner products over norm-sorted blocks (operator 6), and what other searches share with it.

Vectors are dealt into norm bands and each band, by a hash, into blocks of bounded size; queries into blocks too. One group
holds a block of candidates and a block of queries. Inside, candidates run by descending length in chunks: a query whose
length times the chunk's largest length can't reach its threshold is done with the block; for the others the first few
dimensions of an SVD rotation give partial sums, and Cauchy-Schwarz on the residuals bounds the rest. Pairs that
survive are scored exactly. Thresholds begin at each query's k-th best score among the longest vectors.

Ties in score go to the smaller id. Vectors that are null, or hold nulls or non-finite values, take no part, nor do rows without an id. Shorter vectors count as padded
with zeros. Rows that repeat an id are candidates each; as queries they are one (the smallest vector). Empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bounds: rows that fit the rotation and the bands, seeds of the thresholds, norm bands, rows of a block, queries of a block.
SAMPLE, SEEDS, BANDS, BLOCK, QUERY_BLOCK = 8192, 2048, 32, 8192, 4096
CHUNK = 1024
#: Ranges of needs that queries are dealt into.
MOST_SPANS = 64


def stack(vectors, dim: int) -> np.ndarray:
    """A matrix of lists, padded with zeros."""
    vectors = list(vectors)
    out = np.zeros((len(vectors), dim))
    if vectors and all(len(v) == dim for v in vectors):
        return np.stack(vectors).astype(float)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of (query_id, vec_id, score) hits."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Pruner:
    """Scores a block of queries against candidates in descending length."""

    def __init__(self, rotation: np.ndarray, k: int):
        self.rotation, self.k = rotation, k
        self.head = max(1, len(rotation) // 4)

    def exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Integer inner products of rows with rows; in doubles while every sum is below 2^53."""
        if not q.size or not x.size:
            return np.zeros((len(q), len(x)))
        if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
            return q @ x.T
        return (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.int64)

    def run(self, query_ids: np.ndarray, q: np.ndarray, threshold: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query position, vec_id, score) of hits at or above the thresholds, at most k a query and ties beyond, and the pairs scored."""
        length = np.sqrt((x**2).sum(1))
        order = np.argsort(-length, kind="stable")
        ids, x, length = ids[order], x[order], length[order]
        qr, xr, h = q @ self.rotation, x @ self.rotation, self.head
        q_rest, x_rest, q_length = np.sqrt((qr[:, h:] ** 2).sum(1)), np.sqrt((xr[:, h:] ** 2).sum(1)), np.sqrt((q**2).sum(1))
        threshold, scored = threshold.copy(), 0
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in query_ids]
        for at in range(0, len(ids), CHUNK):
            part = slice(at, at + CHUNK)
            slack = 1e-9 * (1 + q_length * length[at])
            live = np.flatnonzero(q_length * length[at] + slack >= threshold)
            if not len(live):
                break
            bound = qr[live, :h] @ xr[part, :h].T + q_rest[live, None] * x_rest[None, part]
            keep = (bound >= (threshold - slack)[live, None]) & (ids[None, part] != query_ids[live, None])
            rows = np.flatnonzero(keep.any(1))
            if not len(rows):
                continue
            scored += int(keep.sum())
            dense = keep[rows].mean() > 0.05
            scores = self.exact(q[live[rows]], x[part]) if dense else None
            for i, r in enumerate(rows.tolist()):
                p, cols = int(live[r]), np.flatnonzero(keep[r])
                s = scores[i, cols] if dense else self.exact(q[p : p + 1], x[part][cols])[0]
                ok = s >= threshold[p]
                if ok.any():
                    found[p].append((ids[part][cols[ok]], s[ok]))
                    if (n := sum(len(a) for a, _ in found[p])) >= self.k:
                        a, b = np.concatenate([f[0] for f in found[p]]), np.concatenate([f[1] for f in found[p]])
                        if n > self.k:
                            top = best(b, a, self.k)
                            a, b = a[top], b[top]
                        found[p] = [(a, b)]
                        threshold[p] = max(threshold[p], b.min())
        at = [np.full(sum(len(a) for a, _ in f), i) for i, f in enumerate(found)]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(at or none).astype(np.int64), np.concatenate([a for f in found for a, _ in f] or none), np.concatenate([b for f in found for _, b in f] or none), scored


def top_k(vectors: DataFrame, query_filter, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest integer inner products of every query with all other rows.

    vectors: (id long, vec array<long>). Every group is bounded by block and query_block. Queries are dealt into blocks by how long a
    candidate must be for them (threshold over length), and a block of queries and a band of candidates meet only if the band's longest
    vector reaches that: the others are pruned before anything is copied.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    queries = rows.where(query_filter).groupBy("id").agg(F.min("vec").alias("vec"))
    schema = "query_id long, rank int, vec_id long, score long"
    total, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    n_queries = queries.count()
    if not total or not n_queries:
        return spark.createDataFrame([], schema)
    fit = common.sample(rows, SAMPLE, total)
    matrix = stack(fit["vec"], dim)
    rotation = np.linalg.eigh(matrix.T @ matrix)[1][:, ::-1].copy() if dim else np.zeros((0, 0))
    edges = sorted({float(e) for e in np.quantile(fit["norm2"], np.linspace(0, 1, BANDS + 1)[1:-1])}, reverse=True)
    band = F.lit(0)
    for e in edges:  # band 0 holds the longest vectors
        band = band + (F.col("norm2") < e).cast("int")
    rows = rows.withColumn("band", band)
    bands = {r["band"]: r for r in rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most")).collect()}  # BANDS rows
    subs = [-(-bands[b]["n"] // block) if b in bands else 1 for b in range(len(edges) + 1)]
    # the longest vector of a band, a little more against rounding
    most = [float(np.sqrt(bands[b]["most"])) * (1 + 1e-9) if b in bands else -1.0 for b in range(len(edges) + 1)]
    first = np.concatenate([[0], np.cumsum(subs)]).astype(int).tolist()
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("band") + 1)
    n_blocks, n_query_blocks = first[-1], min(MOST_SPANS, -(-n_queries // query_block))
    long_ = rows.where(F.col("norm2") >= float(np.quantile(fit["norm2"], max(0.0, 1 - 2 * SEEDS / total)))).select("id", "vec")
    longest = common.sample(long_, SEEDS, long_.count())  # of equal lengths some will do
    seeds, seed_ids = stack(longest["vec"], dim), longest["id"].to_numpy(np.int64)
    pruner = Pruner(rotation, k)

    def begin(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q = stack(pdf["vec"], dim)
            scores = pruner.exact(q, seeds).astype(float)
            scores[pdf["id"].to_numpy()[:, None] == seed_ids[None]] = -np.inf
            threshold = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            length = np.sqrt((q**2).sum(1))
            # a candidate shorter than this can't reach the threshold; a query of no length ties with all
            need = np.where((threshold > 0) & (length > 0), (threshold - 1e-6 * (1 + threshold)) / np.maximum(length, 1e-300), -1.0)
            yield pdf.assign(threshold=threshold, need=need)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        query_ids = right["id"].to_numpy(np.int64)
        at, ids, scores, _ = pruner.run(query_ids, stack(right["vec"], dim), right["threshold"].to_numpy(float), left["id"].to_numpy(np.int64), stack(left["vec"], dim))
        return pd.DataFrame({"query_id": query_ids[at], "vec_id": ids, "score": scores.astype(np.int64)})

    right = common.materialise(queries.mapInPandas(begin, "id long, vec array<long>, threshold double, need double"), "topk-queries")
    # blocks of queries with like needs: ranges of it, split by a hash where many are equal
    cuts = sorted({float(e) for e in np.quantile(common.sample(right.select("id", "need"), SAMPLE, n_queries)["need"], np.linspace(0, 1, n_query_blocks + 1)[1:-1])}) if n_query_blocks > 1 else []
    span = F.lit(0)
    for c in cuts:
        span = span + (F.col("need") >= c).cast("int")
    right = right.withColumn("span", span)
    spans = {r["span"]: r for r in right.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("least")).collect()}  # one for each block of queries
    parts = [-(-spans[i]["n"] // query_block) if i in spans else 1 for i in range(len(cuts) + 1)]
    begins = np.concatenate([[0], np.cumsum(parts)]).astype(int).tolist()
    least = [spans[i]["least"] if i in spans else float("inf") for i in range(len(cuts) + 1) for _ in range(parts[i])]
    of = lambda values, at: F.get(F.array(*map(F.lit, values)), at)
    right = right.withColumn("qblock", (of(begins[:-1], F.col("span")) + F.pmod(F.xxhash64("id"), of(parts, F.col("span")))).cast("int"))
    reach = lambda longest, need: longest >= need
    of_block = F.array(*(F.lit(m) for m, k in zip(most, subs, strict=True) for _ in range(k)))
    needs = F.array(*map(F.lit, least))
    left = rows.select("id", "vec", "band", (pick(first[:-1]) + F.pmod(F.xxhash64("id", F.lit(7)), pick(subs))).cast("int").alias("block"))
    left = left.select("id", "vec", "block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(least) - 1)), lambda q: reach(pick(most), F.get(needs, q)))).alias("qblock"))
    right = right.select("id", "vec", "threshold", "qblock", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda b: reach(F.get(of_block, b), F.col("need")))).alias("block"))
    hits = left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInPandas(meet, "query_id long, vec_id long, score long")
    return ranked(hits, k)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.valid_vectors(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    vectors = vectors.select("id", F.transform("vec", lambda x: F.floor(x * 1024)).alias("vec"))
    return top_k(vectors, F.col("id") % 100 == 0, k=10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
