"""Approximate nearest neighbours by an inverted multi-index (operator 9).

Both halves of a vector are quantised on their own (K centroids each, fitted on a bounded sample), so a row's cell is a pair of
centroids. A query walks the pairs in order of summed squared distance with a heap (multi-sequence), until the cells
seen hold its share of all rows; every row in them is scored exactly. The share is measured, not guessed: a bounded
number of calibration queries is compared with all rows, and the share is what would have found RECALL of their true
neighbours. Inner products of vectors of any length become distances by one more component in the second half,
sqrt(largest length^2 - own length^2), which is 0 for queries.

All rows are indexed; no cell is cut: rows of one first-half centroid are split by a hash into blocks of bounded size, and a
query meets all blocks of the cells it walks. A query goes on past its share until k rows are seen.

Ties in score go to the smaller id. Zero vectors, nulls and non-finite values take no part, nor do rows without an id. Shorter vectors count as padded with zeros. Rows
that repeat an id are candidates each; as queries they are one (the smallest vector). Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .topk import best, ranked, stack

#: Bounds: rows that fit the centroids, calibration queries, centroids of a half, rows and queries of a block.
SAMPLE, CALIBRATION, CENTROIDS, BLOCK, QUERY_BLOCK = 8192, 96, (16, 128), 8192, 4096
#: Centroids of a half grow with the square root of the rows, one for so many of it.
ROOTS = 8
#: The recall that the share of rows is chosen for.
RECALL = 0.96


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)


def centroids_of(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from distinct rows of x, in their order."""
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(0).permutation(len(c))[:k]].copy()
    for _ in range(rounds):
        own = distances(x, c).argmin(1)
        sums, counts = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, target: float):
    """Pairs (i, j) by ascending d1[i] + d2[j], until the rows in them reach target."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, done, seen = [(s1[0] + s2[0], 0, 0)], [-1] * len(s1), 0
    while heap and seen < target:
        _, i, j = heapq.heappop(heap)
        done[i] = j
        yield o1[i], o2[j]
        seen += counts[o1[i]][o2[j]]
        if i + 1 < len(s1) and done[i + 1] == j - 1:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < len(s2) and (i == 0 or done[i - 1] > j):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))


class Index:
    """Centroids of both halves, and how vectors become halves."""

    def __init__(self, fit: np.ndarray, largest2: float, centroids: int):
        self.half, self.largest2 = max(1, fit.shape[1] // 2), largest2
        a, b = self.halves(fit)
        self.first, self.second = centroids_of(a, centroids), centroids_of(b, centroids)

    def halves(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.largest2 - (x**2).sum(1)))
        return x[:, : self.half], np.hstack([x[:, self.half :], extra[:, None]])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return distances(a, self.first).argmin(1), distances(b, self.second).argmin(1)


def score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows; the same sum order for every row, so that equal rows tie."""
    return (x * q).sum(1)


def nearest(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows by exact scores; rough: the same up to rounding, -inf where a row isn't to be taken."""
    rough = np.where(ids == own, -np.inf, rough)
    there = int((rough > -np.inf).sum())
    if not there:
        return ids[:0], rough[:0]
    cut = np.partition(rough, len(rough) - min(k, there))[len(rough) - min(k, there)]
    among = np.flatnonzero((rough >= cut - 1e-9 * (1 + abs(cut))) & (rough > -np.inf))
    exact = score(q, x[among])
    top = best(exact, ids[among], k)
    return ids[among[top]], exact[top]


def search(vectors: DataFrame, query_filter, k: int = 20, centroids: int | None = None, recall: float = RECALL, block: int = BLOCK, query_block: int = QUERY_BLOCK, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows found. vectors: (id long, vec array<double>).

    report: is given the centroids of both halves and the share of all rows that a query visits.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.where(norm2 > 0)
    queries = rows.where(query_filter).groupBy("id").agg(F.min("vec").alias("vec"))
    total, dim, largest2 = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(norm2)).first()
    n_queries = queries.count()
    if not total or not n_queries:
        return spark.createDataFrame([], schema)
    if centroids is None:
        centroids = int(min(CENTROIDS[1], max(CENTROIDS[0], total**0.5 / ROOTS)))
    index = Index(stack(common.sample(rows, SAMPLE, total)["vec"], dim), largest2, centroids)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                c1, c2 = index.cells(stack(pdf["vec"], dim))
                yield pdf.assign(c1=c1.astype(np.int32), c2=c2.astype(np.int32))

    coded = common.materialise(rows.select("id", "vec").mapInPandas(assign, "id long, vec array<double>, c1 int, c2 int"), "multi-index")
    k1, k2 = len(index.first), len(index.second)
    counts = np.zeros((k1, k2), np.int64)
    for r in coded.groupBy("c1", "c2").count().collect():  # at most the square of the centroids
        counts[r["c1"], r["c2"]] = r["count"]
    cells = counts.tolist()

    # the share of rows to see: true neighbours of the calibration queries, and how many rows come before their cells
    probe = common.sample(queries, CALIBRATION, n_queries)
    probe_ids, probe_q = probe["id"].to_numpy(np.int64), stack(probe["vec"], dim)

    def brute(batches):
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in probe_ids]  # a task's best so far
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids, cell = stack(pdf["vec"], dim), pdf["id"].to_numpy(np.int64), (pdf["c1"] * k2 + pdf["c2"]).to_numpy(np.int64)
            rough = probe_q @ x.T
            for i, own in enumerate(probe_ids.tolist()):
                s = np.where(ids == own, -np.inf, rough[i])
                top = best(s, ids, k)
                top = top[s[top] > -np.inf]
                both = [np.concatenate(p) for p in zip(found[i], (ids[top], s[top], cell[top]), strict=True)]
                keep = best(both[1], both[0], k)
                found[i] = tuple(p[keep] for p in both)
        for own, (ids, s, cell) in zip(probe_ids.tolist(), found, strict=True):
            yield pd.DataFrame({"query_id": own, "vec_id": ids, "score": s, "cell": cell})

    truth = coded.mapInPandas(brute, "query_id long, vec_id long, score double, cell int")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    merged = truth.withColumn("nth", nth).where(F.col("nth") <= k).select("query_id", "cell").collect()  # CALIBRATION * k rows
    order = {}
    a, b = index.halves(probe_q, query=True)
    for i, own in enumerate(probe_ids.tolist()):
        at, seen = {}, 0
        for p in walk(distances(a[i : i + 1], index.first)[0], distances(b[i : i + 1], index.second)[0], cells, np.inf):
            at[p[0] * k2 + p[1]] = seen
            seen += cells[p[0]][p[1]]
        order[own] = at
    before = [order[r["query_id"]][r["cell"]] / total for r in merged]
    share = float(np.quantile(before, recall)) if before else 1.0
    target = max(k + 1.0, share * total + 1)
    if report is not None:
        report |= {"centroids": (k1, k2), "visited": min(1.0, target / total)}

    width = -(-k2 // 8)  # bytes of a set of second-half centroids

    def plan(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q = stack(pdf["vec"], dim)
            a, b = index.halves(q, query=True)
            d1, d2 = distances(a, index.first), distances(b, index.second)
            out = []
            for i in range(len(q)):
                masks: dict[int, bytearray] = {}
                for c1, c2 in walk(d1[i], d2[i], cells, target):
                    if cells[c1][c2]:
                        masks.setdefault(c1, bytearray(width))[c2 >> 3] |= 1 << (c2 & 7)
                out.append(masks)
            at = [i for i, m in enumerate(out) for _ in m]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "vec": pdf["vec"].to_numpy()[at], "c1": np.array([c for m in out for c in m], np.int32), "mask": [bytes(v) for m in out for v in m.values()]})

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            x, ids, code = stack(left["vec"], dim), left["id"].to_numpy(np.int64), left["c2"].to_numpy(np.int64)
            q, own, mask = stack(right["vec"], dim), right["id"].to_numpy(np.int64), np.unpackbits(np.frombuffer(b"".join(right["mask"]), np.uint8).reshape(-1, width), axis=1, bitorder="little")
            for at in range(0, len(q), 256):
                rough = q[at : at + 256] @ x.T
                rough[mask[at : at + 256][:, code] == 0] = -np.inf
                for i in range(len(rough)):
                    found.append((own[at + i], *nearest(q[at + i], own[at + i], x, ids, rough[i], k)))
        n = [len(f[1]) for f in found]
        none = [np.zeros(0)]
        return pd.DataFrame({"query_id": np.repeat(np.array([f[0] for f in found], np.int64), n), "vec_id": np.concatenate([f[1] for f in found] or none).astype(np.int64), "score": np.concatenate([f[2] for f in found] or none)})

    subs = [max(1, -(-int(n) // block)) for n in counts.sum(1)]
    n_query_blocks = -(-n_queries // query_block)
    n_sub = F.element_at(F.array(*map(F.lit, subs)), F.col("c1") + 1)
    count = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = coded.select("id", "vec", "c1", "c2", F.pmod(F.xxhash64("id", F.lit(7)), n_sub).cast("int").alias("sub"), count(F.lit(n_query_blocks)).alias("qblock"))
    right = queries.mapInPandas(plan, "id long, vec array<double>, c1 int, mask binary")
    right = right.select("id", "vec", "c1", "mask", count(n_sub).alias("sub"), F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)).cast("int").alias("qblock"))
    keys = ["c1", "sub", "qblock"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    return ranked(hits, k)


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.valid_vectors(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, F.col("id") % 20 == 0, k=20)
