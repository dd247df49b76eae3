"""Exact inner-product retrieval over stored vectors.

A block of queries (QUERY_BLOCK at most, checked) is broadcast and multiplied with every Arrow batch of rows; a batch gives its k
best rows of each query (of each group, if asked). More queries than that are dealt into blocks, as are rows, and each block of
queries meets each block of rows in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import ranked

QUERY_BLOCK, ROW_BLOCK, DIGITS = 4096, 16384, 6


def _best(qid: np.ndarray, q: np.ndarray, pdf: pd.DataFrame, k: int, group: str | None) -> Iterator[pd.DataFrame]:
    for g, part in pdf.groupby(group, dropna=False) if group else ((None, pdf),):
        ids, s = part["id"].to_numpy(np.int64), np.round(q @ np.array(part["vec"].tolist(), float).T, DIGITS)
        top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        found = {"qid": np.repeat(qid, top.shape[1]), "id": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()}
        yield pd.DataFrame(found | ({group: g} if group else {}))


def scores(rows: DataFrame, queries: DataFrame, k: int, group: str | None = None, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """qid, id, score (and group): the k best of each batch or block and query, a superset of the k best of all."""
    spark, n = rows.sparkSession, queries.count()
    kind = dict(rows.dtypes).get(group) if group else None
    schema = "qid long, id long, score double" + (f", `{group}` {kind}" if group else "")
    slim = rows.select("id", "vec", *([group] if group else []))
    if n <= query_block:
        part = queries.select("qid", "vec").toPandas()
        shared = spark.sparkContext.broadcast((part["qid"].to_numpy(np.int64), np.array(part["vec"].tolist(), float)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            for pdf in batches:
                if len(pdf) and len(qid):
                    yield from _best(qid, q, pdf, k, group)

        return slim.mapInPandas(run, schema)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c.split(" ")[0].strip("`"): [] for c in schema.split(", ")})
        return pd.concat(list(_best(right["qid"].to_numpy(np.int64), np.array(right["vec"].tolist(), float), left, k, group)), ignore_index=True)

    blocks, qblocks = max(1, -(-rows.count() // row_block)), -(-n // query_block)
    copies = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = slim.select("*", dealt("id", blocks).alias("_block"), copies(qblocks).alias("_qblock"))
    right = queries.select("qid", "vec", copies(blocks).alias("_block"), dealt("qid", qblocks).alias("_qblock"))
    return left.groupBy("_block", "_qblock").cogroup(right.groupBy("_block", "_qblock")).applyInPandas(meet, schema)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, id, score, rank of rows (id, vec) for queries (qid, vec)."""
    return ranked(scores(rows, queries, k), k, "qid", "id").select("qid", "id", "score", "rank")


def top_k_by_group(rows: DataFrame, queries: DataFrame, group: str, k: int = 10) -> DataFrame:
    """The same within each group of rows; groups with fewer rows give them all."""
    return ranked(scores(rows, queries, k, group), k, [group, "qid"], "id").select(group, "qid", "id", "score", "rank")
