"""Packing documents into windows by non-negative least squares (operator 1).

1. Encode: every document's ids (with its end id) go to a table in the shared folder, once.
2. Histogram: how many documents leave which remainder modulo the window, over all documents (at most window-1 numbers).
3. Plan: enumerate shallow combinations of lengths that fill a window exactly (two lengths, or three with two of them
   popular), and solve min |A x - h|, x >= 0 for the repeat counts x by coordinate descent.
4. Place, in each task for its own documents, HELD ids at a time: whole windows first; then each combination as often as its share
   of the plan and the lengths at hand allow, rounded up or down by a hash of task and combination, so that the whole table gets
   the solved counts however many tasks there are; then residuals greedily, longest first, the longest that fits next, and if none
   does the next one is cut. What is left at a task's end is cut into powers of two, so no sequence needs padding.

sequence_id is the task's number times 2^32 plus a count: unique, not gapless. Null texts are empty documents of one id (the
end id), long ones are cut into windows. Rows that repeat a doc_id are packed one by one. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, word_ids

WINDOW = 2048
#: Ids that a task places at a time.
HELD = 1 << 25
#: How many popular lengths may stand twice in a combination of three.
POPULAR = 40


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Length combinations that fill the window (len(histogram)) and whose lengths occur."""
    window, there = len(histogram), histogram > 0
    out = {(a, window - a) for a in range(window // 2, window) if there[a] and there[window - a]}
    top = [int(x) for x in np.argsort(-histogram, kind="stable")[:POPULAR] if histogram[x] > 0]
    for i, a in enumerate(top):
        for b in top[i:]:
            if 0 < (c := window - a - b) and there[c]:
                out.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(out, reverse=True)


def nnls(combos: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 60, tolerance: float = 1e-4) -> np.ndarray:
    """Repeat counts x >= 0 of least squares |A x - h|; A's column of a combination counts its lengths. Coordinate descent."""
    columns = [sorted((a, c.count(a)) for a in set(c)) for c in combos]
    x, left = [0.0] * len(combos), histogram.astype(float).tolist()
    for _ in range(sweeps):
        moved = 0.0
        for i, col in enumerate(columns):
            step = sum(left[a] * m for a, m in col) / sum(m * m for _, m in col)
            step = max(step, -x[i])
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for a, m in col:
                    left[a] -= m * step
        if moved <= tolerance * max(1.0, float(histogram.max(initial=0))):
            break
    return np.array(x)


def place(lengths: np.ndarray, plan: list[tuple[tuple[int, ...], float]], window: int, seed: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths. plan: combinations and their shares a document.

    seed: what the rounding of shares depends on; each is rounded up as often as its fraction says.
    """
    fractions = np.random.default_rng(seed).random(len(plan)).tolist()
    pieces, sequence = [], 0
    full, rest = lengths // window, lengths % window
    for doc in np.flatnonzero(full).tolist():
        for k in range(int(full[doc])):
            pieces.append((doc, k * window, window, sequence, 0))
            sequence += 1
    by_length: dict[int, list[int]] = {}
    for doc in np.flatnonzero(rest).tolist():
        by_length.setdefault(int(rest[doc]), []).append(doc)
    begin = (full * window).tolist()
    for (combo, share), up in zip(plan, fractions, strict=True):
        most = min(len(by_length.get(a, ())) // combo.count(a) for a in combo)
        for _ in range(min(most, int(share * len(lengths) + up))):
            at = 0
            for a in combo:
                doc = by_length[a].pop()
                pieces.append((doc, begin[doc], a, sequence, at))
                at += a
            sequence += 1
    # residuals: runs (document, start, length), longest first
    order = sorted(a for a, docs in by_length.items() if docs)
    at, cut = 0, None
    while order or cut:
        room = window - at
        if cut:
            (doc, start, a), cut = cut, None
        else:
            i = bisect.bisect_right(order, room) - 1
            a = order[i] if i >= 0 else order[-1]
            doc = by_length[a].pop()
            start = begin[doc]
            if not by_length[a]:
                order.remove(a)
        take = min(a, room)
        pieces.append((doc, start, take, sequence, at))
        if take < a:
            cut = (doc, start + take, a - take)
        at += take
        if at == window:
            sequence, at = sequence + 1, 0
    if at & (at - 1):  # the last sequence: powers of two, largest first
        tail = [p for p in pieces if p[3] == sequence]
        pieces = [p for p in pieces if p[3] != sequence]
        size = 1 << (at.bit_length() - 1)
        used = 0
        for doc, start, length, _, _ in tail:
            while length:
                take = min(length, size - used)
                pieces.append((doc, start, take, sequence, used))
                start, length, used, at = start + take, length - take, used + take, at - take
                if used == size and at:
                    sequence, used, size = sequence + 1, 0, 1 << (at.bit_length() - 1)
    return pieces


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id as text or null, n, ids binary) of every row."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = word_ids.encoder(tokenizer)
        end = end_id.to_bytes(enc.width, "little")
        for pdf in batches:
            ids = [enc.ids(t or "") + end for t in pdf["text"].tolist()]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(x) // enc.width for x in ids], "width": enc.width, "ids": ids})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n long, width int, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and their ids if asked for."""
    spark = docs.sparkSession
    with common.temporary(spark):  # the ids go once the pieces are written
        return common.kept(_pieces(docs, tokenizer, end_id, window, with_ids), "packing-pieces")


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    spark = docs.sparkSession
    coded = common.materialise(encode_documents(docs, tokenizer, end_id), "packing-ids")
    counts = coded.groupBy((F.col("n") % window).alias("rest")).count().collect()  # window rows at most
    histogram = np.zeros(window, np.int64)
    for r in counts:
        histogram[r["rest"]] = r["count"]
    total = max(1, int(histogram.sum()))
    histogram[0] = 0
    combos = combinations(histogram)
    repeats = nnls(combos, histogram)
    plan = sorted(((c, x / total) for c, x in zip(combos, repeats.tolist(), strict=True) if x > 1e-9), key=lambda p: (-p[1], p[0]))
    shared = spark.sparkContext.broadcast(plan)  # at most window/2 + POPULAR^2 combinations

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, first, parts, held = TaskContext.get().partitionId(), 0, [], 0

        def placed() -> Iterator[pd.DataFrame]:
            nonlocal first
            pdf = pd.concat(parts, ignore_index=True)
            keys, ids, kind = pdf["doc_id"].tolist(), pdf["ids"].tolist(), f"<u{int(pdf['width'][0])}"
            n = pdf["n"].to_numpy(np.int64)
            pieces = place(n, shared.value, window, (task << 32) + first)
            for i in range(0, len(pieces), 5000):
                doc, start, length, sequence, at = (np.array(x, np.int64) for x in zip(*pieces[i : i + 5000], strict=True))
                cut = [np.frombuffer(ids[d], kind)[s : s + k].astype("<u4").tobytes() for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                out = {
                    "doc_id": pd.array([None if keys[d] is None else int(keys[d]) for d in doc], "Int64"), "start": start, "length": length, "ids_crc32": [zlib.crc32(c) for c in cut],
                    "doc_tokens": n[doc], "sequence_id": (task << 32) + first + sequence, "offset": at,
                }
                yield pd.DataFrame(out | ({"ids": cut} if with_ids else {}))
            first += max((p[3] for p in pieces), default=-1) + 1

        for pdf in batches:
            if len(pdf):
                parts.append(pdf)
                held += int(pdf["n"].sum())
            if held >= HELD:
                yield from placed()
                parts, held = [], 0
        if parts:
            yield from placed()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return coded.mapInPandas(run, schema + (", ids binary" if with_ids else ""))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), word_ids.default_path(), end_id=1)
