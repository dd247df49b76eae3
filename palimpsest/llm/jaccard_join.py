"""N-gram Jaccard join and its components (operator 7).

1. Describe: each text's set of word shingles as 64-bit hashes; the set's size and a 128-bit fingerprint of it, and counts of
   all shingles in a table of SLOTS hashed counters. Texts with the same set are one class, stood for by its smallest doc_id.
2. Order shingles rare first by (count of their slot, hash). The counters only have to order alike everywhere: a collision
   makes a shingle look more common, it can't lose a pair. The counters have a fixed size, so they may be broadcast.
3. Prefixes: two sets of the asked similarity share a shingle among each one's first n - ceil(t n) + 1. Join on these, with the
   length filter, and the positional filter (what can still follow after the shared position).
4. Suffix filter: the sets' counts in SUFFIX_BINS hashed parts bound their difference from below, and so does the number of
   PARITY_BITS finer parts whose counts differ in parity. Only numbers travel up to here.
5. Verify each remaining pair once, on the words themselves; only texts of such pairs are fetched.

A group of near copies would still make pairs in the square of its size. So pairs are looked for in two passes: first each
prefix shingle's documents with one of them, the one in which the shingle stands foremost (rarer shingles of their own push
it back in edited copies); then, between the components so found, all pairs of which at least one isn't in the largest
part around that one. Pairs inside a component can't change it, so no component is lost.

Null texts and texts without words have no shingles (n_shingles 0) and are linked with nothing, not even each other. Texts with fewer words
than a shingle are one shingle of all their words. Very long texts are read whole, one at a time; their prefixes grow in proportion. Rows that repeat a doc_id: the sets of both stand under that id, it links
to what either links to, and each row returns the component. A null doc_id is never linked and has a null component. Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SLOTS = 1 << 21
SUFFIX_BINS = 16
#: A multiple of 64. Texts whose shingles far outnumber these parts are told apart less.
PARITY_BITS = 1024
#: Ids of texts to fetch are broadcast up to this number (8 bytes each); beyond, texts are shuffled once by their ids.
MOST_IDS = 1 << 19
_BLOCK = 1 << 15
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII only, as the contract's lower-casing.
_LOWER = {i: i + 32 for i in range(65, 91)}
_PRIME = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words(text: str) -> list[str]:
    return _WORDS.findall(lower_ascii(text))


class Shingler:
    """Sets of shingle hashes of texts, without a Python step for each word.

    A word's hash is the sum of its bytes' random numbers times powers of an odd number, modulo 2^64: differences of one running sum
    over the text, each divided by the power at the word's start. A shingle mixes the hashes of its words in order.
    """

    def __init__(self, size: int = 3):
        rng = np.random.default_rng(20)
        self.size = size
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.separator = np.zeros(256, bool)
        self.separator[[0x20, *range(0x09, 0x0E)]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 2 * len(self.power), 1 << 16)
            base = int(_PRIME[2])
            self.power, self.inverse = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            self.power[0] = self.inverse[0] = 1
            np.cumprod(self.power, out=self.power)
            np.cumprod(self.inverse, out=self.inverse)

    def hashes(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        data = np.frombuffer(text.encode("utf-8").lower(), np.uint8)  # lower() of bytes is ASCII only
        n = len(data)
        self._powers(n + 1)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~self.separator[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:n], out=running[1:])
        h = (running[ends] - running[starts]) * self.inverse[starts]
        h ^= (ends - starts).astype(np.uint64) * _PRIME[0]
        h ^= h >> np.uint64(31)
        h *= _PRIME[1]
        h ^= h >> np.uint64(29)
        k = min(self.size, len(h))
        s = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            s ^= h[i : len(h) - k + 1 + i]
            s *= _PRIME[0]
            s ^= s >> np.uint64(32)
            s *= _PRIME[1]
            s ^= s >> np.uint64(29)
        s.sort()
        keep = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=keep[1:])
        return s[keep]


_shinglers: dict[int, Shingler] = {}


def shingler(size: int) -> Shingler:
    if size not in _shinglers:
        _shinglers[size] = Shingler(size)
    return _shinglers[size]


def exact_set(text: str, size: int) -> frozenset:
    ws = words(text)
    return frozenset(zip(*(ws[i:] for i in range(size)), strict=False)) if len(ws) >= size else frozenset([tuple(ws)] if ws else [])


def _describe(docs: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds: documents (doc_id, n, fingerprint) and blocks of counters (block, counts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        sh, counts = shingler(size), np.zeros(SLOTS, np.int64)
        for pdf in batches:
            sets = [sh.hashes(t or "") for t in pdf["text"].tolist()]
            if sets:
                counts += np.bincount((np.concatenate(sets) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(s) for s in sets], "print": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "block": -1, "counts": None})
        for b in range(SLOTS // _BLOCK):
            part = counts[b * _BLOCK : (b + 1) * _BLOCK]
            if part.any():
                at = np.flatnonzero(part)
                packed = np.stack([at, part[at]]).astype("<i8").tobytes() if len(at) < _BLOCK // 8 else part.astype("<i8" if part.max() >= 1 << 31 else "<i4").tobytes()
                yield pd.DataFrame({"doc_id": [None], "n": 0, "print": None, "block": b, "counts": [packed]})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n long, print string, block int, counts binary")


def _unpack(data: bytes) -> np.ndarray:
    if len(data) == _BLOCK * 8:
        return np.frombuffer(data, "<i8")
    if len(data) == _BLOCK * 4:
        return np.frombuffer(data, "<i4").astype(np.int64)
    at, part = np.frombuffer(data, "<i8").reshape(2, -1)
    out = np.zeros(_BLOCK, np.int64)
    out[at] = part
    return out


def _counters(described: DataFrame) -> np.ndarray:
    """All counters, summed block by block; SLOTS numbers."""

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum((_unpack(c) for c in pdf["counts"]), np.zeros(_BLOCK, np.int64))
        # only the order matters: 32 bits, saturated
        return pd.DataFrame({"block": [key[0]], "counts": [np.minimum(s, 2**32 - 1).astype("<u4").tobytes()]})

    # two levels of the square root of the tasks each, so that no group holds a row of every task
    rows = described.where("block >= 0")
    parts = max(8, math.isqrt(rows.where("block = 0").count()) + 1)
    first = rows.withColumn("part", F.pmod(F.crc32("counts"), F.lit(parts)).cast("int"))

    def partial(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum((_unpack(c) for c in pdf["counts"]), np.zeros(_BLOCK, np.int64))
        return pd.DataFrame({"block": [key[0]], "counts": [s.astype("<i8").tobytes()]})

    halves = first.groupBy("block", "part").applyInPandas(partial, "block int, counts binary")
    out = np.zeros(SLOTS, np.uint32)
    for r in halves.groupBy("block").applyInPandas(total, "block int, counts binary").collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], "<u4")
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    """Of a set of n: the first so many shingles share one with every set of similarity num/den or more."""
    return n - -(-n * num // den) + 1


def parities(s: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits: whether a hashed part holds an odd number of the set's shingles. Two sets differ by at least as many shingles as bits."""
    parts = (s >> np.uint64(40)) % np.uint64(PARITY_BITS)
    return np.packbits((np.bincount(parts.astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


def _prefixes(docs: DataFrame, counters: np.ndarray, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, bins, parity, prefix): prefix shingles rare first, and counts of the whole set in hashed parts, those of finer parts modulo 2."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = shingler(size)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                s = sh.hashes(text or "")
                if key is None or not len(s):
                    continue
                order = np.lexsort((s, shared.value[(s % np.uint64(SLOTS)).astype(np.int64)]))
                head = s[order[: prefix_length(len(s), num, den)]].view(np.int64)
                bins = np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=SUFFIX_BINS)
                rows.append((int(key), len(s), bins.astype(np.int32), parities(s), head))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "bins", "parity", "prefix"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n int, bins array<int>, parity array<long>, prefix array<long>")


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in pairs (a, b), written."""
    ids = common.materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-ids")
    ids = F.broadcast(ids) if ids.count() <= MOST_IDS else ids.hint("shuffle_hash")
    return common.materialise(docs.where("text is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "jaccard-texts")


def _verified(pairs: DataFrame, slim: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link: suffix filter on slim (doc_id, n, bins, parity), then the words themselves."""
    a, b = (slim.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "bins", "parity"))) for x in "ab")
    total = lambda f, c: F.aggregate(F.zip_with(f"{c}_a", f"{c}_b", f), F.lit(0), lambda s, x: s + x)
    difference = F.greatest(total(lambda x, y: F.abs(x - y), "bins"), total(lambda x, y: F.bit_count(x.bitwiseXOR(y)), "parity"))
    # |a - b| + |b - a| = n_a + n_b - 2 overlap, and overlap >= t / (1 + t) (n_a + n_b)
    allowed = (F.col("n_a").cast("long") + F.col("n_b")) * (den - num) / F.lit(num + den)
    near = pairs.join(a, "a").join(b, "b").where(difference <= allowed).select("a", "b")
    near = common.materialise(near, "jaccard-near")
    texts = _texts(docs, near)
    left = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, frozenset] = {}
        for pdf in batches:
            keep = []
            for ta, tb in zip(pdf["text_a"], pdf["text_b"], strict=True):
                sets = []
                for t in (ta, tb):
                    if t not in last:
                        if len(last) > 64:
                            last.clear()
                        last[t] = exact_set(t, size)
                    sets.append(last[t])
                shared = len(sets[0] & sets[1])
                keep.append(den * shared >= num * (len(sets[0]) + len(sets[1]) - shared))
            yield pdf.loc[keep, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text); links are sets of similarity num/den or more."""
    common.small_batches(docs.sparkSession, 500)
    with common.temporary(docs.sparkSession):
        return common.kept(_components(docs, size, num, den), "jaccard-components")


def _components(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = common.materialise(_describe(docs, size), "jaccard-described")
    rows = described.where("block = -1").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "print")
    classes = common.materialise(rows.where("n > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "jaccard-classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    # prefixes of the classes' representatives; a shingle is of use from two documents on
    found = _prefixes(docs, _counters(described), size, num, den)
    # a doc_id may stand for several sets, which may share a prefix
    found = common.materialise(found.join(reps, "doc_id", "left_semi").dropDuplicates(), "jaccard-prefixes")
    slim = found.select("doc_id", "n", "bins", "parity")
    entries = found.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
    firsts = entries.groupBy("token").agg(F.min(F.struct("pos", "doc_id", "n")).alias("f"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    firsts = common.materialise(firsts.select("token", F.col("f.doc_id").alias("first"), F.col("f.pos").alias("first_pos"), F.col("f.n").alias("first_n")), "jaccard-firsts")

    def fits(n_a: str, n_b: str, pos_a: str, pos_b: str):
        """Length and positional filters."""
        a, b, pa, pb = (F.col(c).cast("long") for c in (n_a, n_b, pos_a, pos_b))
        most = F.least(a - pa, b - pb)  # overlap, if this is the first shared shingle
        return (a * den >= b * num) & (b * den >= a * num) & (most * (num + den) >= (a + b) * num)

    entries = common.materialise(entries.join(firsts.select("token"), "token", "left_semi"), "jaccard-entries")
    star = entries.join(firsts, (entries["token"] == firsts["token"]) & (entries["doc_id"] != firsts["first"]) & fits("n", "first_n", "pos", "first_pos"))
    star = star.select(F.least("doc_id", "first").alias("a"), F.greatest("doc_id", "first").alias("b")).distinct()
    star = common.materialise(star, "jaccard-star")
    links = common.materialise(_verified(star, slim, docs, size, num, den), "jaccard-links")

    # between components: at least one of a pair lies outside the component of the shingle's foremost document
    label = components(links)
    labelled = entries.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = common.materialise(labelled, "jaccard-labelled")
    centre = firsts.select("token", F.col("first").alias("doc_id")).join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("token", F.coalesce("component", "doc_id").alias("centre"))
    outer = common.materialise(labelled.join(centre, "token").where("component <> centre").select("token", *(F.col(c).alias(f"{c}_o") for c in ("doc_id", "n", "pos", "component"))), "jaccard-outer")
    cross = labelled.join(outer, (labelled["token"] == outer["token"]) & (F.col("component") != F.col("component_o")) & fits("n", "n_o", "pos", "pos_o"))
    cross = cross.select(F.least("doc_id", "doc_id_o").alias("a"), F.greatest("doc_id", "doc_id_o").alias("b")).distinct()
    cross = common.materialise(cross.join(star, ["a", "b"], "left_anti"), "jaccard-cross")
    more = _verified(cross, slim, docs, size, num, den)

    # copies of a class, and rows that repeat a doc_id, hang together
    own = rows.where("n > 0 and doc_id is not null").join(classes, "print").where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = components(links.union(more).union(own))
    out = rows.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"), size=3, num=90, den=100)


#: All pairs that share a shingle are counted, then links are followed until nothing new is reached.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END AS sh FROM w
),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, u.y FROM r JOIN u ON r.other = u.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""
