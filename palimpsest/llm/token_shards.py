"""Token-ID shards with a minimal perfect hash index (operator 5).

A shard file holds raw little-endian ids, then the documents' offsets, then an index: a cascade of bit arrays (each level
keeps the keys that alone hash to their bit; the others go on to the next) whose rank is a minimal perfect hash of the
document keys. Every slot stores a fingerprint and the document's ordinal. Ranks are stored for every RANK_BITS bits, so a lookup in
a file is a few hashes and short ranged reads, however large the file is.

    [ids][arrays ...][directory as JSON][length of the directory, 8 bytes]["PALSHRD1"]

Null texts are empty documents (just the end id); a very long one makes its shard as much longer. Null doc_ids come first, are written and read back, but have no key.
Rows that repeat a doc_id stand next to each other; the index gives their first ordinal and their number. Empty tables give
no shards and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, word_ids

MAGIC = b"PALSHRD1"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of int64 keys."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + _MIX[0] * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys: levels of bits, twice as many as keys left at each."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = np.unpackbits(bits)[: int(self.starts[-1])] if len(bits) else np.zeros(0, np.uint8)
        self.flat, self.rank = flat, np.concatenate([[0], np.cumsum(flat)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, flats, sizes = keys, [], []
        while len(left):
            size = 2 * len(left) + 1
            at = (mix64(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            flats.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        flat = np.concatenate(flats) if flats else np.zeros(0, bool)
        return cls(np.packbits(flat), np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds it. Foreign keys may get a slot: compare fingerprints."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (mix64(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.flat[at] == 1
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


#: Bits between stored ranks.
RANK_BITS = 512


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: list, payloads: list[bytes], width: int) -> bytes:
    """A shard of documents in order; a key may be None or repeat (then in a run)."""
    lengths = np.array([len(p) // width for p in payloads], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    null = np.array([k is None for k in keys], np.uint8)
    key = np.array([0 if k is None else k for k in keys], np.int64)
    there = np.flatnonzero(null == 0)
    distinct, first, runs = np.unique(key[there], return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    prints, ordinal, run = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    prints[slot], ordinal[slot], run[slot] = fingerprints(distinct), there[first] if len(there) else first, runs
    arrays = {"key": key, "null": null, "start": starts, "length": lengths, "bits": mph.bits, "ranks": mph.rank[:-1:RANK_BITS], "sizes": mph.sizes, "prints": prints, "ordinal": ordinal, "run": run}
    out, at = [*payloads], sum(map(len, payloads))
    directory: dict = {"width": width, "arrays": {}}
    for name, a in arrays.items():
        directory["arrays"][name] = [a.dtype.str, at, len(a)]
        out.append(a.tobytes())
        at += a.nbytes
    tail = json.dumps(directory).encode()
    return b"".join([*out, tail, len(tail).to_bytes(8, "little"), MAGIC])


class Shard:
    """Keyed access to the bytes of a shard file."""

    def __init__(self, data: bytes):
        if data[-8:] != MAGIC:
            raise ValueError("not a token shard")
        end = len(data) - 16
        size = int.from_bytes(data[end : end + 8], "little")
        directory = json.loads(data[end - size : end])
        self.data, self.width = memoryview(data), directory["width"]
        for name, (kind, at, n) in directory["arrays"].items():
            setattr(self, name, np.frombuffer(data, np.dtype(kind), n, at))
        self.mph = PerfectHash(self.bits, self.sizes)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First ordinal (-1: absent) and number of documents of each key."""
        slot = self.mph.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprints(keys[ok])
        at, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        at[ok], n[ok] = self.ordinal[slot[ok]], self.run[slot[ok]]
        same = ok.copy()
        same[ok] = self.key[at[ok]] == keys[ok]
        at[~same], n[~same] = -1, 0
        return at, n

    def ids(self, ordinal: int) -> np.ndarray:
        a = int(self.start[ordinal]) * self.width
        return np.frombuffer(self.data[a : a + int(self.length[ordinal]) * self.width], f"<u{self.width}")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key."""
        at, n = self.find(np.array([key], np.int64))
        return [self.ids(int(at[0]) + i) for i in range(int(n[0]))]


class ShardFile:
    """Keyed access to a shard in an open file, by ranged reads: nothing of it is held but the directory and the sizes of the levels."""

    def __init__(self, file):
        self.file, end = file, file.size() - 16
        if end < 0 or self.read(end + 8, 8) != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(self.read(end, 8), "little")
        directory = json.loads(self.read(end - size, size))
        self.width, self.arrays = directory["width"], directory["arrays"]
        self.sizes = self.values("sizes", 0, self.arrays["sizes"][2]).tolist()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def values(self, name: str, first: int, n: int) -> np.ndarray:
        kind, at, _ = self.arrays[name]
        step = np.dtype(kind).itemsize
        return np.frombuffer(self.read(at + first * step, n * step), kind)

    def slot(self, key: int) -> int:
        """The key's slot; -1 where no level holds it."""
        keys, start = np.array([key], np.int64), 0
        for level, size in enumerate(self.sizes):
            bit = start + int(mix64(keys, level)[0] % np.uint64(size))
            block = bit // RANK_BITS
            bits = np.unpackbits(self.values("bits", block * RANK_BITS // 8, min(RANK_BITS // 8, self.arrays["bits"][2] - block * RANK_BITS // 8)))
            if bits[bit % RANK_BITS]:
                return int(self.values("ranks", block, 1)[0]) + int(bits[: bit % RANK_BITS].sum())
            start += size
        return -1

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key."""
        slot = self.slot(key)
        if slot < 0 or self.values("prints", slot, 1)[0] != fingerprints(np.array([key], np.int64))[0]:
            return []
        first, run = int(self.values("ordinal", slot, 1)[0]), int(self.values("run", slot, 1)[0])
        if int(self.values("key", first, 1)[0]) != key:
            return []
        starts, lengths = self.values("start", first, run).tolist(), self.values("length", first, run).tolist()
        return [np.frombuffer(self.read(a * self.width, n * self.width), f"<u{self.width}") for a, n in zip(starts, lengths, strict=True)]


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, shard_ids: int = 1 << 25) -> pd.DataFrame:
    """Encode docs (doc_id, text) and write shards in ascending doc_id order under `out`.

    Returns the manifest, one row per shard (name, docs, ids, base): its size is the number of files. Texts are dealt out by
    ranges of doc_id with a hash of the text behind it, so rows that share a doc_id can fill more than one partition.
    """
    spark = docs.sparkSession
    common.small_batches(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, attempt, enc = TaskContext.get().partitionId(), uuid.uuid4().hex, word_ids.encoder(tokenizer)
        end, keys, payloads, held, n = end_id.to_bytes(enc.width, "little"), [], [], 0, 0

        def flush() -> dict:
            name = f"{task:07d}-{n:04d}-{attempt}.ids"
            f = common.open_output(f"{out}/{name}")
            f.write(pack_shard(keys, payloads, enc.width))
            f.close()
            return {"name": name, "docs": len(keys), "ids": held}

        for pdf in batches:
            for key, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                payloads.append(enc.ids(text or "") + end)
                keys.append(None if key is None or key != key else int(key))
                held += len(payloads[-1]) // enc.width
                if held >= shard_ids:
                    yield pd.DataFrame([flush()])
                    keys, payloads, held, n = [], [], 0, n + 1
        if keys:
            yield pd.DataFrame([flush()])

    # doc_id goes to Python as text: a null would turn a column of longs into doubles
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("salt", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = rows.mapInPandas(write, "name string, docs long, ids long").toPandas()
    found = found.sort_values("name", ignore_index=True)
    return found.assign(base=(found["ids"].cumsum() - found["ids"]).astype("int64"))


def read_shards(spark: SparkSession, out: str, manifest: pd.DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each found through its shard's index. Only files that the manifest names are read."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if manifest.empty:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, base in zip(pdf["name"].tolist(), pdf["base"].tolist(), strict=True):
                with common.open_input(f"{out}/{name}") as f:
                    shard = Shard(f.read())
                keyed = np.flatnonzero(shard.null == 0)
                distinct = np.unique(shard.key[keyed])
                at, n = shard.find(distinct)
                if (at < 0).any():
                    raise ValueError(f"index of {name} lacks a key")
                order = np.concatenate([np.flatnonzero(shard.null), np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]).astype(np.int64)
                crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in order]
                yield pd.DataFrame({
                    "doc_id": pd.Series(shard.key[order]).astype("Int64").mask(shard.null[order] == 1),
                    "start": shard.start[order] + base, "n_tokens": shard.length[order], "ids_crc32": crc,
                })

    files = spark.createDataFrame(manifest[["name", "base"]], "name string, base long")
    return files.repartition(min(len(manifest), 20_000), "name").mapInPandas(read, schema)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.scratch(spark, "token-shards")
    manifest = write_shards(common.table(spark, sf_dir, "documents"), out, word_ids.default_path(), end_id=0)
    return read_shards(spark, out, manifest)
