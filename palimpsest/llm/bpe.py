"""BPE encoding by speculation and verification, and decoding (operator 4).

Greedy longest match proposes the tokens of every distinct pre-token. A proposal is the exact BPE result if and only if every
two neighbours are compatible, that is, if merging their joined bytes gives back these two tokens; this is decided for
all pairs at once with numpy by undoing the later merge of either side and looking up whether the tokens at the border would
have merged before. Only words with an incompatible pair are merged exactly, with a heap over a linked list.

Null texts are empty (no tokens, digests of nothing). Very long texts are encoded whole, in one row of a task; a word of any length is merged
in time n log n. Files with settings that change the ids of a pre-token (dropout, byte_fallback, ignore_merges and so on) are refused. Rows that repeat a doc_id give a row each. Empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, word_ids

_NEVER = 1 << 40


class SpeculativeBPE:
    """A byte-level BPE file as tables. Inside, tokens are numbered by when they are made: bytes first, then merges in order."""

    def __init__(self, path: str, cache_words: int = 600_000):
        spec = word_ids.read_file(path)
        model = spec["model"]
        byte_of = {c: b for b, c in word_ids.byte_alphabet().items()}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        vocab = {raw(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.token = [bytes([b]) for b in range(256)]  # by inner number
        number = {t: i for i, t in enumerate(self.token)}
        left, right = list(range(256)), list(range(256))
        self.merge: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = (number[raw(t)] for t in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.token[a] + self.token[b]
            if made in number:
                raise ValueError("two merges make one token")
            number[made] = self.merge[a, b] = len(self.token)
            self.token.append(made)
            left.append(a)
            right.append(b)
        self.left, self.right = np.array(left), np.array(right)
        self.outer = [vocab[t] for t in self.token]
        size = len(self.token)
        pairs = sorted((a * size + b, made) for (a, b), made in self.merge.items())
        self.pair_key, self.pair_made = np.array([p for p, _ in pairs], np.int64), np.array([m for _, m in pairs], np.int64)
        self.size, self.cache, self.most = size, {}, cache_words
        # greedy may propose only tokens that BPE makes of their own bytes
        self.propose = {t: i for i, t in enumerate(self.token) if i < 256 or self.exact(t) == [i]}
        self.reach: dict[bytes, int] = {}  # first three bytes: the longest token with them
        for t in self.propose:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, get, reach = [], 0, len(word), self.propose.get, self.reach.get
        while at < n:
            for end in range(min(n, at + reach(word[at : at + 3], 2)), at, -1):
                token = get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge the earliest-ranked pair, leftmost first, until none is left."""
        return self._exact_short(word) if len(word) <= 40 else self._exact_long(word)

    def _exact_short(self, word: bytes) -> list[int]:
        token, made = list(word), self.merge.get
        ranks = [made(p, _NEVER) for p in zip(token, token[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            token[i : i + 2] = (best,)
            del ranks[i]
            if i:
                ranks[i - 1] = made((token[i - 1], best), _NEVER)
            if i < len(ranks):
                ranks[i] = made((best, token[i + 1]), _NEVER)
        return token

    def _exact_long(self, word: bytes) -> list[int]:
        """With a heap over a linked list."""
        token, n, merge = list(word), len(word), self.merge
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(made, i) for i in range(n - 1) if (made := merge.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            made, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= n or merge.get((token[i], token[j])) != made:
                continue
            token[i], token[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (m := merge.get((made, token[after[j]]))) is not None:
                    heapq.heappush(heap, (m, i))
            if (p := before[i]) >= 0 and (m := merge.get((token[p], made))) is not None:
                heapq.heappush(heap, (m, p))
        return [t for t in token if t >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of token a's bytes followed by token b's gives (a, b), for every pair."""
        ok = np.ones(len(a), bool)
        todo, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NEVER, np.int64)
        while len(todo):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            clash = (self.pair_key[at] == key) & (self.pair_made[at] < limit)
            ok[todo[clash]] = False
            # undo whichever of the two was made later; once it is a byte, undo the other
            leaf_x, leaf_y = x < 256, y < 256
            undo_x = ((x > y) & ~leaf_x) | ((x <= y) & leaf_y & ~leaf_x)
            undo_y = ((x <= y) & ~leaf_y) | ((x > y) & leaf_x & ~leaf_y)
            go = ~clash & (undo_x | undo_y)
            limit = np.where(undo_x, x, y + 1)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_y, self.left[y], y)[go]
            todo = todo[go]
        return ok

    def learn(self, words: list[str]) -> dict[str, tuple[int, str, bytes]]:
        """(number of ids, ids as decimals joined by commas, decoded bytes) of words, all verified together."""
        data = [w.encode("utf-8") for w in words]
        found = [self.greedy(d) for d in data]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.array([t for f in found for t in f], np.int64)
        word = np.repeat(np.arange(len(found)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(flat) else np.zeros(0, np.int64)
        distinct, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(distinct // self.size, distinct % self.size)[back]
        for i in np.unique(word[inner[~fine]]).tolist():
            found[i] = self.exact(data[i])
        out = {}
        for w, f in zip(words, found, strict=True):
            ids = [self.outer[t] for t in f]
            out[w] = (len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids)))
        return out

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of each text; the words new to this batch are verified together."""
        split = [
            [(p, p in self.added) for p in self.special.split(t)] if self.special and any(a in t for a in self.added) else [(t, False)]
            for t in texts
        ]
        words = [[w for p, added in parts for w in ([(p,)] if added else word_ids.split_words(p))] for parts in split]
        if len(self.cache) > self.most:
            self.cache.clear()
        known = self.cache
        new = [w for w in set().union(*words).difference(known) if isinstance(w, str)]
        known |= self.learn(new)
        for token, i in self.added.items():
            known[(token,)] = (1, str(i), token.encode())
        for ws in words:
            n, ids, decoded = zip(*map(known.__getitem__, ws), strict=True) if ws else ((), (), ())
            text = b"".join(decoded).decode("utf-8", "replace")
            yield sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        for w in new:
            if len(w) > word_ids.KEPT_LENGTH:
                del known[w]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.special.split(text) if self.special else [text]:
            out += [self.added[p]] if p in self.added else [int(i) for w in word_ids.split_words(p) for i in self.learn([w])[w][1].split(",")]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[str, SpeculativeBPE] = {}


def codec(path: str) -> SpeculativeBPE:
    if path not in _loaded:
        _loaded[path] = SpeculativeBPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    common.small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(tokenizer)
        for pdf in batches:
            if len(pdf):
                n, ids, text = zip(*bpe.digest([t or "" for t in pdf["text"].tolist()]), strict=True)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": text})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"), word_ids.default_path())
