"""Language identification of words in code-switched text by a linear-chain conditional random field (operator 8).

A word's features are the word itself (lexicon), its prefixes and suffixes of up to three letters, and its letter bigrams and
trigrams; transitions between the words' languages are learned with them by maximising the likelihood of labelled
sequences, some of them joined from fragments of different languages. Prediction is forward-backward over all words
of a text; a text's language is the one with the largest mean marginal, which is its score.

Learning uses a bounded sample of rows: at most TRAIN_DOCS whole texts of a language, by a hash of doc_id and text, of rows with a
language whose crc32(doc_id) mod 5 is not 0; equal rows count once. Prediction reads whole texts of any length and nothing else.

Texts that are null or have no letter (numerals such as fractions or circled numbers are none) are `und` with score 0, and so is
every text if nothing can be learned. Ties between languages go to the first in order. Rows that repeat a
doc_id are predicted one by one. A null doc_id counts as empty text in the fold (held out). Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS, LENGTH, FOLDS = 120, 24, 5
#: With very many languages: so many rows in all; and with very long texts: so many sequences of LENGTH words, drawn from all.
TRAIN_ROWS, TRAIN_SEQUENCES = 8_000, 60_000
UNKNOWN = "und"
#: Word characters that are neither letters nor decimal digits: numerals of other kinds. None stand beyond U+1FFFF.
_NUMERALS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTER = rf"[^\W\d_{_NUMERALS}]"
_WORD, _LETTERS = re.compile(rf"\b{_LETTER}++\b"), re.compile(rf"{_LETTER}+")
#: The same with such numerals among the letters: many times faster, and right for runs that are all letters.
_QUICK_WORD, _QUICK_LETTERS = re.compile(r"\b[^\W\d_]++\b"), re.compile(r"[^\W\d_]+")


def _runs(quick: re.Pattern, exact: re.Pattern, text: str) -> list[str]:
    found = quick.findall(text)
    return found if all(map(str.isalpha, found)) else [x for w in found for x in ([w] if w.isalpha() else exact.findall(w))]


def words(text: str) -> list[str]:
    """Runs of letters, in lower case; those next to digits (keys, digests) only where there is nothing else."""
    text = text.lower()
    return _runs(_QUICK_WORD, _WORD, text) or _runs(_QUICK_LETTERS, _LETTERS, text)


def features(word: str) -> list[str]:
    """Lexicon, affix and n-gram features; a long word's n-grams are all taken."""
    w = f"^{word}$"
    out = ["=" + word]
    for n in (1, 2, 3):
        if len(word) >= n:
            out += ["<" + word[:n], ">" + word[-n:]]
    for n in (2, 3):
        out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


class Model:
    """Weights of features (rows) by language, transitions, and how sequences start; scores are logarithms."""

    def __init__(self, languages: list[str], index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.languages, self.index, self.weights, self.transitions, self.start = languages, index, weights, transitions, start
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.languages)))

    def __getstate__(self):
        return self.languages, self.index, self.weights, self.transitions, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, lists: list[list[str]], most: int = 400_000) -> np.ndarray:
        """exp(scores), scaled by word, of all words in order. Words are remembered, up to `most`; results don't depend on it."""
        if len(self.known) > most:
            self.reset()
        known = self.known
        new = list({w for ws in lists for w in ws if w not in known})
        if new:
            base, get = len(known), self.index.get
            found = [[i for f in features(w) if (i := get(f)) is not None] for w in new]
            sizes = np.array([len(f) for f in found])
            scores = np.zeros((len(new), len(self.languages)))
            flat = np.array([i for f in found for i in f], np.int64)
            if len(flat):
                full = np.flatnonzero(sizes)
                scores[full] = np.add.reduceat(self.weights[flat], (np.cumsum(sizes) - sizes)[full], axis=0)
            while len(self.rows) < base + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[base : base + len(new)] = np.exp(scores - scores.max(1, keepdims=True))
            known.update(zip(new, range(base, base + len(new)), strict=True))
        at = np.fromiter((known[w] for ws in lists for w in ws), np.int64)
        return self.rows[at]

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """Of each text the language with the largest mean marginal, that mean, and the mean of each word's largest marginal."""
        lists = [words(t) for t in texts]
        sizes = np.array([len(ws) for ws in lists], np.int64)
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        there = np.flatnonzero(sizes)
        if not len(there) or not self.languages:
            return out
        begin = (np.cumsum(sizes) - sizes)[there]
        marginals = forward_backward(self.emissions(lists), begin, np.exp(self.transitions), np.exp(self.start))
        mean = np.add.reduceat(marginals, begin, axis=0) / sizes[there, None]
        sure = np.add.reduceat(marginals.max(1), begin) / sizes[there]
        for i, row, s in zip(there.tolist(), mean, sure.tolist(), strict=True):
            top = int(row.argmax())
            out[i] = (self.languages[top], float(min(1.0, max(0.0, row[top]))), min(1.0, s))
        return out


def forward_backward(psi: np.ndarray, begin: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of all words of many texts laid end to end.

    At a text's first word (begin) the chain starts anew, whatever came before. The long chain is cut into blocks that move in step:
    first every block's product of transfer matrices, then the states at the blocks' borders one after another, then all blocks
    again from their borders. That is exact, and each step is one operation on all blocks.
    """
    n, k = psi.shape
    steps = max(1, int(np.sqrt(n)))
    blocks = -(-n // steps)
    pad = blocks * steps - n
    psi = np.concatenate([psi, np.ones((pad, k))]).reshape(blocks, steps, k)
    first = np.zeros(blocks * steps, bool)
    first[begin] = True
    first[n:] = True  # padding: chains of one
    first = first.reshape(blocks, steps)
    product = np.tile(np.eye(k), (blocks, 1, 1))
    for i in range(steps):
        moved = (product.reshape(-1, k) @ trans).reshape(blocks, k, k)
        new = first[:, i]
        if new.any():
            moved[new] = product[new].sum(2, keepdims=True) * start
        product = moved * psi[:, i, None, :]
        product /= product.sum((1, 2), keepdims=True)
    left, right = np.ones((blocks, k)), np.ones((blocks, k))
    for b in range(1, blocks):
        v = left[b - 1] @ product[b - 1]
        left[b] = v / v.sum()
    for b in range(blocks - 2, -1, -1):
        v = product[b + 1] @ right[b + 1]
        right[b] = v / v.sum()
    out = np.empty_like(psi)
    a = left
    for i in range(steps):
        a = np.where(first[:, i, None], start, a @ trans) * psi[:, i]
        a /= a.sum(1, keepdims=True)
        out[:, i] = a
    b = right
    for i in range(steps - 1, -1, -1):
        out[:, i] *= b
        v = psi[:, i] * b
        b = np.where(first[:, i, None], (v @ start)[:, None], v @ trans.T)
        b = b / b.sum(1, keepdims=True)
    out /= out.sum(2, keepdims=True)
    return out.reshape(-1, k)[:n]


def fit(samples: list[tuple[str, str]], epochs: int = 8, batch: int = 64, rate: float = 0.2, decay: float = 1e-4, seed: int = 0) -> Model:
    """Learn from (text, language) samples by stochastic gradient (Adagrad) on the sequences' likelihood."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in samples})
    k, number = len(languages), {lang: i for i, lang in enumerate(languages)}
    fragments = []  # (words, language)
    for text, lang in samples:
        ws = words(text)
        fragments += [(ws[i : i + LENGTH], number[lang]) for i in range(0, len(ws), LENGTH) if ws[i : i + LENGTH]]
    if not fragments:
        return Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    if len(fragments) > TRAIN_SEQUENCES:
        fragments = [fragments[i] for i in np.sort(rng.permutation(len(fragments))[:TRAIN_SEQUENCES]).tolist()]
    counts: dict[str, int] = {}
    by_word: dict[str, list[str]] = {}
    for ws, _ in fragments:
        for w in ws:
            if w not in by_word:
                by_word[w] = features(w)
            for f in by_word[w]:
                counts[f] = counts.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c > 1))}
    coded = {w: np.array([index[f] for f in fs if f in index], np.int64) for w, fs in by_word.items()}
    weights, trans, start = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)
    seen = [np.full(p.shape, 1e-2) for p in (weights, trans, start)]
    for _ in range(epochs):
        # sequences of one language, and of two fragments joined
        order = rng.permutation(len(fragments)).tolist()
        sequences = []
        while order:
            ws, y = fragments[order.pop()]
            seq = [(w, y) for w in ws]
            if order and rng.random() < 0.5:
                other, z = fragments[order.pop()]
                cut, keep = int(rng.integers(1, len(seq) + 1)), int(rng.integers(1, len(other) + 1))
                seq = (seq[:cut] + [(w, z) for w in other[:keep]])[:LENGTH]
            sequences.append(seq)
        for at in range(0, len(sequences), batch):
            part = sequences[at : at + batch]
            flat = [x for s in part for x in s]
            sizes = np.array([len(s) for s in part])
            begin = np.cumsum(sizes) - sizes
            y = np.array([v for _, v in flat])
            ids = [coded[w] for w, _ in flat]
            n_ids = np.array([len(i) for i in ids])
            all_ids, owner = np.concatenate(ids), np.repeat(np.arange(len(flat)), n_ids)
            scores = np.zeros((len(flat), k))
            np.add.at(scores, owner, weights[all_ids])
            psi = np.exp(scores - scores.max(1, keepdims=True))
            marginals, pairs = _expected(psi, begin, sizes, np.exp(trans), np.exp(start))
            error = -marginals
            error[np.arange(len(y)), y] += 1
            inner = np.ones(len(flat), bool)
            inner[begin] = False
            g_trans = -pairs
            np.add.at(g_trans, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            used, back = np.unique(all_ids, return_inverse=True)
            g = np.zeros((len(used), k))
            np.add.at(g, back, error[owner])
            g -= decay * len(part) * weights[used]
            seen[0][used] += g**2
            weights[used] += rate * g / np.sqrt(seen[0][used])
            for p, q, s in ((trans, g_trans - decay * trans, seen[1]), (start, error[begin].sum(0), seen[2])):
                s += q**2
                p += rate * q / np.sqrt(s)
    return Model(languages, index, weights, trans, start)


def _expected(psi: np.ndarray, begin: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words and summed expectations of transitions of short sequences, all in step."""
    k, longest = psi.shape[1], int(sizes.max())
    at = np.minimum(begin[:, None] + np.arange(longest), len(psi) - 1)
    live = np.arange(longest) < sizes[:, None]
    p = np.where(live[:, :, None], psi[at], 1.0)
    alpha, beta = np.zeros_like(p), np.ones_like(p)
    a = start * p[:, 0]
    alpha[:, 0] = a = a / a.sum(1, keepdims=True)
    for i in range(1, longest):
        a = (a @ trans) * p[:, i]
        alpha[:, i] = a = a / a.sum(1, keepdims=True)
    for i in range(longest - 2, -1, -1):
        b = (p[:, i + 1] * beta[:, i + 1]) @ trans.T
        b = np.where(live[:, i + 1, None], b / b.sum(1, keepdims=True), 1.0)
        beta[:, i] = b
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(1, longest):
        x = alpha[:, i - 1, :, None] * trans * (p[:, i] * beta[:, i])[:, None, :]
        x = x / x.sum((1, 2), keepdims=True)
        pairs += x[live[:, i]].sum(0)
    out = np.zeros_like(psi)
    out[at[live]] = m[live]
    return out, pairs


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def training_sample(docs: DataFrame, per_language: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """At most per_language (text, language) of each language and TRAIN_ROWS in all, chosen by a hash of doc_id and text."""
    space = 1 << 30
    h = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(space))
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", h.alias("h"), "text")
    # equal rows count once, or a row with many copies would leave no room for others
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("h", "text"), 0.02).alias("n"))
    languages = counts.count()
    if not languages:
        return []
    most = max(1, min(per_language, TRAIN_ROWS // languages))
    # half as many again, since a hash doesn't hit a number exactly; cut to the number below
    bounds = counts.select("lang", F.least(F.lit(space), F.floor(1.5 * most * space / F.col("n")) + 1).alias("bound"))
    found = rows.join(F.broadcast(bounds) if languages <= TRAIN_ROWS else bounds, "lang").where(F.col("h") < F.col("bound")).select("lang", "h", "text").distinct()
    pdf = found.toPandas().sort_values(["lang", "h", "text"]).groupby("lang").head(most)
    return list(zip(pdf["text"].tolist(), pdf["lang"].tolist(), strict=True))


def predict(docs: DataFrame, model: Model, language: str = "lang_pred", score: str = "score", sure: str | None = None) -> DataFrame:
    """docs with columns for the predicted language, its score and, if asked for, how sure the words are; columns of these names are replaced, all others kept."""
    names = [language, score, *([sure] if sure else [])]
    docs = docs.drop(*names)
    common.small_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{language}` string", *(f"`{n}` double" for n in names[1:])])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:  # Arrow, so that columns that aren't read go through as they are
            found = shared.value.predict([t or "" for t in batch.column("text").to_pylist()])
            new = {n: pa.array([f[i] for f in found], pa.float64() if i else pa.string()) for i, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | new)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from docs and predict docs: lang_pred and score beside their columns."""
    return predict(docs, fit(training_sample(docs)))


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(training_sample(docs))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
