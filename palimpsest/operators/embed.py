"""The hook for an embedding model: texts in, unit vectors out. Models are outside this engine."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def letter_counts(texts: list[str]) -> np.ndarray:
    """A stand-in for tests: how often each letter a-z occurs."""
    return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], float)


def embed(rows: DataFrame, encode: Callable[[list[str]], np.ndarray] = letter_counts, batch: int = 64) -> DataFrame:
    """id, vec of rows (id, text): encode() is called for batches, its vectors are scaled to length 1 (zero ones stay)."""

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                v = np.asarray(encode([t or "" for t in part["text"]]), float)
                n = np.sqrt((v**2).sum(1, keepdims=True))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": list(v / np.where(n > 0, n, 1))})

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, vec array<double>")
