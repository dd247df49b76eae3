"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from ..shared import scratch, table

__all__ = ["free_name", "importable", "kept", "materialise", "open_input", "open_output", "remove", "sample", "scratch", "small_batches", "table", "temporary", "valid_vectors"]

#: Scratch tables of the operators that run just now, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that materialise() writes inside are deleted at the end; give results out with kept()."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def _written(df: DataFrame, label: str, scopes: list[list[str]]) -> DataFrame:
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    return _written(df, label, _scopes)


def kept(df: DataFrame, label: str) -> DataFrame:
    """materialise() what outlives the innermost temporary()."""
    return _written(df, label, _scopes[:-1])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, since texts can be long, and let workers import this package."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def _located(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else "file://" + uri[5:])


def open_output(uri: str):
    """A writable stream for a whole file at a URI or path, through pyarrow's file systems; it appears under its name on close only."""
    return _Whole(*_located(uri))


def open_input(uri: str):
    """A readable file with random access, at a URI or path that open_output() wrote."""
    system, path = _located(uri)
    return system.open_input_file(path)


class _Whole:
    """Write to a name of its own, then rename: a retried or repeated task replaces the file, never mixes with it."""

    def __init__(self, system, path: str):
        self.system, self.path, self.part = system, path, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.tmp"
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.part, self.path)


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of rows with an id whose vector is there and has neither null nor non-finite components."""
    importable(df.sparkSession)
    v = F.col(vec_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec")).where(
        F.col("vec").isNotNull() & F.col("id").isNotNull() & ~F.exists("vec", bad)
    )


def sample(vectors: DataFrame, rows: int, total: int) -> pd.DataFrame:
    """At most so many rows (id, ...) of a table of `total`, chosen by a hash of the id: those below a bound first, so that tasks send few."""
    h, space = F.xxhash64("id"), 1 << 64
    if total > 2 * rows:
        vectors = vectors.where(h < int(-(1 << 63) + 1.5 * rows / total * space))
    return vectors.orderBy(h, "id").limit(rows).toPandas()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
