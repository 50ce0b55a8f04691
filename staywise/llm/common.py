"""What the operators share: the word rule, block reading in workers, and the query registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.catalog.registry import Query

#: Words and the white space between them, as Java, RE2 and Python read them alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

QUERIES: dict[str, Query] = {}

#: What operators keep in a worker between tasks; all of it can be made again.
KEPT: list[dict] = []


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``(spark, sf_dir) -> DataFrame`` under a name, with its DuckDB twin where SQL can say it."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a name for ``value``, which is then computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def not_above(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at or below ``value`` (null: 0), by binary search."""
    listed = F.lit([int(b) for b in bounds]) if bounds else None

    def search(lo: Column, step: int) -> Column:
        if not step:
            return lo
        there = (lo + step <= len(bounds)) & (F.get(listed, lo + (step - 1)) <= value)
        return bind(F.when(there, lo + step).otherwise(lo), lambda x: search(x, step >> 1))

    return search(F.lit(0), 1 << (len(bounds).bit_length() - 1)) if bounds else F.lit(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside; whole texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def light_batches(spark: SparkSession, max_bytes: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about ``max_bytes`` for the jobs that run inside: 10,000 whole texts would make one of tens of MB, narrow rows stay together."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(max_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def let_go() -> None:
    """At a task's end: the next step reuses the worker, where what steps keep and Arrow's free memory would add up."""
    for cache in KEPT:
        cache.clear()
    pa.default_memory_pool().release_unused()


def few(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row in two tasks a core at most: every file that is written starts processes on its executor."""
    return df.coalesce(max(1, 2 * df.sparkSession.sparkContext.defaultParallelism))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = 512, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no piece holds more than ``rows`` rows or, beyond its first row, ``max_bytes`` of text."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + max_bytes, side="right"))
            stop = min(n, start + rows, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop
