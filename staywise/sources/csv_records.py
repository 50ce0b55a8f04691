"""Records of CSV files whose fields may hold line breaks, read in byte ranges.

A line break ends a record only outside quotes, so where a range begins cannot be told from the
range alone. The number of quotes before it tells: a first scan counts quotes by range, and sums
along each file say which ranges begin inside a field. A second scan puts lines together to
records within each range, in the order they stand in; what a range boundary has cut is at most
one piece at each end of a range, and those pieces are joined by their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise.session import ship_code

_HEAD, _RECORD, _TAIL = 0, 1, 2
_OUT = "file string, start long, number long, kind int, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _records(batches: Iterator[pa.RecordBatch], inside: frozenset, quote: str, header: str) -> Iterator[pa.RecordBatch]:
    """Lines in file order to records, and to the pieces at a range's ends."""
    out: list[tuple] = []
    at: tuple | None = None
    held: list[str] = []
    odd = open_head = False
    number = 0

    def put(kind: int) -> None:
        nonlocal number
        record = "\n".join(held)
        record = record[:-1] if kind != _TAIL and record.endswith("\r") else record
        held.clear()
        if kind == _RECORD and at[1] == 0 and number == 0:
            if record.lstrip("﻿") != header:
                raise ValueError(f"the header of {at[0]} is not that of the other files: {record[:200]}")
        elif kind != _RECORD or record.strip():
            out.append((*at, number, kind, record))
        number += 1

    def end() -> None:
        if held:
            put(_HEAD if open_head else _TAIL if odd else _RECORD)

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], "file start number kind record".split())

    for batch in batches:
        for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
            if (file, start) != at:
                end()
                at, number = (file, start), 0
                odd = open_head = (file, start) in inside
            held.append(value)
            odd ^= value.count(quote) & 1 == 1
            if not odd:
                put(_HEAD if open_head else _RECORD)
                open_head = False
        if out:
            yield flushed()
    end()
    if out:
        yield flushed()


def csv_records(spark: SparkSession, path: str, header: str, quote: str = '"') -> DataFrame:
    """A row per record but the header: file, start, number, record. Empty lines are no records."""
    ship_code(spark)
    lines = _lines(spark, path)
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit(quote), F.lit("")))
    ranges = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranges.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0))).filter("before % 2 = 1")
    inside = frozenset((r["file"], r["start"]) for r in begun.select("file", "start").toLocalIterator())  # ranges, as Spark's own plan of the scan lists them
    cut = lines.mapInArrow(partial(_records, inside=inside, quote=quote, header=header), _OUT)
    if not inside:
        return cut.filter(F.col("kind") != _HEAD).select("file", "start", "number", "record")
    # A tail opens a record that the heads after it go on with.
    order = Window.partitionBy("file").orderBy("start", "number")
    pieces = cut.filter(F.col("kind") != _RECORD).withColumn("opened", F.sum((F.col("kind") == _TAIL).cast("int")).over(order))
    joined = pieces.groupBy("file", "opened").agg(F.sort_array(F.collect_list(F.struct("start", "number", "record"))).alias("p"))
    joined = joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["number"].alias("number"), F.array_join("p.record", "\n").alias("record"))
    return cut.filter(F.col("kind") == _RECORD).select(*joined.columns).unionByName(joined)


def read_records(spark: SparkSession, path: str, names: list[str], options: dict[str, str]) -> DataFrame:
    """All records parsed to text columns."""
    quoted = lambda n: options["quote"] + n.replace(options["quote"], 2 * options["quote"]) + options["quote"]
    first = spark.read.option("lineSep", "\n").text(path).first()
    header = "" if first is None else first[0].removesuffix("\r").lstrip("﻿")
    if header.count(options["quote"]) % 2:
        raise ValueError(f"the header line of {path} breaks within a field: {quoted(header)[:200]}")
    schema = T.StructType([T.StructField(f"c{k}", T.StringType(), True) for k in range(len(names))])
    parsed = csv_records(spark, path, header, options["quote"]).select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {**options, "header": "false", "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{k}").alias(n) for k, n in enumerate(names)])
