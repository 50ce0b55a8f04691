"""CSV and Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staywise import fixed_values as fv
from staywise.functions.numbers import to_number
from staywise.operators.clean import default_note_column
from staywise.sources.csv_records import read_records
from staywise.sources.schema import struct_of


def missing_to_null(c: Column) -> Column:
    """Text tokens that mean "missing" become NULL; a blank stays text."""
    return F.when(~c.isin(fv.CSV_MISSING_TOKENS), c)


def _typed(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.LongType):
        # A fraction has no place in a whole-number column: it is missing, not cut.
        number = to_number(c)
        return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("long")).otherwise(
            F.when(number == F.floor(number), number.try_cast("long"))
        )
    if isinstance(kind, T.DoubleType):
        return to_number(c)
    return c


def read_csv(
    spark: SparkSession, path: str, columns: dict[str, str] | None = None, free_text: bool = False
) -> DataFrame:
    """Read a headed CSV by column name.

    Only the header line is looked at before the scan; every field is read as text,
    missing tokens are normalised, then declared columns are cast. ``free_text``
    accepts quotes and line breaks inside fields; such files are split by byte ranges too
    (``csv_records``), at the cost of a scan that counts quotes.
    """
    options = {"header": "true", "quote": '"', "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    as_text = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    if free_text:
        table = read_records(spark, path, names, options)
    else:
        table = spark.read.options(**options).option("enforceSchema", "false").schema(as_text).csv(path)
    declared = struct_of(columns) if columns else as_text
    kinds = {field.name: field.dataType for field in declared}
    return table.select(
        *[_typed(missing_to_null(F.col(f"`{n}`")), kinds.get(n, T.StringType())).alias(n) for n in names]
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quotes are doubled and blanks kept, so a field reads back as it was."""
    kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode(mode).options(header="true", quote='"', escape='"', **kept).csv(path)


def read_upload(spark: SparkSession, path: str) -> tuple[DataFrame | None, str]:
    """Read a CSV offered for scoring; an unreadable one gives a message, not an exception.

    Notes may hold quotes and line breaks.
    """
    if not path:
        return None, fv.UPLOAD_ABSENT
    try:
        table = read_csv(spark, path, {**fv.ENRICHED_COLUMNS}, free_text=True)
    except AnalysisException as error:
        return None, fv.UPLOAD_UNREADABLE.format(error)
    return default_note_column(table), ""


def write_feature_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Features of all splits as one table, partitioned by split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the partition filter keeps other splits unread."""
    return spark.read.parquet(path).where(F.col("split") == split)
