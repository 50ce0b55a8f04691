"""Dense arrays and ML vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dense_array(df: DataFrame, name: str) -> Column:
    """Column ``name`` as ``array<double>``, whether it holds a vector, an array or a number."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        return F.col(f"`{name}`").cast("array<double>")
    if isinstance(kind, T.NumericType):
        return F.array(F.col(f"`{name}`").cast("double"))
    return vector_to_array(F.col(f"`{name}`"))


def as_vector(c: Column) -> Column:
    return array_to_vector(c)


def zero_array(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)
