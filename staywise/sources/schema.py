"""Declared column maps to Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from staywise import fixed_values as fv

_TYPES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType()}


def struct_of(columns: dict[str, str]) -> T.StructType:
    if not columns:
        raise ValueError("a schema needs at least one column")
    unknown = {kind for kind in columns.values() if kind not in _TYPES}
    if unknown:
        raise ValueError(f"unknown column types: {sorted(unknown)}")
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in columns.items()])


RAW_SCHEMA = struct_of(fv.RAW_COLUMNS)
ENRICHED_SCHEMA = struct_of(fv.ENRICHED_COLUMNS)
