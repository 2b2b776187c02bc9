"""Secrets out of strings, and out of every string of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def redact(c: Column) -> Column:
    for pattern, to in fixed.SECRETS:
        c = F.regexp_replace(c, pattern, to)
    return c


def _deep(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return redact(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _deep(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _deep(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_deep(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def redact_report(df: DataFrame) -> DataFrame:
    """Every string in every column, however deep."""
    return df.select(*[_deep(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
