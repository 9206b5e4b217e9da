"""Strict column operations: what is named must be there, or must not be yet. No casts but those asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from millrace.operators.batching import expression
from millrace.plans.contracts import type_of
from millrace.plans.errors import CastError, ColumnError


def _has(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ColumnError(f"column '{name}' doesn't exist")


def append_column(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """A new last column."""
    if name in df.columns:
        raise ColumnError(f"column '{name}' exists already")
    return df.withColumn(name, expression(value))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    _has(df, name)
    return df.drop(name)


def replace_column(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """Another value, of any type, in the same place."""
    _has(df, name)
    return df.withColumn(name, expression(value))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _has(df, old)
    if new in df.columns:
        raise ColumnError(f"column '{new}' exists already")
    return df.withColumnRenamed(old, new)


def column_as(df: DataFrame, name: str, kind: str) -> Column:
    """The column, if it has exactly that type."""
    _has(df, name)
    if df.schema[name].dataType != type_of(kind):
        raise CastError(f"column '{name}' cannot be cast to requested type")
    return df[name]
