import pytest
from pyspark.sql import types as T

from millrace.plans.contracts import ColumnSet, schema_of
from millrace.plans.errors import SchemaMismatch

A = schema_of([("a", "int"), ("b", "string"), ("c", "double")])


def test_a_superset_satisfies():
    ColumnSet.of(A).satisfies(schema_of([("a", "int")]), "t")


def test_missing_and_mistyped_columns_are_named():
    with pytest.raises(SchemaMismatch) as e:
        ColumnSet.of(A).satisfies(schema_of([("a", "bigint"), ("z", "int")]), "t")
    assert e.value.missing == ["a (expected bigint, got int)", "z"]
    assert (e.value.provider, e.value.consumer) == ("upstream", "t")


def test_nullability_and_order_play_no_part():
    strict = T.StructType([T.StructField("c", T.DoubleType(), False), T.StructField("a", T.IntegerType(), False)])
    ColumnSet.of(A).satisfies(strict, "t")


def test_apply_drops_before_it_produces():
    out = ColumnSet.of(A).apply(schema_of([("a", "string"), ("d", "int")]), ["a", "b"])
    assert dict(out) == {"c": T.DoubleType(), "a": T.StringType(), "d": T.IntegerType()}


def test_common_needs_name_and_type():
    other = ColumnSet.of(schema_of([("a", "int"), ("b", "int")]))
    assert list(ColumnSet.common([ColumnSet.of(A), other])) == ["a"]


def test_empty_requires_nothing():
    ColumnSet().satisfies(schema_of(None), "t")


def test_drops_must_exist():
    with pytest.raises(SchemaMismatch):
        ColumnSet.of(A).contains_all(["zzz"], "t")


def test_unsigned_types_are_refused():
    with pytest.raises(ValueError):
        schema_of([("u", "uint32")])
