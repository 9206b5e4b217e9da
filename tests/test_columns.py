import pyarrow as pa
import pytest

from millrace.functions import tables
from millrace.operators import columns
from millrace.plans.errors import CastError, ColumnError

T = pa.table({"a": pa.array([1, 2], pa.int32()), "b": ["x", "y"]})


def test_table_columns():
    assert tables.append_column(T, "c", [1.0, 2.0]).schema.names == ["a", "b", "c"]
    assert tables.drop_column(T, "a").schema.names == ["b"]
    out = tables.replace_column(T, "a", ["p", "q"])
    assert out.schema.names == ["a", "b"] and out.schema.field("a").type == pa.string()
    assert tables.rename_column(T, "a", "z").schema.names == ["z", "b"]
    assert tables.column_as(T, "a", pa.int32()).to_pylist() == [1, 2]
    for bad in (lambda: tables.append_column(T, "a", [1, 2]), lambda: tables.append_column(T, "c", [1]), lambda: tables.drop_column(T, "z"), lambda: tables.replace_column(T, "z", [1, 2]), lambda: tables.rename_column(T, "z", "y"), lambda: tables.rename_column(T, "a", "b")):
        with pytest.raises(ColumnError):
            bad()
    with pytest.raises(CastError, match="column 'a' cannot be cast to requested type"):
        tables.column_as(T, "a", pa.int64())


@pytest.mark.parametrize(("n", "most", "sizes"), [(6, 3, [3, 3]), (7, 3, [3, 3, 1]), (2, 3, [2]), (0, 3, [0])])
def test_split(n, most, sizes):
    assert [t.num_rows for t in tables.split(pa.table({"x": list(range(n))}), most)] == sizes
    with pytest.raises(ValueError):
        tables.split(T, 0)


def test_frame_columns(spark):
    df = spark.createDataFrame([(1, "x"), (None, None)], "a int, b string")
    assert columns.append_column(df, "c", "a * 2").columns == ["a", "b", "c"]
    assert columns.drop_column(df, "a").columns == ["b"]
    assert dict(columns.replace_column(df, "a", "cast(a as string)").dtypes) == {"a": "string", "b": "string"}
    assert columns.rename_column(df, "a", "z").columns == ["z", "b"]
    assert df.select(columns.column_as(df, "a", "int")).collect()[1][0] is None
    for bad in (lambda: columns.append_column(df, "a", "1"), lambda: columns.drop_column(df, "z"), lambda: columns.replace_column(df, "z", "1"), lambda: columns.rename_column(df, "z", "y"), lambda: columns.rename_column(df, "a", "b")):
        with pytest.raises(ColumnError):
            bad()
    with pytest.raises(CastError):
        columns.column_as(df, "a", "bigint")
