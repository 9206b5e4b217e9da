"""The strict column operations inside batch functions, on pyarrow tables."""

from __future__ import annotations

import pyarrow as pa

from millrace.plans.errors import CastError, ColumnError


def _at(table: pa.Table, name: str) -> int:
    at = table.schema.get_field_index(name)
    if at < 0:
        raise ColumnError(f"column '{name}' doesn't exist")
    return at


def _sized(table: pa.Table, values) -> pa.Array | pa.ChunkedArray:
    values = values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)
    if len(values) != table.num_rows:
        raise ColumnError(f"{len(values)} values for {table.num_rows} rows")
    return values


def append_column(table: pa.Table, name: str, values) -> pa.Table:
    if name in table.schema.names:
        raise ColumnError(f"column '{name}' exists already")
    values = _sized(table, values)
    return table.append_column(pa.field(name, values.type, True), values)


def drop_column(table: pa.Table, name: str) -> pa.Table:
    return table.remove_column(_at(table, name))


def replace_column(table: pa.Table, name: str, values) -> pa.Table:
    values = _sized(table, values)
    return table.set_column(_at(table, name), pa.field(name, values.type, True), values)


def rename_column(table: pa.Table, old: str, new: str) -> pa.Table:
    at = _at(table, old)
    if new in table.schema.names:
        raise ColumnError(f"column '{new}' exists already")
    return table.rename_columns([new if i == at else n for i, n in enumerate(table.schema.names)])


def column_as(table: pa.Table, name: str, kind: pa.DataType) -> pa.ChunkedArray:
    out = table.column(_at(table, name))
    if out.type != kind:
        raise CastError(f"column '{name}' cannot be cast to requested type")
    return out


def split(table: pa.Table, most: int) -> list[pa.Table]:
    """Slices of at most so many rows, without copies; a table that fits is its only slice."""
    if most < 1:
        raise ValueError("split size must be >= 1")
    return [table.slice(i, most) for i in range(0, table.num_rows, most)] if table.num_rows > most else [table]
