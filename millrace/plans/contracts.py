"""Column contracts: what tasks require, produce and drop, as sets of typed columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import types as T

from millrace.plans.errors import SchemaMismatch

_NAMED = {
    "boolean": T.BooleanType(), "byte": T.ByteType(), "tinyint": T.ByteType(), "short": T.ShortType(), "smallint": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(),
    "long": T.LongType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


def type_of(t: str | T.DataType) -> T.DataType:
    """A data type by name; unsigned types have no equal here and are refused."""
    if isinstance(t, T.DataType):
        return t
    if t.lower().startswith("uint"):
        raise ValueError(f"unsigned type {t} isn't supported")
    return _NAMED.get(t.lower()) or T._parse_datatype_string(t)


def schema_of(columns: str | T.StructType | Iterable[tuple[str, str | T.DataType]] | None) -> T.StructType:
    """A schema of nullable columns from pairs, from 'name type, name type', or from a schema; None is the empty one."""
    if columns is None:
        return T.StructType([])
    if isinstance(columns, T.StructType):
        return columns
    if isinstance(columns, str):
        columns = [tuple(c.split(None, 1)) for c in columns.split(",")] if "(" not in columns and "<" not in columns else [(f.name, f.dataType) for f in T._parse_datatype_string(columns)]
    return T.StructType([T.StructField(n, type_of(t), True) for n, t in columns])


class ColumnSet(Mapping):
    """Types by column name. Order and nullability play no part; of repeated names the last counts."""

    def __init__(self, columns: Mapping[str, T.DataType] | Iterable[tuple[str, T.DataType]] = ()):
        self._types = dict(columns)

    @classmethod
    def of(cls, schema: T.StructType) -> ColumnSet:
        return cls((f.name, f.dataType) for f in schema.fields)

    def __getitem__(self, name: str) -> T.DataType:
        return self._types[name]

    def __iter__(self):
        return iter(self._types)

    def __len__(self) -> int:
        return len(self._types)

    def __repr__(self) -> str:
        return f"ColumnSet({', '.join(f'{n} {t.simpleString()}' for n, t in sorted(self._types.items()))})"

    def missing(self, needed: T.StructType) -> list[str]:
        """The needed columns that aren't here with exactly that type: 'c', or 'c (expected T, got U)'."""
        out = []
        for f in needed.fields:
            if f.name not in self._types:
                out.append(f.name)
            elif self._types[f.name] != f.dataType:
                out.append(f"{f.name} (expected {f.dataType.simpleString()}, got {self._types[f.name].simpleString()})")
        return out

    def satisfies(self, needed: T.StructType, consumer: str, provider: str = "upstream") -> None:
        if gone := self.missing(needed):
            raise SchemaMismatch(provider, consumer, gone)

    def contains_all(self, names: Iterable[str], consumer: str, provider: str = "upstream") -> None:
        if gone := [n for n in names if n not in self._types]:
            raise SchemaMismatch(provider, consumer, gone)

    def apply(self, produces: T.StructType, drops: Iterable[str]) -> ColumnSet:
        """Drops go first, so a column may be dropped and produced anew with another type."""
        gone = set(drops)
        return ColumnSet({**{n: t for n, t in self._types.items() if n not in gone}, **{f.name: f.dataType for f in produces.fields}})

    @staticmethod
    def common(sets: Iterable[ColumnSet]) -> ColumnSet:
        """Columns that all have, with one type."""
        first, *rest = sets
        return ColumnSet((n, t) for n, t in first.items() if all(n in s and s[n] == t for s in rest))
