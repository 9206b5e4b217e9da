"""Sources: where batches come from. Each gives its schema before any data is read, then its batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.batching import BATCH, META, POS, Batches, Uniform, expression, no_steps, numbered, uniform_meta


class Source:
    """What a pipeline reads."""

    def schema(self, spark: SparkSession) -> T.StructType:
        raise NotImplementedError

    def batches(self, spark: SparkSession, most: int | None = None) -> tuple[Batches, list[DataFrame]]:
        """At most so many batches (not rows), and frames to unpersist at the end."""
        raise NotImplementedError

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows, for graphs in which no batch can be told from another."""
        raise NotImplementedError


@dataclass
class FrameSource(Source):
    """A DataFrame's rows in the order of unique columns, batch_size at a time or in batches by a value."""

    df: DataFrame
    order_by: str | list[str]
    batch_size: int = 1
    batch_by: Column | str | None = None

    def schema(self, spark):
        return self.df.schema

    def rows(self, spark):
        return self.df

    def batches(self, spark, most=None):
        order = [self.order_by] if isinstance(self.order_by, str) else list(self.order_by)
        if self.batch_by is None:
            rows, total, held = numbered(self.df, order, "__rn")
            data = rows.withColumns({BATCH: F.floor(F.col("__rn") / self.batch_size), POS: F.col("__rn") % self.batch_size}).drop("__rn")
            if most is not None:
                data, total = data.where(F.col(BATCH) < most), min(total, most * self.batch_size)
            return Batches(data, uniform_meta(spark, self.batch_size, total, most), Uniform(self.batch_size, total), True, -(-total // self.batch_size)), [held]
        keyed = self.df.withColumn("__key", expression(self.batch_by))
        # A row for each batch.
        keys, total, held = numbered(keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("rows")), ["__key"], "batch")
        keys = keys if most is None else keys.where(F.col("batch") < most)
        pos = (F.row_number().over(Window.partitionBy(BATCH).orderBy(*order)) - 1).cast("long")
        named = keys.select(F.col("__key").alias("__key2"), F.col("batch").alias(BATCH))
        data = keyed.join(named, F.col("__key").eqNullSafe(F.col("__key2"))).drop("__key", "__key2").withColumn(POS, pos)
        b = F.col("batch")
        return Batches(data, keys.select(b, b.alias("rank"), "rows", b.alias("lo"), b.alias("hi"), *no_steps()), None, True, total), [held]


@dataclass
class RangeSource(Source):
    """The default generator: batches of one row with id = start, start + 1, ...; endless ones need a limit."""

    n: int | None = None
    column: str = "id"
    start: int = 0

    def schema(self, spark):
        return T.StructType([T.StructField(self.column, T.LongType(), False)])

    def _n(self, most):
        if self.n is None and most is None:
            raise ValueError("an endless source needs a maximum number of batches")
        return min(x for x in (self.n, most) if x is not None)

    def rows(self, spark, most=None):
        return spark.range(self.start, self.start + self._n(most)).withColumnRenamed("id", self.column)

    def batches(self, spark, most=None):
        n = self._n(most)
        data = self.rows(spark, most).withColumns({BATCH: F.col(self.column) - self.start, POS: F.lit(0).cast("long")})
        return Batches(data, uniform_meta(spark, 1, n), Uniform(1, n), True, n), []


@dataclass
class GeneratorSource(Source):
    """Batches from a Python generator of pyarrow tables with a given schema; polled until it ends, and never again.

    A generator runs in one place, the driver, which gathers its batches; a source of many batches is a NumberedSource.
    """

    produces: T.StructType
    make: Callable[[], Iterator[pa.Table]]

    def schema(self, spark):
        return self.produces

    def rows(self, spark):
        return self.batches(spark)[0].data.drop(BATCH, POS)

    def batches(self, spark, most=None):
        tables, sizes = [], []
        for i, t in enumerate(self.make() if most is None or most > 0 else ()):
            tables.append(t.append_column(BATCH, pa.array([i] * t.num_rows, pa.int64())).append_column(POS, pa.array(range(t.num_rows), pa.int64())))
            sizes.append(t.num_rows)
            if len(tables) == most:
                break
        data = spark.createDataFrame(pa.concat_tables(tables)) if tables else spark.createDataFrame([], T.StructType([*self.produces.fields, T.StructField(BATCH, T.LongType()), T.StructField(POS, T.LongType())]))
        meta = spark.createDataFrame([(i, i, n, i, i, [], []) for i, n in enumerate(sizes)], META)
        return Batches(data, meta, None, True, len(sizes)), []


@dataclass
class NumberedSource(Source):
    """Batches 0, 1, ... of a custom source, each made by a worker from its number; an endless one needs a limit.

    make: from a number to a pyarrow table of the given schema. It may run again where an executor is lost, so a number always gives the
    same rows.
    """

    produces: T.StructType
    make: Callable[[int], pa.Table]
    n: int | None = None

    def schema(self, spark):
        return self.produces

    def rows(self, spark):
        return self._made(spark, None).drop(BATCH, POS)

    def _made(self, spark, most):
        if self.n is None and most is None:
            raise ValueError("an endless source needs a maximum number of batches")
        n, make, fields = min(x for x in (self.n, most) if x is not None), self.make, self.produces.fields

        def run(parts):
            for part in parts:
                for i in part.column("id").to_pylist():
                    t = make(i).select([f.name for f in fields])
                    t = t.append_column(BATCH, pa.array([i] * t.num_rows, pa.int64())).append_column(POS, pa.array(range(t.num_rows), pa.int64()))
                    yield from t.to_batches()

        return spark.range(n).mapInArrow(run, T.StructType([*fields, T.StructField(BATCH, T.LongType()), T.StructField(POS, T.LongType())]))

    def batches(self, spark, most=None):
        data = self._made(spark, most).persist(StorageLevel.MEMORY_AND_DISK)
        n = min(x for x in (self.n, most) if x is not None)
        sizes = data.groupBy(F.col(BATCH).alias("__b2")).agg(F.count(F.lit(1)).alias("__n"))
        b = F.col("id")
        meta = spark.range(n).join(sizes, b == F.col("__b2"), "left").select(b.alias("batch"), b.alias("rank"), F.coalesce("__n", F.lit(0)).cast("long").alias("rows"), b.alias("lo"), b.alias("hi"), *no_steps())
        return Batches(data, meta, None, True, n), [data]


def endless_stream(spark: SparkSession, rows_per_batch: int = 1) -> DataFrame:
    """The default generator as a stream: id = 0, 1, ... with so many rows in each micro-batch."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load().select(F.col("value").alias("id"))
