"""Compiles a validated graph to DataFrames: one of rows for each node and one small one of its batches."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators import batching
from millrace.operators.batching import BATCH, POS, Batches
from millrace.plans.contracts import ColumnSet
from millrace.plans.errors import SchemaMismatch, TaskError
from millrace.plans.graph import PipelineGraph
from millrace.plans.storage import Storage
from millrace.plans.task import Task
from millrace.sources.frames import Source


class TimesParam(AccumulatorParam):
    """Nanoseconds by (task, batch); a repeated run of a batch counts once, by its last time."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):  # noqa: N802
        a.update(b)
        return a


class Compiled:
    """The frames of a graph. Batch ids and order are only computed where something asks for them."""

    def __init__(self, spark: SparkSession, graph: PipelineGraph, source: Source, *, max_batches: int | None = None, storage: Storage | None = None, times=None, profile=None):
        """profile: from a task's Resources, the resource profile of its stage or None."""
        self.profile = profile
        self.spark, self.graph, self.source, self.max_batches = spark, graph, source, max_batches
        self.storage = storage or Storage()
        self.times = times
        schema = source.schema(spark)
        batching.refuse_reserved(schema.fieldNames(), "the source")
        for node in graph.nodes():
            batching.refuse_reserved(node.task.produces.fieldNames(), f"task '{node.name}'")
        self.columns = graph.validate(schema)
        self._nodes: dict[int, Batches] = {}
        self._source: Batches | None = None
        self._plain: dict[int, DataFrame] = {}
        self._read_by: list[tuple[int, DataFrame]] = []  # sinks, and what is kept for them

    def release(self, sink: int) -> None:
        """The sink's rows have been read: what no other sink still needs goes."""
        for _, df in (x for x in self._read_by if x[0] == sink):
            self.storage.release(df)
        self._read_by = [x for x in self._read_by if x[0] != sink]

    def _rooted(self) -> Batches:
        if self._source is None:
            self._source, held = self.source.batches(self.spark, self.max_batches)
            sinks = [n.index for n in self.graph.sink_nodes()]
            for df in held:
                self.storage.hold(df, max(1, len(sinks)))
                self._read_by += [(s, df) for s in sinks]
        return self._source

    def _bounded_below(self, i: int) -> bool:
        """Whether a task at or after i forms batches by rows, so that row counts matter."""
        return any(self.graph.task(j).mode.max_rows for j in self.graph._reach(i, self.graph.successors) if j != i)

    def row_local(self, i: int) -> bool:
        """Whether no batch can be told from another up to here: only column tasks and bag unions. Then rows need no ids or order."""
        t = self.graph.task(i)
        return t.body == "columns" and t.mode.kind == "passthrough" and self.max_batches is None and all(self.row_local(p) for p in self.graph.predecessors(i))

    def frame(self, i: int) -> DataFrame:
        """The rows after a task, without batches."""
        if self.row_local(i):
            return self._rows(i)
        return self.batches(i).data.drop(BATCH, POS)

    def _rows(self, i: int) -> DataFrame:
        if i not in self._plain:
            before = self.graph.predecessors(i)
            if not before:
                df = self.source.rows(self.spark)
            else:
                names = self._common(before, self._rows(before[0]).columns)
                df = self._rows(before[0]).select(*names)
                for p in before[1:]:
                    df = df.unionByName(self._rows(p).select(*names))
            self._plain[i] = self._checked(i, self._column_task(self.graph.task(i), df), df)
        return self._plain[i]

    def _common(self, before: list[int], order: list[str]) -> list[str]:
        have = ColumnSet.common([self.columns[p] for p in before])
        return [c for c in order if c in have]

    def batches(self, i: int) -> Batches:
        if i in self._nodes:
            return self._nodes[i]
        task, before = self.graph.task(i), self.graph.predecessors(i)
        branches = [self.batches(p) for p in before] or [self._rooted()]
        names = self._common(before, branches[0].columns) if before else branches[0].columns
        if task.mode.max_rows:
            formed = self.accumulated(i, branches, names)
        elif task.mode.kind == "common_origin" and len(before) > 1:
            formed = batching.common_origin(branches, names)
        else:
            formed = batching.passthrough(branches, names)
        if task.body == "columns":
            data = self._column_task(task, formed.data)
            out = Batches(data, formed.meta, formed.uniform, formed.aligned, formed.origins)
        else:
            data = self._frame_task(task, formed.data) if task.body == "frame" else self._batch_task(i, task, formed)
            readers = len(self.graph.successors(i))
            counts = self._bounded_below(i)
            if readers > 1 or counts:  # else every reader would run the function again
                sinks = [n.index for n in self.graph.sink_nodes() if n.index == i or n.index in self.graph._reach(i, self.graph.successors)]
                data = self.storage.keep(data, max(1, len(sinks)))
                self._read_by += [(s, data) for s in sinks]
            out = Batches(data, formed.meta, None, formed.aligned, formed.origins)
            out = batching.recounted(out)
        self._checked(i, out.data.drop(BATCH, POS), formed.data.drop(BATCH, POS))
        self._nodes[i] = batching.executed(out, task.name)
        return self._nodes[i]

    def accumulated(self, i: int, branches: list[Batches], names: list[str]) -> Batches:
        """What a task that accumulates rows gets: all groups, also the last."""
        return batching.max_rows(branches, names, self.graph.task(i).mode.max_rows)

    def _checked(self, i: int, df: DataFrame, before: DataFrame) -> DataFrame:
        """The frame, if it has the columns that the contracts say."""
        have = ColumnSet.of(df.schema)
        if gone := have.missing(T.StructType([T.StructField(n, t) for n, t in self.columns[i].items()])):
            raise SchemaMismatch(self.graph.task(i).name, "its own contract", gone)
        if more := sorted(set(have) - set(self.columns[i])):
            raise SchemaMismatch(self.graph.task(i).name, "its own contract", [f"{c} (not declared)" for c in more])
        return df

    def _column_task(self, task: Task, df: DataFrame) -> DataFrame:
        values = {n: batching.expression(e) for n, e in task.run.items()}
        if task.drops and set(task.drops) & set(values):
            hidden = {f"__new_{n}": v for n, v in values.items()}
            return df.withColumns(hidden).drop(*task.drops).withColumnsRenamed({f"__new_{n}": n for n in values})
        return (df.withColumns(values) if values else df).drop(*task.drops)

    def _frame_task(self, task: Task, df: DataFrame) -> DataFrame:
        out = task.run(df)
        if BATCH not in out.columns:
            raise TaskError(task.name, f"a frame task must keep {BATCH}")
        return out if POS in out.columns else out.withColumn(POS, F.lit(0).cast("long"))

    def _batch_task(self, i: int, task: Task, formed: Batches) -> DataFrame:
        fields = [f for f in formed.data.schema.fields if f.name in self.columns[i] and f.name not in {p.name for p in task.produces.fields}]
        fields = [f for f in fields if f.name not in (BATCH, POS)] + [T.StructField(n, t) for n, t in self.columns[i].items() if n not in {f.name for f in fields}]
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + [T.StructField(BATCH, T.LongType()), T.StructField(POS, T.LongType())])
        run = _wrapped(task, schema, self.times)
        data = formed.data
        if task.call_on_empty:
            # Batches without rows reach the function as a mark.
            empty = formed.meta.where("rows = 0").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in formed.data.schema.fields if f.name not in (BATCH, POS)), F.col("batch").alias(BATCH), F.lit(-1).cast("long").alias(POS))
            data = data.unionByName(empty)
        # A batch's rows come together and in order.
        return data.repartition(BATCH).sortWithinPartitions(BATCH, POS).mapInArrow(_each(run), schema, False, self.profile(task.resources) if self.profile else None)


def _each(run: Callable[[pa.Table], pa.Table], gather: int = 1 << 14):
    """run on each batch of a partition, whose rows lie together; small results go out together."""

    def go(parts):
        held: list[pa.Table] = []  # of the last batch, which may go on
        out: list[pa.Table] = []
        size = 0
        for part in parts:
            if not part.num_rows:
                continue
            key = part.column(BATCH).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(key))[0] + 1).tolist(), len(key)]
            for a, b in itertools.pairwise(cuts):
                if held and held[0].column(BATCH)[0].as_py() != key[a]:
                    out.append(run(pa.concat_tables(held)))
                    size += out[-1].num_rows + 1
                    held = []
                held.append(pa.Table.from_batches([part.slice(a, b - a)]))
            if size > gather:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, size = [], 0
        if held:
            out.append(run(pa.concat_tables(held)))
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return go


def _wrapped(task: Task, schema: T.StructType, times) -> Callable[[pa.Table], pa.Table]:
    """The task's function on one batch in order, its result checked against the contract."""
    expected = to_arrow_schema(schema)
    name, fn = task.name, task.run

    def run(table: pa.Table) -> pa.Table:
        batch = table.column(BATCH)[0].as_py()
        inside = table.filter(pa.compute.greater_equal(table.column(POS), 0)).drop_columns([BATCH, POS])
        began = time.perf_counter_ns()
        try:
            out = fn(inside)
        except Exception as e:
            raise TaskError(name, e) from e
        if times is not None:
            times.add({(name, batch): time.perf_counter_ns() - began})
        if isinstance(out, pa.RecordBatch):
            out = pa.Table.from_batches([out])
        if not isinstance(out, pa.Table):
            raise TaskError(name, f"it gave {type(out).__name__}, not a table")
        cols = []
        for f in expected:
            if f.name in (BATCH, POS):
                continue
            if f.name not in out.schema.names:
                raise TaskError(name, f"its result lacks column '{f.name}'")
            c = out.column(f.name)
            if c.type != f.type and not (pa.types.is_large_string(c.type) and pa.types.is_string(f.type)) and not pa.types.is_null(c.type):
                raise TaskError(name, f"its column '{f.name}' is {c.type}, not {f.type}")
            cols.append(c.cast(f.type))
        if more := set(out.schema.names) - {f.name for f in expected}:
            raise TaskError(name, f"its result has columns that its contract doesn't: {', '.join(sorted(more))}")
        n = out.num_rows
        return pa.Table.from_arrays([*cols, pa.array([batch] * n, pa.int64()), pa.array(range(n), pa.int64())], names=[f.name for f in expected])

    return run
