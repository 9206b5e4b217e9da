"""Running graphs. The executors are presets over one compiler and give the same results."""

from __future__ import annotations

import re
import time
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.batching import BATCH, POS
from millrace.plans.compiler import Compiled, TimesParam, _each
from millrace.plans.graph import PipelineGraph
from millrace.plans.storage import Storage
from millrace.plans.task import Resources
from millrace.plans.tracker import Lineage, OutputBatch, PathStep, PipelineTracker
from millrace.sources.frames import Source


def resource_profile(spark: SparkSession, need: Resources) -> ResourceProfile | None:
    """What a task asks for beyond one CPU, where the cluster manager has such profiles; elsewhere a warning and None."""
    if need.cpus <= 1 and not need.gpus and not need.custom:
        return None
    if re.match(r"local($|\[)", spark.sparkContext.master):
        if need.gpus or need.custom:
            warnings.warn("resource profiles need a cluster; running without", stacklevel=2)
        return None
    ask = TaskResourceRequests().cpus(max(1, need.cpus))
    for name, n in {**({"gpu": need.gpus} if need.gpus else {}), **need.custom}.items():
        ask.resource(name, n)
    return ResourceProfileBuilder().require(ask).build


def _pack(table: pa.Table) -> pa.Table:
    rows, sink = table.drop_columns([BATCH, POS]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_table(rows)
    return pa.table({"__b2": table.column(BATCH).slice(0, 1), "__ipc": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


_each_packed = _each(_pack, 64)


class PipelineRun:
    """A compiled graph. Nothing runs until a frame, the batches or the outputs are read."""

    def __init__(self, compiled: Compiled, times):
        self.compiled, self._times = compiled, times
        self.graph, self.spark = compiled.graph, compiled.spark

    def frame(self, task: str) -> DataFrame:
        """All rows after a task."""
        return self.compiled.frame(self.graph.index_of(task))

    def batched(self, task: str) -> DataFrame:
        """All rows after a task with __batch and __pos."""
        return self.compiled.batches(self.graph.index_of(task)).data

    def batches(self, task: str) -> DataFrame:
        """A row for each batch after a task: batch, rank, rows, origins, path (task names on the longest way)."""
        meta = self.compiled.batches(self.graph.index_of(task)).meta
        return meta.select("batch", "rank", "rows", F.sequence("lo", "hi").alias("origins"), F.transform("path", lambda s: s["task"]).alias("path"))

    def sinks(self) -> list[str]:
        return [n.name for n in self.graph.sink_nodes()]

    def runs(self) -> DataFrame:
        """task, runs: how often every task runs, each execution counted once."""
        out = None
        for n in self.graph.nodes():
            one = self.compiled.batches(n.index).meta.agg(F.count(F.lit(1)).alias("runs")).select(F.lit(n.name).alias("task"), "runs")
            out = one if out is None else out.unionByName(one)
        return out

    def outputs(self) -> Iterator[OutputBatch]:
        """The sinks' batches, each as soon as its first source batch's turn comes (ties: by sink, then canonical order); empty batches too.

        Workers pack each batch as Arrow; the driver holds a partition of batches at a time. What was kept for the sinks goes at the end.
        """
        sinks, out, schemas = self.graph.sink_nodes(), None, []
        for k, node in enumerate(sinks):
            b = self.compiled.batches(node.index)
            schemas.append(to_arrow_schema(b.data.drop(BATCH, POS).schema))
            packed = b.data.repartition(BATCH).sortWithinPartitions(BATCH, POS).mapInArrow(_each_packed, "__b2 bigint, __ipc binary")
            one = b.meta.join(packed, F.col("batch") == F.col("__b2"), "left").select(F.lit(k).alias("sink"), "rank", "batch", "lo", "hi", "path", "steps", "__ipc")
            out = one if out is None else out.unionByName(one)
        began = time.perf_counter_ns()
        for m in out.orderBy("lo", "sink", "rank").toLocalIterator():
            data = schemas[m.sink].empty_table() if m["__ipc"] is None else pa.ipc.open_stream(m["__ipc"]).read_all().cast(schemas[m.sink])
            wall = time.perf_counter_ns() - began
            own = m.path[-1].exec_id if m.path else None
            steps = {s.exec_id: PathStep(s.exec_id, s.task, self._exec_ns(s.task, s.batch), wall if s.exec_id == own else 0) for s in m.steps}
            yield OutputBatch(data, sinks[m.sink].name, Lineage(tuple(range(m.lo, m.hi + 1)), tuple(steps[s.exec_id] for s in m.path), tuple(steps.values())))
            began = time.perf_counter_ns()
        for node in sinks:
            self.compiled.release(node.index)

    def release(self, task: str) -> None:
        """The sink's rows have been read: what was kept for it, and for no other sink still to be read, goes."""
        self.compiled.release(self.graph.index_of(task))

    def _exec_ns(self, task: str, batch: int) -> int:
        return self._times.value.get((task, batch), 0) if self._times is not None else 0

    def tracker(self) -> PipelineTracker:
        return PipelineTracker(n.name for n in self.graph.nodes())

    def explain(self) -> str:
        """The graph and each sink's plan."""
        parts = [self.graph.summary()]
        for s in self.sinks():
            parts.append(f"== {s} ==\n" + self.frame(s)._jdf.queryExecution().simpleString())
        return "\n".join(parts)

    def close(self) -> None:
        self.compiled.storage.release_all()


class Executor:
    """Compiles and runs graphs on a session."""

    def __init__(self, spark: SparkSession, *, max_batches: int | None = None, storage: str = "memory", timed: bool = False):
        self.spark, self.max_batches, self.storage, self.timed = spark, max_batches, storage, timed

    def with_max_batches(self, n: int):
        self.max_batches = n
        return self

    def run(self, graph: PipelineGraph, source: Source) -> PipelineRun:
        """Validates before anything is read."""
        times = self.spark.sparkContext.accumulator({}, TimesParam()) if self.timed else None
        return PipelineRun(Compiled(self.spark, graph, source, max_batches=self.max_batches, storage=Storage(self.storage), times=times, profile=lambda need: resource_profile(self.spark, need)), times)


class LocalExecutor(Executor):
    """A session of one thread; on a given session it runs as that one does."""

    @staticmethod
    def session(**conf: str) -> SparkSession:
        return _session("local[1]", conf)


class ThreadExecutor(Executor):
    """A session of as many threads as CPU slots; on a given session it runs as that one does."""

    @staticmethod
    def session(cpus: int | None = None, **conf: str) -> SparkSession:
        return _session(f"local[{max(1, cpus)}]" if cpus is not None else "local[*]", conf)


class ClusterExecutor(Executor):
    """The session's cluster; what tasks share is kept on disk. Batch tasks run with the resource profile that their Resources ask for."""

    def __init__(self, spark: SparkSession, **more):
        super().__init__(spark, **{"storage": "disk", **more})

    @staticmethod
    def session(master: str, **conf: str) -> SparkSession:
        return _session(master, conf)


def _session(master: str, conf: dict[str, str]) -> SparkSession:
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
