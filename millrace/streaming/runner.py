"""Graphs over streams: every micro-batch is a source batch, its number the origin.

Whatever a graph with Passthrough and CommonOrigin makes of a source batch depends on that batch alone, so micro-batches are compiled
and run like batches. Before a task that accumulates up to n rows, whole batches wait in a table in the shared folder until the next one
doesn't fit: each epoch writes that table anew from the one before it, so that an epoch that runs again gives the same. finish() lets
what waits at the end go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.batching import BATCH, META, POS, Batches, max_rows, next_fit, no_steps, numbered, passthrough, ranked
from millrace.plans.compiler import Compiled
from millrace.plans.errors import GraphError
from millrace.plans.graph import PipelineGraph
from millrace.plans.storage import Storage
from millrace.sources.frames import Source


@dataclass
class FileStream:
    """Files of a folder as a stream, as many in a micro-batch as the buffer says: what a slow graph leaves unread waits in the folder."""

    path: str
    columns: T.StructType
    buffer: int = 16
    format: str = "parquet"

    def with_source_buffer(self, n: int) -> FileStream:
        if n < 1:
            raise ValueError("a source buffer holds at least one file")
        self.buffer = n
        return self

    def load(self, spark: SparkSession, **options: str) -> DataFrame:
        return spark.readStream.format(self.format).schema(self.columns).options(**options).option("maxFilesPerTrigger", self.buffer).load(self.path)


class _Epoch(Source):
    """One micro-batch as a source of one batch; without a frame, no batch."""

    def __init__(self, df: DataFrame | None, columns: T.StructType, epoch: int, order_by: list[str]):
        self.df, self.columns, self.epoch, self.order_by = df, columns, epoch, order_by

    def schema(self, spark):
        return self.columns

    def rows(self, spark):
        return spark.createDataFrame([], self.columns) if self.df is None else self.df

    def batches(self, spark, most=None):
        rows, total, held = numbered(self.rows(spark), self.order_by or [F.monotonically_increasing_id()], POS)
        data = rows.withColumn(BATCH, F.lit(self.epoch).cast("long"))
        e = F.lit(self.epoch).cast("long")
        meta = spark.range(0 if self.df is None else 1).select(e.alias("batch"), e.alias("rank"), F.lit(total).cast("long").alias("rows"), e.alias("lo"), e.alias("hi"), *no_steps())
        return Batches(data, meta, None, True), [held]


class _StreamCompiled(Compiled):
    """A graph's frames for one epoch. Groups that may still grow stay in the runner's folder."""

    def __init__(self, runner: StreamRunner, spark: SparkSession, source: _Epoch, last: bool):
        super().__init__(spark, runner.graph, source, storage=Storage("memory"))
        self.runner, self.epoch, self.last = runner, source.epoch, last

    def row_local(self, i):
        return not self.runner.batched and super().row_local(i)

    def accumulated(self, i, branches, names):
        n, spark = self.graph.task(i).mode.max_rows, self.spark
        new = passthrough(branches, names)
        at = f"{self.runner.folder}/_waiting/{i}"
        waits = self.runner.exists(f"{at}/{self.epoch - 1}/next")
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{at}/{self.epoch - 1}/{name}") if waits else spark.createDataFrame([], schema)
        data = new.data.select(*names, BATCH, POS)
        data = data.unionByName(read("data", data.schema))
        meta = ranked(new.meta.unionByName(read("meta", META)), ["lo", "batch"])
        first = (read("next", "next bigint").first() or [0])[0]
        # From where on batches wait: the first of the open group.
        open_ = None if self.last else next_fit(meta, n).agg(F.max(F.struct("group", F.struct(-F.col("rank"))))).first()[0]
        from_ = open_ and -open_[1][0]
        full = meta if open_ is None else meta.where(F.col("rank") < from_)
        of = lambda some: data.join(some.select(F.col("batch").alias("__b2")), F.col(BATCH) == F.col("__b2"), "left_semi")
        out = max_rows([Batches(of(full), full)], names, n)
        n_out = out.meta.count()
        if not self.last:
            wait = meta.where(F.col("rank") >= from_) if open_ is not None else meta.where("false")
            of(wait).write.mode("overwrite").parquet(f"{at}/{self.epoch}/data")
            wait.write.mode("overwrite").parquet(f"{at}/{self.epoch}/meta")
            spark.createDataFrame([(first + n_out,)], "next bigint").write.mode("overwrite").parquet(f"{at}/{self.epoch}/next")
            # An epoch may run again, and then needs what waited before it; older tables aren't read again.
            self.runner.remove(f"{at}/{self.epoch - 2}")
        moved = {"batch": F.col("batch") + first, "rank": F.col("rank") + first}
        return Batches(out.data.withColumn(BATCH, F.col(BATCH) + first), out.meta.withColumns(moved))


class StreamRunner:
    """Runs a graph over a stream into a folder for each sink: its columns, and epoch, the micro-batch that wrote them.

    order_by: columns that order the rows of a micro-batch, for tasks that see positions. batched: __batch and __pos are written too.
    """

    def __init__(self, spark: SparkSession, graph: PipelineGraph, folder: str, *, order_by: list[str] | None = None, batched: bool = False):
        for n in graph.nodes():
            below = graph._reach(n.index, graph.successors)
            if n.task.mode.max_rows and any(graph.task(j).mode.kind == "common_origin" and len(graph.predecessors(j)) > 1 for j in below):
                raise GraphError("over a stream, no task may wait for the common origins of groups that are still open")
        self.spark, self.graph, self.folder, self.order_by, self.batched = spark, graph, folder.rstrip("/"), order_by or [], batched

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def remove(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def path(self, sink: str) -> str:
        return f"{self.folder}/{sink}"

    def _run(self, spark: SparkSession, source: _Epoch, last: bool) -> None:
        compiled = _StreamCompiled(self, spark, source, last)
        for n in self.graph.sink_nodes():
            df = compiled.batches(n.index).data if self.batched else compiled.frame(n.index)
            df.write.mode("overwrite").parquet(f"{self.path(n.name)}/epoch={source.epoch}")
        compiled.storage.release_all()

    def start(self, stream: DataFrame, **trigger):
        self.graph.validate(stream.schema)
        run = lambda df, epoch: self._run(df.sparkSession, _Epoch(df, stream.schema, epoch, self.order_by), False)
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{self.folder}/_progress").trigger(**(trigger or {"availableNow": True})).start()

    def finish(self, epoch: int, columns: T.StructType) -> None:
        """Groups that still wait after the last epoch go, as one epoch more; run again, it's the same."""
        self._run(self.spark, _Epoch(None, columns, epoch + 1, self.order_by), True)

    def read(self, sink: str) -> DataFrame:
        return self.spark.read.parquet(self.path(sink))
