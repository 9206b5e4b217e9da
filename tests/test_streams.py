import pytest
from pyspark.sql import functions as F

from millrace.plans.errors import GraphError
from millrace.plans.graph import PipelineGraph
from millrace.plans.task import COMMON_ORIGIN, MaxRows, Task
from millrace.sources.frames import endless_stream
from millrace.streaming.runner import FileStream, StreamRunner


def files(spark, folder, groups):
    for i, ids in enumerate(groups):
        spark.createDataFrame([(x,) for x in ids], "id bigint").coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03d}")
    return spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_common_origin_over_a_stream(spark, tmp_path):
    g = PipelineGraph()
    top = g.add_task(Task.passthrough("top"))
    b, c = g.add_fan_out(top, [Task.columns(n, f"{n} int", {n: "1"}) for n in "bc"])
    m = g.add_task(Task.frame("merge", None, "n bigint", lambda df: df.groupBy("__batch").agg(F.count(F.lit(1)).alias("n")), mode=COMMON_ORIGIN).with_drops("id"))
    g.add_edge(b, m)
    g.add_edge(c, m)
    r = StreamRunner(spark, g, str(tmp_path / "out"), order_by=["id"])
    r.start(files(spark, tmp_path, [[1, 2, 3], [4]])).awaitTermination()
    assert sorted(x.n for x in r.read("merge").collect()) == [2, 6]


def test_groups_that_may_grow_can_t_be_waited_for(spark, tmp_path):
    g = PipelineGraph()
    top = g.add_task(Task.passthrough("top").with_mode(MaxRows(2)))
    at = g.add_fan_out(top, [Task.passthrough("a"), Task.passthrough("b")])
    m = g.add_task(Task.passthrough("m").with_mode(COMMON_ORIGIN))
    for i in at:
        g.add_edge(i, m)
    with pytest.raises(GraphError):
        StreamRunner(spark, g, str(tmp_path))


def grouped(run, sink):
    got = {}
    for r in run.read(sink).orderBy("__batch", "__pos").collect():
        got.setdefault(r["__batch"], []).append(r.id)
    return got


def test_accumulation_keeps_batches_whole(spark, tmp_path):
    g = PipelineGraph()
    g.add_linear([Task.passthrough("acc").with_mode(MaxRows(4)), Task.columns("twice", "twice bigint", {"twice": "id * 2"})])
    r = StreamRunner(spark, g, str(tmp_path / "acc"), order_by=["id"], batched=True)
    stream = files(spark, tmp_path, [[1, 2, 3], [4, 5, 6], [7], list(range(8, 18)), [18]])
    r.start(stream).awaitTermination()
    r.finish(4, stream.schema)
    r.finish(4, stream.schema)
    assert grouped(r, "twice") == {0: [1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9, 10, 11], 3: [12, 13, 14, 15], 4: [16, 17], 5: [18]}
    assert all(x.twice == 2 * x.id for x in r.read("twice").collect())
    # What waited before the last epochs is gone.
    assert len(list((tmp_path / "acc/_waiting/0").iterdir())) == 2


def test_accumulation_after_accumulation_and_beside_a_branch(spark, tmp_path):
    g = PipelineGraph()
    top = g.add_task(Task.passthrough("top"))
    g.add_fan_out(top, [Task.passthrough("side")])
    two = g.add_task(Task.passthrough("two").with_mode(MaxRows(2)))
    four = g.add_task(Task.passthrough("four").with_mode(MaxRows(4)))
    g.add_edge(top, two)
    g.add_edge(two, four)
    r = StreamRunner(spark, g, str(tmp_path / "out"), order_by=["id"], batched=True)
    stream = files(spark, tmp_path, [[1], [2], [3, 4], [5]])
    r.start(stream).awaitTermination()
    r.finish(3, stream.schema)
    assert grouped(r, "four") == {0: [1, 2, 3, 4], 1: [5]}
    assert sorted(x.id for x in r.read("side").collect()) == [1, 2, 3, 4, 5]


def test_a_source_buffer_bounds_a_micro_batch(spark, tmp_path):
    spark.range(40).repartition(5).write.parquet(str(tmp_path / "in"))
    sizes = []
    source = FileStream(str(tmp_path / "in"), spark.range(1).schema).with_source_buffer(2)
    q = source.load(spark).writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sizes == [16, 16, 8]
    with pytest.raises(ValueError):
        source.with_source_buffer(0)


def test_endless_stream(spark, tmp_path):
    q = endless_stream(spark, 2).writeStream.format("memory").queryName("gen").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(60):
        if spark.table("gen").count() >= 4:
            break
        q.awaitTermination(0.5)
    q.stop()
    ids = [r.id for r in spark.table("gen").orderBy("id").collect()]
    assert ids == list(range(len(ids))) and len(ids) >= 4
