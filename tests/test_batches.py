"""Batch formation against plain Python models of its rules."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.operators.batching import BATCH, META, Batches, islands, max_rows, next_fit
from millrace.plans.errors import SchemaMismatch, StorageError, TaskError
from millrace.plans.executors import ClusterExecutor, LocalExecutor, ThreadExecutor, resource_profile
from millrace.plans.graph import PipelineGraph
from millrace.plans.storage import References, Storage
from millrace.plans.task import COMMON_ORIGIN, MaxRows, Resources, Task
from millrace.sources.frames import FrameSource, GeneratorSource, RangeSource


def chain(*tasks):
    g = PipelineGraph()
    g.add_linear(tasks)
    return g


def one_batch(spark, n):
    return FrameSource(spark.range(n), "id", max(1, n))


def sizes(run, task):
    return [r.rows for r in run.batches(task).orderBy("rank").collect()]


def fit(rows, n):
    out, held = [], 0
    for r in rows:
        if not out or held + r > n:
            out.append(0 if not out else out[-1] + 1)
            held = 0
        else:
            out.append(out[-1])
        held += r
    return out


def meta_of(spark, rows, spans=None):
    spans = spans or [(i, i) for i in range(len(rows))]
    return spark.createDataFrame([(i, i, r, a, b, [], []) for i, (r, (a, b)) in enumerate(zip(rows, spans))], META)


def test_next_fit_random(spark):
    rng = random.Random(1)
    for _ in range(8):
        rows, n = [rng.randint(0, 9) for _ in range(rng.randint(1, 40))], rng.randint(1, 15)
        got = [r.group for r in next_fit(meta_of(spark, rows), n).orderBy("rank").collect()]
        assert got == fit(rows, n), (rows, n)


def test_max_rows_places_rows_random(spark):
    rng = random.Random(2)
    for _ in range(4):
        rows, n = [rng.randint(0, 12) for _ in range(rng.randint(1, 15))], rng.randint(1, 8)
        data = spark.createDataFrame([(b * 100 + p, b, p) for b, r in enumerate(rows) for p in range(r)] or [(0, 0, 0)], f"x bigint, {BATCH} bigint, __pos bigint")
        out = max_rows([Batches(data, meta_of(spark, rows))], ["x"], n)
        groups = {}
        for b, g in enumerate(fit(rows, n)):
            groups.setdefault(g, []).extend(b * 100 + p for p in range(rows[b]))
        want = [g[i : i + n] for g in groups.values() for i in range(0, max(1, len(g)), n)]
        got = {}
        for r in out.data.where(F.col("x").isNotNull()).orderBy(BATCH, "__pos").collect():
            got.setdefault(r[BATCH], []).append(r.x)
        if any(rows):
            assert [g for _, g in sorted(got.items())] == [w for w in want if w]
        assert [r.rows for r in out.meta.orderBy("rank").collect()] == [len(w) for w in want]


def test_islands_random(spark):
    rng = random.Random(3)
    for _ in range(4):
        spans = [(s, s + rng.randint(0, 3)) for s in (rng.randint(0, 30) for _ in range(12))]
        parent = {i: i for i in range(12)}
        for _ in range(12):
            for i in range(12):
                for j in range(12):
                    if spans[i][0] <= spans[j][1] and spans[j][0] <= spans[i][1]:
                        parent[i] = parent[j] = min(parent[i], parent[j])
        got = {r.batch: r.comp for r in islands(meta_of(spark, [1] * 12, spans)).collect()}
        assert all((got[i] == got[j]) == (parent[i] == parent[j]) for i in range(12) for j in range(12))


@pytest.mark.parametrize(("source", "n", "want"), [((5, 1), 3, [3, 2]), ((10, 10), 3, [3, 3, 3, 1]), ((148, 64), 150, [148]), ((4, 2), 3, [2, 2]), ((2, 1), 5, [2]), ((6, 3), 3, [3, 3])])
def test_accumulate_split_and_flush(spark, source, n, want):
    rows, b = source
    run = LocalExecutor(spark).run(chain(Task.passthrough("a"), Task.passthrough("acc").with_mode(MaxRows(n))), FrameSource(spark.range(rows), "id", b))
    assert sizes(run, "acc") == want
    got = run.batched("acc").groupBy(BATCH).count().orderBy(BATCH).collect()
    assert [r["count"] for r in got] == want
    run.close()


def test_a_root_accumulates_too(spark):
    run = LocalExecutor(spark, max_batches=4).run(chain(Task.passthrough("acc").with_mode(MaxRows(3))), RangeSource())
    assert [o.data.column("id").to_pylist() for o in run.outputs()] == [[0, 1, 2], [3]]


def _value(batch):
    return tables.append_column(batch, "value", pa.array([i * 1.5 for i in range(batch.num_rows)], pa.float64()))


@pytest.mark.parametrize("executor", [LocalExecutor, ThreadExecutor, ClusterExecutor])
def test_linear_outputs(spark, executor):
    g = chain(Task.batch("value", None, "value double", _value))
    outs = list(executor(spark, max_batches=3).run(g, RangeSource()).outputs())
    assert [o.data.to_pydict() for o in outs] == [{"id": [i], "value": [0.0]} for i in range(3)]
    assert [o.lineage.origins for o in outs] == [(0,), (1,), (2,)]


def diamond(mode=None, b=None):
    g = PipelineGraph()
    top = g.add_task(Task.passthrough("top"))
    at = g.add_fan_out(top, [Task.columns("b", "from_b double", {"from_b": "1.0D"}), Task.columns("c", "from_c double", {"from_c": "2.0D"})])
    if b:
        g.replace_task(at[0], g.task(at[0]).with_mode(b))
    m = g.add_task(Task.passthrough("merge").with_mode(mode) if mode else Task.passthrough("merge"))
    for i in at:
        g.add_edge(i, m)
    return g


def test_diamond_is_a_bag_union(spark):
    run = LocalExecutor(spark, max_batches=1).run(diamond(), RangeSource())
    outs = list(run.outputs())
    assert len(outs) == 2 and {o.task for o in outs} == {"merge"} and outs[0].data.schema.names == ["id"]


def test_common_origin(spark):
    run = LocalExecutor(spark, max_batches=2).run(diamond(COMMON_ORIGIN), RangeSource())
    assert [(o.data.num_rows, o.lineage.origins) for o in run.outputs()] == [(2, (0,)), (2, (1,))]
    run = LocalExecutor(spark, max_batches=5).run(diamond(COMMON_ORIGIN, MaxRows(2)), RangeSource())
    assert [(o.data.num_rows, o.lineage.origins) for o in run.outputs()] == [(4, (0, 1)), (4, (2, 3)), (2, (4,))]


def test_split_batches_share_their_origins(spark):
    g = diamond(COMMON_ORIGIN, MaxRows(4))
    run = LocalExecutor(spark).run(g, one_batch(spark, 10))
    assert [r.rows for r in run.batches("b").orderBy("rank").collect()] == [4, 4, 2]
    assert [(o.data.num_rows, o.lineage.origins) for o in run.outputs()] == [(20, (0,))]


def test_mixed_fan_out(spark):
    g = PipelineGraph()
    top = g.add_task(Task.passthrough("top"))
    g.add_fan_out(top, [Task.passthrough("a"), Task.passthrough("b").with_mode(MaxRows(2))])
    run = LocalExecutor(spark).run(g, one_batch(spark, 5))
    assert (sizes(run, "a"), sizes(run, "b")) == ([5], [2, 2, 1])


def _scaled(batch, factor):
    return tables.append_column(batch, "scaled", pa.array([x * factor for x in batch.column("id").to_pylist()], pa.int64()))


def test_configuration(spark):
    g = chain(Task.batch_with_config("scale", "id bigint", "scaled bigint", _scaled, 10))
    assert {(r.id, r.scaled) for r in LocalExecutor(spark, max_batches=3).run(g, RangeSource()).frame("scale").collect()} == {(0, 0), (1, 10), (2, 20)}


def test_batches_without_rows_stay(spark):
    g = chain(Task.passthrough("none", lambda t: t.slice(0, 0)), Task.passthrough("after"))
    run = LocalExecutor(spark, max_batches=2).run(g, RangeSource())
    assert [o.data.num_rows for o in run.outputs()] == [0, 0]
    counted = Task.batch("count", None, "n bigint", lambda t: pa.table({"n": pa.array([t.num_rows], pa.int64())}), call_on_empty=True).with_drops("id")
    run = LocalExecutor(spark, max_batches=2).run(chain(Task.passthrough("none", lambda t: t.slice(0, 0)), counted), RangeSource())
    assert [r.n for r in run.frame("count").collect()] == [0, 0]


def test_failures_name_the_task(spark):
    for fn, what in ((lambda t: 1 / 0, "division"), (lambda t: t.append_column("more", pa.array([1] * t.num_rows)), "more"), (lambda t: t.drop_columns(["id"]), "lacks"), (lambda t: 5, "int")):
        with pytest.raises(Exception, match=f"(?s)task 'bad'.*{what}"):
            LocalExecutor(spark, max_batches=1).run(chain(Task.passthrough("bad", fn)), RangeSource()).frame("bad").collect()
    with pytest.raises(SchemaMismatch):
        LocalExecutor(spark, max_batches=1).run(chain(Task.columns("bad", "x int", {"x": "'text'"})), RangeSource()).frame("bad")
    with pytest.raises(TaskError):
        LocalExecutor(spark, max_batches=1).run(chain(Task.frame("bad", None, None, lambda df: df.drop(BATCH))), RangeSource()).frame("bad")


def test_sources(spark):
    two = pa.table({"x": pa.array([1, 2], pa.int64())})
    schema = spark.createDataFrame([], "x bigint").schema
    run = LocalExecutor(spark).run(chain(Task.passthrough("a")), GeneratorSource(schema, lambda: iter([two, two.slice(0, 0), two])))
    assert sizes(run, "a") == [2, 0, 2]
    assert LocalExecutor(spark).run(chain(Task.passthrough("a")), GeneratorSource(schema, lambda: iter([]))).frame("a").count() == 0
    with pytest.raises(ValueError):
        LocalExecutor(spark).run(chain(Task.passthrough("a")), RangeSource()).frame("a")
    nulls = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, k string")
    assert sizes(LocalExecutor(spark).run(chain(Task.passthrough("a")), FrameSource(nulls, "id", batch_by="k")), "a") == [2, 1]
    assert sizes(LocalExecutor(spark).run(chain(Task.passthrough("a")), FrameSource(nulls.where("false"), "id", 2)), "a") == []


def test_tracking(spark):
    run = LocalExecutor(spark, max_batches=3, timed=True).run(chain(Task.passthrough("a", lambda t: t), Task.passthrough("b", lambda t: t)), RangeSource())
    tracker = run.tracker()
    for o in run.outputs():
        tracker.update(o)
    s = tracker.summary()
    assert s.sink_batches == 3 and s.tasks["a"].runs == s.tasks["b"].runs == 3 and s.total_exec_ns > 0
    assert {(r.task, r.runs) for r in run.runs().collect()} == {("a", 3), ("b", 3)}
    assert "TASK" in tracker.table() and "TOTAL" in tracker.table()
    assert "== b ==" in run.explain()


def test_column_graphs_need_no_batches(spark):
    g = chain(Task.columns("a", "x bigint", {"x": "id + 1"}), Task.columns("b", "y bigint", {"y": "x + 1"}))
    plan = LocalExecutor(spark).run(g, FrameSource(spark.range(10), "id", 2)).frame("b")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "__batch" not in plan


def test_storage():
    refs = References()
    refs.insert("k")
    refs.add("k", 1)
    refs.add("other", 5)
    assert not refs.release("other") and not refs.release("k") and "k" in refs and refs.release("k") and "k" not in refs
    with pytest.raises(StorageError):
        Storage("tape")


@pytest.mark.parametrize("policy", ["memory", "disk", "checkpoint", "none"])
def test_storage_policies_agree(spark, policy):
    g = PipelineGraph()
    top = g.add_task(Task.passthrough("top", lambda t: t))
    g.add_fan_out(top, [Task.passthrough("x"), Task.passthrough("y").with_mode(MaxRows(3))])
    run = LocalExecutor(spark, storage=policy).run(g, FrameSource(spark.range(10), "id", 2))
    assert sizes(run, "x") == [2] * 5 and sizes(run, "y") == [2] * 5
    assert run.frame("y").count() == 10
    run.close()
    assert run.compiled.storage.kept == 0


def test_resource_profiles_need_a_cluster(spark):
    with pytest.warns(UserWarning):
        assert resource_profile(spark, Resources(gpus=1)) is None


CLASHING = ("comp", "brank", "group", "first", "offset", "b2", "s2", "rank", "rows", "lo", "hi", "path", "batch", "steps", "place", "part")


@pytest.mark.parametrize(("mode", "b"), [(COMMON_ORIGIN, None), (COMMON_ORIGIN, MaxRows(2)), (MaxRows(3), None), (MaxRows(3), MaxRows(4)), (None, None)])
def test_columns_may_have_any_name(spark, mode, b):
    df = spark.range(5).selectExpr("id", *(f"id * 100 + {k} as `{c}`" for k, c in enumerate(CLASHING)))
    run = LocalExecutor(spark).run(diamond(mode, b), FrameSource(df, "id", 1))
    want = sorted([i, *(i * 100 + k for k in range(len(CLASHING)))] for i in range(5) for _ in range(2))
    assert sorted(list(r) for r in run.frame("merge").select("id", *CLASHING).collect()) == want
    outs = [dict(zip(o.data.schema.names, c, strict=True)) for o in run.outputs() for c in zip(*(x.to_pylist() for x in o.data.columns), strict=True)]
    assert sorted([r["id"], *(r[c] for c in CLASHING)] for r in outs) == want


def test_the_engine_keeps_its_own_names(spark):
    with pytest.raises(SchemaMismatch, match="__pos"):
        LocalExecutor(spark).run(chain(Task.passthrough("a")), FrameSource(spark.range(2).selectExpr("id", "id as __pos"), "id"))
    with pytest.raises(SchemaMismatch, match="__x"):
        LocalExecutor(spark).run(chain(Task.columns("a", "__x bigint", {"__x": "id"})), RangeSource(3))


def test_blocks_carry_ranks_and_sums(spark, monkeypatch):
    # With blocks of three, every prefix scan crosses many of them.
    monkeypatch.setattr("millrace.operators.batching.BLOCK", 3)
    test_max_rows_places_rows_random(spark)
    test_islands_random(spark)
    run = LocalExecutor(spark, max_batches=11).run(diamond(None), RangeSource())
    assert [(r["rank"], r.origins) for r in run.batches("merge").orderBy("rank").collect()] == [(i, [i // 2]) for i in range(22)]


def test_no_task_orders_all_batches(spark, monkeypatch):
    """Windows without a key only see a row for each block."""
    monkeypatch.setattr("millrace.operators.batching.BLOCK", 3)
    for g in (diamond(None), diamond(COMMON_ORIGIN, MaxRows(4))):
        run = LocalExecutor(spark).run(g, FrameSource(spark.range(20), "id", 2))
        plan = run.compiled.batches(3).meta._jdf.queryExecution().analyzed().toString()
        assert set(re.findall(r"windowspecdefinition\(0, (\w+)#", plan)) == {"__b"}


def test_sinks_take_turns(spark):
    g = PipelineGraph()
    top = g.add_task(Task.passthrough("top"))
    g.add_fan_out(top, [Task.passthrough("a"), Task.passthrough("b").with_mode(MaxRows(2))])
    run = LocalExecutor(spark, max_batches=4).run(g, RangeSource())
    assert [(o.task, o.lineage.origins) for o in run.outputs()] == [("a", (0,)), ("b", (0, 1)), ("a", (1,)), ("a", (2,)), ("b", (2, 3)), ("a", (3,))]


def test_what_is_kept_goes_with_its_last_sink(spark):
    g = PipelineGraph()
    top = g.add_task(Task.passthrough("top", lambda t: t))
    g.add_fan_out(top, [Task.passthrough("x"), Task.passthrough("y")])
    run = LocalExecutor(spark).run(g, FrameSource(spark.range(10), "id", 2))
    assert run.frame("x").count() == run.frame("y").count() == 10
    kept = run.compiled.storage.kept
    run.release("x")
    assert run.compiled.storage.kept == kept > 0
    run.release("y")
    assert run.compiled.storage.kept == 0
    run = LocalExecutor(spark).run(g, FrameSource(spark.range(10), "id", 2))
    assert len(list(run.outputs())) == 10 and run.compiled.storage.kept == 0


def test_a_tracker_counts_the_ways_that_merge(spark):
    run = LocalExecutor(spark, max_batches=4, timed=True).run(diamond(COMMON_ORIGIN), RangeSource())
    tracker = run.tracker()
    for o in run.outputs():
        tracker.update(o)
        assert [s.task for s in o.lineage.path] == ["top", "b", "merge"]
    assert {t: s.runs for t, s in tracker.summary().tasks.items()} == {"top": 4, "b": 4, "c": 4, "merge": 4}


def test_each_step_has_its_own_time(spark):
    def slow(t):
        import time

        time.sleep(0.2 if t.column("id")[0].as_py() == 1 else 0)
        return t

    run = LocalExecutor(spark, max_batches=3, timed=True).run(chain(Task.passthrough("a", slow), Task.passthrough("b")), RangeSource())
    times = [o.lineage.path[0].exec_ns for o in run.outputs()]
    assert times[1] > 2e8 > max(times[0], times[2])


def test_resources_reach_the_stage(tmp_path):
    """On a cluster, a task that asks for two CPUs runs with a profile that says so."""
    import os
    import subprocess
    import sys

    code = """
import sys
from pyspark.sql import SparkSession
from pyspark import TaskContext
import pyarrow as pa
from millrace.shipping import ship
from millrace.plans.executors import ClusterExecutor
from millrace.plans.graph import PipelineGraph
from millrace.plans.task import Resources, Task
from millrace.sources.frames import FrameSource
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
ship(spark)
def cpus(t):
    return t.append_column("cpus", pa.array([TaskContext.get().cpus()] * t.num_rows, pa.int64()))
g = PipelineGraph()
g.add_linear([Task.batch("c", None, "cpus bigint", cpus).with_resources(Resources(cpus=2))])
print("CPUS", {r.cpus for r in ClusterExecutor(spark).run(g, FrameSource(spark.range(4), "id", 2)).frame("c").collect()})
spark.stop()
"""
    import pyspark

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": os.path.dirname(pyspark.__file__), "SPARK_WORKER_DIR": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180, cwd=tmp_path)
    assert "CPUS {2}" in out.stdout, out.stdout + out.stderr[-2000:]
