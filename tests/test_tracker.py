import io

import pyarrow as pa

from millrace.plans.tracker import Lineage, OutputBatch, PathStep, PipelineTracker

MS = 1_000_000


def out(*steps):
    return OutputBatch(pa.table({"x": [1]}), "sink", Lineage((0,), tuple(PathStep(i, t, ns * MS, ns * MS) for i, t, ns in steps)))


def test_runs_and_times_add_up():
    t = PipelineTracker(["a", "b"])
    for o in (out((1, "a", 100)), out((2, "b", 200)), out((3, "a", 50))):
        t.update(o)
    assert (t.stats("a").runs, t.stats("a").exec_ns, t.stats("b").runs, t.stats("b").exec_ns) == (2, 150 * MS, 1, 200 * MS)
    assert t.summary().sink_batches == 3


def test_an_execution_counts_once():
    t = PipelineTracker(["a"])
    t.update(out((1, "a", 10)))
    t.update(out((1, "a", 10)))
    assert t.summary().sink_batches == 2 and t.stats("a").runs == 1


def test_unknown_tasks_join_the_order():
    t = PipelineTracker(["a"])
    t.update(out((1, "a", 1), (2, "z", 1)))
    assert t.order == ["a", "z"]


def test_live_table():
    t, to = PipelineTracker(["a"]), io.StringIO()
    t.update_and_report(out((1, "a", 1)), to)
    t.update_and_report(out((2, "a", 1)), to)
    t.finish(to)
    assert "\x1b[" in to.getvalue() and "100.0%" in t.table()
    assert PipelineTracker(["a"]).table().count("0.0%") >= 2
