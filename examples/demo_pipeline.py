"""A diamond of tasks with tracking: double -> branch_a, branch_b (three rows at a time) -> merge_sink.

python examples/demo_pipeline.py [--local | --threads N | --master URL] [--batches N] [--sleep-ms N]
"""

from __future__ import annotations

import argparse
import time

import pyarrow as pa

from millrace.functions import tables
from millrace.plans.executors import ClusterExecutor, LocalExecutor, ThreadExecutor
from millrace.plans.graph import PipelineGraph
from millrace.plans.task import MaxRows, Resources, Task
from millrace.shipping import ship
from millrace.sources.frames import RangeSource


def build(sleep_ms: int) -> PipelineGraph:
    def double(batch: pa.Table) -> pa.Table:
        time.sleep(sleep_ms / 1000)
        return tables.append_column(batch, "doubled", pa.array([2.0 * x for x in tables.column_as(batch, "id", pa.int64()).to_pylist()], pa.float64()))

    def work(batch: pa.Table) -> pa.Table:
        time.sleep(sleep_ms / 1000)
        return batch

    g = PipelineGraph()
    top = g.add_task(Task.batch("double", "id bigint", "doubled double", double))
    branches = g.add_fan_out(top, [Task.passthrough("branch_a", work), Task.passthrough("branch_b", work).with_mode(MaxRows(3)).with_resources(Resources(cpus=2))])
    sink = g.add_task(Task.passthrough("merge_sink", work))
    for b in branches:
        g.add_edge(b, sink)
    return g


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    where = p.add_mutually_exclusive_group()
    where.add_argument("--local", action="store_true")
    where.add_argument("--threads", type=int)
    where.add_argument("--master")
    p.add_argument("--batches", type=int, default=100)
    p.add_argument("--sleep-ms", type=int, default=2)
    a = p.parse_args()
    kind, session = (LocalExecutor, LocalExecutor.session()) if a.local else (ClusterExecutor, ClusterExecutor.session(a.master)) if a.master else (ThreadExecutor, ThreadExecutor.session(a.threads))
    ship(session)
    graph = build(a.sleep_ms)
    graph.print_summary()
    run = kind(session, max_batches=a.batches, timed=True).run(graph, RangeSource())
    tracker = run.tracker()
    for out in run.outputs():
        tracker.update_and_report(out)
    tracker.finish()
    tracker.print_summary()
    run.close()


if __name__ == "__main__":
    main()
