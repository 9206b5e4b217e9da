"""Lineage of output batches, and statistics over it."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa


@dataclass(frozen=True)
class PathStep:
    """One execution of a task on a batch."""

    exec_id: int
    task: str
    exec_ns: int = 0
    wall_ns: int = 0


@dataclass(frozen=True)
class Lineage:
    """The source batches that an output stems from, the longest way of executions to it, and all executions that it stems from."""

    origins: tuple[int, ...]
    path: tuple[PathStep, ...]
    steps: tuple[PathStep, ...] = ()


@dataclass(frozen=True)
class OutputBatch:
    data: pa.Table
    task: str
    lineage: Lineage


@dataclass
class TaskStats:
    runs: int = 0
    exec_ns: int = 0
    wall_ns: int = 0


@dataclass(frozen=True)
class Summary:
    elapsed_s: float
    sink_batches: int
    total_exec_ns: int
    total_wall_ns: int
    parallelism: float
    tasks: dict[str, TaskStats] = field(default_factory=dict)


def _share(part: int, total: int) -> float:
    return 100.0 * part / total if total else 0.0


def _ms(ns: int) -> str:
    return f"{ns / 1e6:.1f}ms"


class PipelineTracker:
    """Adds up executions over output batches; one that several outputs share counts once."""

    def __init__(self, tasks: Iterable[str] = ()):
        self.order = list(tasks)
        self._stats: dict[str, TaskStats] = {}
        self._seen: set[int] = set()
        self._sinks, self._began, self._lines = 0, time.monotonic(), 0

    def update(self, output: OutputBatch) -> None:
        self._sinks += 1
        for step in output.lineage.steps or output.lineage.path:
            if step.exec_id in self._seen:
                continue
            self._seen.add(step.exec_id)
            if step.task not in self.order:
                self.order.append(step.task)
            s = self._stats.setdefault(step.task, TaskStats())
            s.runs, s.exec_ns, s.wall_ns = s.runs + 1, s.exec_ns + step.exec_ns, s.wall_ns + step.wall_ns

    def update_and_report(self, output: OutputBatch, to=None) -> None:
        """Also redraws the table in place."""
        to = to or sys.stderr
        self.update(output)
        if self._lines:
            to.write(f"\x1b[{self._lines}A")
        lines = self.table().splitlines()
        to.write("".join(f"\x1b[2K{x}\n" for x in lines))
        to.flush()
        self._lines = len(lines)

    def finish(self, to=None) -> None:
        """Clears what was drawn."""
        to = to or sys.stderr
        if self._lines:
            to.write(f"\x1b[{self._lines}A" + "\x1b[2K\n" * self._lines + f"\x1b[{self._lines}A")
            self._lines = 0

    def stats(self, task: str) -> TaskStats:
        return self._stats.get(task, TaskStats())

    def summary(self) -> Summary:
        spent, total = time.monotonic() - self._began, sum(s.exec_ns for s in self._stats.values())
        return Summary(spent, self._sinks, total, sum(s.wall_ns for s in self._stats.values()), total / 1e9 / spent if spent else 0.0, {t: self.stats(t) for t in self.order})

    def table(self) -> str:
        """The statistics as text; the layout is a fixed format."""
        s = self.summary()
        out = [f"  elapsed: {s.elapsed_s:.1f}s  sink batches: {s.sink_batches}  total exec: {_ms(s.total_exec_ns)}  parallelism: {s.parallelism:.1f}x"]
        out += [f"  {'TASK':<15} {'RUNS':>6} {'EXEC':>12} {'% EXEC':>8} {'WALL':>12} {'% WALL':>8}", "  " + "-" * 66]
        for name, t in s.tasks.items():
            out.append(f"  {name:<15} {t.runs:>6} {_ms(t.exec_ns):>12} {_share(t.exec_ns, s.total_exec_ns):>7.1f}% {_ms(t.wall_ns):>12} {_share(t.wall_ns, s.total_wall_ns):>7.1f}%")
        out += ["  " + "-" * 66, f"  {'TOTAL':<15} {'':>6} {_ms(s.total_exec_ns):>12} {'100.0%':>8} {_ms(s.total_wall_ns):>12}"]
        return "\n".join(out) + "\n"

    def print_summary(self) -> None:
        print(self.table(), end="")
