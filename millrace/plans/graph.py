"""Acyclic graphs of tasks, validated against their contracts before any data is read."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T

from millrace.plans.contracts import ColumnSet
from millrace.plans.errors import GraphError
from millrace.plans.task import Task


@dataclass(frozen=True)
class Node:
    """A task's place in a graph."""

    index: int
    task: Task
    is_source: bool
    is_sink: bool

    @property
    def name(self) -> str:
        return self.task.name


class PipelineGraph:
    """Tasks by index, and edges in the order in which they were added."""

    def __init__(self):
        self._tasks: list[Task] = []
        self._edges: list[tuple[int, int]] = []

    def add_task(self, task: Task) -> int:
        if any(t.name == task.name for t in self._tasks):
            raise GraphError(f"there is a task '{task.name}' already")
        self._tasks.append(task)
        return len(self._tasks) - 1

    def add_edge(self, a: int, b: int) -> None:
        """Refuses an edge that is there already or closes a cycle; the graph then stays as it was."""
        for i in (a, b):
            if not 0 <= i < len(self._tasks):
                raise GraphError(f"there is no task {i}")
        if (a, b) in self._edges:
            raise GraphError("there is such an edge already")
        if a == b or a in self._reach(b, self.successors):
            raise GraphError("adding this edge would create a cycle")
        self._edges.append((a, b))

    def add_linear(self, tasks: Iterable[Task]) -> list[int]:
        """A chain of new tasks."""
        at = [self.add_task(t) for t in tasks]
        for a, b in zip(at, at[1:], strict=False):
            self.add_edge(a, b)
        return at

    def add_fan_out(self, a: int, tasks: Iterable[Task]) -> list[int]:
        """New tasks that each follow task a."""
        at = [self.add_task(t) for t in tasks]
        for b in at:
            self.add_edge(a, b)
        return at

    def _reach(self, start: int, step) -> dict[int, int]:
        """Hops to everything that repeated steps from start lead to."""
        hops, queue = {start: 0}, deque([start])
        while queue:
            i = queue.popleft()
            for j in step(i):
                if j not in hops:
                    hops[j] = hops[i] + 1
                    queue.append(j)
        return hops

    def task(self, i: int) -> Task:
        return self._tasks[i]

    def replace_task(self, i: int, task: Task) -> None:
        self._tasks[i] = task

    def predecessors(self, i: int) -> list[int]:
        return [a for a, b in self._edges if b == i]

    def successors(self, i: int) -> list[int]:
        return [b for a, b in self._edges if a == i]

    def out_degree(self, i: int) -> int:
        return len(self.successors(i))

    @property
    def task_count(self) -> int:
        return len(self._tasks)

    @property
    def edges(self) -> list[tuple[int, int]]:
        return list(self._edges)

    def node_indices(self) -> list[int]:
        return list(range(len(self._tasks)))

    def is_source(self, i: int) -> bool:
        return not self.predecessors(i)

    def is_sink(self, i: int) -> bool:
        return not self.successors(i)

    def source_tasks(self) -> list[int]:
        return [i for i in self.node_indices() if self.is_source(i)]

    def sink_tasks(self) -> list[int]:
        return [i for i in self.node_indices() if self.is_sink(i)]

    def node(self, i: int) -> Node:
        return Node(i, self._tasks[i], self.is_source(i), self.is_sink(i))

    def nodes(self) -> list[Node]:
        return [self.node(i) for i in self.node_indices()]

    def source_nodes(self) -> list[Node]:
        return [n for n in self.nodes() if n.is_source]

    def sink_nodes(self) -> list[Node]:
        return [n for n in self.nodes() if n.is_sink]

    def index_of(self, name: str) -> int:
        for i, t in enumerate(self._tasks):
            if t.name == name:
                return i
        raise GraphError(f"there is no task '{name}'")

    def topological(self) -> list[int]:
        """Every task after those before it, earlier added ones first."""
        left = {i: len(self.predecessors(i)) for i in self.node_indices()}
        out: list[int] = []
        while ready := [i for i, n in left.items() if n == 0]:
            out.append(ready[0])
            del left[ready[0]]
            for j in self.successors(ready[0]):
                left[j] -= 1
        if left:
            raise GraphError("graph contains a cycle")
        return out

    def rank_from_sink(self) -> dict[int, int]:
        """For each task the longest of its shortest ways to the sinks that it reaches: 0 at a sink."""
        rank = dict.fromkeys(self.node_indices(), 0)
        for s in self.sink_tasks():
            for i, hops in self._reach(s, self.predecessors).items():
                rank[i] = max(rank[i], hops)
        return rank

    def ranked_nodes(self) -> list[int]:
        rank = self.rank_from_sink()
        return sorted(self.node_indices(), key=lambda i: (rank[i], i))

    def validate(self, source: T.StructType) -> dict[int, ColumnSet]:
        """Each task's columns after it, or the first error: a cycle, no source, no sink, or a contract that isn't met."""
        order = self.topological()
        if not self.source_tasks():
            raise GraphError("graph has no source tasks")
        if not self.sink_tasks():
            raise GraphError("graph has no sink tasks")
        out: dict[int, ColumnSet] = {}
        for i in order:
            task, before = self._tasks[i], self.predecessors(i)
            have = ColumnSet.common([out[p] for p in before]) if before else ColumnSet.of(source)
            have.satisfies(task.requires, task.name)
            have.contains_all(task.drops, task.name)
            out[i] = have.apply(task.produces, task.drops)
        return out

    def summary(self) -> str:
        """Tasks with their part, batch mode and resources, edges, and tasks by rank; the layout is a fixed format."""
        ranks = self.rank_from_sink()
        role = lambda n: "SOURCE" if n.is_source else "SINK  " if n.is_sink else "      "
        lines = [f"Pipeline: {self.task_count} tasks ({len(self.source_tasks())} source, {len(self.sink_tasks())} sink), {len(self._edges)} edges", ""]
        lines += [f"  [{role(n)}] {n.name:<15} batch_mode={n.task.mode!r}  resources=(cpus={n.task.resources.cpus}, gpus={n.task.resources.gpus})" for n in self.nodes()]
        lines += ["", "Edges:", *(f"  {self._tasks[a].name} -> {self._tasks[b].name}" for a, b in sorted(self._edges, key=lambda e: e[0]))]
        lines += ["", "Sink-rank (priority ordering):", *(f"  {self._tasks[i].name:<15} rank={ranks[i]}" for i in self.ranked_nodes())]
        return "\n".join(lines) + "\n"

    def write_summary(self, to) -> None:
        to.write(self.summary())

    def print_summary(self) -> None:
        print(self.summary(), end="")

    def __repr__(self) -> str:
        return f"Pipeline({self.task_count} tasks, {len(self._edges)} edges, {len(self.source_tasks())} source, {len(self.sink_tasks())} sink)"
