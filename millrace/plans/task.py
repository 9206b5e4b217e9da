"""Tasks: named steps with a column contract, a way to form batches and one of three bodies."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from millrace.plans.contracts import schema_of
from millrace.plans.errors import GraphError


@dataclass(frozen=True)
class Resources:
    """What one run of a task needs; honoured where the cluster manager knows resource profiles."""

    cpus: int = 0
    gpus: int = 0
    custom: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class BatchMode:
    """How batches are formed before a task: each as it comes, up to a number of rows, or all branches of common origins."""

    kind: str
    rows: int | None = None

    def __post_init__(self):
        if self.kind == "max_rows" and (self.rows is None or self.rows < 1):
            raise ValueError(f"MaxRows({self.rows}) is invalid: batch size must be >= 1")

    @property
    def max_rows(self) -> int | None:
        return self.rows if self.kind == "max_rows" else None

    def __repr__(self) -> str:
        return {"passthrough": "Passthrough", "common_origin": "CommonOrigin"}.get(self.kind, f"MaxRows({self.rows})")


PASSTHROUGH = BatchMode("passthrough")
COMMON_ORIGIN = BatchMode("common_origin")


def MaxRows(n: int) -> BatchMode:  # noqa: N802
    return BatchMode("max_rows", n)


@dataclass(frozen=True)
class Task:
    """A node's program.

    body 'columns': exprs by name, row-local, seen whole by the optimizer. body 'batch': a function from a pyarrow.Table (one batch, in
    order) to one. body 'frame': a function from a DataFrame with the column __batch to one that keeps it.
    """

    name: str
    body: str
    run: Any
    requires: T.StructType = field(default_factory=lambda: T.StructType([]))
    produces: T.StructType = field(default_factory=lambda: T.StructType([]))
    drops: tuple[str, ...] = ()
    mode: BatchMode = PASSTHROUGH
    resources: Resources = field(default_factory=lambda: Resources(cpus=1))
    call_on_empty: bool = False

    @staticmethod
    def columns(name: str, produces=None, exprs: Mapping[str, Any] | None = None, requires=None, **more) -> Task:
        """A row-local task: each produced column by a Column or SQL text."""
        return Task(name, "columns", dict(exprs or {}), schema_of(requires), schema_of(produces), **more)

    @staticmethod
    def batch(name: str, requires, produces, fn: Callable, **more) -> Task:
        return Task(name, "batch", fn, schema_of(requires), schema_of(produces), **more)

    @staticmethod
    def batch_with_config(name: str, requires, produces, fn: Callable, config: Any, **more) -> Task:
        """fn gets the batch and the configuration, which travels with the task."""
        return Task.batch(name, requires, produces, functools.partial(_configured, fn, config), **more)

    @staticmethod
    def frame(name: str, requires, produces, fn: Callable, **more) -> Task:
        return Task(name, "frame", fn, schema_of(requires), schema_of(produces), **more)

    @staticmethod
    def passthrough(name: str, fn: Callable | None = None, **more) -> Task:
        """A task with an empty contract: without a function, its rows as they are; else what the function makes of a batch."""
        return Task.columns(name, **more) if fn is None else Task.batch(name, None, None, fn, **more)

    def with_drops(self, *names: str) -> Task:
        return dataclasses.replace(self, drops=tuple(names))

    def with_mode(self, mode: BatchMode) -> Task:
        return dataclasses.replace(self, mode=mode)

    def with_batch_size(self, n: int) -> Task:
        return self.with_mode(MaxRows(n))

    def with_resources(self, resources: Resources) -> Task:
        return dataclasses.replace(self, resources=resources)


def _configured(fn: Callable, config: Any, table):
    return fn(table, config)


class TaskRegistry:
    """Tasks by name; of tasks of one name the last counts."""

    def __init__(self, graph=None):
        self._tasks: dict[str, Task] = {}
        if graph is not None:
            self.register_graph(graph)

    def register(self, task: Task) -> None:
        self._tasks[task.name] = task

    def register_graph(self, graph) -> None:
        for node in graph.nodes():
            self.register(node.task)

    def build(self, name: str) -> Task:
        if name not in self._tasks:
            raise GraphError(f"task '{name}' not found in registry")
        return self._tasks[name]

    def task_names(self) -> list[str]:
        return list(self._tasks)
