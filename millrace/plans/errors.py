"""What can go wrong."""

from __future__ import annotations


class PipelineError(Exception):
    """Any failure of a pipeline."""


class GraphError(PipelineError):
    """The graph isn't one that can run."""


class SchemaMismatch(PipelineError):
    """A task's contract asks for columns that what stands before it doesn't give."""

    def __init__(self, provider: str, consumer: str, missing: list[str]):
        self.provider, self.consumer, self.missing = provider, consumer, missing
        super().__init__(f"schema mismatch: {provider} doesn't give {', '.join(missing)} to {consumer}")


class CastError(PipelineError):
    """A column isn't of the type that was asked for."""


class ColumnError(PipelineError):
    """A column is missing, or there already."""


class TaskError(PipelineError):
    """A task's function failed, or gave what its contract doesn't allow."""

    def __init__(self, task: str, cause: object):
        self.task = task
        super().__init__(f"task '{task}': {cause}")


class StorageError(PipelineError):
    """An intermediate result can't be kept or found."""
