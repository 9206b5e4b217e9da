"""Where results that several tasks read are kept, and until when."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from millrace.plans.errors import StorageError

_LEVELS = {"memory": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY}


class References:
    """How many readers a key has left; keys that aren't there are left alone."""

    def __init__(self):
        self._n: dict = {}

    def insert(self, key) -> None:
        self._n[key] = 1

    def add(self, key, more: int) -> None:
        if key in self._n:
            self._n[key] += more

    def release(self, key) -> bool:
        """True when that was the last reader."""
        if key not in self._n:
            return False
        self._n[key] -= 1
        if self._n[key] == 0:
            del self._n[key]
            return True
        return False

    def __contains__(self, key) -> bool:
        return key in self._n


class Storage:
    """Keeps frames by a policy: 'memory' (spilling to disk), 'disk', or 'checkpoint' (in the folder all executors share), 'none'."""

    def __init__(self, policy: str = "memory"):
        if policy not in ("memory", "disk", "checkpoint", "none"):
            raise StorageError(f"unknown storage policy '{policy}'")
        self.policy = policy
        self._kept: dict[int, DataFrame] = {}
        self._refs = References()

    def keep(self, df: DataFrame, readers: int = 1) -> DataFrame:
        if self.policy == "none":
            return df
        if self.policy == "checkpoint":
            if df.sparkSession.sparkContext.getCheckpointDir() is None and not df.sparkSession.conf.get("spark.checkpoint.dir", None):
                raise StorageError("the checkpoint policy needs spark.checkpoint.dir")
            return df.checkpoint()
        out = df.persist(_LEVELS[self.policy])
        self.hold(out, readers)
        return out

    def hold(self, df: DataFrame, readers: int = 1) -> None:
        self._kept[id(df)] = df
        self._refs.insert(id(df))
        self._refs.add(id(df), readers - 1)

    def release(self, df: DataFrame) -> None:
        """One reader less; the frame goes with the last."""
        if self._refs.release(id(df)):
            self._kept.pop(id(df)).unpersist()

    def release_all(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()
        self._refs = References()

    @property
    def kept(self) -> int:
        return len(self._kept)
