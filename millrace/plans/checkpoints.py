"""Named checkpoints that a rerun picks up: the data of a step, in the shared folder, under the step's name and version.

A changed plan under an old name and version is not noticed: change the version with it."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.staging import shared_root


@dataclass(frozen=True)
class Policy:
    """When a step is saved: after every ``every``-th step, or if ``seconds`` have passed since the last save (either may be off)."""

    every: int | None = 1
    seconds: float | None = None
    keep: int = 10


class Checkpoints:
    """Runs named steps and saves or restores their data."""

    def __init__(self, spark: SparkSession, job: str, policy: Policy = Policy(), root: str | None = None):
        self.spark, self.policy = spark, policy
        self.root = f"{(root or shared_root(spark)).rstrip('/')}/checkpoints-{job}"
        self._steps, self._last = 0, time.monotonic()
        self.log: list[tuple[str, str]] = []

    def _fs(self, path: str) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def step(self, name: str, make: Callable[[], DataFrame], version: str = "") -> DataFrame:
        """The saved data of the step, if it was finished under the same name and version; else ``make()``, saved as the policy says."""
        tag = hashlib.sha256(json.dumps([name, version]).encode()).hexdigest()[:16]
        path = f"{self.root}/{tag}"
        fs, done = self._fs(f"{path}/_SUCCESS")
        if fs.exists(done):
            self.log.append((name, "restored"))
            return self.spark.read.parquet(path)
        df = make()
        self._steps += 1
        due = self.policy.every is not None and self._steps % self.policy.every == 0
        due |= self.policy.seconds is not None and time.monotonic() - self._last >= self.policy.seconds
        if not due:
            self.log.append((name, "made"))
            return df
        df.write.mode("overwrite").parquet(path)
        self._last = time.monotonic()
        self.log.append((name, "saved"))
        self.cleanup()
        return self.spark.read.schema(df.schema).parquet(path)

    def cleanup(self) -> None:
        """Keeps the newest saves; a frame read from one that went can't be used any more, so keep enough."""
        fs, root = self._fs(self.root)
        found = sorted(fs.listStatus(root), key=lambda x: x.getModificationTime()) if fs.exists(root) else []
        for x in found[: max(0, len(found) - self.policy.keep)]:
            fs.delete(x.getPath(), True)

    def clear(self) -> None:
        fs, root = self._fs(self.root)
        fs.delete(root, True)
