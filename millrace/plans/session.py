"""Session settings: adaptive execution, partition sizes, memory and spill."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Memory:
    """How executors divide memory and where they spill; Spark spills sorts, aggregates and joins by itself."""

    fraction: float = 0.6
    storage_fraction: float = 0.3
    local_dirs: str | None = None
    compress_spill: bool = True

    def settings(self) -> dict[str, str]:
        own = {"spark.memory.fraction": str(self.fraction), "spark.memory.storageFraction": str(self.storage_fraction), "spark.shuffle.spill.compress": str(self.compress_spill).lower()}
        return own | ({"spark.local.dir": self.local_dirs} if self.local_dirs else {})


def session(app: str, master: str | None = None, memory: Memory = Memory(), **settings: str) -> SparkSession:
    """A session for batch jobs; ``settings`` with underscores for dots come last."""
    values = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **memory.settings(), **{k.replace("_", "."): v for k, v in settings.items()},
    }
    builder = SparkSession.builder.appName(app).config(map=values)
    return (builder.master(master) if master else builder).getOrCreate()


def partitions_for(input_bytes: int, cores: int, target: int = 128 << 20) -> int:
    """Shuffle partitions so that each holds about ``target`` bytes: a multiple of the cores, at least one wave."""
    return max(1, cores) * max(1, math.ceil(input_bytes / target / max(1, cores)))


def tune(df: DataFrame, cores: int | None = None) -> int:
    """Sets the session's shuffle partitions by the optimiser's estimate of a frame's size; adaptive execution joins small ones."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = partitions_for(min(size, 1 << 50), cores or spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n


def coders(df: DataFrame) -> dict[str, str]:
    """How each column is encoded between operators: its Catalyst type."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}
