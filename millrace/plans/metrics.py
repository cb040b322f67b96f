"""Counters, gauges and histograms, filled by rows as they pass."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Metrics:
    """Named values; ``observe`` adds values of a frame once an action has run over it."""

    values: dict[str, float] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    _watched: list[Observation] = field(default_factory=list)
    _began: float | None = None
    _ended: float | None = None

    def count(self, name: str, by: int = 1, description: str = "") -> None:
        self.values[name] = self.values.get(name, 0) + by
        self.descriptions.setdefault(name, description)

    def gauge(self, name: str, value: float, description: str = "") -> None:
        self.values[name] = value
        self.descriptions.setdefault(name, description)

    def observe(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        seen = Observation()
        self._watched.append(seen)
        return df.observe(seen, *(a.alias(n) for n, a in aggregates.items()))

    def histogram(self, df: DataFrame, name: str, column: str, percentiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
        """Count, sum, mean, min, max and percentiles of a column as rows pass."""
        c = F.col(column)
        return self.observe(df, **{
            f"{name}.count": F.count(c), f"{name}.sum": F.sum(c), f"{name}.mean": F.avg(c), f"{name}.min": F.min(c), f"{name}.max": F.max(c),
            **{f"{name}.p{round(100 * p)}": F.percentile_approx(c, F.lit(p)) for p in percentiles},
        })

    def start(self) -> None:
        self._began, self._ended = time.monotonic(), None

    def stop(self) -> None:
        self._ended = time.monotonic()

    def elapsed(self) -> float | None:
        return None if self._began is None else (self._ended or time.monotonic()) - self._began

    def collect(self) -> dict[str, float]:
        """All values; waits for actions over observed frames."""
        for seen in self._watched:
            self.values |= seen.get
        self._watched.clear()
        return dict(self.values) | ({} if self._began is None else {"elapsed_s": self.elapsed()})

    def to_json(self) -> str:
        return json.dumps(self.collect(), sort_keys=True, default=str)

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_json())
