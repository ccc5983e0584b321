"""Operational metrics: counters that ride along with a job, and how long stages took."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Metrics:
    """Counters by name and durations by stage, as rows.

    Counters of a frame are taken while it is computed for its own sake (``DataFrame.observe``), so no pass is added; they are
    there once an action on the frame has ended.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._seen: list[Observation] = []
        self._counts: dict[str, int] = defaultdict(int)
        self._times: dict[str, list[float]] = defaultdict(list)

    def counting(self, rows: DataFrame, /, **counters: Column) -> DataFrame:
        """``rows``, whose aggregates ``counters`` are added up under their names as an action reads them. A name's dots are written as ``__``."""
        seen = Observation()
        self._seen.append(seen)
        return rows.observe(seen, *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(name) for name, c in counters.items()])

    def add(self, name: str, n: int = 1) -> None:
        self._counts[name] += n

    @contextmanager
    def timed(self, stage: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.took(stage, time.monotonic() - began)

    def took(self, stage: str, seconds: float) -> None:
        self._times[stage].append(seconds)

    def counters(self) -> dict[str, int]:
        for seen in self._seen:
            for name, n in seen.get.items():
                self._counts[name.replace("__", ".")] += n
        self._seen = []
        return dict(self._counts)

    def report(self) -> DataFrame:
        """name, kind, count, total_ms, mean_ms: a row for each counter and each stage."""
        rows = [(name, "counter", n, None, None) for name, n in self.counters().items()]
        rows += [(name, "duration", len(t), round(sum(t) * 1000, 3), round(sum(t) / len(t) * 1000, 3)) for name, t in self._times.items()]
        return self.spark.createDataFrame(rows, "name string, kind string, count long, total_ms double, mean_ms double")
