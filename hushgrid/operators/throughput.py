"""Throughput and peaks of a job, gathered while it runs: its rows are never read again to be counted."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PEAKS = ("JVMHeapMemory", "JVMOffHeapMemory", "OnHeapExecutionMemory", "ProcessTreePythonRSSMemory")


@dataclass
class Meter:
    """Counts the rows of a frame in the job that writes it. Use the frame of of() in one action, then ask report()."""

    metrics: dict[str, Column] = field(default_factory=dict)
    _seen: Observation | None = None
    _start: float = 0.0

    def of(self, rows: DataFrame) -> DataFrame:
        """rows, observed; the clock starts here. An observation is of one action, so a second frame needs a second meter."""
        if self._seen is not None:
            raise ValueError("a meter observes one frame")
        clash = {"rows", "seconds", "rows_per_second"} & set(self.metrics)
        if clash:
            raise ValueError(f"names of the meter's own: {sorted(clash)}")
        self._seen = Observation()
        self._start = time.perf_counter()
        return rows.observe(self._seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in self.metrics.items()])

    def report(self) -> dict[str, object]:
        """rows, the other metrics, seconds since of(), and rows a second. Call it when the action has ended, which it waits
        for; an action that never began would be waited for without end."""
        if self._seen is None:
            raise ValueError("nothing was observed")
        found = dict(self._seen.get)
        seconds = time.perf_counter() - self._start
        return found | {"seconds": seconds, "rows_per_second": found["rows"] / seconds if seconds > 0 else 0.0}


def executor_peaks(spark: SparkSession) -> DataFrame:
    """executor, metric, bytes: the greatest values that each executor (and the driver) has reported with its heartbeats and at
    the ends of stages, a row for each; none for metrics that it doesn't report. Short jobs end before the first heartbeat:
    spark.executor.metrics.pollingInterval makes tasks report them."""
    store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    rows = []
    for place in range(store.size()):
        one = store.apply(place)
        peaks = one.peakMemoryMetrics()
        if peaks.isDefined():
            rows += [(one.id(), name, int(peaks.get().getMetricValue(name))) for name in PEAKS]
    return spark.createDataFrame(rows, "executor string, metric string, bytes long")
