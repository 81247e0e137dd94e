"""Memory that a run takes, sampled while it lasts."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession


class Sampler:
    """Within it, the driver's heap is read every so often, and so are the peaks that executors report with their heartbeats.

    peaks() has megabytes: the driver's heap, and of all executors the largest peak of the heap, of execution memory and, where
    Spark polls it (spark.executor.processTreeMetrics.enabled), of resident memory. A short run may end before an executor's first report: then its figure is None.
    """

    METRICS = {"executor_heap_mb": ("JVMHeapMemory",), "executor_execution_mb": ("OnHeapExecutionMemory",), "executor_resident_mb": ("ProcessTreeJVMRSSMemory", "ProcessTreePythonRSSMemory")}

    def __init__(self, spark: SparkSession, every: float = 0.5):
        self.jvm, self.context, self.every = spark._jvm, spark.sparkContext._jsc.sc(), every
        self.samples, self.found = 0, {"driver_heap_mb": 0.0, **dict.fromkeys(self.METRICS)}
        self.ended = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _sample(self) -> None:
        heap = self.jvm.java.lang.Runtime.getRuntime()
        self.samples += 1
        self.found["driver_heap_mb"] = max(self.found["driver_heap_mb"], (heap.totalMemory() - heap.freeMemory()) / 2**20)
        executors = self.context.statusStore().executorList(False)
        for i in range(executors.size()):
            told = executors.apply(i).peakMemoryMetrics()
            if not told.isDefined():
                continue
            for name, parts in self.METRICS.items():
                value = sum(told.get().getMetricValue(p) for p in parts) / 2**20
                if value > 0:
                    self.found[name] = max(self.found[name] or 0.0, value)

    def _run(self) -> None:
        while not self.ended.wait(self.every):
            self._sample()

    def __enter__(self) -> Sampler:
        self._sample()
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.thread.join()
        self._sample()

    def peaks(self) -> dict:
        return {k: v if v is None else round(v, 1) for k, v in self.found.items()} | {"samples": self.samples}
