"""What a stretch of work cost: totals over the stages that Spark ran meanwhile."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

MB = 1 << 20


@dataclass
class Totals:
    """Sums over stages; megabytes are 2 ** 20 bytes."""

    seconds: float = 0.0
    stages: int = 0
    tasks: int = 0
    task_seconds: float = 0.0
    shuffle_read_mb: float = 0.0
    shuffle_write_mb: float = 0.0
    memory_spilled_mb: float = 0.0
    disk_spilled_mb: float = 0.0

    def add(self, other: Totals) -> None:
        for name, value in vars(other).items():
            setattr(self, name, getattr(self, name) + value)


@dataclass
class Watch:
    """``with Watch(spark) as w: ...``, then ``w.totals``. Concurrent work of the same application counts as well."""

    spark: SparkSession
    totals: Totals = field(default_factory=Totals)

    def _stages(self) -> dict[tuple[int, int], tuple]:
        context = self.spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()  # events come later than the work they tell of
        quantiles = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.double, 0)
        found = context.statusStore().stageList(None, False, False, quantiles, None)
        out = {}
        for k in range(found.size()):
            s = found.apply(k)
            out[s.stageId(), s.attemptId()] = (s.numCompleteTasks(), s.executorRunTime(), s.shuffleReadBytes(), s.shuffleWriteBytes(), s.memoryBytesSpilled(), s.diskBytesSpilled())
        return out

    def __enter__(self) -> Watch:
        self._before = set(self._stages())
        self._began = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        t = self.totals
        t.seconds = time.perf_counter() - self._began
        for key, (tasks, run, read, write, memory, disk) in self._stages().items():
            if key not in self._before and tasks:
                t.stages += 1
                t.tasks += tasks
                t.task_seconds += run / 1000
                t.shuffle_read_mb += read / MB
                t.shuffle_write_mb += write / MB
                t.memory_spilled_mb += memory / MB
                t.disk_spilled_mb += disk / MB


def resources(spark: SparkSession) -> dict[str, object]:
    """Executors, their memory and cores, and the driver's memory, as configured."""
    context = spark.sparkContext
    conf = context.getConf()
    return {
        "executors": max(1, context._jsc.sc().getExecutorMemoryStatus().size() - 1),
        "executor_memory": conf.get("spark.executor.memory", "1g"),
        "cores": context.defaultParallelism,
        "driver_memory": conf.get("spark.driver.memory", "1g"),
    }
