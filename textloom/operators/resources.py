"""What a step costs on this machine: wall and CPU seconds, peak memory, latency by row."""

from __future__ import annotations

import resource
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def measured(step: Callable[[], object], repeats: int = 3) -> dict[str, float]:
    """Median wall and CPU seconds of the driver process over repeats, and its peak memory in MB."""
    wall, cpu = [], []
    for _ in range(max(1, repeats)):
        began, used = time.perf_counter(), time.process_time()
        step()
        wall.append(time.perf_counter() - began)
        cpu.append(time.process_time() - used)
    return {"wall_s": statistics.median(wall), "cpu_s": statistics.median(cpu), "peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024}


def run_to_end(df: DataFrame) -> None:
    """Computes every row and column, and keeps none."""
    df.write.format("noop").mode("overwrite").save()


def throughput(df: DataFrame, rows: int, repeats: int = 3) -> dict[str, float]:
    """measured(), with rows a second and milliseconds a row of the batch."""
    out = measured(lambda: run_to_end(df), repeats)
    return out | {"rows_per_s": rows / out["wall_s"], "ms_per_row": 1000 * out["wall_s"] / max(1, rows)}
