"""Counters observed while a job runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows unchanged and an observation holding their number once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def throughput(df: DataFrame) -> dict:
    """Rows, seconds and rows per second of reading a table once."""
    rows, seen = counted(df, "throughput")
    began = time.monotonic()
    rows.write.format("noop").mode("overwrite").save()
    seconds = time.monotonic() - began
    n = seen.get["rows"]
    return {"rows": n, "seconds": seconds, "per_second": n / seconds if seconds else 0.0}
