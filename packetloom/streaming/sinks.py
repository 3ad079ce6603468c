"""Micro-batch sinks and jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from packetloom.operators import correlate
from packetloom.operators.matching import match_packets
from packetloom.functions.alerts import persisted


def _batch_folder(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/batch={batch}"


def alert_sink(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Stored alert rows appended per micro-batch; a repeated batch replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        persisted(rows).write.mode("overwrite").parquet(_batch_folder(path, batch))

    return _start(alerts, write, checkpoint, available_now)


def match_job(
    packets: DataFrame,
    load_rules: Callable[[SparkSession], DataFrame],
    to_alerts: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Rules matched to a packet stream; every micro-batch loads the rules as they are then."""

    def write(rows: DataFrame, batch: int) -> None:
        found = match_packets(rows, load_rules(rows.sparkSession))
        to_alerts(found).write.mode("overwrite").parquet(_batch_folder(path, batch))

    return _start(packets, write, checkpoint, available_now)


def attacker_sink(marks: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Attackers kept up to date: every micro-batch writes the next version of the table."""

    def write(rows: DataFrame, batch: int) -> None:
        stored = read_attackers(rows.sparkSession, path, before=batch)
        correlate.upsert_attackers(stored, rows).write.mode("overwrite").parquet(_batch_folder(path, batch))

    return _start(marks, write, checkpoint, available_now)


def read_attackers(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Latest version of the attacker table (older than ``before``); empty if there is none."""
    schema = "src_ip string, severity string, first_seen timestamp, description string"
    try:
        versions = spark.read.schema(schema + ", batch bigint").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if before is not None:
        versions = versions.filter(F.col("batch") < before)
    # a partition value: answered from the folder names
    last = versions.agg(F.max("batch")).first()[0]
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_batch_folder(path, last))


def _start(stream: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
