"""Reading and writing: rules, rule texts, alerts, packet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.alerts import persisted
from packetloom.operators.rule_table import decode_patterns
from packetloom.schemas import PACKETS


def read_rule_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of rule files (``line``), without blank lines and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_rules(spark: SparkSession, path: str, list_form: bool = False, fmt: str = "parquet", **options) -> DataFrame:
    """Stored rules ordered by id, pattern texts decoded to lists (any Spark format, also jdbc)."""
    stored = spark.read.format(fmt).options(**options).load(path) if path else spark.read.format(fmt).options(**options).load()
    kind = F.col("pattern_type") if list_form else None
    return stored.withColumn("pattern", decode_patterns(F.col("pattern"), kind)).orderBy("rule_id")


JSON_RULE = "name string, patterns array<string>, severity string, description string, category string, protocol string"


def read_json_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON files holding arrays of objects; objects without name, patterns or severity are dropped."""
    return usable_json_rules(spark.read.schema(JSON_RULE).option("multiLine", True).json(path))


def usable_json_rules(raw: DataFrame) -> DataFrame:
    kept = raw.filter("name is not null and patterns is not null and severity is not null")
    word = F.lower(F.trim("severity"))
    priority = F.coalesce(
        word.try_cast("int"), F.when(word == "high", 1).when(word == "medium", 2).otherwise(3)
    )
    return kept.select(
        F.concat(F.lit("json_"), F.substring(F.sha1(F.concat_ws("|", "name", F.array_join("patterns", "|"))), 1, 16)).alias("rule_id"),
        "name",
        F.col("patterns").alias("pattern"),
        priority.alias("priority"),
        *[c for c in raw.columns if c not in ("name", "patterns", "severity")],
    )


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet rows of a parquet folder."""
    return spark.read.schema(PACKETS).parquet(path)


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Packet rows as a stream over a growing folder; packets without an IP protocol are left out."""
    source = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return source.filter(F.col("proto").isNotNull())


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append cleaned alert rows, one folder per day so that range reads prune."""
    rows = persisted(alerts).withColumn("day", F.to_date("created_at"))
    rows.repartition("day", F.pmod(F.xxhash64("src_ip"), F.lit(16))).sortWithinPartitions("src_ip").write.mode(
        "append"
    ).partitionBy("day").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(alerts: DataFrame, path: str) -> None:
    """Alert list as CSV with a header, quotes doubled."""
    alerts.select(
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.col("src_ip").alias("src"),
        F.col("dst_ip").alias("dst"),
        F.col("rule_id").alias("rule"),
        F.col("effective_severity").alias("severity"),
        F.col("match_text").alias("message"),
        F.col("payload_preview").alias("summary"),
    ).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
