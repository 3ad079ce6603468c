"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it.

    Only where driver and executors are one process may it be unset: then a temporary folder is made. Elsewhere a
    machine-local folder would lose what other executors write, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="packetloom-"))
    return _FALLBACK[0]


def new_path(spark: SparkSession) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/packetloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back.

    For results that are read by several branches: they are computed once, the
    lineage ends here, a lost executor costs nothing but reading again, and each
    branch reads only the columns it needs.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
