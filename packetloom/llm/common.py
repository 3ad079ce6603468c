"""Small things several operators need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.materialize import materialize, new_path

__all__ = ["let", "materialize", "new_path", "read_table", "table_of", "text_batches", "u32", "unwrapped", "wrapped"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound to a variable, so that inner lambdas do not compute it once per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wrapped(documents: DataFrame) -> DataFrame:
    """All columns in one called ``row``, so that no name of theirs meets a name of ours."""
    return documents.select(F.struct("*").alias("row"))


def unwrapped(documents: DataFrame, **changed: Column) -> list[Column]:
    """The columns of a wrapped table as they were, but those named."""
    return [changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in documents.schema["row"].dataType.fieldNames()]


def text_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(first column, texts) of each Arrow batch; a null text is an empty one."""
    for batch in batches:
        yield batch.column(0), [t or "" for t in batch.column(1).to_pylist()]


def table_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def u32(values) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.asarray(values, dtype="<u4").tobytes()
