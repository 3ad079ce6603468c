"""Join helpers for a large and a small side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
SALTS = 32


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows, of at most ``size`` bytes as text (reads no more rows than that)."""
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= size


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of a large with a lookup table.

    The lookup side is broadcast only if it is counted to be small.  Otherwise
    it is repeated per salt and the large side spread over the salts, so that a
    key holding much of the large side is shared by several tasks (``salts=1``
    where no key does); both sides are then shuffled, whatever size Spark
    estimates for a file.
    """
    on = list(on)
    if how not in ("inner", "left", "left_anti", "left_semi"):
        raise ValueError(f"lookup_join does not support {how}")
    if fits(small, rows):
        return big.join(F.broadcast(small), on, how)
    if salts == 1:
        return big.join(small.hint("merge"), on, how)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if _hashable(big, c)]), F.lit(salts))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return big.withColumn("_salt", spread).join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame, column: str) -> bool:
    return "map<" not in df.schema[column].dataType.simpleString()
