"""Alert dedupe and deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.windows import silence


def fingerprint() -> Column:
    """What makes two alerts the same: rule, hosts, matched text and preview."""
    parts = ("match_rule", "src_ip", "dst_ip", "match_text", "payload_preview")
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in parts])


def dedupe_alerts(alerts: DataFrame, seconds: float = 10, order: Sequence[str] = ("packet_no",), derived: bool = False) -> DataFrame:
    """Alerts whose fingerprint was not emitted in the last ``seconds`` (inclusive)."""
    return silence(alerts, [fingerprint()], "ts", seconds, True, order, derived)


def dedupe_modes(hits: DataFrame, seconds: float = 2, order: Sequence[str] = ("packet_no",), derived: bool = False) -> DataFrame:
    """One hit per rule and connection within ``seconds``, whether found per packet or per stream."""
    keys = ["match_rule", "src_ip", "dst_ip", "src_port", "dst_port"]
    return silence(hits, keys, "ts", seconds, True, order, derived)


def delete_alerts(alerts: DataFrame, ids: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(remaining alerts, one-row count of the deleted); all are deleted without ids."""
    gone = F.col("id").isin(list(ids)) if ids is not None else F.lit(True)
    return alerts.filter(~gone), alerts.agg(F.count_if(gone).alias("deleted"))
