"""Rule rows: decode, insert-if-absent, replace, delete, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.joins import lookup_join


def decode_patterns(pattern: Column, pattern_type: Column | None = None) -> Column:
    """Stored pattern text as a list: a JSON list if it is one, else the text itself.

    With ``pattern_type`` regular expressions are never read as JSON (list form).
    """
    listed = F.coalesce(F.from_json(pattern, "array<string>"), F.array(pattern))
    decoded = F.when(pattern.rlike(r"^\s*\["), listed).otherwise(F.array(pattern))
    if pattern_type is None:
        return decoded
    return F.when(pattern_type == "pcre", F.array(pattern)).otherwise(decoded)


def insert_if_absent(existing: DataFrame, new: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` whose rule id is not stored yet, one per id (the first by ``order``)."""
    rest = F.struct(*[F.col(c) for c in new.columns])
    rank = F.struct(*[F.col(c) for c in order]) if order else F.xxhash64(F.to_json(rest))
    first = new.groupBy("rule_id").agg(F.min_by(rest, rank).alias("row")).select("row.*")
    return first.join(existing.select("rule_id"), "rule_id", "left_anti")


def overlay(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base rows with the changed ids replaced."""
    kept = lookup_join(base, changes.select("rule_id").distinct(), ["rule_id"], "left_anti", salts=1)
    return kept.unionByName(changes)


def delete_rules(base: DataFrame, ids: DataFrame) -> DataFrame:
    return lookup_join(base, ids.select("rule_id").distinct(), ["rule_id"], "left_anti", salts=1)


def _like(column: str, text: str) -> Column:
    return F.col(column).ilike(f"%{text}%")


def search_rules(rules: DataFrame, search: str = "", category: str = "", tags: str = "") -> DataFrame:
    """Rules by case-insensitive text in id, name or description, by category and by tag."""
    out = rules
    if search:
        out = out.filter(_like("rule_id", search) | _like("name", search) | _like("description", search))
    if category:
        out = out.filter(_like("category", category))
    if tags:
        out = out.filter(F.exists("tags", lambda t: t.ilike(f"%{tags}%")))
    return out


def rule_page(rules: DataFrame, skip: int = 0, limit: int = 20, order: str = "rule_id") -> DataFrame:
    return rules.orderBy(order).offset(skip).limit(limit)
