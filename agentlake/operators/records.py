"""Rows with a key: conversations, services, goals, settings, findings and a research log.

Adding, changing and removing give the new frame; ids that are not given are hashes of
the row, so that a repeated call gives the same id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import last_write, overlay

FINDING_STATUSES = ("pending", "presented", "acted", "dismissed")


def add(rows: DataFrame, new: DataFrame, at: int, key: str = "id", **defaults: object) -> DataFrame:
    """rows with those of new: a missing id is a hash, missing columns take the defaults (then null), times are ``at``."""
    filled = {k: F.coalesce(new[k], F.lit(v)) if k in new.columns else F.lit(v) for k, v in defaults.items()}
    filled |= {c: F.lit(at).cast("long") for c in ("created_at", "updated_at") if c in rows.columns and c not in new.columns}
    new = new.withColumns(filled)
    made = F.sha2(F.to_json(F.struct(*new.columns)), 256)
    new = new.withColumn(key, F.coalesce(F.col(key), made) if key in new.columns else made)
    return rows.unionByName(new.select(*(F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)))


def get(rows: DataFrame, value: object, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) == value).limit(1)


def update(rows: DataFrame, changes: DataFrame, at: int | None = None, key: str = "id") -> DataFrame:
    """Null columns of changes leave a row as it is; changes of no row do nothing."""
    if at is not None:
        changes = changes.withColumn("updated_at", F.lit(at).cast("long"))
    return overlay(rows, changes, key)


def remove(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def set_setting(settings: DataFrame, key: str, value: str, at: int) -> DataFrame:
    """An upsert of (key, value, updated_at)."""
    return last_write(settings.unionByName(settings.sparkSession.createDataFrame([(key, value, at)], settings.schema)))


def settings_map(settings: DataFrame) -> DataFrame:
    """All settings in one map, the latest value of each key."""
    return last_write(settings).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def set_status(findings: DataFrame, ids: DataFrame, status: str, at: int) -> DataFrame:
    """Findings with a new status and the time of it (presented_at, acted_at, dismissed_at)."""
    if status not in FINDING_STATUSES:
        raise ValueError(f"status must be one of {FINDING_STATUSES}")
    chosen = findings.join(ids.select("id", F.lit(True).alias("_chosen")).distinct(), "id", "left")

    def new(c: str) -> Column:
        value = F.lit(status) if c == "status" else F.lit(at).cast("long") if c == f"{status}_at" else F.col(c)
        return F.when(F.col("_chosen"), value).otherwise(F.col(c)).alias(c)

    return chosen.select(*(new(c) for c in findings.columns))


def research_history(log: DataFrame, target: str | None = None, limit: int | None = 50) -> DataFrame:
    """Newest first."""
    rows = (log if target is None else log.where(F.col("target") == target)).orderBy(F.desc("created_at"), "id")
    return rows if limit is None else rows.limit(limit)
