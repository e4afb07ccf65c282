"""Stores of many users in one place: each user's tables lie in a partition of their own."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .facade import MESSAGE, Engine
from .operators import store


def folder_of(user_id: str) -> str:
    """A user's folder: signs other than letters, digits, '-' and '_' become '_', so that no id leads elsewhere."""
    if not user_id:
        raise ValueError("a user id is needed")
    return "user_id=" + re.sub(r"[^\w-]", "_", user_id, flags=re.ASCII)


@dataclass
class Users:
    """Engines by user; nothing is pooled, as a table needs no connection."""

    spark: SparkSession
    path: str
    options: dict[str, object] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=lambda: {"requests": 0, "hits": 0, "evictions": 0})
    _open: dict[str, Engine] = field(default_factory=dict)

    def _where(self, name: str = "") -> tuple[object, object]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def engine(self, user_id: str) -> Engine:
        """The user's engine, made at the first call."""
        name = folder_of(user_id)
        self.counters["requests"] += 1
        self.counters["hits"] += name in self._open
        return self._open.setdefault(name, Engine(self.spark, f"{self.path}/{name}", **self.options))

    def close(self, user_id: str | None = None) -> None:
        for name in [folder_of(user_id)] if user_id is not None else list(self._open):
            self._open.pop(name, None)

    def ids(self) -> list[str]:
        where, system = self._where()
        found = system.listStatus(where) if system.exists(where) else []
        return sorted(f.getPath().getName().removeprefix("user_id=") for f in found if f.isDirectory() and f.getPath().getName().startswith("user_id="))

    def has(self, user_id: str) -> bool:
        where, system = self._where(folder_of(user_id))
        return bool(system.exists(where))

    def delete(self, user_id: str) -> bool:
        """Remove a user's partition; whether there was one."""
        self.close(user_id)
        where, system = self._where(folder_of(user_id))
        return bool(system.exists(where) and system.delete(where, True))

    def messages(self) -> DataFrame:
        """Messages of all users with their user_id; a filter on it reads that partition alone."""
        users = [u for u in self.ids() if self.engine(u).exists("messages")]
        if not users:
            return self.spark.createDataFrame([], f"{MESSAGE}, user_id string")
        return self.spark.read.schema(f"{MESSAGE}, user_id string").option("basePath", self.path).parquet(*(f"{self.path}/user_id={u}/messages" for u in users))

    def stats(self) -> DataFrame:
        return store.aggregate_stats(self.messages())

    def totals(self) -> dict[str, int]:
        sums = self.stats().agg(F.count("*").alias("users"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("conversations", "messages", "tokens"))).first()
        return sums.asDict()

    def health(self, memory_ratio: float = 0.0, open_files_ratio: float = 0.0) -> dict[str, object]:
        """Score and status from resource figures and the share of engines that were there already."""
        asked = self.counters["requests"]
        rate = self.counters["hits"] / asked if asked else 1.0
        score, status = store.health(memory_ratio, open_files_ratio, rate, self.counters["evictions"], asked)
        return {"score": score, "status": status, "hit_rate": rate, "open": len(self._open), "users": len(self.ids())}
