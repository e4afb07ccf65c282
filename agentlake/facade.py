"""One object over a store of Parquet tables: import, ingest, search, assemble, compact, report.

Tables live under one folder (of each user, see ``users``); each call reads what it
needs and appends; ``vacuum`` alone rewrites, into few files.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tokens import token_count
from .operators import assembly, records, search, store
from .sources import sessions

MESSAGE = "message_id string, conversation_id string, role string, content string, tokens long, sequence_num int, created_at long, model_family string, metadata string"
CONVERSATION = "conversation_id string, session_key string, title string, created_at long, updated_at long, metadata string"
EVENT = "event_id string, conversation_id string, messages_before int, messages_after int, tokens_before long, tokens_after long, dropped_message_ids array<string>, strategy string, created_at long"


@dataclass
class Engine:
    """The facade; ``as_of`` (epoch milliseconds) is passed wherever the time matters."""

    spark: SparkSession
    path: str
    model_family: str = "claude"
    strategy: str = "hybrid"
    max_tokens: int = 8000
    schemas: dict[str, str] = field(default_factory=lambda: {"messages": MESSAGE, "compactions": EVENT, "conversations": CONVERSATION})

    def _where(self, name: str) -> tuple[object, object]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        where, system = self._where(name)
        return bool(system.exists(where))

    def table(self, name: str) -> DataFrame:
        if self.exists(name):
            return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], self.schemas[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def create_conversation(self, session_key: str, as_of: int, title: str | None = None, metadata: str | None = None, conversation_id: str | None = None) -> str:
        """The id of a new conversation; a session key that is known is an error."""
        now = self.table("conversations")
        if now.where(F.col("session_key") == session_key).limit(1).count():
            raise ValueError(f"the session exists: {session_key}")
        new = self.spark.createDataFrame([(conversation_id, session_key, title, metadata)], "conversation_id string, session_key string, title string, metadata string")
        added = records.add(now.limit(0), new, as_of, "conversation_id")
        self._append("conversations", added)
        return conversation_id or added.first()["conversation_id"]

    def vacuum(self, name: str, files: int = 1) -> int:
        """Rewrite a table into so many files beside it and put it in its place; the number of its rows."""
        where, system = self._where(name)
        if not system.exists(where):
            return 0
        rows = self.table(name)
        rows.coalesce(files).write.mode("overwrite").parquet(f"{self.path}/{name}.new")
        new, _ = self._where(f"{name}.new")
        old, _ = self._where(f"{name}.old")
        system.rename(where, old)
        system.rename(new, where)
        system.delete(old, True)
        return self.table(name).count()

    def export(self, path: str) -> None:
        store.export_jsonl(self.table("messages"), path)

    def bootstrap(self, session_path: str, as_of: int, session_key: str | None = None, use_original_timestamp: bool = False) -> dict[str, int]:
        """Import a session file or folder; a given key replaces the file's name."""
        read = sessions.read_sessions(self.spark, session_path, as_of, self.model_family, use_original_timestamp).drop("parsed_lines")
        if session_key is not None:
            read = read.withColumn("conversation_id", F.lit(session_key))
        read = read.select(*self.table("messages").columns)
        known = self.table("messages").select("message_id")
        self._append("messages", read.join(known, "message_id", "left_anti"))
        done = read.agg(F.count("*").alias("messages"), F.countDistinct("conversation_id").alias("conversations")).first()
        if not done["messages"]:
            raise ValueError(f"no valid messages in {session_path}")
        return done.asDict()

    def ingest(self, conversation_id: str, role: str, content: str, as_of: int) -> None:
        new = self.spark.createDataFrame([(conversation_id, 0, role, content, as_of)], "conversation_id string, position int, role string, content string, created_at long")
        new = new.withColumn("tokens", token_count(F.col("content"), F.lit(self.model_family))).withColumn("model_family", F.lit(self.model_family)).withColumn("metadata", F.lit(None).cast("string"))
        now = self.table("messages")
        added = store.add_messages(now.where(F.col("conversation_id") == conversation_id), new).join(now.select("message_id"), "message_id", "left_anti")
        self._append("messages", added.select(*now.columns))

    def assemble(self, conversation_id: str, as_of: int, budget: int | None = None, strategy: str | None = None, query: str | None = None, **options: object) -> tuple[DataFrame, dict[str, object]]:
        own = self.table("messages")
        if not own.where(F.col("conversation_id") == conversation_id).limit(1).count():
            raise KeyError(f"no such session: {conversation_id}")
        budget = self.max_tokens if budget is None else budget
        out = assembly.assemble(own, strategy or self.strategy, budget, as_of, conversation_id, query, **options)
        meta = assembly.metadata(out, own.where(F.col("conversation_id") == conversation_id), budget).first()
        return out, meta.asDict()

    def search(self, query: str, as_of: int, conversation_id: str | None = None, limit: int = 20, **options: object) -> DataFrame:
        """An unknown session searches everything, as in the reference."""
        known = conversation_id is not None and self.table("messages").where(F.col("conversation_id") == conversation_id).limit(1).count()
        return search.sparse_search(self.table("messages"), query, as_of, limit=limit, conversation_id=conversation_id if known else None, **options)

    def record_compaction(self, conversation_id: str, dropped: list[str], strategy: str, as_of: int) -> None:
        own = self.table("messages").where(F.col("conversation_id") == conversation_id)
        gone = F.col("message_id").isin(dropped)
        event = own.agg(
            F.lit(str(uuid.uuid4())).alias("event_id"), F.lit(conversation_id).alias("conversation_id"), F.count("*").cast("int").alias("messages_before"), F.count_if(~gone).cast("int").alias("messages_after"),
            F.sum("tokens").alias("tokens_before"), F.sum(F.when(~gone, F.col("tokens")).otherwise(0)).alias("tokens_after"), F.array(*(F.lit(d) for d in dropped)).cast("array<string>").alias("dropped_message_ids"), F.lit(strategy).alias("strategy"), F.lit(as_of).cast("long").alias("created_at"),
        )
        self._append("compactions", event)

    def compaction_history(self, conversation_id: str) -> DataFrame:
        return store.compaction_history(self.table("compactions"), conversation_id)

    def stats(self) -> dict[str, int]:
        return store.store_stats(self.table("messages"), self.table("compactions")).first().asDict()

    def health_check(self) -> bool:
        return self.table("messages").limit(1).count() >= 0
