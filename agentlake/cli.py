"""Command line over a store: python -m agentlake.cli --path STORE COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .facade import Engine
from .operators import store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="agentlake", description="Conversation memory on Spark")
    out.add_argument("--path", default="./store", help="folder of the tables")
    out.add_argument("--as-of", type=int, default=None, help="the time that counts as now, in milliseconds")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="make an empty store")
    add = commands.add_parser("import", help="read a session file or folder")
    add.add_argument("source")
    add.add_argument("--session", default=None)
    find = commands.add_parser("search", help="the best messages for a query")
    find.add_argument("query", nargs="+")
    find.add_argument("--limit", type=int, default=10)
    commands.add_parser("stats", help="numbers of conversations, messages and tokens")
    each = commands.add_parser("conversations", help="the conversations, latest first")
    each.add_argument("--limit", type=int, default=20)
    of = commands.add_parser("messages", help="the messages of a conversation")
    of.add_argument("conversation")
    of.add_argument("--limit", type=int, default=None)
    commands.add_parser("health", help="whether the store can be read")
    commands.add_parser("vacuum", help="rewrite the tables into few files")
    to = commands.add_parser("export", help="write all messages as JSON lines")
    to.add_argument("target")
    return out


def _shown(rows: DataFrame) -> list[dict[str, object]]:
    return [r.asDict(recursive=True) for r in rows.collect()]


def run(arguments: list[str], spark: SparkSession) -> object:
    """What the command gives, as values that JSON can hold."""
    args = parser().parse_args(arguments)
    engine, now = Engine(spark, args.path), args.as_of if args.as_of is not None else int(time.time() * 1000)
    if args.command == "init":
        for name in engine.schemas:
            if not engine.exists(name):
                engine.table(name).write.parquet(f"{engine.path}/{name}")
        return {"path": args.path, "tables": sorted(engine.schemas)}
    if args.command == "import":
        return engine.bootstrap(args.source, now, args.session)
    if args.command == "search":
        return _shown(engine.search(" ".join(args.query), now, limit=args.limit).select("message_id", "conversation_id", "role", "content", "score"))
    if args.command == "stats":
        return engine.stats()
    if args.command == "conversations":
        rows = engine.table("messages").groupBy("conversation_id").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
        return _shown(store.list_conversations(rows, args.limit))
    if args.command == "messages":
        return _shown(store.conversation_messages(engine.table("messages"), args.conversation, args.limit).select("sequence_num", "role", "content", "tokens"))
    if args.command == "health":
        return {"healthy": engine.health_check()}
    if args.command == "vacuum":
        return {name: engine.vacuum(name) for name in sorted(engine.schemas)}
    engine.export(args.target)
    return {"exported": args.target}


def main() -> int:
    spark = SparkSession.builder.appName("agentlake").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        print(json.dumps(run(sys.argv[1:], spark), ensure_ascii=False, indent=2))
    except (ValueError, KeyError) as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
