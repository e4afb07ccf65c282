"""Adapters of exports: Slack, Discord, mail, Markdown and long documents.

All give items (source, source_id, content, role, created_at, conversation_id,
metadata).  Options limit, conversation_ids, since and until are honoured by all.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all

ITEM = "source string, source_id string, content string, role string, created_at long, conversation_id string, metadata map<string,string>"


def fetch(items: DataFrame, since: int | None = None, until: int | None = None, conversation_ids: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The options that every adapter honours."""
    if since is not None:
        items = items.where(F.col("created_at") >= since)
    if until is not None:
        items = items.where(F.col("created_at") <= until)
    if conversation_ids:
        items = items.where(F.col("conversation_id").isin(conversation_ids))
    return items if limit is None else items.orderBy("created_at", "source_id").offset(offset).limit(limit)


def stats(items: DataFrame) -> DataFrame:
    return items.groupBy("source").agg(F.count("*").alias("items"), F.countDistinct("conversation_id").alias("conversations"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def fetch_updates(items: DataFrame, since: int) -> DataFrame:
    return items.where(F.col("created_at") > since)


def _items(source: str, source_id: Column, content: Column, role: Column, at: Column, conversation: Column, **metadata: Column) -> list[Column]:
    meta = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in metadata.items())), lambda e: e["value"].isNotNull())) if metadata else F.expr("cast(map() as map<string,string>)")
    return [F.lit(source).alias("source"), source_id.alias("source_id"), content.alias("content"), role.alias("role"), at.cast("long").alias("created_at"), conversation.alias("conversation_id"), meta.alias("metadata")]


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for raw in files["content"]:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                rows = [(n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith(".json")]
            yield pd.DataFrame(rows, columns=["name", "body"])


def slack_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of the JSON files in an export: a zip file, or an unpacked folder."""
    if path.endswith(".zip"):
        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unzip, "name string, body string")
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return files.select(F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1).alias("name"), F.col("value").alias("body"))


def slack(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Messages with text of the channels; mentions show names; bots are assistants; threads are conversations."""
    user = F.explode(F.from_json("body", "array<struct<id:string,name:string,real_name:string>>"))
    users = files.where(F.col("name").rlike(r"(^|/)users\.json$")).select(user.alias("u")).select(F.col("u.id").alias("user"), F.coalesce("u.real_name", "u.name", "u.id").alias("shown"))
    if names:
        own = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        users = users.withColumn("shown", F.coalesce(own[F.col("user")], "shown"))
    message = "array<struct<type:string,ts:string,user:string,bot_id:string,text:string,thread_ts:string,reply_count:int>>"
    days = files.where(F.col("name").rlike(r"[^/]+/\d{4}-\d{2}-\d{2}\.json$")).withColumn("channel", F.regexp_extract("name", r"([^/]+)/[^/]+$", 1))
    days = days.where(F.col("channel").isin(include)) if include else days
    days = days.where(~F.col("channel").isin(exclude)) if exclude else days
    rows = days.select("channel", F.explode(F.from_json("body", message)).alias("m")).select("channel", "m.*").where("type = 'message' AND text IS NOT NULL AND text != ''")
    # A message is cut at its mentions; pieces and names are put together again in order.
    table = users.agg(F.map_from_entries(F.collect_list(F.struct("user", "shown"))).alias("table"))
    rows = rows.crossJoin(F.broadcast(table))
    pieces = F.split("text", r"<@[A-Z0-9]+>", -1)
    ids = F.regexp_extract_all("text", F.lit(r"<@([A-Z0-9]+)>"), F.lit(1))
    shown = F.transform(ids, lambda i: F.concat(F.lit("@"), F.coalesce(F.col("table")[i], i)))
    text = F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), shown.alias("s")), lambda x: F.array(x["p"], F.coalesce(x["s"], F.lit(""))))), "")
    thread = F.concat_ws(":", "channel", F.coalesce("thread_ts", "ts"))
    return rows.select(*_items("slack", F.concat_ws(":", "channel", "ts"), text, F.when(F.col("bot_id").isNotNull(), "assistant").otherwise("user"), F.col("ts").cast("double") * 1000, thread, user=F.coalesce(F.col("table")[F.col("user")], "user"), channel=F.col("channel")))


def discord(spark: SparkSession, path: str, include_dms: bool = True, include_servers: bool = True, channels: list[str] | None = None) -> DataFrame:
    """messages/index.json and messages/cN/messages.json (or .csv)."""
    index = spark.read.text(f"{path}/messages/index.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("channel_id", "title"))
    files = spark.read.text(f"{path}/messages", wholetext=True, recursiveFileLookup=True, pathGlobFilter="messages.json")
    channel = F.regexp_extract("_metadata.file_path", r"/c?(\d+)/[^/]+$", 1)
    rows = files.select(channel.alias("channel_id"), F.explode(F.from_json("value", "array<struct<ID:string,Timestamp:string,Contents:string,Attachments:string>>")).alias("m")).select("channel_id", "m.*")
    rows = rows.join(F.broadcast(index), "channel_id", "left").where("Contents IS NOT NULL AND Contents != ''")
    direct = F.coalesce(F.col("title").startswith("Direct Message"), F.lit(False))
    rows = rows.where((direct & F.lit(include_dms)) | (~direct & F.lit(include_servers)))
    rows = rows.where(F.col("channel_id").isin(channels)) if channels else rows
    at = F.unix_millis(F.to_timestamp("Timestamp"))
    return rows.select(*_items("discord", F.col("ID"), F.col("Contents"), F.lit("user"), at, F.col("channel_id"), channel=F.col("title"), attachments=F.col("Attachments")))


def _header(name: str) -> Column:
    return F.nullif(trim_all(F.regexp_extract("_head", rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def strip_words(text: Column) -> Column:
    """Encoded words without their marks."""
    return F.regexp_replace(F.regexp_replace(text, r"=\?[^?]+\?[BbQq]\?", ""), r"\?=", "")


def parse_mbox(raw: DataFrame) -> DataFrame:
    """Messages of mbox texts (column value): headers unfolded, body, ids, addresses."""
    mails = raw.select(F.explode(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\r\n", "\n")), r"\nFrom ")).alias("_mail")).where("trim(_mail) != ''")
    cut = F.instr("_mail", "\n\n")
    rows = mails.withColumn("_raw_head", F.when(cut > 0, F.substring(F.col("_mail"), F.lit(1), cut)).otherwise(F.col("_mail"))).withColumn("_body", F.when(cut > 0, F.substring(F.col("_mail"), cut + 2, F.length("_mail"))).otherwise(""))
    rows = rows.withColumn("_head", F.regexp_replace("_raw_head", r"\n[ \t]+", " "))
    bracketed = lambda c: F.regexp_extract(c, "<([^>]+)>", 1)
    addresses = lambda c: F.when(c.isNotNull(), F.transform(F.split(c, ","), trim_all))
    boundary = F.regexp_extract("_head", r'(?i)boundary="?([^";\s]+)"?', 1)
    part = F.regexp_extract("_body", r"(?is)content-type:\s*text/plain.*?\n\n(.*?)(?:\n--|\z)", 1)
    body = F.when((boundary != "") & (part != ""), part).otherwise(F.col("_body"))
    subject = strip_words(_header("subject"))
    plain = F.lower(trim_all(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^(re|fwd|fw):\s*", "")))
    return rows.select(
        bracketed(_header("message-id")).alias("message_id"), _header("from").alias("sender"), addresses(_header("to")).alias("to"), addresses(_header("cc")).alias("cc"), subject.alias("subject"), plain.alias("thread_subject"),
        F.unix_millis(F.try_to_timestamp(F.regexp_replace(_header("date"), r"^\w{3},\s*|\s*\([^)]*\)$", ""), F.lit("d MMM yyyy HH:mm:ss Z"))).alias("created_at"), bracketed(_header("in-reply-to")).alias("in_reply_to"), trim_all(body).alias("body"),
    ).where("sender IS NOT NULL")


def email(raw: DataFrame) -> DataFrame:
    """Items of mbox texts; a subject of several mails is a thread; no-reply senders are the system."""
    rows = parse_mbox(raw).withColumn("_n", F.count("*").over(Window.partitionBy("thread_subject")))
    own = F.coalesce(F.nullif(F.col("message_id"), F.lit("")), F.sha2(F.concat_ws("|", "sender", "subject", "body"), 256))
    thread = F.when(F.col("_n") > 1, F.concat(F.lit("thread_"), F.substring("thread_subject", 1, 50))).otherwise(own)
    role = F.when(F.lower("sender").rlike("no-?reply"), "system").otherwise("user")
    return rows.select(*_items("email", own, F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.col("body")), role, F.col("created_at"), thread, sender=F.col("sender")))


def frontmatter(text: Column) -> tuple[Column, Column]:
    """(map of 'key: value' lines between '---' lines, the rest of the text)."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n?", 1)
    entries = F.transform(F.filter(F.split(block, "\n"), lambda line: line.contains(":")), lambda line: F.struct(trim_all(F.split_part(line, F.lit(":"), F.lit(1))).alias("key"), F.regexp_replace(trim_all(F.regexp_replace(line, "^[^:]*:", "")), "^[\"']|[\"']$", "").alias("value")))
    return F.map_from_entries(F.array_distinct(entries)), F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")


def chunk_by_headings(docs: DataFrame) -> DataFrame:
    """(path, content) cut at '# …' lines: chunk_no, heading, level, start_line, end_line (from 0), chunk."""
    lines = docs.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    number = F.sum(F.col("line").rlike(r"^#{1,6}\s+\S").cast("int")).over(Window.partitionBy("path").orderBy("line_no"))
    rows = lines.withColumn("chunk_no", number).groupBy("path", "chunk_no").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min_by("line", "line_no").alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("chunk"),
    )
    level = F.length(F.regexp_extract("_first", r"^(#{1,6})\s", 1))
    rows = rows.select("path", "chunk_no", F.when(level > 0, trim_all(F.regexp_extract("_first", r"^#{1,6}\s+(.*)$", 1))).alias("heading"), level.alias("level"), "start_line", "end_line", "chunk")
    return rows.where("trim(chunk) != ''")


def chunk_by_size(text: Column, most: int = 2000) -> Column:
    """Chunks of whole lines: a chunk is closed before the line that would make it longer than most."""
    state = F.aggregate(
        F.split(text, "\n"),
        F.expr("named_struct('done', cast(array() as array<string>), 'now', cast(null as string), 'size', 0L)"),
        lambda s, line: F.when(
            (s["size"] + F.length(line) > most) & s["now"].isNotNull(),
            F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), line.alias("now"), F.length(line).cast("long").alias("size")),
        ).otherwise(F.struct(s["done"].alias("done"), F.when(s["now"].isNull(), line).otherwise(F.concat(s["now"], F.lit("\n"), line)).alias("now"), (s["size"] + F.length(line) + 1).cast("long").alias("size"))),
    )
    return F.filter(F.concat(state["done"], F.array(state["now"])), lambda c: trim_all(c) != "")


def markdown(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """Items of .md and .markdown files, a chunk a heading."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,markdown}").select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("mtime"), "value")
    files = files.where(F.col("mtime") >= since) if since is not None else files
    _, body = frontmatter(F.col("value"))
    chunks = chunk_by_headings(files.select("path", body.alias("content"))).join(files.select("path", "mtime"), "path")
    source_id = F.concat("path", F.when(F.col("heading").isNotNull(), F.concat(F.lit("#"), "heading")).otherwise(F.concat(F.lit(":L"), F.col("start_line").cast("string"))))
    return chunks.select(*_items("markdown", source_id, F.col("chunk"), F.lit("system"), F.col("mtime"), F.col("path"), heading=F.col("heading"), level=F.col("level")))


def split_size(text: str, size: int = 5000) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size) if text[i : i + size].strip()]


def split_paragraphs(text: str, size: int = 5000) -> list[str]:
    """Paragraphs together up to a size."""
    out: list[str] = []
    now = ""
    for paragraph in re.split(r"\n\s*\n", text):
        if now and len(now) + len(paragraph) + 2 > size:
            out.append(now)
            now = ""
        now = f"{now}\n\n{paragraph}" if now else paragraph
    return [x.strip() for x in [*out, now] if x.strip()]


def split_pages(text: str, pages: int) -> list[str]:
    """Equal pages, each ended at a blank line within 100 characters of its end; every page moves on."""
    size = max(1, -(-len(text) // max(pages, 1)))
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            near = text.find("\n\n", max(at + 1, end - 100), end + 100)
            end = near if near > at else end
        out.append(text[at:end].strip())
        at = end
    return [x for x in out if x]


def documents(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[str, int]], strategy: str = "page", size: int = 5000, glob: str = "*.pdf") -> DataFrame:
    """Items of binary documents; ``parse`` gives a document's text and number of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for name, at, raw in zip(files["path"], files["at"], files["content"], strict=True):
                text, pages = parse(raw)
                chunks = split_pages(text, pages) if strategy == "page" else split_paragraphs(text, size) if strategy == "paragraph" else split_size(text, size)
                rows += [("document", f"{name}#{i}", c, "system", at, name, {"chunk": str(i)}) for i, c in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=["source", "source_id", "content", "role", "created_at", "conversation_id", "metadata"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.unix_millis("modificationTime").alias("at"), "content").mapInPandas(run, ITEM)


class Registry:
    """Adapters by name and format, with their state."""

    def __init__(self) -> None:
        self._made: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {}
        self.status: dict[str, str] = {}

    def register(self, name: str, make: Callable[..., DataFrame], formats: tuple[str, ...]) -> None:
        if name in self._made:
            raise ValueError(f"{name} is registered")
        self._made[name], self.status[name] = (make, formats), "idle"

    def names(self) -> list[str]:
        return sorted(self._made)

    def for_format(self, extension: str) -> list[str]:
        return sorted(n for n, (_, formats) in self._made.items() if extension.lower().lstrip(".") in formats)

    def read(self, name: str, *args: object, **options: object) -> DataFrame:
        self.status[name] = "running"
        try:
            out = self._made[name][0](*args, **options)
        except Exception:
            self.status[name] = "error"
            raise
        self.status[name] = "ready"
        return out

    def healthy(self) -> dict[str, bool]:
        return {n: s != "error" for n, s in self.status.items()}


def default_registry() -> Registry:
    out = Registry()
    out.register("slack", slack, ("zip",))
    out.register("discord", discord, ("json", "csv"))
    out.register("email", email, ("mbox",))
    out.register("markdown", markdown, ("md", "markdown"))
    out.register("document", documents, ("pdf",))
    return out

