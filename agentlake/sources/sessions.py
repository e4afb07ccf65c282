"""Session logs: one JSON object a line, content a string or an array of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import token_count


def content_text(content: Column) -> Column:
    """A JSON string's text, or the text blocks of a JSON array joined by line breaks; null without text."""
    plain = F.get_json_object(F.concat(F.lit('{"c":'), content, F.lit("}")), "$.c")
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    is_array = F.ltrim(content).startswith("[")
    is_text = F.ltrim(content).startswith('"')
    return F.when(is_array & (F.size(texts) > 0), F.array_join(texts, "\n")).when(is_text, plain)


def read_sessions(spark: SparkSession, path: str, as_of: int, family: str = "claude", use_original_timestamp: bool = False) -> DataFrame:
    """Messages of all *.jsonl files in a folder (or of one file), numbered within their file's session.

    Blank and broken lines are dropped; lines without text stay in ``parsed_lines``
    and are not stored; the session key is the file's name without 'session-'.
    """
    # wholetext keeps the order of lines whatever the size of splits
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.jsonl").select("value", F.col("_metadata.file_name").alias("file"))
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).where("trim(value) != ''")
    parsed = lines.withColumn("j", F.from_json("value", "role string, content string, timestamp bigint")).where("j.role IS NOT NULL")
    raw = F.when(F.ltrim("j.content").startswith("["), F.col("j.content")).otherwise(F.to_json(F.struct(F.col("j.content").alias("c"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("j.content").alias("c")))) - 6))
    rows = parsed.withColumn("content", content_text(raw)).withColumn("session_key", F.regexp_replace(F.regexp_replace("file", r"\.jsonl$", ""), "^session-", ""))
    per = Window.partitionBy("session_key")
    rows = rows.withColumn("parsed_lines", F.count("*").over(per)).where("content IS NOT NULL")
    created = F.coalesce("j.timestamp", F.lit(as_of)) if use_original_timestamp else F.lit(as_of)
    return rows.select(
        F.concat_ws("-", F.lit("msg"), "session_key", F.row_number().over(per.orderBy("line")) - 1).alias("message_id"), F.col("session_key").alias("conversation_id"), F.col("j.role").alias("role"), "content",
        token_count(F.col("content"), F.lit(family)).alias("tokens"), (F.row_number().over(per.orderBy("line")) - 1).alias("sequence_num"), created.cast("long").alias("created_at"), F.lit(family).alias("model_family"),
        F.to_json(F.struct(F.col("file").alias("imported_from"), F.col("j.timestamp").alias("original_timestamp"))).alias("metadata"), "parsed_lines",
    )


def verify_import(messages: DataFrame, expected: DataFrame) -> DataFrame:
    """Issues of each conversation, against (conversation_id, message_count, total_tokens): counts, tokens, gaps."""
    found = messages.groupBy("conversation_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min("sequence_num").alias("low"), F.max("sequence_num").alias("high"), F.countDistinct("sequence_num").alias("d"))
    both = expected.join(found, "conversation_id", "full_outer")
    issue = lambda bad, text: F.when(bad, text)
    issues = F.array_compact(F.array(
        issue(~F.col("message_count").eqNullSafe(F.col("n")), "message count differs"), issue(~F.col("total_tokens").eqNullSafe(F.col("t")), "token total differs"),
        issue((F.col("low") != 0) | (F.col("high") - F.col("low") + 1 != F.col("n")) | (F.col("d") != F.col("n")), "sequence has gaps"),
    ))
    return both.select("conversation_id", issues.alias("issues"), (F.size(issues) == 0).alias("valid"))


def import_stats(messages: DataFrame) -> DataFrame:
    rows = messages.where(F.get_json_object("metadata", "$.imported_from").isNotNull())
    return rows.agg(F.countDistinct("conversation_id").alias("conversations"), F.count("*").alias("messages"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
