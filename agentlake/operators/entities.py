"""Entities: extraction by patterns, and resolution of their names.

The patterns are data; each is one JVM regular expression over all messages, and a
message is scanned once for all of them without leaving the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settle
from ..functions.text import once, squeeze_name, trim_all, trim_name
from .updates import holds_any

NAME = r"((?:[A-Z][a-z]+\s)?[A-Z][a-z]+)"
CLAUSE = r"([^\n.!?]+)"
TYPES = ("person", "decision", "action", "question", "topic", "project")
#: type, confidence, regular expression, group, how the match is shaped
PATTERNS: list[tuple[str, float, str, int, str]] = [
    ("person", 0.95, r"@(\w+)", 1, ""),
    ("person", 0.85, rf"(?:spoke with|call with|talked to|email from|meeting with)\s+{NAME}", 1, ""),
    ("person", 0.80, rf"(?:by|from|to|with)\s+{NAME}\s+(?:mentioned|proposed|said|suggested)", 1, ""),
    ("decision", 0.85, rf"(?i)(?:we'll|let's|decided to|going to)\s+{CLAUSE}", 1, "clip"),
    ("decision", 0.90, rf"(?i)(?:resolution|decision):\s*{CLAUSE}", 1, "clip"),
    ("decision", 0.80, rf"(?i)(?:picked|selected|chose)\s+{CLAUSE}", 1, "clip"),
    ("action", 0.90, rf"(?i)(?:need to|have to|action item|must|should|todo)\s*:?\s*{CLAUSE}", 1, "clip"),
    ("action", 0.95, r"[\[]\s*\]\s*([^\n\[]+)", 1, "clip"),
    ("action", 0.70, r"(?i)(?:plan to|will|going to)\s+([\s\w]{5,50})(?:[.,]|\z)", 1, "trim"),
    ("question", 0.95, r"(?m)^([^\n?]{10,}?[?])", 1, "trim"),
    ("question", 0.90, r"(?i)(?:which|who|where|when|why|how|what|should|would|could|can)\s+([^\n?]+?[?])", 0, "trim"),
    ("topic", 0.90, r"#(\w+)", 1, ""),
    ("topic", 0.75, r"(?i)\b(database|deployment|testing|authentication|authorization|GraphQL|REST|API|DevOps|CI/CD)\b", 1, "lower"),
    ("topic", 0.70, r"(?i)(?:related to|concerning|regarding|about)\s+((?:[a-z]+\s){0,2}[a-z]+)", 1, "lower"),
    ("project", 0.85, r"(?i)(?:milestone|release|sprint|initiative|project)\s+((?:[A-Z][\w-]+\s)?[A-Z][\w-]+)", 1, ""),
    ("project", 0.90, r"(?:\s|^)([A-Z][A-Z]+-[0-9]+)(?:\z|\s)", 1, ""),
]
#: What a text must hold (in lower case) for the pattern of the same number to match; the regular expression runs over such texts alone.
HINTS = [
    "@", "spoke with|call with|talked to|email from|meeting with", "mentioned|proposed|said|suggested", "we'll|let's|decided to|going to", "resolution|decision", "picked|selected|chose",
    "need to|have to|action item|must|should|todo", "]", "plan to|will|going to", "?", "?", "#", "database|deployment|testing|authentication|authorization|graphql|rest|api|devops|ci/cd",
    "related to|concerning|regarding|about", "milestone|release|sprint|initiative|project", "-",
]
NOISE = set("a an the i it he she we they you this that these those is be are was were been do did does has had have if or and but else then".split())
NOISE_OF = {"person": {"admin", "assistant", "bot", "system", "user"}, "topic": {"issue", "problem", "stuff", "thing"}}
NICKNAMES = {
    short: full
    for line in """alexander: alex | andrew: andy | anthony: tony | benjamin: ben benny | christopher: chris | daniel: dan danny | david: dave davey | james: jamie jim jimmy | joseph: joe joey
    | matthew: matt matty | michael: mike mikey | nicholas: nick | patrick: pat | richard: dick rich richie rick | robert: bob bobby rob robbie | samuel: sam sammy | steven: steve stevie
    | thomas: tom tommy | william: bill billy will willie""".split("|")
    for full, _, shorts in [line.strip().partition(":")]
    for short in shorts.split()
}


def canonical_name(name: Column, kind: Column) -> Column:
    return (
        F.when(kind == "person", F.lower(trim_name(name)))
        .when(kind.isin("topic", "project"), F.lower(squeeze_name(name)))
        .otherwise(F.substring(squeeze_name(name), 1, 100))
    )


def is_noise(name: Column, kind: Column) -> Column:
    low = F.lower(name)
    out = low.isin(*sorted(NOISE))
    for k, listed in NOISE_OF.items():
        out = out | ((kind == k) & low.isin(*sorted(listed)))
    return out


def entity_id(kind: Column, canonical: Column) -> Column:
    return F.concat(kind, F.lit("_"), F.substring(F.sha2(F.concat(kind, F.lit(":"), canonical), 256), 1, 16))


def type_of(entity: Column) -> Column:
    """The type that an id of entity_id() begins with."""
    return F.substring(entity, F.lit(1), F.length(entity) - 17)


def pattern_table(patterns: list[tuple] | None = None) -> list[dict[str, object]]:
    return [{"type": t, "confidence": c, "pattern": p} for t, c, p, *_ in patterns or PATTERNS]


def mentions(messages: DataFrame, patterns: list[tuple] | None = None) -> DataFrame:
    """Every match: message columns, entity_type, name, canonical_name, entity_id, confidence, pattern_no, match_no."""
    listed = patterns or PATTERNS
    hits = [F.regexp_extract_all(F.col("content"), F.lit(regex), F.lit(group)) for _, _, regex, group, _ in listed]
    if patterns is None:
        hits = [F.when(holds_any(F.col("_low"), hint), own) for hint, own in zip(HINTS, hits, strict=True)]
    of = ["message_id", "conversation_id", "sequence_num", "created_at"]
    rows = once(messages, "_low", F.lower("content")).select(*of, F.posexplode(F.array(*hits)).alias("pattern_no", "_hits"))
    rows = rows.select(*of, "pattern_no", F.posexplode("_hits").alias("match_no", "_raw"))
    # shapes are columns over rows and not lambdas over arrays, which Spark interprets
    by_number = lambda values: F.array(*(F.lit(x) for x in values))[F.col("pattern_no")]
    rows = rows.select(*of, "pattern_no", "match_no", by_number([p[0] for p in listed]).alias("entity_type"), by_number([p[1] for p in listed]).alias("confidence"), by_number([p[4] for p in listed]).alias("_shape"), "_raw")
    trimmed, shape = trim_name(F.col("_raw")), F.col("_shape")
    name = F.when(shape == "", F.col("_raw")).when(shape == "clip", F.substring(trimmed, 1, 100)).when(shape == "lower", F.lower(trimmed)).otherwise(trimmed)
    rows = once(rows, "name", name).drop("_shape", "_raw")
    kind, name = F.col("entity_type"), F.col("name")
    rows = rows.where(F.length(name).between(2, 150) & ~is_noise(name, kind)).withColumn("canonical_name", canonical_name(name, kind))
    return rows.withColumn("entity_id", entity_id(kind, F.col("canonical_name")))


def merged(found: DataFrame, by: list[str] | None = None, again: bool = False) -> DataFrame:
    """One row for each entity (of each message, with by=['message_id']): first name kept, others are aliases.

    By message, rows are shuffled once and by message alone, so that what is done with a
    message's entities later needs no other shuffle; positions are packed into a number,
    as numbers are aggregated by hash and structs by sorting.  ``again`` adds ``_first``
    (where the name was found), for merged_again().
    """
    order = F.struct("created_at", "sequence_num", "message_id", "pattern_no", "match_no")
    keys = [*(by or []), "entity_id", "entity_type", "canonical_name"]
    place = [F.min(F.shiftleft(F.col("pattern_no").cast("long"), 32) + F.col("match_no")).alias("position")] if by and "message_id" in by else []
    found = found.repartition("message_id") if place else found
    out = found.groupBy(*keys).agg(
        F.min_by("name", order).alias("name"), F.count("*").alias("mention_count"), F.max("confidence").alias("confidence"),
        F.min("created_at").alias("first_mentioned"), F.max("created_at").alias("last_mentioned"), F.array_sort(F.collect_set("name")).alias("names"), *place, *([F.min(order).alias("_first")] if again else []),
    ).withColumn("aliases", F.array_except("names", F.array("name"))).drop("names")
    packed = F.col("position")
    return out.withColumn("position", F.struct(F.shiftright(packed, 32).cast("int").alias("pattern_no"), packed.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("match_no"))) if place else out


def merged_again(rows: DataFrame) -> DataFrame:
    """One row for each entity from merged(…, by, again=True): what merged(found) gives, without another look at the texts."""
    return rows.groupBy("entity_id", "entity_type", "canonical_name").agg(
        F.min_by("name", "_first").alias("name"), F.sum("mention_count").alias("mention_count"), F.max("confidence").alias("confidence"), F.min("first_mentioned").alias("first_mentioned"), F.max("last_mentioned").alias("last_mentioned"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_union("aliases", F.array("name")))))).alias("names"),
    ).withColumn("aliases", F.array_except("names", F.array("name"))).drop("names")


def extract(messages: DataFrame) -> DataFrame:
    return merged(mentions(messages))


def person_key(name: Column, rules: dict[str, str] | None = None) -> Column:
    """The name with its first word's nickname resolved."""
    low = F.lower(trim_all(name))
    first = F.substring_index(low, " ", 1)
    table = F.create_map(*(F.lit(x) for pair in sorted((NICKNAMES | (rules or {})).items()) for x in pair))
    return F.concat(F.coalesce(table[first], first), F.substring(low, F.length(first) + 1, F.length(low)))


def resolve_people(entities: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """People under their resolved names, the fullest and strongest one first."""
    strength = F.struct((F.col("confidence") * F.log1p(F.col("mention_count").cast("double"))).alias("s"), F.length("name").alias("l"), F.col("entity_id"))
    people = entities.where("entity_type = 'person'").withColumn("resolved", person_key(F.col("name"), rules))
    return people.groupBy("resolved").agg(
        F.max_by("entity_id", strength).alias("entity_id"), F.max_by("name", F.struct(F.length("name"), strength)).alias("name"), F.sum("mention_count").alias("mention_count"),
        F.max("confidence").alias("confidence"), F.min("first_mentioned").alias("first_mentioned"), F.max("last_mentioned").alias("last_mentioned"), F.count("*").alias("merged_entities"),
    ).withColumnRenamed("resolved", "canonical_name").withColumn("entity_type", F.lit("person"))


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar_topics(a: str, b: str) -> bool:
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return True
    if a in b or b in a:
        return min(len(a), len(b)) >= 0.4 * max(len(a), len(b))
    return levenshtein(a, b) <= 0.2 * max(len(a), len(b))


def similar_projects(a: str, b: str) -> bool:
    a, b = a.lower().strip(), b.lower().strip()
    return a in b or b in a


def leaders(rows: pd.DataFrame, similar: object) -> pd.Series:
    """Order-dependent clustering: each name joins the first leader it is similar to."""
    found: list[str] = []
    out = []
    for name, canonical in zip(rows["name"], rows["canonical_name"], strict=True):
        hit = next((x for x in found if similar(name, x)), None)
        if hit is None:
            found.append(hit := canonical or name.lower())
        out.append(hit)
    return pd.Series(out, index=rows.index)


def resolve_names(entities: DataFrame, kind: str, scope: str = "conversation_id") -> DataFrame:
    """Topics or projects clustered within a scope, in order of first mention; the longest name (topics) or the most mentioned (projects) is kept."""
    similar = similar_topics if kind == "topic" else similar_projects
    rows = entities.where(F.col("entity_type") == kind)
    schema = rows.select(scope, "entity_id", "name", "canonical_name", "mention_count", "confidence", "first_mentioned", "last_mentioned").schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["first_mentioned", "entity_id"], ignore_index=True)
        group["leader"] = leaders(group, similar)
        out = []
        for leader, own in group.groupby("leader", sort=False):
            best = own.sort_values("mention_count", ascending=False, kind="stable").iloc[0] if kind == "project" else own.assign(s=own.mention_count * own.confidence).sort_values("s", ascending=False, kind="stable").iloc[0]
            name = best["name"] if kind == "project" else max(own["name"], key=len)
            out.append([group[scope].iloc[0], best["entity_id"], name, leader, own.mention_count.sum(), own.confidence.max(), own.first_mentioned.min(), own.last_mentioned.max()])
        return pd.DataFrame(out, columns=schema.names)

    return rows.select(*schema.names).groupBy(scope).applyInPandas(run, schema)


def resolve(entities: DataFrame, scope: str = "conversation_id") -> DataFrame:
    """All entities by the rules of their types: people, topics and projects are merged, the others stay as they are."""
    columns = ["entity_id", "entity_type", "canonical_name", "name", "mention_count", "confidence", "first_mentioned", "last_mentioned"]
    entities = settle(entities.select(scope, *columns))  # else each type extracts them again
    out = entities.where(~F.col("entity_type").isin("person", "topic", "project")).select(*columns)
    out = out.unionByName(resolve_people(entities).select(*columns))
    for kind in ("topic", "project"):
        out = out.unionByName(resolve_names(entities, kind, scope).withColumn("entity_type", F.lit(kind)).select(*columns))
    return out
