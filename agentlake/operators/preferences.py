"""Preferences mined from messages: technologies, roles, domains, working hours, style.

One conditional aggregation over all messages per family of patterns; nothing is
collected, and many users are served at once with ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once
from .updates import holds_any

TECHNOLOGIES: list[tuple[str, str, str]] = [
    ("backend_framework", "Django", "django"), ("backend_framework", "Express", r"express\.js|express"), ("backend_framework", "FastAPI", "fastapi"), ("backend_framework", "Flask", "flask"),
    ("backend_framework", "NestJS", r"nestjs|nest\.js"), ("database", "MongoDB", "mongo|mongodb"), ("database", "MySQL", "mysql"), ("database", "PostgreSQL", "postgres|postgresql"),
    ("database", "Redis", "redis"), ("database", "SQLite", "sqlite"), ("frontend_framework", "Angular", "angular"), ("frontend_framework", "React", "react|jsx|tsx"),
    ("frontend_framework", "Svelte", "svelte"), ("frontend_framework", "Vue", r"vue\.js|vue"), ("language", "Go", r"golang|go lang|\bgo\b"), ("language", "Java", r"java|\\.java\b"),
    ("language", "JavaScript", r"javascript|\.js\b"), ("language", "Python", r"python|\.py\b"), ("language", "Rust", r"rust|\.rs\b"), ("language", "TypeScript", r"typescript|\.ts\b"),
    ("tool", "Docker", "docker"), ("tool", "Git", r"\bgit\b"), ("tool", "Kubernetes", "kubernetes|k8s"), ("tool", "VS Code", "vs code|vscode"),
]
ROLES: list[tuple[str, str, float]] = [
    ("data_engineer", "airflow|spark|data warehouse|data pipeline|etl", 1.0), ("ml_engineer", "neural network|model training|machine learning|ml|ai", 1.0),
    ("site_reliability", "site reliability|sre|on-call|observability|monitoring", 1.0), ("security_engineer", "penetration testing|encryption|security|authorization|authentication", 1.0),
    ("devops_engineer", "infrastructure|deployment|devops|docker|kubernetes|ci/cd", 1.0), ("fullstack_developer", "both frontend and backend|full-stack|fullstack", 1.2),
    ("frontend_developer", "html|css|angular|vue|react|ux|ui|frontend", 1.0), ("backend_developer", "microservices|api development|server-side|backend", 1.0),
]
DOMAINS: list[tuple[str, str]] = [
    ("blockchain", "web3|smart contract|solidity|ethereum|blockchain"), ("cloud_infrastructure", "serverless|cloud|gcp|azure|aws"), ("data_science", "notebook|jupyter|numpy|pandas|data analysis"),
    ("game_development", "game engine|godot|unreal|unity|game dev"), ("machine_learning", "sklearn|pytorch|tensorflow|deep learning|machine learning"),
    ("mobile_development", "flutter|react native|android|ios|mobile app"), ("web_development", "graphql|rest api|http|webapp|website|web app"),
]


def _fragments(pattern: str) -> str:
    """What a text must hold, in lower case, for any of a pattern's alternatives to match."""
    return pattern.replace("\\\\", "\\").replace("\\b", "").replace("\\.", ".").lower()


def occurrences(content: Column, pattern: str) -> Column:
    """Matches in any case; the regular expression runs over texts alone that hold one of its fragments (column ``_low``: the text in lower case)."""
    return F.when(holds_any(F.col("_low"), _fragments(pattern)), F.regexp_count(content, F.lit(f"(?i){pattern}"))).otherwise(0)


def _unpivoted(messages: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """(by..., name, value) of one aggregation."""
    wide = messages.groupBy(*by).agg(*(c.alias(f"_{i}") for i, c in enumerate(columns.values())))
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"_{i}").cast("double").alias("value")) for i, n in enumerate(columns)))
    return wide.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")


def technologies(messages: DataFrame, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """Occurrences of each technology, with confidence n / 10 up to 1."""
    by = by or []
    counts = _unpivoted(once(messages, "_low", F.lower("content")), by, {f"{c}/{n}": F.sum(occurrences(F.col("content"), p)) for c, n, p in TECHNOLOGIES})
    rows = counts.where(F.col("value") >= least)
    return rows.select(*by, F.split_part("name", F.lit("/"), F.lit(1)).alias("category"), F.split_part("name", F.lit("/"), F.lit(2)).alias("value"), F.col("value").cast("long").alias("evidence_count"), F.least(F.col("value") / 10, F.lit(1.0)).alias("confidence"))


def domains(messages: DataFrame, by: list[str] | None = None, least: int = 5) -> DataFrame:
    """The domain with most occurrences, if there are enough."""
    by = by or []
    counts = _unpivoted(once(messages, "_low", F.lower("content")), by, {d: F.sum(occurrences(F.col("content"), p)) for d, p in DOMAINS})
    top = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("value"), "name")
    rows = counts.withColumn("_n", F.row_number().over(top)).where((F.col("_n") == 1) & (F.col("value") >= least))
    return rows.select(*by, F.col("name").alias("domain"), F.col("value").cast("long").alias("evidence_count"), F.least(F.col("value") / 15, F.lit(1.0)).alias("confidence"))


def roles(messages: DataFrame, by: list[str] | None = None, least: float = 3) -> DataFrame:
    """The role that most messages hint at, by weight."""
    by = by or []
    counts = _unpivoted(once(messages, "_low", F.lower("content")), by, {r: F.count_if(holds_any(F.col("_low"), p)) * F.lit(w) for r, p, w in ROLES})
    top = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("value"), "name")
    return counts.withColumn("_n", F.row_number().over(top)).where((F.col("_n") == 1) & (F.col("value") >= least)).select(*by, F.col("name").alias("role"), F.col("value").alias("score"))


def work_patterns(messages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The eight most active hours of at least four, and whether weekdays dominate; ten messages are needed."""
    by = by or []
    at = F.timestamp_millis("created_at")
    hours = messages.groupBy(*by, F.hour(at).alias("hour")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("n"), "hour"))
    best = hours.withColumn("_n", place).where("_n <= 8").groupBy(*by).agg(F.array_sort(F.collect_list("hour")).alias("active_hours")).withColumn("active_hours", F.when(F.size("active_hours") >= 4, F.col("active_hours")))
    weekend = F.dayofweek(at).isin(1, 7)
    days = messages.groupBy(*by).agg(F.count("*").alias("messages"), F.count_if(~weekend).alias("weekday"), F.count_if(weekend).alias("weekend"))
    out = days.join(best, by) if by else days.crossJoin(best)
    return out.where("messages >= 10").withColumn("prefers_weekdays", F.col("weekday") > 3 * F.col("weekend"))


def communication_style(messages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """From at least five user messages: length, share with code, share of questions."""
    by = by or []
    own = messages.where("role = 'user'").groupBy(*by).agg(
        F.count("*").alias("messages"), F.avg(F.size(F.split(F.regexp_replace("content", r"^\s+|\s+\z", ""), r"\s+"))).alias("mean_words"),
        F.avg(F.col("content").contains("`").cast("int")).alias("code_ratio"), F.avg(F.col("content").contains("?").cast("int")).alias("question_ratio"),
    )
    length = F.when(F.col("mean_words") < 20, "concise").when(F.col("mean_words") > 100, "detailed").otherwise("balanced")
    return own.where("messages >= 5").select(*by, "messages", "mean_words", "code_ratio", "question_ratio", length.alias("style"), (F.col("code_ratio") > 0.3).alias("code_heavy"), (F.col("question_ratio") > 0.5).alias("inquisitive"))


def merge_with_existing(existing: DataFrame, mined: DataFrame) -> DataFrame:
    """(category, value, evidence_count, confidence, first_observed, last_observed): evidence is added up, confidence is the mean and 0.1, at most 1."""
    e = existing.select("category", "value", *(F.col(c).alias(f"e_{c}") for c in ("evidence_count", "confidence", "first_observed", "last_observed")))
    both = mined.join(e, ["category", "value"], "full_outer")
    known = F.col("e_confidence").isNotNull() & F.col("confidence").isNotNull()
    return both.select(
        "category", "value", (F.coalesce("evidence_count", F.lit(0)) + F.coalesce("e_evidence_count", F.lit(0))).alias("evidence_count"),
        F.when(known, F.least((F.col("confidence") + F.col("e_confidence")) / 2 + 0.1, F.lit(1.0))).otherwise(F.coalesce("confidence", "e_confidence")).alias("confidence"),
        F.least("first_observed", "e_first_observed").alias("first_observed"), F.greatest("last_observed", "e_last_observed").alias("last_observed"),
    )


def extract(messages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., category, value, evidence_count, confidence) of all families: technologies, role, domain, working hours and style."""
    by = by or []
    columns = [*by, "category", "value", "evidence_count", "confidence"]
    out = technologies(messages, by).select(*columns)
    out = out.unionByName(domains(messages, by).select(*by, F.lit("domain").alias("category"), F.col("domain").alias("value"), "evidence_count", "confidence"))
    role = roles(messages, by)
    out = out.unionByName(role.select(*by, F.lit("role").alias("category"), F.col("role").alias("value"), F.floor("score").alias("evidence_count"), F.least(F.col("score") / 10, F.lit(1.0)).alias("confidence")))
    style = communication_style(messages, by)
    out = out.unionByName(style.select(*by, F.lit("communication_style").alias("category"), F.col("style").alias("value"), F.col("messages").alias("evidence_count"), F.least(F.col("messages") / 20, F.lit(1.0)).alias("confidence")))
    days = work_patterns(messages, by)
    return out.unionByName(days.select(*by, F.lit("work_pattern").alias("category"), F.when(F.col("prefers_weekdays"), "weekdays").otherwise("any day").alias("value"), F.col("messages").alias("evidence_count"), F.least(F.col("messages") / 50, F.lit(1.0)).alias("confidence")))
