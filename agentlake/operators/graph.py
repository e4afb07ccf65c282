"""The context graph: relationships between messages and entities, traversal and measures.

An edge has source_type, source_id, target_type, target_id, relationship_type, strength,
created_at.  A node's key is 'type:id'.  "Either end" joins are written as two equi-joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settle
from ..functions.text import once
from .entities import entity_id, mentions, merged, merged_again, person_key, type_of
from .updates import holds_any

LOOKBACK, FLOOR, WINDOW = 10, 0.5, 3_600_000
REFERENCES = r"(?i)(?:as (?:they|we|you|i) (?:noted|said|mentioned)|like \w+ said|mentioned (?:previously|earlier|above)|(?:check|see) (?:earlier|previous|above)|following up on|regarding (?:the|your) (?:message|comment|question))"
#: What a text must hold (in lower case) for REFERENCES to match; the regular expression runs over such texts alone.
REFERENCE_HINTS = "noted|said|mentioned|earlier|previous|above|following up on|regarding the|regarding your"
EDGE = ["source_type", "source_id", "target_type", "target_id", "relationship_type", "strength", "created_at"]


def _edge(source: Column, target: Column, kind: str | Column, strength: Column, at: Column, source_type: str = "message", target_type: str = "message") -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [F.lit(source_type).alias("source_type"), source.alias("source_id"), F.lit(target_type).alias("target_type"), target.alias("target_id"), kind.alias("relationship_type"), strength.cast("double").alias("strength"), at.alias("created_at")]


def mention_edges(per_message: DataFrame) -> DataFrame:
    """Message to entity, as strong as the mention is sure."""
    return per_message.select(*_edge(F.col("message_id"), F.col("entity_id"), "mentions", F.col("confidence"), F.col("last_mentioned"), "message", "entity"))


def _before(rows: DataFrame, carried: list[str], lookback: int, where: str = "true") -> DataFrame:
    """rows with ``_then`` (the carried columns of a message before it) and ``_back``, for each of the lookback ones before it.

    One window, so that every message is moved once and not once for each of its successors.
    """
    own = Window.partitionBy("conversation_id").orderBy("sequence_num")
    then = F.array(*(F.lag(F.struct(*carried), k).over(own) for k in range(1, lookback + 1)))
    found = rows.where("conversation_id IS NOT NULL").withColumn("_n", F.row_number().over(own)).withColumn("_before", then).where(where)
    return found.select(*rows.columns, "_n", F.posexplode("_before").alias("_back", "_then")).where("_then IS NOT NULL")


def predecessors(messages: DataFrame, lookback: int = LOOKBACK, carried: list[str] | None = None) -> DataFrame:
    """Pairs (message, one of the lookback messages before it in the conversation), gaps in numbering aside, each with the carried columns."""
    names = ["message_id", *(carried if carried is not None else ["role", "content", "created_at"])]
    pairs = _before(messages.select("conversation_id", "sequence_num", *names), names, lookback)
    return pairs.select("conversation_id", "_n", *names, *(F.col(f"_then.{c}").alias(f"prev_{c}") for c in names), (F.col("_n") - F.col("_back") - 1).alias("prev_n"))


def message_edges(messages: DataFrame, lookback: int = LOOKBACK, window: int = WINDOW, explicit: bool = True) -> DataFrame:
    """Explicit references, else continuations, else answers; what counts of a text is read once, and texts stay where they are."""
    refers = F.when(holds_any(F.col("_low"), REFERENCE_HINTS), F.col("content").rlike(REFERENCES)).otherwise(F.lit(False)) & F.lit(explicit)
    marks = {"_refers": refers, "_short": F.length("content") < 50, "_asks": F.col("content").contains("?")}
    marked = once(messages, "_low", F.lower("content")).select("conversation_id", "sequence_num", "message_id", "role", "created_at", *(c.alias(n) for n, c in marks.items()))
    pairs = predecessors(marked, lookback, ["role", "created_at", *marks])
    gap = F.col("created_at") - F.col("prev_created_at")
    refers = F.col("_refers")
    goes_on = (gap <= window) & (F.col("role") == F.col("prev_role")) & (gap < 60_000)
    answers = F.col("prev__asks") & (F.col("role") != F.col("prev_role")) & (gap < 300_000)
    kind = F.when(refers, "references").when(goes_on, "continues").when(answers, "answers")
    strength = F.when(refers, 0.9).when(goes_on, F.when(F.col("_short"), 0.85).otherwise(0.75)).when(answers, 0.8)
    return pairs.withColumn("_kind", kind).where("_kind IS NOT NULL").select(*_edge(F.col("message_id"), F.col("prev_message_id"), F.col("_kind"), strength, F.col("created_at")))


def within_message(per_message: DataFrame, mention: bool = True, co_occurrence: bool = True, typed: bool = True) -> DataFrame:
    """Edges of the entities of each message: mentions, co-occurrences and edges by type, from one grouping by message and no join."""
    if not (co_occurrence or typed):
        return mention_edges(per_message).where(F.lit(mention))
    one = F.struct("position", "entity_id", "entity_type", "confidence", "last_mentioned")
    own = per_message.where("message_id IS NOT NULL" if not mention else "true").groupBy("message_id").agg(F.collect_list(one).alias("_own"))
    pairs = own.select("message_id", "_own", F.posexplode("_own").alias("_i", "a")).select("message_id", "_i", "a", F.posexplode("_own").alias("_j", "b"))
    a, b = F.col("a"), F.col("b")
    known = F.col("message_id").isNotNull()
    decision = (a["entity_type"] == "decision") & b["entity_type"].isin("topic", "project")
    action = (a["entity_type"] == "action") & (b["entity_type"] == "project")
    between = lambda kind, strength: F.struct(*_edge(a["entity_id"], b["entity_id"], kind, strength, a["last_mentioned"], "entity", "entity"))
    found = []
    if mention:
        found.append(F.when(F.col("_i") == F.col("_j"), F.struct(*_edge(F.col("message_id"), a["entity_id"], "mentions", a["confidence"], a["last_mentioned"], "message", "entity"))))
    if co_occurrence:
        found.append(F.when(known & (a["position"] < b["position"]), between("relates_to", F.least(a["confidence"], b["confidence"]) * 0.6)))
    if typed:
        found.append(F.when(known & (decision | action), between(F.when(decision, "decision_about").otherwise("action_item"), F.when(decision, 0.75).otherwise(0.8))))
    return pairs.select(F.explode(F.array(*found)).alias("e")).where("e IS NOT NULL").select("e.*")


def co_occurrence(per_message: DataFrame) -> DataFrame:
    """Pairs of entities within a message, from the one that was found first, 0.6 of the lesser confidence."""
    return within_message(per_message, mention=False, typed=False)


def typed_edges(per_message: DataFrame) -> DataFrame:
    """Decisions about topics and projects, and actions for projects."""
    return within_message(per_message, mention=False, co_occurrence=False)


def overlap_edges(messages: DataFrame, per_message: DataFrame, lookback: int = LOOKBACK, window: int = WINDOW) -> DataFrame:
    """Messages near in time that share entities: 0.7 of the Jaccard index, if that is over 0.3."""
    sets = per_message.groupBy("message_id").agg(F.collect_set("entity_id").alias("set"))
    rows = messages.select("conversation_id", "sequence_num", "message_id", "created_at").join(sets, "message_id", "left")
    pairs = _before(rows, ["message_id", "created_at", "set"], lookback, "set IS NOT NULL")
    near = pairs.where((F.col("_then.set").isNotNull()) & (F.col("created_at") - F.col("_then.created_at") <= window))
    shared = F.size(F.array_intersect("set", F.col("_then.set")))
    j = near.withColumn("_j", shared / (F.size("set") + F.size("_then.set") - shared))
    return j.where("_j > 0.3").select(*_edge(F.col("message_id"), F.col("_then.message_id"), "relates_to", F.col("_j") * 0.7, F.col("created_at")))


@dataclass(frozen=True)
class Options:
    """What detection looks for, and how far."""

    lookback: int = LOOKBACK
    window: int = WINDOW
    min_strength: float = FLOOR
    explicit: bool = True
    co_occurrence: bool = True
    typed: bool = True
    overlap: bool = True
    resolve: bool = False


def detect(messages: DataFrame, per_message: DataFrame, options: Options | None = None) -> DataFrame:
    """All edges of messages and of the entities in each; edges below the floor are dropped."""
    o = options or Options()
    edges = within_message(per_message, True, o.co_occurrence, o.typed).unionByName(message_edges(messages, o.lookback, o.window, o.explicit))
    if o.overlap:
        edges = edges.unionByName(overlap_edges(messages, per_message, o.lookback, o.window))
    return edges.where(F.col("strength") >= o.min_strength)


def edge_stats(edges: DataFrame) -> DataFrame:
    """What detection found: edges and mean strength by type."""
    return edges.groupBy("relationship_type").agg(F.count("*").alias("edges"), F.avg("strength").alias("mean_strength"))


def build(messages: DataFrame, min_strength: float = FLOOR, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of all messages in one batch; with ``options.resolve``, people go by their resolved names."""
    o = options or Options(min_strength=min_strength)
    found = mentions(messages)
    if o.resolve:
        kind = F.col("entity_type")
        found = found.withColumn("canonical_name", F.when(kind == "person", person_key(F.col("canonical_name"))).otherwise(F.col("canonical_name")))
        found = found.withColumn("entity_id", entity_id(kind, F.col("canonical_name")))
    per_message = settle(merged(found, ["message_id"], again=True))
    return merged_again(per_message), detect(messages, per_message, o)


def upsert_entities(known: DataFrame, new: DataFrame) -> DataFrame:
    """known with new entities added, or merged into those of the same id: counts are summed, times widened, the first name kept."""
    both = known.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("entity_id", "entity_type", "canonical_name").agg(
        F.min_by("name", "_age").alias("name"), F.sum("mention_count").alias("mention_count"), F.max("confidence").alias("confidence"), F.min("first_mentioned").alias("first_mentioned"), F.max("last_mentioned").alias("last_mentioned"),
    )


def previous_messages(messages: DataFrame, targets: DataFrame, n: int = LOOKBACK) -> DataFrame:
    """(target_id, message_id, distance): the n messages before each target in its conversation."""
    pairs = predecessors(messages, n).join(targets.select("message_id").distinct(), "message_id", "left_semi")
    return pairs.select(F.col("message_id").alias("target_id"), F.col("prev_message_id").alias("message_id"), (F.col("_n") - F.col("prev_n")).cast("int").alias("distance"))


def message_entities(per_message: DataFrame) -> DataFrame:
    """(message_id, entities): the ids of each message's entities, in order."""
    return per_message.groupBy("message_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))


def entity_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Each entity with the number of edges at either of its ends; a loop counts once."""
    source, target = (F.when(F.col(f"{end}_type") == "entity", F.col(f"{end}_id")) for end in ("source", "target"))
    ends = edges.select(F.explode(F.array(source, F.when(source.isNull() | (target != source), target))).alias("entity_id"))
    counts = ends.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.count("*").alias("connection_count"))
    return entities.select("entity_id", "entity_type", "name", "mention_count").join(counts, "entity_id", "left").fillna({"connection_count": 0})


def relationships(edges: DataFrame, entities: DataFrame | None, node: str | None = None, min_strength: float = 0.0) -> DataFrame:
    """Edges between entities with the names of both, of one node (at either end) or of all, the strongest first.

    Without entities there are no names, and nothing is joined: all edges between entities count.
    """
    own = edges.where((F.col("source_type") == "entity") & (F.col("target_type") == "entity") & (F.col("strength") >= min_strength))
    own = own if node is None else own.where((F.col("source_id") == node) | (F.col("target_id") == node))
    names = [] if entities is None else ["source_name", "target_name"]
    for end in ("source", "target") if names else ():
        own = own.join(entities.select(F.col("entity_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id")
    return own.select("source_id", *names[:1], "relationship_type", "target_id", *names[1:], "strength").orderBy(F.desc("strength"), "source_id", "target_id")


def node_data(nodes: DataFrame, messages: DataFrame, entities: DataFrame) -> DataFrame:
    """(node, kind, text) of nodes 'message:id' and 'entity:id'; unknown ones are left out."""
    m = messages.select(F.concat(F.lit("message:"), "message_id").alias("node"), F.lit("message").alias("kind"), F.col("content").alias("text"))
    e = entities.select(F.concat(F.lit("entity:"), "entity_id").alias("node"), F.col("entity_type").alias("kind"), F.col("name").alias("text"))
    return nodes.select("node").distinct().join(m.unionByName(e), "node")


def mean_confidence(entities: DataFrame) -> DataFrame:
    return entities.agg(F.coalesce(F.avg("confidence"), F.lit(1.0)).alias("confidence"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: node, other, relationship_type, strength."""
    a, b = F.concat_ws(":", "source_type", "source_id"), F.concat_ws(":", "target_type", "target_id")
    one = edges.select(a.alias("node"), b.alias("other"), "relationship_type", "strength")
    return one.unionByName(edges.select(b.alias("node"), a.alias("other"), "relationship_type", "strength"))


def related(edges: DataFrame, starts: DataFrame, max_depth: int = 3, max_results: int = 50, min_strength: float = FLOOR, types: list[str] | None = None) -> DataFrame:
    """Breadth-first from each start (column ``node``): start, node, depth, path (relationship types).

    One join a level for all starts together; of several ways to a node at its least
    depth, that of the strongest edges, in order of strength and name, is kept.
    """
    steps = both_ways(edges.where(F.col("strength") >= min_strength))
    steps = settle(steps.where(F.col("relationship_type").isin(types)) if types else steps)
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.expr("cast(array() as array<string>)").alias("path"), F.expr("cast(array() as array<double>)").alias("_way"))
    seen = frontier = settle(seen.distinct())
    for depth in range(1, max_depth + 1):
        step = frontier.join(steps, "node").select("start", F.col("other").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("relationship_type")).alias("path"), F.concat("_way", F.array(-F.col("strength"))).alias("_way"))
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = settle(step.groupBy("start", "node", "depth").agg(F.min_by("path", F.struct("_way", "path")).alias("path"), F.min("_way").alias("_way")))
        if not frontier.limit(1).count():
            break
        seen = settle(seen.unionByName(frontier.select(*seen.columns)))
    place = F.row_number().over(Window.partitionBy("start").orderBy("depth", "_way", "node"))
    return seen.withColumn("_n", place).where(F.col("_n") <= max_results).drop("_n", "_way")


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int = 5, min_strength: float = FLOOR) -> list[str] | None:
    """Nodes of a shortest path, or None."""
    steps = settle(both_ways(edges.where(F.col("strength") >= min_strength)).select("node", "other").distinct())
    frontier = steps.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = frontier.select("node")
    for _ in range(max_depth + 1):
        if hit := frontier.where(F.col("node") == goal).orderBy("path").first():
            return hit["path"]
        step = frontier.join(steps, "node").select(F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path")).join(seen, "node", "left_anti")
        frontier = settle(step.groupBy("node").agg(F.min("path").alias("path")))
        if not frontier.limit(1).count():
            return None
        seen = settle(seen.union(frontier.select("node")))
    return None


def neighbours(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    """One hop, strongest first; an edge counts each time."""
    out = both_ways(edges).where(F.col("node") == node)
    out = out.where(F.col("relationship_type") == kind) if kind else out
    return out.orderBy(F.desc("strength"), "other")


def strongly_connected(edges: DataFrame, entities: DataFrame, node: str, min_strength: float = 0.75, limit: int = 10) -> DataFrame:
    """The limit applies before entities are looked up, so that there may be fewer."""
    best = both_ways(edges.where(F.col("strength") >= min_strength)).where(F.col("node") == node).orderBy(F.desc("strength"), "other").limit(limit)
    return best.join(entities, F.concat(F.lit("entity:"), F.col("entity_id")) == F.col("other"))


def density(edges: DataFrame) -> DataFrame:
    """Nodes, edges, 2E / (N (N - 1)) and 2E / N; nodes are merged by id whatever their type."""
    nodes = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct().agg(F.count("*").alias("nodes"))
    both = nodes.crossJoin(edges.agg(F.count("*").alias("edges")))
    n, e = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return both.select("nodes", "edges", F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"), F.when(n > 0, 2 * e / n).otherwise(F.lit(0.0)).alias("average_degree"))


def centrality(edges: DataFrame, entities: DataFrame, limit: int | None = 20) -> DataFrame:
    """Degree and summed strength of each entity; a loop counts once."""
    a, b = (edges.where(F.col(f"{end}_type") == "entity").select(F.col(f"{end}_id").alias("entity_id"), "strength", "source_id", "target_id") for end in ("source", "target"))
    ends = a.unionByName(b.where("NOT (source_id <=> target_id)")).groupBy("entity_id").agg(F.count("*").alias("degree"), F.sum("strength").alias("strength"))
    out = entities.select("entity_id", "name", "entity_type").join(ends, "entity_id", "left").fillna({"degree": 0, "strength": 0.0}).orderBy(F.desc("degree"), F.desc("strength"), "entity_id")
    return out if limit is None else out.limit(limit)


def graph_stats(entities: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Entities by type, edges and their mean strength.

    Without entities, those that messages mention by the edges are counted, in the same look at the edges.
    """
    by_type = lambda kind: [F.count_if(kind == t).alias(f"{t}s") for t in ("person", "topic", "decision", "action", "question", "project")]
    if entities is not None:
        one = entities.agg(F.count("*").alias("entities"), *by_type(F.col("entity_type")))
        return one.crossJoin(edges.agg(F.count("*").alias("edges"), F.avg("strength").alias("mean_strength")))
    mentioned = F.when((F.col("relationship_type") == "mentions") & (F.col("target_type") == "entity"), F.col("target_id"))
    own = edges.groupBy(mentioned.alias("entity_id")).agg(F.count("*").alias("_edges"), F.count("strength").alias("_known"), F.sum("strength").alias("_sum"))
    number, mean = F.coalesce(F.sum("_edges"), F.lit(0)), F.try_divide(F.sum("_sum"), F.sum("_known"))
    return own.agg(F.count("entity_id").alias("entities"), *by_type(type_of(F.col("entity_id"))), number.alias("edges"), mean.alias("mean_strength"))


def recent_activity(found: DataFrame, as_of: int, hours: int = 24) -> DataFrame:
    """Entities mentioned in the last hours and in how many messages."""
    return found.where(F.col("created_at") > as_of - hours * 3_600_000).groupBy("entity_id", "entity_type").agg(F.countDistinct("message_id").alias("recent_messages"))


def without_conversation(entities: DataFrame, edges: DataFrame, messages: DataFrame, conversation_id: object) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) without a conversation: orphans are found before its edges go."""
    own = messages.where(F.col("conversation_id") == conversation_id).select(F.col("message_id").alias("_id"))
    touching = edges.join(own, ((F.col("source_type") == "message") & (F.col("source_id") == F.col("_id"))), "left_semi").unionByName(edges.join(own, ((F.col("target_type") == "message") & (F.col("target_id") == F.col("_id"))), "left_semi")).distinct()
    rest = edges.join(touching, EDGE, "left_anti")
    used = rest.where("relationship_type = 'mentions'").select(F.col("target_id").alias("entity_id")).distinct()
    orphaned = touching.where("relationship_type = 'mentions'").select(F.col("target_id").alias("entity_id")).distinct().join(used, "entity_id", "left_anti")
    kept = rest.join(orphaned.select(F.col("entity_id").alias("source_id")), "source_id", "left_anti").join(orphaned.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti")
    return entities.join(orphaned, "entity_id", "left_anti"), kept.select(*EDGE)
