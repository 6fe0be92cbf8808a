"""Directed provenance graphs: build, validate, search, traverse, mirror, merge.

nodes: (node_id, kind, type, label, document_id); edges: (edge_id, source, target, relation, description, confidence);
provenance: (edge_id, ordinal, node_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlex.functions import text as X


#: Frontiers of a traversal up to this bound are broadcast.
BROADCAST_NODES = 10_000


def edge_id(source, relation, target):
    return F.concat(F.lit("E_"), F.substring(F.sha2(F.concat_ws("\0", source, relation, target), 256), 1, 16))


def structural(nodes: DataFrame, next_edges: DataFrame) -> DataFrame:
    """(source, target, relation): CONTAINS from parent links and NEXT between neighbours."""
    contains = nodes.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"), F.lit("CONTAINS").alias("relation"))
    return contains.unionByName(next_edges.select("source", "target", F.lit("NEXT").alias("relation")))


def validate(nodes: DataFrame, edges: DataFrame, provenance: DataFrame) -> DataFrame:
    """(id, code): repeated ids, self loops, dangling ends, confidence out of range, edges without provenance."""
    twice = lambda df, c, code: df.groupBy(F.col(c).alias("id")).count().where("count > 1").select("id", F.lit(code).alias("code"))
    ids = nodes.select(F.col("node_id").alias("end"))
    ends = edges.select("edge_id", F.explode(F.array("source", "target")).alias("end"))
    out = twice(nodes, "node_id", "DUPLICATE_NODE").unionByName(twice(edges, "edge_id", "DUPLICATE_EDGE"))
    out = out.unionByName(edges.where("source = target").select(F.col("edge_id").alias("id"), F.lit("SELF_LOOP").alias("code")))
    out = out.unionByName(edges.where("confidence is null or confidence < 0 or confidence > 1").select(F.col("edge_id").alias("id"), F.lit("BAD_CONFIDENCE").alias("code")))
    out = out.unionByName(ends.join(ids, "end", "left_anti").select(F.col("edge_id").alias("id"), F.lit("DANGLING").alias("code")).distinct())
    return out.unionByName(edges.join(provenance.select("edge_id"), "edge_id", "left_anti").select(F.col("edge_id").alias("id"), F.lit("NO_PROVENANCE").alias("code")))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): nodes by kind and edges by relation."""
    return nodes.groupBy(F.concat(F.lit("node:"), "kind").alias("what")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.concat(F.lit("edge:"), "relation").alias("what")).agg(F.count("*").alias("n")))


def search(nodes: DataFrame, aliases: DataFrame, q: str, kind: str | None = None, type_: str | None = None, limit: int = 20) -> DataFrame:
    """Label or approved alias contains q, case aside: exact labels first, then short ones, then by id."""
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    named = aliases.where((F.col("status") == "approved") & F.col("alias").ilike(pattern)).select("node_id").distinct().withColumn("by_alias", F.lit(True))
    rows = nodes.join(named, "node_id", "left").where(F.col("label").ilike(pattern) | F.col("by_alias"))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if type_ is not None:
        rows = rows.where(F.col("type") == type_)
    exact = F.when(F.lower("label") == q.lower(), 0).otherwise(1)
    return rows.select("node_id", "kind", "type", "label", "document_id").orderBy(exact, F.char_length("label"), "node_id").limit(limit)


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("source") == node_id) | (F.col("target") == node_id)).orderBy("relation", "edge_id")


def subgraph(edges: DataFrame, start: str, depth: int = 1, relations: list[str] | None = None, max_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """Undirected neighbourhood: (node_id, level, place) in breadth-first order and the edges met on the way.

    A node's place is that of the first (level, finder's place, edge id) that reaches it, so max_nodes cuts as a queue
    would; edges of visited nodes above the last level count even if their far end is beyond max_nodes."""
    if not 0 <= depth <= 3 or max_nodes < 1:
        raise ValueError("depth is 0 to 3 and max_nodes positive")
    use = edges.where(F.col("relation").isin(relations)) if relations else edges
    ways = use.select("edge_id", F.col("source").alias("node_id"), F.col("target").alias("far")).unionByName(use.select("edge_id", F.col("target").alias("node_id"), F.col("source").alias("far")))
    spark = edges.sparkSession
    # the frontier holds max_nodes rows at most: broadcast it where that bound is small, else leave the choice to Spark
    small = F.broadcast if max_nodes <= BROADCAST_NODES else lambda df: df
    seen = spark.createDataFrame([(start, 0, 0)], "node_id string, level int, place long")
    met = None
    for level in range(depth):
        frontier = seen.where(F.col("level") == level)
        steps = ways.join(small(frontier.select("node_id", "place")), "node_id")
        met = steps.select("edge_id") if met is None else met.unionByName(steps.select("edge_id"))
        new = steps.join(small(seen.select(F.col("node_id").alias("far"))), "far", "left_anti")
        first = new.groupBy("far").agg(F.min(F.struct("place", "edge_id")).alias("at"))
        numbered = first.select(F.col("far").alias("node_id"), F.lit(level + 1).alias("level"), "at").orderBy("at", "node_id").limit(max_nodes)
        w = Window.orderBy("at", "node_id")
        numbered = numbered.withColumn("place", F.row_number().over(w).cast("long") + (level + 1) * 10_000_000).select("node_id", "level", "place")
        seen = seen.unionByName(numbered).orderBy("level", "place").limit(max_nodes)
    found = use.join(met.distinct(), "edge_id", "left_semi") if met is not None else use.limit(0)
    return seen, found


def mirror(edges: DataFrame, provenance: DataFrame) -> DataFrame:
    """Undirected pairs (left, right, relations, description, weight, edge_ids): weight is the number of distinct sources, 1 at least."""
    rows = edges.withColumn("left", F.least("source", "target")).withColumn("right", F.greatest("source", "target"))
    line = F.trim(F.concat(F.lit("["), "source", F.lit(" -"), "relation", F.lit("-> "), "target", F.lit("] "), F.coalesce("description", F.lit(""))))
    pairs = rows.groupBy("left", "right").agg(
        F.array_join(F.array_sort(F.collect_set("relation")), ", ").alias("relations"),
        F.transform(F.array_sort(F.collect_list(F.struct("edge_id", line.alias("line")))), lambda x: x["line"]).alias("lines"),
        F.array_sort(F.collect_list("edge_id")).alias("edge_ids"),
    )
    said = rows.join(provenance, "edge_id").groupBy("left", "right").agg(F.countDistinct("node_id").alias("sources"))
    out = pairs.join(said, ["left", "right"], "left")
    return out.select("left", "right", "relations", F.array_join("lines", "\n").alias("description"), F.greatest(F.coalesce("sources", F.lit(0)), F.lit(1)).cast("double").alias("weight"), "edge_ids")


def alias_table(nodes: DataFrame) -> DataFrame:
    """(node_id, normalized, alias): nodes (node_id, aliases); the first alias of each normal form."""
    rows = nodes.select("node_id", F.posexplode("aliases").alias("pos", "alias")).withColumn("normalized", X.normalize_reference(F.col("alias"))).where("normalized <> ''")
    return rows.groupBy("node_id", "normalized").agg(F.min(F.struct("pos", "alias")).getField("alias").alias("alias"))


def provenance_of(provenance: DataFrame) -> DataFrame:
    """(edge_id, citations): distinct cited nodes in order."""
    listed = provenance.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "node_id"))).alias("p"))
    return listed.select("edge_id", F.array_distinct(F.transform("p", lambda x: x["node_id"])).alias("citations"))


def merge_nodes(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of several loads (node_id, kind, type, label, batch): the merged nodes, the last load's label winning, and the
    ids whose kind or type disagrees."""
    per = batches.groupBy("node_id").agg(F.countDistinct(F.struct("kind", "type")).alias("n"), F.max(F.struct("batch", "kind", "type", "label")).alias("last"))
    return per.where("n = 1").select("node_id", "last.kind", "last.type", "last.label"), per.where("n > 1").select("node_id")


def semantic(extracted: DataFrame, texts: DataFrame, nodes: DataFrame, relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """extracted: (row, source, target, relation, evidence, node_id). Accepted edges, merged by id with their provenance,
    and rejected rows with the first reason that applies."""
    known = nodes.select("node_id")
    rows = extracted.join(texts.select("node_id", F.col("text").alias("said")), "node_id", "left")
    for end in ("source", "target"):
        rows = rows.join(known.select(F.col("node_id").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    reason = F.when(~F.col("relation").isin(relations), "UNKNOWN_RELATION").when(F.col("said").isNull(), "UNKNOWN_SOURCE").when(F.instr("said", F.col("evidence")) == 0, "EVIDENCE_NOT_FOUND").when(F.col("has_source").isNull() | F.col("has_target").isNull(), "UNKNOWN_END").when(F.col("source") == F.col("target"), "SELF_LOOP")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").withColumn("edge_id", edge_id(F.col("source"), F.col("relation"), F.col("target")))
    offset = F.instr("said", F.col("evidence")) - 1
    merged = good.groupBy("edge_id").agg(F.first("source").alias("source"), F.first("target").alias("target"), F.first("relation").alias("relation"), F.array_sort(F.collect_set(F.struct("node_id", offset.alias("start")))).alias("provenance"))
    return merged, rows.where("reason is not null").select("row", "reason")


def semantic_entities(extracted: DataFrame, texts: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """extracted: (article_id, row, local_key, kind, label, aliases, provenance (node_id, evidence)); texts: (article_id,
    node_id, text). Rows count in the order of `row` within an article.

    Entities (article_id, kind, label, aliases, provenance (node_id, start, end)), equal ones merged; and rejected
    (article_id, row, reason): UNKNOWN_ENTITY_TYPE, one of CROSS_ARTICLE_PROVENANCE and EVIDENCE_NOT_IN_CANONICAL_TEXT
    for each place that does not hold, NO_VALID_PROVENANCE where none does, and DUPLICATE_LOCAL_KEY where an earlier
    entity has the key and another kind or label."""
    keys = ["article_id", "row"]
    known = F.col("kind").isin(types)
    unknown = extracted.where(~known).select(*keys, F.lit("UNKNOWN_ENTITY_TYPE").alias("reason"))
    rows = extracted.where(known)
    places = rows.select(*keys, F.posexplode("provenance").alias("at", "p")).select(*keys, "at", "p.node_id", "p.evidence")
    places = places.join(texts.select("article_id", "node_id", "text"), ["article_id", "node_id"], "left").withColumn("start", F.instr("text", F.col("evidence")) - 1)
    problem = F.when(F.col("text").isNull(), "CROSS_ARTICLE_PROVENANCE").when(F.col("start") < 0, "EVIDENCE_NOT_IN_CANONICAL_TEXT")
    places = places.withColumn("reason", problem)
    place = F.struct("at", "node_id", "start", (F.col("start") + F.char_length("evidence")).alias("end"))
    held = places.where("reason is null").groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("held"))
    rows = rows.join(held, keys, "left")
    bare = rows.where("held is null").select(*keys, F.lit("NO_VALID_PROVENANCE").alias("reason"))
    first = F.first(F.struct("kind", "label")).over(Window.partitionBy("article_id", "local_key").orderBy("row"))
    rows = rows.where("held is not null").withColumn("same", F.struct("kind", "label") == first)
    twice = rows.where("not same").select(*keys, F.lit("DUPLICATE_LOCAL_KEY").alias("reason"))
    listed = rows.where("same").groupBy("article_id", "kind", "label").agg(F.array_sort(F.collect_list(F.struct("row", "aliases", "held"))).alias("r"))
    flat = lambda c: F.array_distinct(F.flatten(F.transform("r", lambda x: x[c])))
    spots = F.array_distinct(F.transform(flat("held"), lambda x: F.struct(x["node_id"].alias("node_id"), x["start"].alias("start"), x["end"].alias("end"))))
    rejected = unknown.unionByName(places.where("reason is not null").select(*keys, "reason")).unionByName(bare).unionByName(twice)
    return listed.select("article_id", "kind", "label", flat("aliases").alias("aliases"), spots.alias("provenance")), rejected


#: Allowed changes of a release's state.
TRANSITIONS = (("BUILDING", "VALIDATING"), ("VALIDATING", "READY"), ("READY", "ACTIVE"), ("ACTIVE", "RETIRED"), ("RETIRED", "ACTIVE"))


def bad_transitions(history: DataFrame) -> DataFrame:
    """history: (release_id, step, state). Steps whose change is not allowed."""
    w = Window.partitionBy("release_id").orderBy("step")
    rows = history.withColumn("before", F.lag("state").over(w)).where("before is not null")
    ok = F.lit(False)
    for a, b in TRANSITIONS:
        ok = ok | ((F.col("before") == a) & (F.col("state") == b))
    return rows.where(~ok).select("release_id", "step", "before", "state")


def activate(releases: DataFrame, release_id: str) -> DataFrame:
    """The release table after activation: one ACTIVE, the former one RETIRED. Only READY or RETIRED ones can be activated."""
    state = F.when((F.col("release_id") == release_id) & F.col("state").isin("READY", "RETIRED"), "ACTIVE").when((F.col("state") == "ACTIVE") & (F.col("release_id") != release_id), "RETIRED").otherwise(F.col("state"))
    return releases.withColumn("state", state)
