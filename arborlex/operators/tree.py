"""Canonical trees as node tables: navigation, closure, leaves, content, violations.

A node row has document_id, node_id, parent_id, type, ordinal (place in document order, unique in its document) and
text. Depth is bounded by the hierarchy (MAX_DEPTH levels), so closures are that many equi-joins at most, each on
(document_id, node_id): no recursion on the driver, no path strings to compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlex.functions import text as X

MAX_DEPTH = 8


def document_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("document_id", "ordinal")


def children(nodes: DataFrame) -> DataFrame:
    """(document_id, node_id, children_ids): children in document order, for nodes that have any."""
    own = nodes.where(F.col("parent_id").isNotNull()).groupBy("document_id", F.col("parent_id").alias("node_id"))
    return own.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("node_id").alias("id")))), lambda x: x["id"]).alias("children_ids"))


def closure(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(document_id, ancestor_id, node_id, distance) of every node and itself or an ancestor."""
    up = nodes.where(F.col("parent_id").isNotNull()).select("document_id", F.col("node_id").alias("ancestor_id"), F.col("parent_id").alias("above"))
    step = nodes.select("document_id", F.col("node_id").alias("ancestor_id"), "node_id", F.lit(0).alias("distance"))
    out = step
    for k in range(1, max_depth):
        step = step.join(up, ["document_id", "ancestor_id"]).select("document_id", F.col("above").alias("ancestor_id"), "node_id", F.lit(k).alias("distance"))
        out = out.unionByName(step)
    return out


def ancestors(nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(document_id, node_id, ancestor_ids), nearest first."""
    rows = closure(nodes, depth).where("distance > 0").groupBy("document_id", "node_id")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "ancestor_id"))), lambda x: x["ancestor_id"]).alias("ancestor_ids"))


def descendants(nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(document_id, node_id, descendant_ids) in document order."""
    rows = closure(nodes, depth).where("distance > 0").join(nodes.select("document_id", "node_id", "ordinal"), ["document_id", "node_id"])
    rows = rows.groupBy("document_id", F.col("ancestor_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "node_id"))), lambda x: x["node_id"]).alias("descendant_ids"))
    return rows.withColumnRenamed("id", "node_id")


def nearest_of_type(nodes: DataFrame, kind: str, depth: int = MAX_DEPTH) -> DataFrame:
    """(document_id, node_id, found): the node itself or its nearest ancestor of that type."""
    typed = nodes.where(F.col("type") == kind).select("document_id", F.col("node_id").alias("ancestor_id"))
    found = closure(nodes, depth).join(typed, ["document_id", "ancestor_id"])
    return found.groupBy("document_id", "node_id").agg(F.min(F.struct("distance", "ancestor_id")).getField("ancestor_id").alias("found"))


def is_ancestor(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keeps the pairs (document_id, ancestor_id, node_id) that hold, the node itself excluded."""
    return pairs.join(closure(nodes).where("distance > 0").drop("distance"), ["document_id", "ancestor_id", "node_id"], "left_semi")


def typed_targets(edges: DataFrame, relation: str, reverse: bool = False) -> DataFrame:
    """edges: (position, source_id, target_id, relation). (node_id, found_ids) in the order of edges: what nodes refer to or
    amend, or, reversed, what repeals them."""
    here, there = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    own = edges.where(F.col("relation") == relation).groupBy(F.col(here).alias("node_id"))
    return own.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(there).alias("id")))), lambda x: x["id"]).alias("found_ids"))


def required_with_children(targets: DataFrame, nodes: DataFrame, kind: str = "point") -> DataFrame:
    """targets: (document_id, node_id). Adds required_ids: the node itself, then its children of that type in order."""
    below = children(nodes.where(F.col("type") == kind))
    rest = F.coalesce("children_ids", F.array().cast("array<string>"))
    return targets.join(below, ["document_id", "node_id"], "left").withColumn("required_ids", F.concat(F.array("node_id"), rest)).drop("children_ids")


def leaf_targets(nodes: DataFrame) -> DataFrame:
    """Points, clauses without points and articles without clauses, with their own columns."""
    parents = lambda kind: nodes.where(F.col("type") == kind).select("document_id", F.col("parent_id").alias("node_id")).distinct()
    points = nodes.where("type = 'point'")
    clauses = nodes.where("type = 'clause'").join(parents("point"), ["document_id", "node_id"], "left_anti")
    articles = nodes.where("type = 'article'").join(parents("clause"), ["document_id", "node_id"], "left_anti")
    return points.unionByName(clauses.select(points.columns)).unionByName(articles.select(points.columns))


def subtree_content(nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(document_id, node_id, content, source_node_ids): non-blank texts of a subtree in order, joined by newlines."""
    said = nodes.where(F.trim("text") != "").select("document_id", "node_id", "ordinal", F.trim("text").alias("text"))
    rows = closure(nodes, depth).join(said, ["document_id", "node_id"]).groupBy("document_id", F.col("ancestor_id").alias("id"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("ordinal", "node_id", "text"))).alias("parts"))
    content = F.array_join(F.transform("parts", lambda x: x["text"]), "\n")
    return listed.select("document_id", F.col("id").alias("node_id"), content.alias("content"), F.transform("parts", lambda x: x["node_id"]).alias("source_node_ids"))


#: Types that may stand directly under each type.
ALLOWED_PARENTS = {"chapter": ("document",), "section": ("document", "chapter"), "article": ("document", "chapter", "section"), "clause": ("article",), "point": ("clause",)}


def violations(nodes: DataFrame) -> DataFrame:
    """(document_id, node_id, code): duplicate ids, dangling parents, parents of a wrong type, unreachable nodes."""
    keys = ["document_id", "node_id"]
    twice = nodes.groupBy(*keys).count().where("count > 1").select(*keys, F.lit("DUPLICATE_NODE_ID").alias("code"))
    above = nodes.select("document_id", F.col("node_id").alias("parent_id"), F.col("type").alias("parent_type")).dropDuplicates(["document_id", "parent_id"])
    joined = nodes.where(F.col("parent_id").isNotNull()).join(above, ["document_id", "parent_id"], "left")
    dangling = joined.where(F.col("parent_type").isNull()).select(*keys, F.lit("DANGLING_PARENT").alias("code"))
    allowed = F.create_map(*[x for k, v in ALLOWED_PARENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wrong = joined.where(F.col("parent_type").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(allowed, "type"), F.col("parent_type")), F.lit(True)))
    wrong = wrong.select(*keys, F.lit("WRONG_PARENT_TYPE").alias("code"))
    roots = nodes.where(F.col("parent_id").isNull()).select("document_id", F.col("node_id").alias("ancestor_id"))
    reached = closure(nodes).join(roots, ["document_id", "ancestor_id"], "left_semi").select(*keys)
    lost = nodes.select(*keys).distinct().join(reached, keys, "left_anti").join(dangling.select(*keys), keys, "left_anti").select(*keys, F.lit("UNREACHABLE").alias("code"))
    return twice.unionByName(dangling).unionByName(wrong).unionByName(lost)


def next_edges(nodes: DataFrame) -> DataFrame:
    """(document_id, source, target, type): articles follow each other in a document, other types under one parent."""
    scope = F.when(F.col("type") == "article", F.lit("")).otherwise(F.col("parent_id"))
    w = Window.partitionBy("document_id", "type", "scope").orderBy("ordinal")
    rows = nodes.where("type in ('article','clause','point')").withColumn("scope", scope).withColumn("target", F.lead("node_id").over(w))
    return rows.where(F.col("target").isNotNull()).select("document_id", F.col("node_id").alias("source"), "target", "type")


def sequence_gaps(nodes: DataFrame) -> DataFrame:
    """(document_id, node_id, key, previous): numbered siblings whose number is not their predecessor's plus one."""
    scope = F.when(F.col("type") == "article", F.lit("")).otherwise(F.col("parent_id"))
    w = Window.partitionBy("document_id", "type", "scope").orderBy("ordinal")
    rows = nodes.where(F.col("key").isNotNull()).withColumn("scope", scope).withColumn("previous", F.lag("key").over(w))
    return rows.where("previous is not null and key <> previous + 1").select("document_id", "node_id", "key", "previous")


def heading_of(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("heading", X.heading(F.col("text")))
