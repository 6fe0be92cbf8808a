"""Evidence: components of passages, scout bundles, evidence of single nodes, direct evidence for resolved citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlex.functions import text as X

from . import tree

#: Fixed value: tokens that evidence may have.
MAX_TOKENS = 8192


def components(passages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(primary_id, ordinal, node_id, role, text, hash, tokens) from passages (document_id, primary_id, source_node_ids)."""
    rows = passages.select("document_id", "primary_id", F.posexplode("source_node_ids").alias("ordinal", "node_id"))
    joined = rows.join(nodes.select("document_id", "node_id", "type", F.trim("text").alias("text")), ["document_id", "node_id"])
    role = F.when(F.col("node_id") == F.col("primary_id"), "primary").when(F.col("type") == "article", "heading").otherwise(F.concat(F.lit("context_"), "type"))
    key = F.sha2(F.array_join(X.tokens(F.col("text")), " "), 256)
    return joined.select("document_id", "primary_id", "ordinal", "node_id", role.alias("role"), "text", key.alias("hash"), X.word_count(F.col("text")).alias("tokens"))


def bundles(parts: DataFrame) -> DataFrame:
    """(bundle_id, text, node_ids, tokens): components (bundle_id, ordinal, node_id, text, hash, tokens) in order, a hash
    kept at its first place only."""
    w = Window.partitionBy("bundle_id", "hash").orderBy("ordinal", "node_id")
    once = parts.withColumn("n", F.row_number().over(w)).where("n = 1")
    listed = once.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "node_id", "text"))).alias("p"), F.sum("tokens").alias("tokens"))
    return listed.select("bundle_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.array_distinct(F.transform("p", lambda x: x["node_id"])).alias("node_ids"), "tokens")


def expand(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(document_id, node_id, evidence): article heading, the clause's own text, then the node's own text; not the subtree."""
    own = targets.join(nodes.select("document_id", "node_id", "type", "text"), ["document_id", "node_id"])
    up = lambda kind, name: tree.nearest_of_type(nodes, kind).join(nodes.select("document_id", F.col("node_id").alias("found"), F.col("text").alias(name)), ["document_id", "found"]).drop("found")
    rows = own.join(up("article", "a"), ["document_id", "node_id"], "left").join(up("clause", "c"), ["document_id", "node_id"], "left")
    head = F.when(F.col("type") != "article", F.trim(X.heading(F.col("a"))))
    clause = F.when(F.col("type") == "point", F.trim("c"))
    part = lambda c: F.when(c != "", c)
    return rows.select("document_id", "node_id", F.concat_ws("\n", part(head), part(clause), part(F.trim("text"))).alias("evidence"))


def structural_gold(hits: DataFrame, gold: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds exact and structural to hits (query_id, document_id, node_id): a gold node itself, or above or below one."""
    up = tree.closure(nodes).drop("distance")
    near = gold.join(up, ["document_id", "node_id"]).select("query_id", "document_id", F.col("ancestor_id").alias("node_id"))
    below = gold.select("query_id", "document_id", F.col("node_id").alias("ancestor_id")).join(up, ["document_id", "ancestor_id"]).select("query_id", "document_id", "node_id")
    related = near.unionByName(below).distinct().withColumn("structural", F.lit(True))
    exact = gold.select("query_id", "document_id", "node_id").distinct().withColumn("exact", F.lit(True))
    keys = ["query_id", "document_id", "node_id"]
    out = hits.join(exact, keys, "left").join(related, keys, "left")
    return out.withColumn("exact", F.coalesce("exact", F.lit(False))).withColumn("structural", F.coalesce("structural", F.lit(False)))


def direct(targets: DataFrame, nodes: DataFrame, titles: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Evidence of resolved citations: targets (query_id, position, document_id, node_id), titles (document_id, title).

    An article gives itself and what is below it, without blank nodes; a clause itself and its points; points, one or a list
    under one clause, give title, article heading, clause and the points, in the order in which they were asked. Returns
    (query_id, primary_id, included_ids, context_ids, citation_ids, evidence, tokens, problem); problem is null or says why
    a bundle must not be served: CROSS_DOCUMENT, NOT_POINTS (several targets, not all points), SPLIT_PARENT, TOO_LONG.
    """
    keys = ["document_id", "node_id"]
    tree_ = nodes.join(targets.select("document_id").distinct(), "document_id", "left_semi")
    asked = targets.join(tree_.select(*keys, "type"), keys)
    said = tree_.select("document_id", "node_id", F.col("type").alias("kind"), "ordinal", F.trim("text").alias("text"))
    closure = tree.closure(tree_)
    below = closure.select("document_id", F.col("ancestor_id").alias("target"), "node_id", "distance")
    whole = asked.where("type <> 'point'").withColumnRenamed("node_id", "target").join(below, ["document_id", "target"]).join(said, keys)
    whole = whole.where((F.col("type") == "article") & (F.col("text") != "") | (F.col("type") == "clause") & ((F.col("distance") == 0) | (F.col("kind") == "point")))
    whole = whole.select("query_id", F.lit(1).alias("level"), F.col("ordinal").alias("at"), "node_id", "text")
    points = asked.where("type = 'point'")
    own = points.join(said, keys).select("query_id", F.lit(3).alias("level"), F.col("position").cast("long").alias("at"), "node_id", "text")
    up = points.join(closure.where("distance > 0"), keys).drop("node_id", "distance").withColumnRenamed("ancestor_id", "node_id").join(said, keys).where(F.col("kind").isin("document", "article", "clause"))
    shown = F.when(F.col("kind") == "document", F.trim("title")).when(F.col("kind") == "article", F.trim(X.heading(F.col("text")))).otherwise(F.col("text"))
    context = up.join(titles, "document_id", "left").select("query_id", F.array_position(F.array(F.lit("document"), F.lit("article"), F.lit("clause")), F.col("kind")).alias("place"), "ordinal", "node_id", shown.alias("text")).distinct()
    parents = context.groupBy("query_id").agg(*(F.count_if(F.col("place") == k).alias(name) for k, name in ((2, "articles"), (3, "clauses"))))
    rows = whole.unionByName(own).unionByName(context.select("query_id", F.lit(0).alias("level"), F.col("place").cast("long").alias("at"), "node_id", "text"))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("level", "at", "node_id", "text"))).alias("p"))
    head = asked.groupBy("query_id").agg(F.min(F.struct("position", "node_id")).getField("node_id").alias("primary_id"), F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"), F.count_if(F.col("type") != "point").alias("others"))
    out = head.join(listed, "query_id", "left").join(parents, "query_id", "left")
    none = F.array().cast("array<string>")
    ids = lambda keep: F.coalesce(F.array_distinct(F.transform(F.filter("p", keep), lambda x: x["node_id"])), none)
    out = out.withColumn("evidence", F.coalesce(F.array_join(F.filter(F.transform("p", lambda x: x["text"]), lambda x: x != ""), "\n"), F.lit("")))
    out = out.withColumn("tokens", X.word_count(F.col("evidence")))
    problem = (
        F.when(F.col("documents") > 1, "CROSS_DOCUMENT")
        .when((F.col("n") > 1) & (F.col("others") > 0), "NOT_POINTS")
        .when((F.col("n") > 1) & ((F.col("articles") != 1) | (F.col("clauses") != 1)), "SPLIT_PARENT")
        .when(F.col("tokens") > max_tokens, "TOO_LONG")
    )
    return out.select("query_id", "primary_id", ids(lambda x: F.lit(True)).alias("included_ids"), ids(lambda x: x["level"] == 0).alias("context_ids"), ids(lambda x: x["level"] > 0).alias("citation_ids"), "evidence", "tokens", problem.alias("problem"))
