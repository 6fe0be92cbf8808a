"""Passages from trees: fixed windows, whole articles, clauses, leaves, and context variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlex.functions import text as X

from . import tree

WINDOW, OVERLAP, MAX_TOKENS = 400, 80, 8192


def fixed_windows(documents: DataFrame, id_col: str, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, window_no, start, tokens, passage): windows of whole words; the one that reaches the end is the last.

    Windows are cut from the word array by slices, so a document is one row until its windows explode."""
    if not 0 <= overlap < window:
        raise ValueError("0 <= overlap < window")
    step = window - overlap
    words = documents.select(F.col(id_col).alias("document_id"), F.regexp_extract_all(F.col(text), F.lit(r"(\S+)"), F.lit(1)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - window) / step), F.lit(0)).cast("int")
    rows = words.select("document_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    part = F.slice("w", F.col("no") * step + 1, window)
    return rows.select("document_id", (F.col("no") + 1).alias("window_no"), (F.col("no") * step).alias("start"), F.size(part).alias("tokens"), F.array_join(part, " ").alias("passage"))


def articles(nodes: DataFrame) -> DataFrame:
    """Whole subtrees of articles."""
    kinds = nodes.where("type = 'article'").select("document_id", "node_id")
    return tree.subtree_content(nodes, 4).join(kinds, ["document_id", "node_id"], "left_semi").select("document_id", F.col("node_id").alias("primary_id"), F.col("content").alias("text"), "source_node_ids")


def clauses(nodes: DataFrame) -> DataFrame:
    """Clause subtrees, and articles that have no clause."""
    with_clause = nodes.where("type = 'clause'").select("document_id", F.col("parent_id").alias("node_id")).distinct()
    targets = nodes.where("type = 'clause'").select("document_id", "node_id").unionByName(nodes.where("type = 'article'").join(with_clause, ["document_id", "node_id"], "left_anti").select("document_id", "node_id"))
    return tree.subtree_content(nodes, 4).join(targets, ["document_id", "node_id"], "left_semi").select("document_id", F.col("node_id").alias("primary_id"), F.col("content").alias("text"), "source_node_ids")


#: Parts of each variant's text, outermost first.
VARIANTS = {"B3": ("leaf",), "B4": ("heading", "clause", "leaf"), "B4a": ("leaf",), "B4b": ("heading", "leaf"), "B4c": ("clause", "leaf"), "B4d": ("heading", "clause", "leaf"), "B4e": ("title", "heading", "clause", "leaf")}


def leaves_in_context(nodes: DataFrame, variant: str, titles: DataFrame | None = None) -> DataFrame:
    """Leaf targets with the wanted context joined by newlines; titles: (document_id, title), for B4e."""
    wanted = VARIANTS[variant]
    leaves = tree.leaf_targets(nodes).select("document_id", F.col("node_id").alias("primary_id"), "type", F.trim("text").alias("leaf"))
    above = lambda kind, name: tree.nearest_of_type(nodes, kind, 4).join(nodes.select("document_id", F.col("node_id").alias("found"), F.col("text").alias(name)), ["document_id", "found"]).select("document_id", F.col("node_id").alias("primary_id"), name)
    rows = leaves
    if "heading" in wanted:
        rows = rows.join(above("article", "article_text"), ["document_id", "primary_id"], "left").withColumn("heading", F.when(F.col("type") != "article", F.trim(X.heading(F.col("article_text")))))
    if "clause" in wanted:
        rows = rows.join(above("clause", "clause_text"), ["document_id", "primary_id"], "left").withColumn("clause", F.when(F.col("type") == "point", F.trim("clause_text")))
    if "title" in wanted:
        rows = rows.join(titles, "document_id", "left")
    part = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select("document_id", "primary_id", F.concat_ws("\n", *map(part, wanted)).alias("text"))


def passage_hash(strategy: Column, *texts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", strategy, *map(X.normalize_text, texts)), 256)


def stats(passages: DataFrame, text: str = "text") -> DataFrame:
    """One row: count and token lengths, with nearest-rank, floor-index and rounded-index style positions by name."""
    n = passages.select(X.word_count(F.col(text)).alias("n"))
    return n.agg(F.count("*").alias("passages"), F.min("n").alias("min"), F.percentile("n", 0.25).alias("p25"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.75).alias("p75"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").alias("p95"), F.max("n").alias("max"), F.round(F.avg("n"), 3).alias("mean"))


def coverage(required: DataFrame, passages: DataFrame) -> DataFrame:
    """Required (document_id, node_id) that no passage represents in source_node_ids."""
    said = passages.select("document_id", F.explode("source_node_ids").alias("node_id")).distinct()
    return required.select("document_id", "node_id").join(said, ["document_id", "node_id"], "left_anti")


def issues(passages: DataFrame, nodes: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(primary_id, code): repeated ids, empty or too long texts, unknown or missing sources."""
    twice = passages.groupBy("primary_id").count().where("count > 1").select("primary_id", F.lit("DUPLICATE_PASSAGE").alias("code"))
    size = X.word_count(F.col("text"))
    length = passages.select("primary_id", F.when(size == 0, "EMPTY").when(size > max_tokens, "TOO_LONG").when(F.size("source_node_ids") == 0, "MISSING_PROVENANCE").alias("code")).where("code is not null")
    known = nodes.select("document_id", F.col("node_id").alias("s"))
    unknown = passages.select("document_id", "primary_id", F.explode("source_node_ids").alias("s")).join(known, ["document_id", "s"], "left_anti").select("primary_id", F.lit("UNKNOWN_NODE").alias("code")).distinct()
    return twice.unionByName(length).unionByName(unknown)
