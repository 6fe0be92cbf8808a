"""Retrieval metrics over ranked rows, as two-level aggregates.

A row has query_id, rank, exact_hit, evidence_tokens and included (node ids); gold is (query_id, required_ids). Every
metric of aggregate() is an average over queries of a per-query value. aggregate_duplication() states its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_K = (1, 3, 5, 10)


def first_hits(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, first_rank, reciprocal): null and 0 without a hit."""
    first = rows.where("exact_hit").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.select("query_id").distinct().join(first, "query_id", "left").select("query_id", "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal"))


def at_k(queries: DataFrame, rows: DataFrame, top_k: tuple[int, ...] = TOP_K) -> DataFrame:
    """(query_id, k, hit, evidence, tokens): one row for each query and k, also without results."""
    ks = queries.select("query_id", "required_ids", F.explode(F.array(*map(F.lit, top_k))).alias("k"))
    joined = ks.join(rows.select("query_id", "rank", "exact_hit", "included", "evidence_tokens"), "query_id", "left").where("rank is null or rank <= k or rank = 1")
    mine = F.col("rank") <= F.col("k")
    per = joined.groupBy("query_id", "k").agg(
        F.max(F.when(mine & F.col("exact_hit"), 1).otherwise(0)).alias("hit"),
        F.array_distinct(F.flatten(F.collect_list(F.when(mine, F.col("included"))))).alias("seen"),
        F.sum(F.when(mine, F.col("evidence_tokens")).otherwise(0)).alias("tokens"),
        F.first("required_ids").alias("required_ids"),
    )
    share = F.try_divide(F.size(F.array_intersect("seen", "required_ids")), F.size(F.array_distinct("required_ids")))
    return per.select("query_id", "k", F.col("hit").cast("double").alias("hit"), F.coalesce(share, F.lit(0.0)).alias("evidence"), F.col("tokens").cast("double").alias("tokens"))


def aggregate(queries: DataFrame, rows: DataFrame, by: str | None = None, top_k: tuple[int, ...] = TOP_K) -> DataFrame:
    """(by, k, queries, mrr, recall, evidence_coverage, avg_evidence_tokens); by: a column of queries, null for all."""
    group = F.col(by).cast("string") if by else F.lit("all")
    q = queries.select("query_id", group.alias("grp"))
    per = at_k(queries, rows, top_k).join(first_hits(queries, rows).select("query_id", "reciprocal"), "query_id").join(q, "query_id")
    r = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return per.groupBy("grp", "k").agg(F.count("*").alias("queries"), r("reciprocal", "mrr"), r("hit", "recall"), r("evidence", "evidence_coverage"), r("tokens", "avg_evidence_tokens"))


def aggregate_duplication(queries: DataFrame, rows: DataFrame, top_k: tuple[int, ...] = TOP_K) -> DataFrame:
    """One row per k: structural coverage, index tokens, relevant density, and what the first k rows hold twice.

    queries: (query_id, gold_ids, required (id, tokens)); rows: (query_id, rank, covered (gold ids), nodes (id, tokens),
    contexts (ids), components (hash, tokens), index_tokens, evidence_tokens). Without components, nodes are counted. A query
    without gold has coverage 0."""
    lists = ("covered", "nodes", "contexts", "components")
    ks = queries.select("query_id", "gold_ids", "required", F.explode(F.array(*map(F.lit, top_k))).alias("k"))
    joined = ks.join(rows.select("query_id", "rank", *lists, "index_tokens", "evidence_tokens"), "query_id", "left")
    mine = F.col("rank") <= F.col("k")
    sums = [F.sum(F.when(mine, F.col(c)).otherwise(0)).alias(c) for c in ("index_tokens", "evidence_tokens")]
    per = joined.groupBy("query_id", "k").agg(*[F.flatten(F.collect_list(F.when(mine, F.col(c)))).alias(c) for c in lists], *sums, F.first("gold_ids").alias("gold_ids"), F.first("required").alias("required"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["tokens"])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    twice = lambda xs: F.when(F.size(xs) > 0, 1 - F.size(F.array_distinct(xs)) / F.size(xs)).otherwise(0.0)
    ids = F.transform("nodes", lambda x: x["id"])
    parts = F.size("components") > 0
    held = F.when(parts, F.col("components")).otherwise(F.transform("nodes", lambda x: F.struct(x["id"].alias("hash"), x["tokens"].alias("tokens"))))
    per = per.withColumn("held", held).withColumn("repeated", total(F.col("held")) - total(F.array_distinct("held"))).withColumn("all", F.when(parts, total(F.col("components"))).otherwise(F.col("evidence_tokens")))
    relevant = F.least(F.col("evidence_tokens"), total(F.filter("required", lambda x: F.array_contains(ids, x["id"]))))
    per = per.select(
        "k",
        share(F.size(F.array_intersect("covered", "gold_ids")), F.size(F.array_distinct("gold_ids"))).alias("structural"),
        share(relevant, F.col("evidence_tokens")).alias("density"),
        twice(ids).alias("nodes"),
        twice(F.col("contexts")).alias("contexts"),
        F.least(share(F.col("repeated"), F.col("all")), F.lit(1.0)).alias("ratio"),
        *("repeated", "all", "index_tokens"),
        F.size(F.array_distinct(ids)).alias("unique"),
    )
    r = lambda c, name: F.round(c, 6).alias(name)
    means = {"structural": "structural_coverage", "index_tokens": "avg_index_tokens", "density": "relevant_token_density", "nodes": "duplicate_node_ratio", "contexts": "duplicate_context_ratio", "ratio": "duplicate_token_ratio", "repeated": "avg_duplicate_token_count", "all": "avg_total_component_tokens", "unique": "unique_source_node_coverage"}
    return per.groupBy("k").agg(F.count("*").alias("queries"), *[r(F.avg(c), name) for c, name in means.items()], r(linear(0.5, "ratio"), "duplicate_token_ratio_median"), r(nearest_rank(0.95, "ratio"), "duplicate_token_ratio_p95"))


def redundancy(components: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, unique_tokens, repeated, ratio) of components (keys, hash, tokens): a hash counts once."""
    once = components.groupBy(*keys, "hash").agg(F.min("tokens").alias("one"), F.sum("tokens").alias("all"), F.count("*").alias("times"))
    out = once.groupBy(*keys).agg(F.sum("all").alias("total"), F.sum("one").alias("unique_tokens"), F.sum(F.when(F.col("times") > 1, 1).otherwise(0)).alias("repeated"))
    return out.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("total") - F.col("unique_tokens"), F.col("total")), F.lit(0.0)), 6))


def nearest_rank(p: float, c: str) -> Column:
    """The value at position ceil(p n), from 1."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def floor_index(p: float, c: str) -> Column:
    """The value at index int(p n), from 0."""
    s = F.sort_array(F.collect_list(c))
    return F.element_at(s, F.least(F.floor(F.size(s) * F.lit(p)) + 1, F.size(s)).cast("int"))


def rounded_index(p: float, c: str) -> Column:
    """The value at index round((n - 1) p), half to even, from 0."""
    s = F.sort_array(F.collect_list(c))
    return F.element_at(s, (F.bround((F.size(s) - 1) * F.lit(p), 0) + 1).cast("int"))


def linear(p: float, c: str) -> Column:
    return F.percentile(c, p)
