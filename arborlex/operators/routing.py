"""Structural citations by rule: parse, resolve, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlex.functions import text as X

# The order of point letters, and citation patterns over normalised text.
POINT_ORDER = "abcdđefghiklmnopqrstuvxy"
_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ARTICLE = rf"(?u){_START}điều\s+(\d+[a-z]?){_END}"
CLAUSE = rf"(?u){_START}khoản\s+(\d+[a-z]?){_END}"
POINT = rf"(?u){_START}điểm\s+([a-zđ]){_END}"
RANGE = rf"(?u){_START}điểm\s+([a-zđ])\s+(?:đến|tới)\s+(?:điểm\s+)?([a-zđ]){_END}"
LETTER = rf"(?u){_START}([a-zđ]){_END}"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def point_segment(t: Column) -> Column:
    """From the first point up to the clause or article that follows it."""
    tail = F.regexp_extract(t, rf"(?u)({_START}điểm\s+[a-zđ]{_END}.*)$", 1)
    cut = rf"(?u)^(.*?)(?:{_START}khoản\s+\d+[a-z]?{_END}|{_START}điều\s+\d+[a-z]?{_END}|$)"
    return F.regexp_extract(tail, cut, 1)


def expand_range(a: Column, b: Column) -> Column:
    """Letters from a to b in point order; the two themselves where that is no range."""
    order = F.array(*map(F.lit, POINT_ORDER))
    i, j = F.array_position(order, a).cast("int"), F.array_position(order, b).cast("int")
    return F.when((i > 0) & (j >= i), F.slice(order, F.greatest(i, F.lit(1)), F.greatest(j - i + 1, F.lit(0)))).otherwise(F.array(a, b))


def parse(queries: DataFrame, query: str = "query") -> DataFrame:
    """Adds normalized, article, clause and points. Queries may come in any Unicode normal form."""
    rows = queries.withColumn("normalized", X.normalize_reference(X.nfc(F.col(query)))).withColumn("_segment", point_segment(F.col("normalized")))
    a, b = _first(F.col("_segment"), RANGE), _first(F.col("_segment"), RANGE, 2)
    letters = F.regexp_extract_all("_segment", F.lit(LETTER), F.lit(1))
    points = F.when(a.isNotNull(), expand_range(a, b)).otherwise(letters)
    rows = rows.withColumn("article", _first(F.col("normalized"), ARTICLE)).withColumn("clause", _first(F.col("normalized"), CLAUSE))
    return rows.withColumn("points", F.array_distinct(points)).drop("_segment")


def aliases(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, document_ids) by alias: names (document_id, alias). Longest alias first, first place only, overlaps skipped.

    Names are few next to queries; candidates are found by substring, then folded greedily in order within each query."""
    n = names.select("document_id", X.normalize_reference(X.nfc(F.col("alias"))).alias("alias")).where("alias <> ''").distinct()
    met = queries.join(n, F.contains(F.col("normalized"), F.col("alias")))
    found = met.select("query_id", (-F.char_length("alias")).alias("order"), "document_id", "alias", F.instr("normalized", F.col("alias")).alias("start"))
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("order", "document_id", "alias", "start"))).alias("found"))
    hit = lambda taken, x: F.exists(taken, lambda y: (x["start"] < y["start"] - y["order"]) & (x["start"] - x["order"] > y["start"]))
    empty = F.expr("CAST(array() AS array<struct<order:int,document_id:string,alias:string,start:int>>)")
    kept = F.aggregate("found", empty, lambda taken, x: F.when(hit(taken, x), taken).otherwise(F.concat(taken, F.array(x))))
    return listed.select("query_id", F.array_distinct(F.transform(kept, lambda x: x["document_id"])).alias("document_ids"))


def resolve(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """parsed: (query_id, article, clause, points, explicit_ids, requested_ids); nodes: (document_id, node_id, type, ordinal,
    article, clause, point). Returns (query_id, status, document_ids, node_ids)."""
    none = F.array().cast("array<string>")
    q = parsed.select("query_id", "article", "clause", F.coalesce("points", none).alias("points"), F.coalesce("explicit_ids", none).alias("explicit_ids"), F.coalesce("requested_ids", none).alias("requested_ids"))
    kind = F.when(F.size("points") > 0, "point").when(F.col("clause").isNotNull(), "clause").otherwise("article")
    asked = q.where(F.col("article").isNotNull() & ((F.size("points") == 0) | F.col("clause").isNotNull())).withColumn("kind", kind)
    scope = F.when(F.size("explicit_ids") > 0, F.col("explicit_ids")).otherwise(F.col("requested_ids"))
    n = nodes.select("document_id", "node_id", F.col("type").alias("kind"), "ordinal", "article", F.col("clause").alias("n_clause"), F.col("point").alias("n_point"))
    met = asked.join(n, ["kind", "article"]).where((F.col("kind") == "article") | (F.col("n_clause") == F.col("clause")))
    met = met.where((F.col("kind") != "point") | F.array_contains("points", F.col("n_point"))).where((F.size(scope) == 0) | F.array_contains(scope, F.col("document_id")))
    per = met.groupBy("query_id", "document_id").agg(F.countDistinct("n_point").alias("got"), F.first("kind").alias("kind"), F.first(F.size("points")).alias("want"), F.array_sort(F.collect_list(F.struct("ordinal", "node_id"))).alias("hit"))
    per = per.where((F.col("kind") != "point") | (F.col("got") == F.col("want")))
    docs = per.groupBy("query_id").agg(F.array_sort(F.collect_list("document_id")).alias("found"), F.first("hit").alias("hit"))
    rows = q.join(docs, "query_id", "left")
    n_found = F.coalesce(F.size("found"), F.lit(0))
    status = (
        F.when(F.col("article").isNull() & F.col("clause").isNull() & (F.size("points") == 0), "NO_REFERENCE")
        .when(F.size("explicit_ids") > 1, "CONFLICT")
        .when((F.size("explicit_ids") > 0) & (F.size("requested_ids") > 0) & ~F.array_contains("requested_ids", F.get("explicit_ids", F.lit(0))), "CONFLICT")
        .when(((F.size("points") > 0) & (F.col("article").isNull() | F.col("clause").isNull())) | (F.col("clause").isNotNull() & F.col("article").isNull()), "PARTIAL")
        .when(n_found == 0, "NOT_FOUND")
        .when(n_found > 1, "AMBIGUOUS")
        .otherwise("RESOLVED")
    )
    rows = rows.withColumn("status", status)
    return rows.select("query_id", "status", F.when(F.col("status").isin("RESOLVED", "AMBIGUOUS"), F.col("found")).otherwise(none).alias("document_ids"), F.when(F.col("status") == "RESOLVED", F.transform("hit", lambda x: x["node_id"])).otherwise(none).alias("node_ids"))


def route(resolved: DataFrame, policy: str) -> DataFrame:
    """Adds route: direct, hybrid, suggestion or none. Policies: B6 never direct, B7a one node, B7b several, B7c both."""
    if policy not in ("B6", "B7a", "B7b", "B7c"):
        raise ValueError(f"policy {policy} is not served")
    n = F.size("node_ids")
    direct = {"B6": F.lit(False), "B7a": n == 1, "B7b": n > 1, "B7c": n >= 1}[policy]
    out = F.when(F.lit(policy) == "B6", "hybrid").when(F.col("status") == "CONFLICT", "none").when((F.col("status") == "RESOLVED") & direct, "direct").when(F.col("status") == "AMBIGUOUS", "suggestion").otherwise("hybrid")
    return resolved.withColumn("route", out)


def quality(routed: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: shares of cases whose status and nodes are as expected (query_id, expected_status, expected_ids)."""
    j = routed.join(expected, "query_id")
    seen, want = F.col("status") != "NO_REFERENCE", F.col("expected_status") != "NO_REFERENCE"
    share = lambda ok, of: F.round(F.coalesce(F.try_divide(F.count_if(ok & of), F.count_if(of)), F.lit(0.0)), 6)
    yes = F.lit(True)
    return j.agg(F.count("*").alias("cases"), share(want, seen).alias("detection_precision"), share(seen, want).alias("detection_recall"), share(F.col("status") == F.col("expected_status"), yes).alias("status_accuracy"), share(F.col("node_ids") == F.col("expected_ids"), yes).alias("node_accuracy"))
