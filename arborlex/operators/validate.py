"""Checks of registries, texts, datasets and reviews: a check is a query of its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlex.functions import text as X

SEVERITIES = ("INFO", "WARN", "ERROR", "CRITICAL")
RETENTION = 0.995
#: A leak shares more than this share of a query's distinct tokens, or a run of so many tokens.
LEAK, RUN = 0.65, 9


def registry_issues(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(document_id, code): repeated ids, sources without document, documents without exactly one source, bad date order."""
    twice = documents.groupBy("document_id").count().where("count > 1").select("document_id", F.lit("DUPLICATE_ID").alias("code"))
    dangling = sources.join(documents, "document_id", "left_anti").select("document_id", F.lit("DANGLING_SOURCE").alias("code")).distinct()
    n = sources.groupBy("document_id").agg(F.count("*").alias("n"))
    wrong = documents.select("document_id").distinct().join(n, "document_id", "left").where("coalesce(n, 0) <> 1").select("document_id", F.lit("SOURCE_COUNT").alias("code"))
    dates = documents.where("effective_to < effective_from").select("document_id", F.lit("DATE_ORDER").alias("code"))
    return twice.unionByName(dangling).unionByName(wrong).unionByName(dates)


def retention(raw: DataFrame, kept: DataFrame, least: float = RETENTION) -> DataFrame:
    """(document_id, raw_chars, kept_chars, ratio, passed): characters other than spaces, before and after."""
    size = lambda df, name: df.groupBy("document_id").agg(F.sum(F.char_length(F.regexp_replace("text", r"\s+", ""))).alias(name))
    j = size(raw, "raw_chars").join(size(kept, "kept_chars"), "document_id", "left").withColumn("kept_chars", F.coalesce("kept_chars", F.lit(0)))
    ratio = F.coalesce(F.try_divide(F.col("kept_chars"), F.col("raw_chars")), F.lit(1.0))
    return j.withColumn("ratio", F.round(ratio, 6)).withColumn("passed", ratio >= least)


def replaced_characters(texts: DataFrame) -> DataFrame:
    """Rows whose text holds U+FFFD."""
    return texts.where(F.contains(F.col("text"), F.lit("�")))


def truncated_pages(blocks: DataFrame) -> DataFrame:
    """blocks: (document_id, page, block, text, marked). Last block of a page without end punctuation before an unmarked one."""
    w = Window.partitionBy("document_id").orderBy("page", "block")
    rows = blocks.withColumn("next_page", F.lead("page").over(w)).withColumn("next_marked", F.lead("marked").over(w))
    open_end = ~F.rlike(F.trim("text"), F.lit(r"[.;:!?)\]\"”]$"))
    return rows.where((F.col("next_page") > F.col("page")) & ~F.col("next_marked") & open_end).select("document_id", "page", "block")


def provenance_coverage(nodes: DataFrame) -> DataFrame:
    """(document_id, ratio) of nodes with a source page."""
    return nodes.groupBy("document_id").agg(F.round(F.avg(F.col("page").isNotNull().cast("double")), 6).alias("ratio"))


def report(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, status, issues): the gravest severity decides: PASS, WARN or FAIL."""
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    worst = issues.groupBy("document_id").agg(F.max(level).alias("level"), F.count("*").alias("issues"))
    status = F.when(F.coalesce("level", F.lit(0)) >= 3, "FAIL").when(F.col("level") == 2, "WARN").otherwise("PASS")
    return documents.select("document_id").distinct().join(worst, "document_id", "left").select("document_id", status.alias("status"), F.coalesce("issues", F.lit(0)).alias("issues"))


def published(report_: DataFrame, approved: bool = False) -> DataFrame:
    """Adds published: PASS, or WARN with approval; the rest is quarantined."""
    return report_.withColumn("published", (F.col("status") == "PASS") | ((F.col("status") == "WARN") & F.lit(approved)))


def review_diff(before: DataFrame, after: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """(key, column) of immutable columns that a review changed, and of rows that it added or lost (column null)."""
    b = before.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in fixed], F.lit(1).alias("in_b"))
    a = after.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in fixed], F.lit(1).alias("in_a"))
    j = b.join(a, key, "full")
    lost = j.where("in_a is null or in_b is null").select(key, F.lit(None).cast("string").alias("column"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), F.lit(c)) for c in fixed]))
    return j.where("in_a is not null and in_b is not null").select(key, F.explode(changed).alias("column")).unionByName(lost)


def lexical_leaks(pairs: DataFrame, ratio: float = LEAK) -> DataFrame:
    """pairs: (query_id, query, source). Adds overlap and leak."""
    return pairs.withColumn("overlap", F.round(X.overlap_ratio(F.col("query"), F.col("source")), 6)).withColumn("leak", F.col("overlap") > ratio)


def longest_common_run(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys, run): the longest run of equal tokens, by grouping equal tokens on their distance and on gaps in place."""
    tok = lambda c, n: pairs.select(*keys, F.posexplode(X.tokens(F.col(c))).alias(n, "token"))
    met = tok(left, "i").join(tok(right, "j"), [*keys, "token"]).withColumn("shift", F.col("j") - F.col("i"))
    w = Window.partitionBy(*keys, "shift").orderBy("i")
    runs = met.withColumn("island", F.col("i") - F.row_number().over(w)).groupBy(*keys, "shift", "island").agg(F.count("*").alias("n"))
    best = runs.groupBy(*keys).agg(F.max("n").alias("run"))
    return pairs.select(*keys).distinct().join(best, keys, "left").withColumn("run", F.coalesce("run", F.lit(0)))


def containing_candidates(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(item_id, doc_id): every pair of queries (item_id, query) and sources (doc_id, source) in which the source may hold the
    query literally. The first and last token may stand inside longer words there; of the others the source has each, so
    the rarest one is asked. Queries of fewer than three tokens are looked for by the substring itself."""
    tokens = X.tokens(F.col("query"))
    inner = queries.where(F.size(tokens) > 2).select("item_id", F.explode(F.array_distinct(F.slice(tokens, F.lit(2), F.size(tokens) - 2))).alias("token"))
    words = sources.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("source")))).alias("token")).join(inner.select("token").distinct(), "token", "left_semi")
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    rarest = inner.join(df, "token", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).getField("token").alias("token"))
    short = queries.where(F.size(tokens) <= 2).join(sources, F.contains(F.col("source"), F.col("query"))).select("item_id", "doc_id")
    return words.join(rarest, "token").select("item_id", "doc_id").unionByName(short).distinct()


def overlap_candidates(queries: DataFrame, sources: DataFrame, ratio: float = LEAK) -> DataFrame:
    """(item_id, doc_id): every pair whose overlap can be above ratio, of queries (item_id, query) and sources (doc_id, source).
    Such a source lacks less than 1 - ratio of the query's tokens, so it has one of any that many: the rarest are asked."""
    asked = queries.select("item_id", F.explode(F.array_distinct(X.tokens(F.col("query")))).alias("token"))
    words = sources.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("source")))).alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "token")
    rare = asked.join(df, "token", "left").withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    rare = rare.where(F.col("at") <= F.floor(F.col("n") * (1 - ratio)) + 1).select("item_id", "token")
    return words.join(rare, "token").select("item_id", "doc_id").distinct()


def run_candidates(queries: DataFrame, sources: DataFrame, least: int = RUN) -> DataFrame:
    """(item_id, doc_id): every pair with a common run of `least` tokens, of queries (item_id, query) and sources (doc_id,
    source). Cut a source's tokens into pieces of half that length: such a run holds a whole piece, wherever it begins."""
    piece = (least + 1) // 2
    gram = lambda t, i: F.xxhash64(F.slice(t, i, piece))
    starts = lambda t, step: F.when(F.size(t) >= piece, F.sequence(F.lit(1), F.size(t) - piece + 1, F.lit(step)))
    pieces = lambda df, key, c, step: df.select(key, X.tokens(F.col(c)).alias("t")).select(key, F.explode(F.array_distinct(F.transform(starts(F.col("t"), step), lambda i: gram(F.col("t"), i)))).alias("gram"))
    asked, held = pieces(queries, "item_id", "query", 1), pieces(sources, "doc_id", "source", piece)
    return held.join(asked, "gram").select("item_id", "doc_id").distinct()


def quota_issues(rows: DataFrame, category: str, quotas: dict[str, int]) -> DataFrame:
    """(category, n, wanted) of categories whose count is not its quota."""
    wanted = rows.sparkSession.createDataFrame(list(quotas.items()), f"{category} string, wanted int")
    n = rows.groupBy(category).agg(F.count("*").alias("n"))
    return wanted.join(n, category, "full").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("wanted", F.coalesce("wanted", F.lit(0))).where("n <> wanted")
