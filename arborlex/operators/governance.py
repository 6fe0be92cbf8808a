"""Corpus loading and reports, extraction bookkeeping, citation links, dataset checks, reviews and locks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlex.functions import text as X

#: Characters that make a page digital, and the shares and mean that type a document.
PAGE_CHARS, DIGITAL_SHARE, DIGITAL_MEAN, MIXED_SHARE = 100, 0.95, 500, 0.20


def inspect(pages: DataFrame) -> DataFrame:
    """pages: (document_id, text, null where unreadable). (document_id, pages, ratio, kind): DIGITAL, MIXED, SCANNED or BROKEN."""
    n = F.char_length("text")
    out = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.avg((n >= PAGE_CHARS).cast("double")).alias("ratio"), F.avg(n).alias("mean"), F.count_if(F.col("text").isNull()).alias("broken"))
    kind = F.when(F.col("broken") > 0, "BROKEN").when((F.col("ratio") >= DIGITAL_SHARE) & (F.col("mean") >= DIGITAL_MEAN), "DIGITAL").when(F.col("ratio") >= MIXED_SHARE, "MIXED").otherwise("SCANNED")
    return out.select("document_id", "pages", F.round("ratio", 6).alias("ratio"), kind.alias("kind"))


def freeze(blocks: DataFrame) -> DataFrame:
    """blocks: (node_id, position, page, text). (node_id, text, first_page, last_page, blocks, content_hash)."""
    parts = blocks.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("p"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return parts.select("node_id", text.alias("text"), "first_page", "last_page", F.size("p").alias("blocks"), X.content_hash(text).alias("content_hash"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("document_id", "type").agg(F.count("*").alias("n"))


def label(*levels: tuple[str, str]) -> Column:
    """Names of the open levels: (prefix, column) joined by a middle dot."""
    return F.concat_ws(" · ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(p + " "), F.col(c))) for p, c in levels])


def navigate(nodes: DataFrame, document: str, article: int | None = None, clause: int | None = None) -> DataFrame:
    """The node that document, article and clause keys lead to, one equality at a time."""
    own = nodes.where(F.col("document_id") == document)
    if article is None:
        return own.where("type = 'document'")
    found = own.where((F.col("type") == "article") & (F.col("key") == article))
    if clause is None:
        return found
    parent = found.select(F.col("node_id").alias("parent_id"))
    return own.where((F.col("type") == "clause") & (F.col("key") == clause)).join(parent, "parent_id", "left_semi")


def guided_from_ranking(ranking: DataFrame, scouted: DataFrame, per_group: int = 3) -> DataFrame:
    """Best rows of each scouted group out of a full ranking (query_id, rank, id, group)."""
    w = Window.partitionBy("query_id", "group").orderBy("rank")
    rows = ranking.join(scouted.select("query_id", "group").distinct(), ["query_id", "group"], "left_semi").withColumn("local_rank", F.row_number().over(w))
    return rows.where(F.col("local_rank") <= per_group).select("query_id", "group", "local_rank", "id")


def oracle_recall(pool: DataFrame, gold: DataFrame, depth: int = 30, shown: int = 5) -> DataFrame:
    """One row: share of gold queries with gold within depth, and those of them that do not show it."""
    met = pool.join(gold.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    all_ = gold.select("query_id").distinct().join(met, "query_id", "left")
    return all_.agg(F.count("*").alias("queries"), F.round(F.avg((F.coalesce("best", F.lit(1 << 30)) <= depth).cast("double")), 6).alias("recall"), F.count_if((F.col("best") > shown) & (F.col("best") <= depth)).alias("ordering_failures"))


def comparison(runs: DataFrame, key: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One row per run, one column per stated metric."""
    return runs.groupBy(key).pivot(metric, metrics).agg(F.first(value))


def projection(nodes: DataFrame, articles: DataFrame, limit: int = 8192) -> DataFrame:
    """Article texts with a marker before each node's text: (document_id, article_id, text, content_hash, within_limit).
    articles: (document_id, node_id, article_id)."""
    rows = nodes.join(articles, ["document_id", "node_id"]).where(F.trim("text") != "")
    listed = rows.groupBy("document_id", "article_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.concat(F.lit("[["), "node_id", F.lit("]] "), F.trim("text")).alias("line")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["line"]), "\n")
    return listed.select("document_id", "article_id", text.alias("text"), X.content_hash(text).alias("content_hash"), (X.word_count(text) <= limit).alias("within_limit"))


def cited_articles(texts: DataFrame, pattern: str) -> DataFrame:
    """(document_id, node_id, article) of every citation in texts (document_id, node_id, text), once per node; a citation
    without a document named refers to its own."""
    found = F.array_distinct(F.regexp_extract_all(X.normalize_reference(F.col("text")), F.lit(pattern), F.lit(1)))
    return texts.select("document_id", "node_id", F.explode(found).alias("article"))


def reconcile(expected: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """(key, code) of what was not extracted exactly once: MISSING, EXTRA or TWICE."""
    n = extracted.groupBy(key).agg(F.count("*").alias("n"))
    j = expected.select(key).distinct().withColumn("wanted", F.lit(True)).join(n, key, "full")
    return j.select(key, F.when(F.col("n").isNull(), "MISSING").when(F.col("wanted").isNull(), "EXTRA").when(F.col("n") > 1, "TWICE").alias("code")).where("code is not null")


def cost(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """(model, calls, usd): calls (model, tokens_in, tokens_out) at prices per million tokens."""
    price = lambda k: F.element_at(F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.lit(p[k]))]), F.col("model"))
    sums = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
    return sums.select("model", "calls", F.round((F.col("i") * price(0) + F.col("o") * price(1)) / 1e6, 6).alias("usd"))


def citation_links(text: Column) -> Column:
    """Distinct node ids of canonical:// links, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"canonical://([\p{L}\p{N}_]+)"), F.lit(1)))


def disallowed(found: Column, allowed: Column) -> Column:
    return F.array_except(found, allowed)


def identity(lines: DataFrame, pattern: str, first: int = 80) -> DataFrame:
    """(document_id, found): the first match of pattern within a document's first lines (document_id, line_no, text)."""
    hit = F.when(F.rlike("text", F.lit(pattern)), F.struct("line_no", F.regexp_extract("text", pattern, 0).alias("m")))
    return lines.where(F.col("line_no") <= first).groupBy("document_id").agg(F.min(hit).getField("m").alias("found"))


def dataset_issues(queries: DataFrame, least_chars: int = 8) -> DataFrame:
    """(query_id, code): queries that are too short, or equal to another in normal form."""
    rows = queries.withColumn("n", F.sha2(X.normalize_reference(F.col("query")), 256))
    short = rows.where(F.char_length(F.trim("query")) < least_chars).select("query_id", F.lit("TOO_SHORT").alias("code"))
    twice = rows.groupBy("n").agg(F.collect_list("query_id").alias("ids")).where(F.size("ids") > 1)
    return short.unionByName(twice.select(F.explode("ids").alias("query_id"), F.lit("DUPLICATE").alias("code")))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def frozen(reviews: DataFrame, by: str, status: str) -> DataFrame:
    """(by, n, approved, frozen): a dataset freezes when every review is approved, case and blanks aside."""
    ok = F.lower(F.trim(status)) == "approved"
    return reviews.groupBy(by).agg(F.count("*").alias("n"), F.count_if(ok).alias("approved")).withColumn("frozen", F.col("n") == F.col("approved"))


def context(rows: DataFrame, group: str, order: str, text: str, around: int = 1) -> DataFrame:
    """Adds context: the texts from `around` rows before to `around` rows after within the group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-around, around)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), " | "))


def lock_issues(lock: DataFrame, now: DataFrame) -> DataFrame:
    """(name, code): locked hashes (name, hash) that changed or are gone."""
    j = lock.select("name", F.col("hash").alias("was")).join(now.select("name", "hash"), "name", "left")
    return j.select("name", F.when(F.col("hash").isNull(), "GONE").when(F.col("hash") != F.col("was"), "CHANGED").alias("code")).where("code is not null")


def review_metrics(reviews: DataFrame, by: str) -> DataFrame:
    """(by, n, precision, missing): reviews with booleans correct and missed."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return reviews.groupBy(by).agg(F.count("*").alias("n"), share("correct").alias("precision"), share("missed").alias("missing"))


#: Kinds of reviewed rows.
ENTITY, RELATION, COVERAGE = "entity", "relationship", "article_coverage"


def extraction_quality(reviews: DataFrame, by: str) -> DataFrame:
    """reviews: (by, kind, verdict, direction_correct, source_valid, mapping_valid, missing_relation), the last four
    'true' in any case or else false. One row per provider; a share of nothing is 0."""
    true = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))
    good = F.coalesce(F.col("verdict") == "correct", F.lit(False))
    kind = lambda *ks: F.col("kind").isin(*ks)
    share = lambda of, what: F.round(F.coalesce(F.try_divide(F.count_if(of & what), F.count_if(of)), F.lit(0.0)), 9)
    both = kind(ENTITY, RELATION)
    return reviews.groupBy(by).agg(
        share(kind(ENTITY), good).alias("entity_precision"),
        share(kind(RELATION), good).alias("relationship_precision"),
        share(kind(RELATION), true("direction_correct")).alias("direction_accuracy"),
        share(both, true("source_valid")).alias("source_accuracy"),
        share(both, true("mapping_valid")).alias("mapping_accuracy"),
        share(kind(COVERAGE), true("missing_relation")).alias("missing_rate"),
        F.count_if(kind(RELATION) & good).alias("accepted_edges"),
        F.count_if(F.col("verdict") == "benchmark_issue").alias("benchmark_issues"),
        F.count("*").alias("reviews"),
    )


def select_provider(quality: DataFrame, gates: dict[str, float], delta: float, by: str = "provider", favoured: str = "") -> DataFrame:
    """quality: extraction_quality with failures, cost_per_edge and latency. Adds passed and winner. A provider passes without
    failures and benchmark issues, at or above each gate, and at or below missing_rate's. Among those less than delta below
    the best relationship precision the cheapest edge wins, then entity precision, latency, the favoured one, the name."""
    ok = (F.col("failures") == 0) & (F.col("benchmark_issues") == 0)
    for name, limit in gates.items():
        ok = ok & (F.col(name) <= limit if name == "missing_rate" else F.col(name) >= limit)
    everything = Window.partitionBy(F.lit(1))  # one row per provider
    best = F.max(F.when(F.col("passed"), F.col("relationship_precision"))).over(everything)
    near = F.col("passed") & (F.round(F.col("best") - F.col("relationship_precision"), 9) < delta)
    order = F.struct("cost_per_edge", (-F.col("entity_precision")).alias("e"), "latency", (F.col(by) != favoured).alias("f"), by)
    rows = quality.withColumn("passed", F.coalesce(ok, F.lit(False))).withColumn("best", best).withColumn("order", F.when(near, order))
    return rows.withColumn("winner", F.coalesce(F.col("order") == F.min("order").over(everything), F.lit(False))).drop("best", "order")


def release_health(releases: DataFrame, passages: DataFrame, embeddings: DataFrame, model: str, revision: str, count: int, lock: str | None = None) -> DataFrame:
    """One row (active, dataset_id, passages, embeddings, lock_match, ready): exactly one ACTIVE release (dataset_id, state, model,
    revision, lock), of the wanted model and counts; lock: its hash, null where no match is asked for. Without exactly one, ids and
    counts are null and nothing is ready."""
    one = releases.where("state = 'ACTIVE'").agg(F.count("*").alias("active"), F.max(F.struct("dataset_id", "model", "revision", "lock")).alias("r"))
    one = one.withColumn("dataset_id", F.when(F.col("active") == 1, F.col("r.dataset_id")))
    counted = lambda df, name: df.groupBy("dataset_id").agg(F.count("*").alias(name))
    out = one.join(counted(passages, "passages"), "dataset_id", "left").join(counted(embeddings.where("status = 'READY'"), "embeddings"), "dataset_id", "left")
    n = lambda c: F.when(F.col("dataset_id").isNotNull(), F.coalesce(c, F.lit(0)))
    match = F.lit(True) if lock is None else F.col("r.lock").eqNullSafe(F.lit(lock))
    out = out.select("active", "dataset_id", n("passages").alias("passages"), n("embeddings").alias("embeddings"), (match & F.col("dataset_id").isNotNull()).alias("lock_match"), "r")
    good = (F.col("r.model") == model) & (F.col("r.revision") == revision) & (F.col("passages") == count) & (F.col("embeddings") == count) & F.col("lock_match")
    return out.withColumn("ready", F.coalesce(good, F.lit(False))).drop("r")


def apply_reviews(dataset: DataFrame, review: DataFrame, key: str, fixed: list[str], changed: list[str]) -> tuple[DataFrame, DataFrame]:
    """The dataset with the columns in `changed` as reviewed (null keeps the old value) and review_status in lower case,
    'draft' without one; and (key, code): MISSING, EXTRA or TWICE rows, and FIXED_CHANGED where an immutable column differs.
    Nothing is applied while there is an issue: then the dataset comes back as it was."""
    issues = reconcile(dataset, review, key)
    r = review.select(key, *[F.col(c).alias(f"_{c}") for c in (*fixed, *changed, "review_status")])
    moved = [F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)) for c in fixed]
    if moved:
        issues = issues.unionByName(dataset.join(r, key).where(reduce(lambda a, b: a | b, moved)).select(key, F.lit("FIXED_CHANGED").alias("code")))
    fine = issues.agg((F.count("*") == 0).alias("_fine"))
    # one row: whether there is an issue at all. Repeated reviews are an issue, so that none may multiply rows
    j = dataset.join(last_wins(r, key, key), key, "left").crossJoin(F.broadcast(fine))
    new = {c: F.when(F.col("_fine"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in changed}
    status = F.when(F.col("_fine"), F.coalesce(F.lower(F.trim("_review_status")), F.lit("draft"))).otherwise(F.col("review_status"))
    return j.withColumns({**new, "review_status": status}).select(*dataset.columns), issues


def migration_state(applied: DataFrame, files: DataFrame) -> DataFrame:
    """applied and files: (name, checksum). (name, state): APPLIED, PENDING, CHANGED since it was applied, or GONE."""
    j = files.join(applied.select("name", F.col("checksum").alias("was")), "name", "full")
    state = F.when(F.col("checksum").isNull(), "GONE").when(F.col("was").isNull(), "PENDING").when(F.col("was") != F.col("checksum"), "CHANGED").otherwise("APPLIED")
    return j.select("name", state.alias("state"))
