"""Registered queries over the driver tables, and for each the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlex.functions import text as X
from arborlex.operators import bm25, dense, evidence, fusion, graph, metrics, parsing, passages, routing, selection, tree, validate
from arborlex.plans.tables import NODES_SQL, nodes, table
from arborlex.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_FOLD = "replace(lower({0}), 'ß', 'ss')"
_TOKENS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
T = lambda c: _TOKENS.format(c)
W = "WITH " + NODES_SQL


# ---- text -------------------------------------------------------------------------------------------------------


@query("token_counts", f"SELECT doc_id, CAST(len({T('text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({T('text')})) AS INTEGER) AS n_distinct, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS n_words FROM documents")
def token_counts(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), X.word_count(F.col("text")).alias("n_words"))


@query(
    "normalized_text",
    """SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]{2,}|\\t', ' ', 'g'))), lambda x: x <> ''), ' ')) AS normal_sha256 FROM documents""",
)
def normalized_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(X.normalize_text("text"), 256).alias("normal_sha256"))


@query("frequency_keys", f"{W} SELECT key, count(*) AS n FROM (SELECT regexp_replace({_FOLD.format('line')}, '[0-9]+', '#', 'g') AS key FROM lines WHERE line <> '') GROUP BY key")
def frequency_keys(spark, d):
    lines = table(spark, d, "documents", "text").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy(X.frequency_key(F.col("line")).alias("key")).agg(F.count("*").alias("n"))


@query("content_hashes", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hashes(spark, d):
    return table(spark, d, "documents", "doc_id", "text").groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def containing(spark, d):
    """(item_id, query, doc_id, source): documents that hold a benchmark text literally."""
    b, docs = leak_texts(spark, d)
    return validate.containing_candidates(b, docs).join(b, "item_id").join(docs, "doc_id").where(F.contains(F.col("source"), F.col("query"))).select("item_id", "query", "doc_id", "source")


def leak_texts(spark, d):
    """(benchmark texts, document texts)."""
    b = table(spark, d, "benchmark", "item_id", "text").select("item_id", F.col("text").alias("query"))
    return b, table(spark, d, "documents", "doc_id", "text").select("doc_id", F.col("text").alias("source"))


@query("overlap_ratio", f"SELECT item_id, doc_id, round(o, 6) AS overlap FROM (SELECT item_id, doc_id, CAST(len(list_intersect(qt, dt)) AS DOUBLE) / len(qt) AS o FROM (SELECT item_id, list_distinct({T('text')}) AS qt FROM benchmark), (SELECT doc_id, list_distinct({T('text')}) AS dt FROM documents)) WHERE o > {validate.LEAK}")
def overlap_ratio(spark, d):
    b, docs = leak_texts(spark, d)
    pairs = validate.overlap_candidates(b, docs).join(b, "item_id").join(docs, "doc_id")
    return validate.lexical_leaks(pairs).where("leak").select("item_id", "doc_id", "overlap")


@query(
    "longest_common_run",
    f"""WITH b AS (SELECT item_id, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM (SELECT item_id, {T('text')} AS t FROM benchmark)),
    s AS (SELECT doc_id, generate_subscripts(t, 1) AS j, unnest(t) AS token FROM (SELECT doc_id, {T('text')} AS t FROM documents)),
    m AS (SELECT item_id, doc_id, j - i AS shift, i - row_number() OVER (PARTITION BY item_id, doc_id, j - i ORDER BY i) AS island FROM b JOIN s USING (token)),
    n AS (SELECT item_id, doc_id, count(*) AS n FROM m GROUP BY item_id, doc_id, shift, island)
    SELECT item_id, doc_id, max(n) AS run FROM n GROUP BY ALL HAVING max(n) >= {validate.RUN}""",
)
def longest_common_run(spark, d):
    b, docs = leak_texts(spark, d)
    pairs = validate.run_candidates(b, docs).join(b, "item_id").join(docs, "doc_id")
    return validate.longest_common_run(pairs, ["item_id", "doc_id"], "query", "source").where(F.col("run") >= validate.RUN)


# ---- retrieval --------------------------------------------------------------------------------------------------

_BM25 = f"""
tok AS (SELECT doc_id AS id, unnest({T('text')}) AS term FROM documents),
len AS (SELECT doc_id AS id, len({T('text')}) AS length FROM documents),
stat AS (SELECT count(*) AS n, avg(length) AS avgdl FROM len),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, stat),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({T('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 9) AS score
       FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (id), stat GROUP BY ALL),
every AS (SELECT b.item_id AS query_id, d.doc_id AS id, coalesce(score, 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.query_id = b.item_id AND sc.id = d.doc_id),
top AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM every QUALIFY rank <= 10)
"""


def bm25_hits(spark, d, top_k=10):
    return bm25.search(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"), top_k, "doc_id", "text", "item_id", "text")


@query("bm25_top10", f"WITH {_BM25} SELECT query_id, rank, id AS doc_id, round(score, 6) AS score FROM top")
def bm25_top10(spark, d):
    return bm25_hits(spark, d).withColumn("score", F.round("score", 6))


@query("bm25_idf_stats", f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf_stats(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return bm25.idf(bm25.term_table(docs, "doc_id", "text"), bm25.corpus_stats(docs, "doc_id", "text")).select("term", "df", F.round("idf", 6).alias("idf"))


_VEC = """
v AS (SELECT vec_id, 'V' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label, 'A' || (label * 8 + vec_id % 8) AS grp FROM embeddings),
q AS (SELECT vec_id AS query_id, x AS y FROM v WHERE vec_id % 20 = 0),
art AS (SELECT grp, first(x ORDER BY vec_id) AS x FROM v GROUP BY grp),
g AS (SELECT query_id, id, round(list_dot_product(x, y), 6) AS score FROM v, q),
g50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g QUALIFY rank <= 50),
a AS (SELECT query_id, grp, round(list_dot_product(x, y), 6) AS score FROM art, q),
a10 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, grp) AS rank FROM a QUALIFY rank <= 10),
l AS (SELECT a10.query_id, a10.grp, a10.rank AS group_rank, g.id, g.score, row_number() OVER (PARTITION BY a10.query_id, a10.grp ORDER BY g.score DESC, g.id) AS local_rank
      FROM a10 JOIN v ON v.grp = a10.grp JOIN g ON g.query_id = a10.query_id AND g.id = v.id QUALIFY local_rank <= 3)
"""


def vectors(spark, d):
    grp = F.concat(F.lit("A"), F.col("label") * 8 + F.col("vec_id") % 8)
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("V"), "vec_id").alias("id"), F.col("embedding").alias("vector"), grp.alias("group"))


#: The stated query set of the searches: every vector whose id is divisible by this.
STEP = 20


def vector_queries(spark, d):
    return table(spark, d, "embeddings").where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def scouts(spark, d):
    """(articles, fine hits, guided leaves) of each vector query; an article's vector is its first one."""
    v, q = vectors(spark, d), vector_queries(spark, d)
    art = v.groupBy("group").agg(F.min(F.struct("vec_id", "vector")).getField("vector").alias("vector")).select(F.col("group").alias("id"), "vector")
    a = dense.global_search(art, q, 10)
    return a, dense.global_search(v, q, 50), dense.guided_search(v, q, a.select("query_id", F.col("id").alias("group"), "rank"), 3)


@query("dense_top10", f"WITH {_VEC} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM g50 WHERE rank <= 10")
def dense_top10(spark, d):
    return dense.global_search(vectors(spark, d), vector_queries(spark, d), 10)


@query("guided_top3_per_group", f'WITH {_VEC} SELECT query_id, grp AS "group", CAST(group_rank AS INTEGER) AS group_rank, CAST(local_rank AS INTEGER) AS local_rank, id, score FROM l')
def guided_top3_per_group(spark, d):
    return scouts(spark, d)[2]


@query("vector_validation", "SELECT count(*) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS least_dim, CAST(max(len(embedding)) AS INTEGER) AS most_dim, round(max(abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1)), 5) AS worst_norm, CAST(0 AS BIGINT) AS issues FROM embeddings")
def vector_validation(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    bad = dense.vector_issues(e, 64).agg(F.count("*").alias("issues"))
    return e.agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"), F.round(F.max(F.abs(dense.norm(F.col("embedding")) - 1)), 5).alias("worst_norm")).crossJoin(bad)


_POOL = """
guided AS (SELECT query_id, id, min(3 * (group_rank - 1) + local_rank) AS guided FROM l GROUP BY ALL),
fine AS (SELECT coalesce(g50.query_id, guided.query_id) AS query_id, coalesce(g50.id, guided.id) AS id, coalesce(1.0 / (60 + g50.rank), 0) + coalesce(1.0 / (60 + guided), 0) AS score
         FROM g50 FULL JOIN guided ON g50.query_id = guided.query_id AND g50.id = guided.id),
best AS (SELECT l.query_id, l.grp, min(g50.rank) AS best FROM l LEFT JOIN g50 ON g50.query_id = l.query_id AND g50.id = l.id GROUP BY ALL),
pool AS (
  SELECT query_id, fine.id AS passage_id, 'fine' AS source, grp AS article_id, round(fine.score, 9) AS score FROM fine JOIN v ON v.id = fine.id
  UNION ALL SELECT a10.query_id, a10.grp, 'article', a10.grp, round(1.0 / (60 + a10.rank) + coalesce(1.0 / (60 + best), 0), 9) FROM a10 LEFT JOIN best ON best.query_id = a10.query_id AND best.grp = a10.grp)
"""


def fusion_inputs(spark, d):
    a, g, leaves = scouts(spark, d)
    fine = vectors(spark, d).select("id", F.col("id").alias("primary_id"), F.col("group").alias("article_id"))
    return a.select("query_id", "rank", F.col("id").alias("article_id")), g.select("query_id", "rank", "id"), leaves.withColumnRenamed("group", "article_id"), fine


@query("rrf_pool", f"WITH {_VEC}, {_POOL} SELECT query_id, passage_id, source, article_id, score FROM pool")
def rrf_pool(spark, d):
    return fusion.candidates(*fusion_inputs(spark, d)).select("query_id", "passage_id", "source", "article_id", "score")


@query(
    "hybrid_top10",
    f"""WITH {_VEC}, {_POOL},
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE source WHEN 'article' THEN 1 ELSE 0 END, passage_id) AS o FROM pool),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, CASE source WHEN 'article' THEN '' ELSE article_id END ORDER BY o) AS r FROM o),
    e AS (SELECT *, r <= CASE source WHEN 'article' THEN 1 ELSE 3 END AS e1, r <= CASE source WHEN 'article' THEN 2 ELSE 3 END AS e2 FROM r),
    s AS (SELECT *, CASE WHEN e1 AND sum(CAST(e1 AS INTEGER)) OVER (PARTITION BY query_id ORDER BY o) <= 5 THEN 0 ELSE 1 END AS late FROM e),
    f AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY late, o) AS INTEGER) AS rank FROM s WHERE e2 QUALIFY rank <= 10)
    SELECT query_id, rank, passage_id, source, score, count(*) OVER (PARTITION BY query_id) = 10 AS complete FROM f""",
)
def hybrid_top10(spark, d):
    return fusion.hybrid(*fusion_inputs(spark, d)).drop("evidence_ids")


@query(
    "scoped_hits",
    f"""WITH {_VEC}, h AS (SELECT query_id, rank, id, grp FROM g50 JOIN v USING (id) WHERE rank <= 10)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, id FROM h WHERE query_id // 20 % 2 = 0 OR CAST(substr(grp, 2) AS INTEGER) < 40""",
)
def scoped_hits(spark, d):
    hits = dense.global_search(vectors(spark, d), vector_queries(spark, d), 10).join(vectors(spark, d).select("id", F.col("group").alias("document_id")), "id")
    scope = vector_queries(spark, d).where(f"query_id div {STEP} % 2 = 1").select("query_id").join(vectors(spark, d).select(F.col("group").alias("document_id")).distinct().where("cast(substr(document_id, 2) as int) < 40"))
    return fusion.scoped(hits, scope).select("query_id", "rank", "id")


# ---- metrics ----------------------------------------------------------------------------------------------------

_HITS = f"""{_BM25},
gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
need AS (SELECT item_id AS query_id, item_id % 6 AS category, (SELECT count(*) FROM gold WHERE gold.query_id = item_id) AS required FROM benchmark),
hits AS (SELECT top.*, length AS tokens, EXISTS (SELECT 1 FROM gold WHERE gold.query_id = top.query_id AND gold.doc_id = top.id) AS exact FROM top JOIN len USING (id)),
perk AS (SELECT need.query_id, category, k, CAST(coalesce(max(CASE WHEN exact THEN 1 ELSE 0 END) FILTER (rank <= k), 0) AS DOUBLE) AS hit,
         CASE WHEN required = 0 THEN 0.0 ELSE CAST(count(*) FILTER (exact AND rank <= k) AS DOUBLE) / required END AS evidence,
         CAST(sum(tokens) FILTER (rank <= k) AS DOUBLE) AS tokens, coalesce(1.0 / min(rank) FILTER (exact), 0.0) AS reciprocal
         FROM need CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k) LEFT JOIN hits USING (query_id) GROUP BY need.query_id, category, k, required)
"""
_AGG = "count(*) AS queries, round_even(avg(reciprocal), 6) AS mrr, round_even(avg(hit), 6) AS recall, round_even(avg(evidence), 6) AS evidence_coverage, round_even(avg(tokens), 6) AS avg_evidence_tokens"


def ranked_rows(spark, d):
    """(queries with gold, ranked rows) of the BM25 run."""
    gold = containing(spark, d).select(F.col("item_id").alias("query_id"), F.col("doc_id").cast("string").alias("doc"))
    need = table(spark, d, "benchmark", "item_id").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 6).alias("category"))
    queries = need.join(gold.groupBy("query_id").agg(F.collect_set("doc").alias("required_ids")), "query_id", "left").withColumn("required_ids", F.coalesce("required_ids", F.array().cast("array<string>")))
    tokens = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(X.tokens(F.col("text"))).alias("evidence_tokens"))
    rows = bm25_hits(spark, d).join(tokens, "doc_id").withColumn("doc", F.col("doc_id").cast("string"))
    rows = rows.join(gold.withColumn("exact_hit", F.lit(True)), ["query_id", "doc"], "left").withColumn("exact_hit", F.coalesce("exact_hit", F.lit(False)))
    return queries, rows.withColumn("included", F.array("doc"))


@query("ir_metrics_at_k", f"WITH {_HITS} SELECT 'all' AS grp, CAST(k AS INTEGER) AS k, {_AGG} FROM perk GROUP BY k")
def ir_metrics_at_k(spark, d):
    return metrics.aggregate(*ranked_rows(spark, d))


@query("ir_metrics_by_category", f"WITH {_HITS} SELECT CAST(category AS VARCHAR) AS grp, CAST(k AS INTEGER) AS k, {_AGG} FROM perk GROUP BY category, k")
def ir_metrics_by_category(spark, d):
    return metrics.aggregate(*ranked_rows(spark, d), by="category")


@query("ir_duplication_at_k")
def ir_duplication_at_k(spark, d):
    """A document is a node, its lines are its components."""
    queries, rows = ranked_rows(spark, d)
    docs = table(spark, d, "documents", "doc_id", "text")
    node = lambda id_, n: F.struct(id_.alias("id"), n.alias("tokens"))
    line = lambda x: F.struct(F.sha2(F.array_join(X.tokens(x), " "), 256).alias("hash"), F.size(X.tokens(x)).alias("tokens"))
    need = queries.select("query_id", F.explode("required_ids").alias("doc")).join(docs.withColumn("doc", F.col("doc_id").cast("string")), "doc")
    need = need.groupBy("query_id").agg(F.collect_list(node(F.col("doc"), F.size(X.tokens(F.col("text"))))).alias("required"))
    queries = queries.join(need, "query_id", "left").withColumn("required", F.coalesce("required", F.array().cast("array<struct<id:string,tokens:int>>"))).withColumnRenamed("required_ids", "gold_ids")
    rows = rows.join(docs, "doc_id").withColumn("covered", F.when(F.col("exact_hit"), F.array("doc")).otherwise(F.array().cast("array<string>"))).withColumn("contexts", F.array().cast("array<string>"))
    rows = rows.withColumn("nodes", F.array(node(F.col("doc"), F.col("evidence_tokens")))).withColumn("components", F.transform(F.split("text", "\n"), line)).withColumn("index_tokens", F.col("evidence_tokens"))
    return metrics.aggregate_duplication(queries, rows)


@query("first_hit_rank", f"WITH {_HITS} SELECT need.query_id, coalesce(min(rank) FILTER (exact), 0) AS first_rank, round(coalesce(1.0 / min(rank) FILTER (exact), 0.0), 6) AS reciprocal FROM need LEFT JOIN hits USING (query_id) GROUP BY need.query_id")
def first_hit_rank(spark, d):
    return metrics.first_hits(*ranked_rows(spark, d)).withColumn("reciprocal", F.round("reciprocal", 6)).withColumn("first_rank", F.coalesce("first_rank", F.lit(0)))


@query("component_redundancy", f"""{W}, c AS (SELECT document_id, sha256(array_to_string({T('line')}, ' ')) AS hash, len({T('line')}) AS tokens FROM lines),
    h AS (SELECT document_id, hash, min(tokens) AS one, sum(tokens) AS every, count(*) AS times FROM c GROUP BY ALL)
    SELECT document_id, CAST(sum(every) AS BIGINT) AS total, CAST(sum(one) AS BIGINT) AS unique_tokens, CAST(sum(CASE WHEN times > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated, round(CASE WHEN sum(every) = 0 THEN 0 ELSE (sum(every) - sum(one)) / sum(every) END, 6) AS ratio FROM h GROUP BY document_id""")
def component_redundancy(spark, d):
    lines = table(spark, d, "documents", "doc_id", "text").select(F.concat(F.lit("D"), "doc_id").alias("document_id"), F.explode(F.split("text", "\n")).alias("line"))
    t = X.tokens(F.col("line"))
    out = metrics.redundancy(lines.select("document_id", F.sha2(F.array_join(t, " "), 256).alias("hash"), F.size(t).alias("tokens")), ["document_id"])
    return out.select("document_id", "total", F.col("unique_tokens").cast("long").alias("unique_tokens"), "repeated", "ratio")


@query("percentiles", "SELECT lang, CAST(list_sort(list(n_chars))[CAST(ceil(0.95 * count(*)) AS INTEGER)] AS BIGINT) AS nearest_rank, CAST(list_sort(list(n_chars))[CAST(least(floor(0.95 * count(*)) + 1, count(*)) AS INTEGER)] AS BIGINT) AS floor_index, CAST(list_sort(list(n_chars))[CAST(round_even((count(*) - 1) * 0.95, 0) + 1 AS INTEGER)] AS BIGINT) AS rounded_index, round(quantile_cont(n_chars, 0.95), 6) AS linear FROM documents GROUP BY lang")
def percentiles(spark, d):
    docs = table(spark, d, "documents", "lang", "n_chars")
    return docs.groupBy("lang").agg(metrics.nearest_rank(0.95, "n_chars").cast("long").alias("nearest_rank"), metrics.floor_index(0.95, "n_chars").alias("floor_index"), metrics.rounded_index(0.95, "n_chars").alias("rounded_index"), F.round(metrics.linear(0.95, "n_chars"), 6).alias("linear"))


# ---- trees and passages -----------------------------------------------------------------------------------------


@query("tree_nodes", f"{W} SELECT document_id, node_id, parent_id, type, ordinal FROM nodes")
def tree_nodes(spark, d):
    return nodes(spark, d).select("document_id", "node_id", "parent_id", "type", "ordinal")


@query("children_ordered", f"{W} SELECT document_id, parent_id AS node_id, count(*) AS children, sha256(string_agg(node_id, ',' ORDER BY ordinal)) AS digest FROM nodes WHERE parent_id IS NOT NULL GROUP BY document_id, parent_id")
def children_ordered(spark, d):
    return tree.children(nodes(spark, d)).select("document_id", "node_id", F.size("children_ids").cast("long").alias("children"), F.sha2(F.array_join("children_ids", ","), 256).alias("digest"))


_CLOSURE = f"WITH RECURSIVE {NODES_SQL}, c AS (SELECT document_id, node_id AS ancestor_id, node_id, 0 AS distance FROM nodes UNION ALL SELECT c.document_id, n.parent_id, c.node_id, c.distance + 1 FROM c JOIN nodes n ON n.document_id = c.document_id AND n.node_id = c.ancestor_id WHERE n.parent_id IS NOT NULL)"


@query("tree_closure", f"{_CLOSURE} SELECT document_id, ancestor_id, node_id, distance FROM c")
def tree_closure(spark, d):
    return tree.closure(nodes(spark, d), 4)


@query("ancestors_path", f"{_CLOSURE} SELECT document_id, node_id, string_agg(ancestor_id, '>' ORDER BY distance) AS path FROM c WHERE distance > 0 GROUP BY document_id, node_id")
def ancestors_path(spark, d):
    return tree.ancestors(nodes(spark, d), 4).select("document_id", "node_id", F.array_join("ancestor_ids", ">").alias("path"))


@query("descendant_counts", f"{_CLOSURE} SELECT c.document_id, ancestor_id AS node_id, count(*) AS descendants, sha256(string_agg(c.node_id, ',' ORDER BY ordinal)) AS digest FROM c JOIN nodes n ON n.document_id = c.document_id AND n.node_id = c.node_id WHERE distance > 0 GROUP BY c.document_id, ancestor_id")
def descendant_counts(spark, d):
    return tree.descendants(nodes(spark, d), 4).select("document_id", "node_id", F.size("descendant_ids").cast("long").alias("descendants"), F.sha2(F.array_join("descendant_ids", ","), 256).alias("digest"))


@query("nearest_article", f"{W} SELECT document_id, node_id, CASE type WHEN 'article' THEN node_id ELSE parent_id END AS found FROM nodes WHERE type <> 'document'")
def nearest_article(spark, d):
    return tree.nearest_of_type(nodes(spark, d), "article", 4)


@query("leaf_targets", f"{W} SELECT document_id, node_id, type FROM nodes n WHERE type = 'clause' OR (type = 'article' AND NOT EXISTS (SELECT 1 FROM nodes m WHERE m.document_id = n.document_id AND m.parent_id = n.node_id))")
def leaf_targets(spark, d):
    return tree.leaf_targets(nodes(spark, d)).select("document_id", "node_id", "type")


@query("tree_violations", f"{W} SELECT document_id, node_id, 'X' AS code FROM nodes WHERE parent_id IS NOT NULL AND node_id = parent_id")
def tree_violations(spark, d):
    return tree.violations(nodes(spark, d))


@query("next_edges", f"{W}, e AS (SELECT document_id, node_id AS source, lead(node_id) OVER (PARTITION BY document_id, type, CASE type WHEN 'article' THEN '' ELSE parent_id END ORDER BY ordinal) AS target, type FROM nodes WHERE type <> 'document') SELECT * FROM e WHERE target IS NOT NULL")
def next_edges(spark, d):
    return tree.next_edges(nodes(spark, d))


@query("sequence_gaps", "SELECT 'C' || conv_id AS document_id, 'C' || conv_id || '__' || turn AS node_id, CAST(turn AS INTEGER) AS key, CAST(before AS INTEGER) AS previous FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE turn % 3 <> 1) WHERE before IS NOT NULL AND turn <> before + 1")
def sequence_gaps(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn").where("turn % 3 <> 1").select(F.concat(F.lit("C"), "conv_id").alias("document_id"), F.concat(F.lit("C"), "conv_id", F.lit("__"), "turn").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("article").alias("type"), F.col("turn").alias("ordinal"), F.col("turn").cast("int").alias("key"))
    return tree.sequence_gaps(c)


@query(
    "fixed_window_passages",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
    n AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 400) / 320.0), 0) AS BIGINT) + 1)) AS no FROM w WHERE len(w) > 0)
    SELECT doc_id AS document_id, CAST(no + 1 AS INTEGER) AS window_no, CAST(no * 320 AS INTEGER) AS start, CAST(len(w[no * 320 + 1 : no * 320 + 400]) AS INTEGER) AS tokens, sha256(array_to_string(w[no * 320 + 1 : no * 320 + 400], ' ')) AS passage_sha256 FROM n""",
)
def fixed_window_passages(spark, d):
    out = passages.fixed_windows(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return out.select("document_id", "window_no", "start", "tokens", F.sha2("passage", 256).alias("passage_sha256"))


_ARTICLES = f"{W}, art AS (SELECT document_id, CASE type WHEN 'article' THEN node_id ELSE parent_id END AS primary_id, string_agg(trim(text), chr(10) ORDER BY ordinal) AS text, count(*) AS sources FROM nodes WHERE type <> 'document' AND trim(text) <> '' GROUP BY ALL)"


@query("article_passages", f"{_ARTICLES} SELECT document_id, primary_id, sha256(text) AS text_sha256, sources FROM art")
def article_passages(spark, d):
    return passages.articles(nodes(spark, d)).select("document_id", "primary_id", F.sha2("text", 256).alias("text_sha256"), F.size("source_node_ids").cast("long").alias("sources"))


@query("clause_passages", f"{W} SELECT document_id, node_id AS primary_id, sha256(trim(text)) AS text_sha256 FROM nodes n WHERE trim(text) <> '' AND (type = 'clause' OR (type = 'article' AND NOT EXISTS (SELECT 1 FROM nodes m WHERE m.document_id = n.document_id AND m.parent_id = n.node_id)))")
def clause_passages(spark, d):
    return passages.clauses(nodes(spark, d)).select("document_id", "primary_id", F.sha2("text", 256).alias("text_sha256"))


@query("context_variants", f"{W}, t AS (SELECT 'D' || doc_id AS document_id, source || '-' || lang AS title FROM documents) SELECT n.document_id, n.node_id AS primary_id, sha256(concat_ws(chr(10), title, nullif(trim(m.text), ''), nullif(trim(n.text), ''))) AS text_sha256 FROM nodes n JOIN t USING (document_id) LEFT JOIN nodes m ON m.document_id = n.document_id AND m.node_id = n.parent_id AND m.type = 'article' WHERE n.type = 'clause' OR (n.type = 'article' AND NOT EXISTS (SELECT 1 FROM nodes k WHERE k.document_id = n.document_id AND k.parent_id = n.node_id))")
def context_variants(spark, d):
    titles = table(spark, d, "documents", "doc_id", "source", "lang").select(F.concat(F.lit("D"), "doc_id").alias("document_id"), F.concat_ws("-", "source", "lang").alias("title"))
    return passages.leaves_in_context(nodes(spark, d), "B4e", titles).select("document_id", "primary_id", F.sha2("text", 256).alias("text_sha256"))


@query("passage_stats", f"{_ARTICLES}, n AS (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM art) SELECT count(*) AS passages, CAST(min(n) AS INTEGER) AS min, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS p75, CAST(quantile_disc(n, 0.95) AS DOUBLE) AS p95, CAST(max(n) AS INTEGER) AS max, round(avg(n), 3) AS mean FROM n")
def passage_stats(spark, d):
    return passages.stats(passages.articles(nodes(spark, d))).withColumn("p95", F.col("p95").cast("double"))


@query("coverage_violations", f"{W} SELECT document_id, node_id FROM nodes WHERE type <> 'document' AND trim(text) = ''")
def coverage_violations(spark, d):
    n = nodes(spark, d)
    return passages.coverage(n.where("type <> 'document'"), passages.articles(n))


@query("passage_issues", f"{_ARTICLES} SELECT primary_id, 'TOO_LONG' AS code FROM art WHERE len(regexp_extract_all(text, '\\S+')) > 200")
def passage_issues(spark, d):
    n = nodes(spark, d)
    return passages.issues(passages.articles(n), n, 200)


@query("parent_expansion", f"{W} SELECT n.document_id, n.node_id, sha256(concat_ws(chr(10), nullif(trim(m.text), ''), nullif(trim(n.text), ''))) AS evidence_sha256 FROM nodes n LEFT JOIN nodes m ON m.document_id = n.document_id AND m.node_id = n.parent_id AND m.type = 'article' WHERE n.type = 'clause'")
def parent_expansion(spark, d):
    n = nodes(spark, d)
    return evidence.expand(n, n.where("type = 'clause'").select("document_id", "node_id")).select("document_id", "node_id", F.sha2("evidence", 256).alias("evidence_sha256"))


@query("evidence_components", f"{W} SELECT document_id, CASE type WHEN 'article' THEN node_id ELSE parent_id END AS primary_id, CAST(row_number() OVER (PARTITION BY document_id, CASE type WHEN 'article' THEN node_id ELSE parent_id END ORDER BY ordinal) - 1 AS INTEGER) AS ordinal, node_id, CASE type WHEN 'article' THEN 'primary' ELSE 'context_clause' END AS role, sha256(array_to_string({T('trim(text)')}, ' ')) AS hash, CAST(len(regexp_extract_all(trim(text), '\\S+')) AS INTEGER) AS tokens FROM nodes WHERE type <> 'document' AND trim(text) <> ''")
def evidence_components(spark, d):
    n = nodes(spark, d)
    return evidence.components(passages.articles(n), n).drop("text")


@query("scout_bundles", f"{W}, p AS (SELECT document_id, node_id, ordinal, trim(text) AS text, sha256(array_to_string({T('trim(text)')}, ' ')) AS hash FROM nodes WHERE type <> 'document' AND trim(text) <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY document_id, hash ORDER BY ordinal, node_id) AS n FROM p) SELECT document_id AS bundle_id, count(*) AS parts, sha256(string_agg(text, chr(10) ORDER BY ordinal, node_id)) AS text_sha256 FROM o WHERE n = 1 GROUP BY document_id")
def scout_bundles(spark, d):
    said = nodes(spark, d).where("type <> 'document' and trim(text) <> ''").withColumn("text", F.trim("text"))
    parts = said.select(F.col("document_id").alias("bundle_id"), "ordinal", "node_id", "text", F.sha2(F.array_join(X.tokens(F.col("text")), " "), 256).alias("hash"), X.word_count(F.col("text")).alias("tokens"))
    return evidence.bundles(parts).select("bundle_id", F.size("node_ids").cast("long").alias("parts"), F.sha2("text", 256).alias("text_sha256"))


# ---- parsing ----------------------------------------------------------------------------------------------------


_MARKED = """marked AS (SELECT doc_id, turn, CASE turn % 5 WHEN 0 THEN 'Chương IV Title' WHEN 1 THEN 'Điều ' || turn || '. Heading' WHEN 2 THEN turn || '. text here' WHEN 3 THEN 'đ) point here' ELSE 'plain ' || turn END AS text FROM (SELECT conv_id AS doc_id, turn FROM conversations))"""


def marked(spark, d):
    t = F.col("turn")
    text = F.when(t % 5 == 0, "Chương IV Title").when(t % 5 == 1, F.concat(F.lit("Điều "), t, F.lit(". Heading"))).when(t % 5 == 2, F.concat(t, F.lit(". text here"))).when(t % 5 == 3, "đ) point here").otherwise(F.concat(F.lit("plain "), t))
    return table(spark, d, "conversations", "conv_id", "turn").select(F.col("conv_id").alias("doc_id"), "turn", text.alias("text"))


@query("marker_detection", f"WITH {_MARKED} SELECT doc_id, turn, CASE turn % 5 WHEN 0 THEN 'chapter' WHEN 1 THEN 'article' WHEN 2 THEN 'clause' WHEN 3 THEN 'point' END AS kind, CASE turn % 5 WHEN 0 THEN 'IV' WHEN 1 THEN '' || turn WHEN 2 THEN '' || turn WHEN 3 THEN 'đ' END AS key, CASE turn % 5 WHEN 0 THEN 'Title' WHEN 1 THEN 'Heading' WHEN 2 THEN 'text here' WHEN 3 THEN 'point here' END AS title FROM marked")
def marker_detection(spark, d):
    return marked(spark, d).withColumn("m", parsing.marker(F.col("text"))).select("doc_id", "turn", "m.kind", "m.key", "m.title")


@query(
    "hierarchy_state",
    f"""WITH {_MARKED}, m AS (SELECT doc_id, turn, turn % 5 AS k FROM marked WHERE turn % 5 < 4),
    s AS (SELECT doc_id, turn, k, max(CASE WHEN k = 0 THEN turn END) OVER w AS ch, max(CASE WHEN k = 1 THEN turn END) OVER w AS ar, max(CASE WHEN k = 2 THEN turn END) OVER w AS cl, max(CASE WHEN k = 3 THEN turn END) OVER w AS po FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY turn)),
    o AS (SELECT *, ar > coalesce(ch, -1) AS oa, cl > greatest(coalesce(ch, -1), coalesce(ar, -1)) AS oc, po > greatest(coalesce(ch, -1), coalesce(ar, -1), coalesce(cl, -1)) AS op FROM s)
    SELECT doc_id AS document_id, turn AS position, CASE WHEN ch IS NOT NULL THEN 'IV' END AS chapter, CASE WHEN oa THEN '' || ar END AS article, CASE WHEN oc THEN '' || cl END AS clause, CASE WHEN op THEN 'đ' END AS point, (k = 2 AND NOT coalesce(oa, false)) OR (k = 3 AND NOT coalesce(oc, false)) AS orphan FROM o""",
)
def hierarchy_state(spark, d):
    m = marked(spark, d).withColumn("m", parsing.marker(F.col("text"))).where("m is not null").select(F.col("doc_id").alias("document_id"), F.col("turn").alias("position"), "m.kind", "m.key")
    return parsing.hierarchy(m).select("document_id", "position", "chapter", "article", "clause", "point", "orphan")


@query(
    "segment_groups",
    f"""WITH {_MARKED}, o AS (SELECT *, CASE WHEN turn % 5 < 4 AND row_number() OVER (PARTITION BY doc_id ORDER BY turn) > 1 THEN 1 ELSE 0 END AS opens FROM marked),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY turn) AS segment FROM o)
    SELECT doc_id AS document_id, CAST(segment AS BIGINT) AS segment, string_agg(text, ' ' ORDER BY turn) AS text FROM g GROUP BY doc_id, segment""",
)
def segment_groups(spark, d):
    lines = marked(spark, d).select(F.col("doc_id").alias("document_id"), F.lit("b").alias("block_id"), F.col("turn").alias("line_no"), "text")
    return parsing.segments(lines).select("document_id", "segment", "text")


@query(
    "margin_lines",
    """WITH l AS (SELECT l_orderkey % 50 AS document_id, l_orderkey AS page, l_linenumber AS line_no, CASE l_linenumber WHEN 1 THEN 'Header ' || l_orderkey WHEN 2 THEN '- ' || l_orderkey % 1000 || ' -' ELSE l_returnflag || ' ' || l_linestatus END AS text, CASE WHEN l_linenumber IN (1, 2) THEN 2.0 WHEN l_linenumber = 3 THEN 95.0 ELSE 50.0 END AS top FROM lineitem),
    k AS (SELECT *, top <= 8 OR top + 1 >= 92 AS marginal, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS key FROM l),
    p AS (SELECT document_id, count(DISTINCT page) AS pages FROM l GROUP BY 1),
    r AS (SELECT document_id, key FROM k JOIN p USING (document_id) WHERE marginal GROUP BY document_id, key, pages HAVING count(*) >= greatest(2, floor(pages * 0.6 + 0.999))),
    x AS (SELECT k.*, CASE WHEN marginal AND regexp_matches(text, '^\\s*[-–—]?\\s*[0-9]{1,4}\\s*[-–—]?\\s*$') THEN 'page_number' WHEN marginal AND r.key IS NOT NULL THEN CASE WHEN top <= 8 THEN 'header' ELSE 'footer' END END AS removed FROM k LEFT JOIN r ON r.document_id = k.document_id AND r.key = k.key)
    SELECT document_id, coalesce(removed, 'kept') AS removed, count(*) AS n FROM x GROUP BY ALL""",
)
def margin_lines(spark, d):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    text = F.when(n == 1, F.concat(F.lit("Header "), o)).when(n == 2, F.concat(F.lit("- "), o % 1000, F.lit(" -"))).otherwise(F.concat_ws(" ", "l_returnflag", "l_linestatus"))
    top = F.when(n.isin(1, 2), 2.0).when(n == 3, 95.0).otherwise(50.0)
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").select((o % 50).alias("document_id"), o.alias("page"), n.alias("line_no"), top.alias("top"), (top + 1).alias("bottom"), F.lit(100.0).alias("height"), text.alias("text"))
    return parsing.margin_lines(lines).groupBy("document_id", F.coalesce("removed", F.lit("kept")).alias("removed")).agg(F.count("*").alias("n"))


# ---- citations --------------------------------------------------------------------------------------------------

#: (case, query, status, node ids): citations of a small stated corpus.
CASES = (
    ("r1", "Điều 7 khoản 1", "AMBIGUOUS", ""),
    ("r2", "Các điểm c đến e khoản 1 Điều 7 của luật a", "RESOLVED", "A7C1Pc,A7C1Pd,A7C1Pđ,A7C1Pe"),
    ("r3", "Điểm b, a và đ khoản 1 Điều 7 luật a", "RESOLVED", "A7C1Pa,A7C1Pb,A7C1Pđ"),
    ("r4", "khoản 2 quy định gì", "PARTIAL", ""),
    ("r5", "Điều 99 luật b", "NOT_FOUND", ""),
    ("r6", "thủ tục đăng ký là gì", "NO_REFERENCE", ""),
    ("r7", "Điều 7 luật a và luật b", "CONFLICT", ""),
    ("r8", "Điều 8 luật b", "RESOLVED", "B8"),
)


def citation_corpus(spark):
    rows = [("LA", "A7", "article", 1, "7", None, None), ("LA", "A7C1", "clause", 2, "7", "1", None)]
    rows += [("LA", f"A7C1P{p}", "point", 3 + i, "7", "1", p) for i, p in enumerate("abcdđe")]
    rows += [("LB", "B7", "article", 1, "7", None, None), ("LB", "B7C1", "clause", 2, "7", "1", None), ("LB", "B8", "article", 3, "8", None, None)]
    n = spark.createDataFrame(rows, "document_id string, node_id string, type string, ordinal int, article string, clause string, point string")
    return n, spark.createDataFrame([("LA", "luật a"), ("LB", "luật b")], "document_id string, alias string")


def routed_cases(spark, policy):
    q = spark.createDataFrame([(c, t) for c, t, _, _ in CASES], "query_id string, query string")
    n, names = citation_corpus(spark)
    parsed = routing.parse(q)
    parsed = parsed.join(routing.aliases(parsed, names).withColumnRenamed("document_ids", "explicit_ids"), "query_id", "left").withColumn("requested_ids", F.array().cast("array<string>"))
    return routing.route(routing.resolve(parsed, n), policy)


_CASE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}', '{i}')" for c, _, s, i in CASES) + ") t(query_id, status, node_ids)"


@query("resolve_status", _CASE_SQL)
def resolve_status(spark, d):
    return routed_cases(spark, "B7c").select("query_id", "status", F.array_join("node_ids", ",").alias("node_ids"))


@query("route_counts", f"WITH c AS ({_CASE_SQL}) SELECT CASE status WHEN 'RESOLVED' THEN 'direct' WHEN 'AMBIGUOUS' THEN 'suggestion' WHEN 'CONFLICT' THEN 'none' ELSE 'hybrid' END AS route, count(*) AS n FROM c GROUP BY 1")
def route_counts(spark, d):
    return routed_cases(spark, "B7c").groupBy("route").agg(F.count("*").alias("n"))


@query("routing_quality", "SELECT CAST(8 AS BIGINT) AS cases, 1.0::DOUBLE AS detection_precision, 1.0::DOUBLE AS detection_recall, 1.0::DOUBLE AS status_accuracy, 1.0::DOUBLE AS node_accuracy")
def routing_quality(spark, d):
    e = spark.createDataFrame([(c, s, i.split(",") if i else []) for c, _, s, i in CASES], "query_id string, expected_status string, expected_ids array<string>")
    return routing.quality(routed_cases(spark, "B7c"), e)


# ---- selection and governance -----------------------------------------------------------------------------------

_STRATEGIES = "s AS (SELECT source AS strategy, CAST(count(*) FILTER (lang = 'en') AS DOUBLE) AS recall, CAST(count(*) FILTER (lang = 'de') AS DOUBLE) AS mrr, CAST(count(DISTINCT n_chars) AS DOUBLE) AS evidence, round(avg(n_chars), 6) AS tokens, CAST(min(n_chars) AS DOUBLE) AS duplicates FROM documents GROUP BY source)"


def strategies(spark, d):
    docs = table(spark, d, "documents", "source", "lang", "n_chars").groupBy(F.col("source").alias("strategy"))
    return docs.agg(F.count_if(F.col("lang") == "en").cast("double").alias("recall"), F.count_if(F.col("lang") == "de").cast("double").alias("mrr"), F.countDistinct("n_chars").cast("double").alias("evidence"), F.round(F.avg("n_chars"), 6).alias("tokens"), F.min("n_chars").cast("double").alias("duplicates"))


@query("pareto_frontier", f"WITH {_STRATEGIES} SELECT strategy FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.strategy <> a.strategy AND b.recall >= a.recall AND b.mrr >= a.mrr AND b.evidence >= a.evidence AND b.tokens <= a.tokens AND b.duplicates <= a.duplicates AND (b.recall > a.recall OR b.mrr > a.mrr OR b.evidence > a.evidence OR b.tokens < a.tokens OR b.duplicates < a.duplicates))")
def pareto_frontier(spark, d):
    return selection.pareto_frontier(strategies(spark, d)).select("strategy")


@query("strict_winner", f"WITH {_STRATEGIES} SELECT strategy, CAST(row_number() OVER (ORDER BY recall DESC, mrr DESC, evidence DESC, tokens, duplicates, strategy) AS INTEGER) AS place FROM s")
def strict_winner(spark, d):
    return selection.ranked(strategies(spark, d)).select("strategy", "place")


@query("gate_failures", f"WITH {_STRATEGIES}, b AS (SELECT * FROM s WHERE strategy = 'src0') SELECT s.strategy, concat_ws(',', CASE WHEN s.recall - b.recall < 1 THEN 'recall' END, CASE WHEN s.tokens > b.tokens * 1.25 THEN 'tokens' END, CASE WHEN s.duplicates - b.duplicates > 10 THEN 'duplicates' END) AS failures FROM s, b WHERE s.strategy <> 'src0'")
def gate_failures(spark, d):
    out = selection.gate_failures(strategies(spark, d), "src0", {"recall": ("gain", 1.0), "tokens": ("ratio", 1.25), "duplicates": ("rise", 10.0)})
    return out.select("strategy", F.array_join("failures", ",").alias("failures"))


@query("round_robin_sample", "SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS turn FROM documents ORDER BY turn, lang LIMIT 30")
def round_robin_sample(spark, d):
    return selection.round_robin(table(spark, d, "documents", "doc_id", "lang"), "lang", "doc_id", 30).select("doc_id", "lang", "turn")


@query("spread_sample", "WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM n WHERE i IN (SELECT CAST(round_even(k * (n - 1) / 6.0, 0) AS BIGINT) FROM (SELECT unnest(range(7)) AS k))")
def spread_sample(spark, d):
    return selection.spread(table(spark, d, "documents", "doc_id", "source"), "source", "doc_id", 7).select("doc_id", "source")


@query("shadow_diff", f"WITH {_VEC}, h AS (SELECT query_id, rank, id, score FROM g50 WHERE rank <= 10) SELECT query_id, CAST(rank AS INTEGER) AS rank, CASE WHEN query_id // 20 % 10 = 0 AND rank = 10 THEN 'MISSING_RIGHT' ELSE 'OTHER_SCORE' END AS code FROM h WHERE (query_id // 20 % 10 = 0 AND rank = 10) OR (query_id // 20 % 10 = 1 AND rank = 1)")
def shadow_diff(spark, d):
    left = dense.global_search(vectors(spark, d), vector_queries(spark, d), 10)
    q, r = F.expr(f"query_id div {STEP} % 10"), F.col("rank")
    right = left.where(~((q == 0) & (r == 10))).withColumn("score", F.when((q == 1) & (r == 1), F.col("score") + 0.001).otherwise(F.col("score")))
    return selection.shadow_diff(left, right)


@query("review_diff", "SELECT doc_id, 'lang' AS \"column\" FROM documents WHERE doc_id % 100 = 1 UNION ALL SELECT doc_id, CAST(NULL AS VARCHAR) FROM documents WHERE doc_id % 100 = 2")
def review_diff(spark, d):
    before = table(spark, d, "documents", "doc_id", "lang", "source")
    after = before.where("doc_id % 100 <> 2").withColumn("lang", F.when(F.col("doc_id") % 100 == 1, "xx").otherwise(F.col("lang")))
    return validate.review_diff(before, after, "doc_id", ["lang", "source"])


@query("registry_issues", "SELECT 'D' || doc_id AS document_id, 'SOURCE_COUNT' AS code FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'D' || doc_id, 'SOURCE_COUNT' FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY doc_id HAVING count(*) > 1")
def registry_issues(spark, d):
    docs = table(spark, d, "documents", "doc_id").select(F.concat(F.lit("D"), "doc_id").alias("document_id"), F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    return validate.registry_issues(docs, table(spark, d, "labels", "doc_id").select(F.concat(F.lit("D"), "doc_id").alias("document_id")))


@query("text_retention", f"{W}, k AS (SELECT document_id, sum(length(regexp_replace(line, '\\s+', '', 'g'))) AS raw_chars, coalesce(sum(length(regexp_replace(line, '\\s+', '', 'g'))) FILTER (key <= 20), 0) AS kept_chars FROM lines GROUP BY 1) SELECT document_id, CAST(raw_chars AS BIGINT) AS raw_chars, CAST(kept_chars AS BIGINT) AS kept_chars, round(CASE WHEN raw_chars = 0 THEN 1.0 ELSE kept_chars / raw_chars END, 6) AS ratio, CASE WHEN raw_chars = 0 THEN true ELSE kept_chars / raw_chars >= 0.995 END AS passed FROM k")
def text_retention(spark, d):
    lines = table(spark, d, "documents", "doc_id", "text").select(F.concat(F.lit("D"), "doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("key", "text"))
    return validate.retention(lines, lines.where("key < 20"))


@query("validation_report", "WITH i AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END) AS level, count(*) AS n FROM labels GROUP BY doc_id) SELECT 'D' || d.doc_id AS document_id, CASE WHEN level = 2 THEN 'FAIL' WHEN level = 1 THEN 'WARN' ELSE 'PASS' END AS status, coalesce(n, 0) AS issues, coalesce(level, 0) < 2 AS published FROM documents d LEFT JOIN i USING (doc_id)")
def validation_report(spark, d):
    key = F.concat(F.lit("D"), "doc_id").alias("document_id")
    severity = F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "WARN").otherwise("INFO")
    issues = table(spark, d, "labels").select(key, severity.alias("severity"))
    return validate.published(validate.report(issues, table(spark, d, "documents", "doc_id").select(key)), approved=True)


# ---- graph ------------------------------------------------------------------------------------------------------

_GRAPH = """
gn AS (SELECT 'R' || r_regionkey AS node_id, 'place' AS kind, 'region' AS type, r_name AS label FROM region UNION ALL SELECT 'N' || n_nationkey, 'place', 'nation', n_name FROM nation
       UNION ALL SELECT 'C' || c_custkey, 'party', 'customer', c_name FROM customer UNION ALL SELECT 'S' || s_suppkey, 'party', 'supplier', s_name FROM supplier),
ge AS (SELECT 'N' || n_nationkey AS source, 'R' || n_regionkey AS target, 'IN' AS relation FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'FROM' FROM customer
       UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'FROM' FROM supplier),
g AS (SELECT source || '>' || target AS edge_id, * FROM ge)
"""


def graph_tables(spark, d):
    node = lambda t, p, k, kind, type_, label: table(spark, d, t).select(F.concat(F.lit(p), k).alias("node_id"), F.lit(kind).alias("kind"), F.lit(type_).alias("type"), F.col(label).alias("label"), F.lit(t).alias("document_id"))
    n = node("region", "R", "r_regionkey", "place", "region", "r_name").unionByName(node("nation", "N", "n_nationkey", "place", "nation", "n_name")).unionByName(node("customer", "C", "c_custkey", "party", "customer", "c_name")).unionByName(node("supplier", "S", "s_suppkey", "party", "supplier", "s_name"))
    edge = lambda t, p, k, q, to, r: table(spark, d, t).select(F.concat(F.lit(p), k).alias("source"), F.concat(F.lit(q), to).alias("target"), F.lit(r).alias("relation"))
    e = edge("nation", "N", "n_nationkey", "R", "n_regionkey", "IN").unionByName(edge("customer", "C", "c_custkey", "N", "c_nationkey", "FROM")).unionByName(edge("supplier", "S", "s_suppkey", "N", "s_nationkey", "FROM"))
    return n, e.select(F.concat("source", F.lit(">"), "target").alias("edge_id"), "*", F.lit("").alias("description"), F.lit(1.0).alias("confidence"))


@query("structural_edges", f"{W}, e AS (SELECT document_id, node_id AS source, lead(node_id) OVER (PARTITION BY document_id, type, CASE type WHEN 'article' THEN '' ELSE parent_id END ORDER BY ordinal) AS target FROM nodes WHERE type <> 'document') SELECT parent_id AS source, node_id AS target, 'CONTAINS' AS relation FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT source, target, 'NEXT' FROM e WHERE target IS NOT NULL")
def structural_edges(spark, d):
    n = nodes(spark, d)
    return graph.structural(n, tree.next_edges(n))


@query("graph_counts", f"WITH {_GRAPH} SELECT 'node:' || kind AS what, count(*) AS n FROM gn GROUP BY kind UNION ALL SELECT 'edge:' || relation, count(*) FROM g GROUP BY relation")
def graph_counts(spark, d):
    return graph.counts(*graph_tables(spark, d))


@query("graph_validation", f"WITH {_GRAPH} SELECT edge_id AS id, 'DANGLING' AS code FROM g WHERE target = 'N3' UNION ALL SELECT edge_id, 'DANGLING' FROM g WHERE source = 'N3' UNION ALL SELECT edge_id, 'NO_PROVENANCE' FROM g WHERE relation = 'IN'")
def graph_validation(spark, d):
    n, e = graph_tables(spark, d)
    p = e.where("relation <> 'IN'").select("edge_id", F.lit(0).alias("ordinal"), F.col("source").alias("node_id"))
    return graph.validate(n.where("node_id <> 'N3'"), e, p)


@query("node_search", f"WITH {_GRAPH} SELECT node_id, kind, type, label FROM gn WHERE label ILIKE '%a%' AND kind = 'place' ORDER BY CASE WHEN lower(label) = 'a' THEN 0 ELSE 1 END, length(label), node_id LIMIT 12")
def node_search(spark, d):
    n, _ = graph_tables(spark, d)
    aliases = spark.createDataFrame([], "node_id string, alias string, status string")
    return graph.search(n, aliases, "a", kind="place", limit=12).drop("document_id")


@query("subgraph_depth2", f"WITH {_GRAPH}, a AS (SELECT CASE WHEN source = 'R1' THEN target ELSE source END AS node_id FROM g WHERE source = 'R1' OR target = 'R1'), b AS (SELECT CASE WHEN source = a.node_id THEN target ELSE source END AS node_id FROM g JOIN a ON source = a.node_id OR target = a.node_id) SELECT node_id, min(level) AS level FROM (SELECT 'R1' AS node_id, 0 AS level UNION ALL SELECT node_id, 1 FROM a UNION ALL SELECT node_id, 2 FROM b) GROUP BY node_id")
def subgraph_depth2(spark, d):
    _, e = graph_tables(spark, d)
    return graph.subgraph(e, "R1", 2, max_nodes=1_000_000)[0].select("node_id", "level")


@query("node_detail", f"WITH {_GRAPH} SELECT edge_id, source, target, relation FROM g WHERE source = 'N1' OR target = 'N1'")
def node_detail(spark, d):
    return graph.incident(graph_tables(spark, d)[1], "N1").select("edge_id", "source", "target", "relation")


@query("mirror_pairs", f"WITH {_GRAPH}, x AS (SELECT edge_id, source, target, relation FROM g UNION ALL SELECT edge_id || '~', target, source, 'BACK' FROM g WHERE relation = 'IN') SELECT least(source, target) AS \"left\", greatest(source, target) AS \"right\", string_agg(DISTINCT relation, ', ' ORDER BY relation) AS relations, string_agg('[' || source || ' -' || relation || '-> ' || target || ']', chr(10) ORDER BY edge_id) AS description, CAST(count(DISTINCT source) AS DOUBLE) AS weight FROM x GROUP BY 1, 2")
def mirror_pairs(spark, d):
    _, e = graph_tables(spark, d)
    back = e.where("relation = 'IN'").select(F.concat("edge_id", F.lit("~")).alias("edge_id"), F.col("target").alias("source"), F.col("source").alias("target"), F.lit("BACK").alias("relation"), "description", "confidence")
    both = e.unionByName(back)
    return graph.mirror(both, both.select("edge_id", F.lit(0).alias("ordinal"), F.col("source").alias("node_id"))).drop("edge_ids")


@query("alias_rebuild", f"WITH {_GRAPH} SELECT node_id, lower(label) AS normalized, label AS alias FROM gn")
def alias_rebuild(spark, d):
    n, _ = graph_tables(spark, d)
    return graph.alias_table(n.select("node_id", F.array("label", F.upper("label")).alias("aliases")))


@query("graph_merge", f"WITH {_GRAPH} SELECT node_id, kind, type, label || CASE WHEN type = 'nation' THEN '!' ELSE '' END AS label FROM gn WHERE node_id <> 'R0'")
def graph_merge(spark, d):
    n, _ = graph_tables(spark, d)
    again = n.where("type = 'nation'").withColumn("label", F.concat("label", F.lit("!"))).unionByName(n.where("node_id = 'R0'").withColumn("type", F.lit("other")))
    return graph.merge_nodes(n.withColumn("batch", F.lit(0)).unionByName(again.withColumn("batch", F.lit(1))))[0]


@query("release_transitions", "SELECT o_custkey AS release_id, o_orderkey AS step, before, state FROM (SELECT o_custkey, o_orderkey, state, lag(state) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM (SELECT o_custkey, o_orderkey, ['BUILDING', 'VALIDATING', 'READY', 'ACTIVE', 'RETIRED'][o_orderkey % 5 + 1] AS state FROM orders)) WHERE before IS NOT NULL AND (before || state) NOT IN ('BUILDINGVALIDATING', 'VALIDATINGREADY', 'READYACTIVE', 'ACTIVERETIRED', 'RETIREDACTIVE')")
def release_transitions(spark, d):
    states = F.array(*map(F.lit, ("BUILDING", "VALIDATING", "READY", "ACTIVE", "RETIRED")))
    h = table(spark, d, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("release_id"), F.col("o_orderkey").alias("step"), F.get(states, (F.col("o_orderkey") % 5).cast("int")).alias("state"))
    return graph.bad_transitions(h)


# ---- corpus, extraction and reviews -------------------------------------------------------------------------------

from arborlex.operators import governance as gov  # noqa: E402


def lines_of(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select(F.concat(F.lit("D"), "doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("document_id", (F.col("pos") + 1).alias("line_no"), "text")


@query("inspect_documents", f"{W}, i AS (SELECT document_id, count(*) AS pages, avg(CASE WHEN length(line) >= 100 THEN 1.0 ELSE 0.0 END) AS ratio, avg(length(line)) AS mean FROM lines GROUP BY 1) SELECT document_id, pages, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.95 AND mean >= 500 THEN 'DIGITAL' WHEN ratio >= 0.2 THEN 'MIXED' ELSE 'SCANNED' END AS kind FROM i")
def inspect_documents(spark, d):
    return gov.inspect(lines_of(spark, d))


@query("node_freeze", "SELECT conv_id AS node_id, min(turn // 3) AS first_page, max(turn // 3) AS last_page, CAST(count(*) AS INTEGER) AS blocks, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS content_hash FROM conversations GROUP BY conv_id")
def node_freeze(spark, d):
    b = table(spark, d, "conversations", "conv_id", "turn", "text").select(F.col("conv_id").alias("node_id"), F.col("turn").alias("position"), F.floor(F.col("turn") / 3).alias("page"), "text")
    return gov.freeze(b).drop("text")


@query("node_counts", f"{W} SELECT document_id, type, count(*) AS n FROM nodes GROUP BY ALL")
def node_counts(spark, d):
    return gov.node_counts(nodes(spark, d))


@query("hierarchy_labels", f"{W} SELECT node_id, concat_ws(' · ', 'Article ' || split_part(split_part(node_id, '__A', 2), '__C', 1), CASE WHEN type = 'clause' THEN 'Clause ' || key END) AS label FROM nodes WHERE type <> 'document'")
def hierarchy_labels(spark, d):
    n = nodes(spark, d).where("type <> 'document'").withColumn("article", F.regexp_extract("node_id", r"__A(\d+)", 1)).withColumn("clause", F.when(F.col("type") == "clause", F.col("key").cast("string")))
    return n.select("node_id", gov.label(("Article", "article"), ("Clause", "clause")).alias("label"))


@query("corpus_navigation", f"{W} SELECT node_id, sha256(text) AS text_sha256 FROM nodes WHERE node_id = 'D1__A1__C1'")
def corpus_navigation(spark, d):
    return gov.navigate(nodes(spark, d), "D1", 1, 1).select("node_id", F.sha2("text", 256).alias("text_sha256"))


@query("guided_from_ranking", f'WITH {_VEC}, r AS (SELECT g50.query_id, g50.id, grp, CAST(row_number() OVER (PARTITION BY g50.query_id, grp ORDER BY g50.rank) AS INTEGER) AS local_rank FROM g50 JOIN v USING (id) SEMI JOIN a10 USING (query_id, grp) QUALIFY local_rank <= 3) SELECT query_id, grp AS "group", local_rank, id FROM r')
def guided_from_ranking(spark, d):
    a, g, _ = scouts(spark, d)
    return gov.guided_from_ranking(g.join(vectors(spark, d).select("id", "group"), "id"), a.select("query_id", F.col("id").alias("group")))


@query("oracle_recall", f"WITH {_BM25.replace('QUALIFY rank <= 10', 'QUALIFY rank <= 30')}, gold AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), m AS (SELECT gold.query_id, min(rank) AS best FROM gold LEFT JOIN top USING (query_id, id) GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN best <= 30 THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) FILTER (best > 5 AND best <= 30) AS ordering_failures FROM m")
def oracle_recall(spark, d):
    gold = containing(spark, d).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))
    return gov.oracle_recall(bm25_hits(spark, d, 30).withColumnRenamed("doc_id", "id"), gold)


@query("latency_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(list_sort(list(value))[CAST(least(floor(0.5 * count(*)) + 1, count(*)) AS INTEGER)], 6) AS p50, round(list_sort(list(value))[CAST(least(floor(0.95 * count(*)) + 1, count(*)) AS INTEGER)], 6) AS p95 FROM events GROUP BY 1")
def latency_summary(spark, d):
    e = table(spark, d, "events", "event_type", "value")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(metrics.floor_index(0.5, "value"), 6).alias("p50"), F.round(metrics.floor_index(0.95, "value"), 6).alias("p95"))


@query("run_comparison", f"WITH {_STRATEGIES} SELECT strategy, recall, mrr, evidence FROM s")
def run_comparison(spark, d):
    long = strategies(spark, d).select("strategy", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in selection.MAXIMISE])).alias("x")).select("strategy", "x.metric", "x.value")
    return gov.comparison(long, "strategy", "metric", "value", list(selection.MAXIMISE))


@query("retriever_winners", "WITH s AS (SELECT lang, source AS strategy, CAST(count(*) AS DOUBLE) AS recall, CAST(max(n_chars) AS DOUBLE) AS tokens FROM documents GROUP BY ALL) SELECT lang, strategy FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY recall DESC, tokens, strategy) = 1")
def retriever_winners(spark, d):
    s = table(spark, d, "documents", "lang", "source", "n_chars").groupBy("lang", F.col("source").alias("strategy")).agg(F.count("*").cast("double").alias("recall"), F.max("n_chars").cast("double").alias("tokens"))
    return selection.ranked(s, ["lang"], up=("recall",), down=("tokens",)).where("place = 1").select("lang", "strategy")


@query("article_projection", f"{W}, p AS (SELECT document_id, CASE type WHEN 'article' THEN node_id ELSE parent_id END AS article_id, string_agg('[[' || node_id || ']] ' || trim(text), chr(10) ORDER BY ordinal) AS text FROM nodes WHERE type <> 'document' AND trim(text) <> '' GROUP BY ALL) SELECT document_id, article_id, sha256(text) AS content_hash, len(regexp_extract_all(text, '\\S+')) <= 300 AS within_limit FROM p")
def article_projection(spark, d):
    n = nodes(spark, d)
    return gov.projection(n, tree.nearest_of_type(n, "article", 4).withColumnRenamed("found", "article_id"), 300).drop("text")


@query("reference_edges", f"WITH {_MARKED} SELECT doc_id AS document_id, turn AS node_id, '' || turn AS article FROM marked WHERE turn % 5 = 1")
def reference_edges(spark, d):
    texts = marked(spark, d).select(F.col("doc_id").alias("document_id"), F.col("turn").alias("node_id"), "text")
    return gov.cited_articles(texts, routing.ARTICLE)


@query("extraction_reconcile", "SELECT doc_id, 'MISSING' AS code FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'EXTRA' FROM labels WHERE doc_id % 2 = 1")
def extraction_reconcile(spark, d):
    return gov.reconcile(table(spark, d, "documents", "doc_id").where("doc_id % 2 = 0"), table(spark, d, "labels", "doc_id"), "doc_id")


@query("extraction_cost", "SELECT role AS model, count(*) AS calls, round((sum(length(text)) * CASE role WHEN 'user' THEN 0.2 ELSE 0.25 END + sum(turn) * CASE role WHEN 'user' THEN 1.2 ELSE 1.5 END) / 1e6, 6) AS usd FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role")
def extraction_cost(spark, d):
    calls = table(spark, d, "conversations", "role", "turn", "text").where("role in ('user', 'assistant')").select(F.col("role").alias("model"), F.char_length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return gov.cost(calls, {"user": (0.20, 1.20), "assistant": (0.25, 1.50)})


@query("citation_links", "SELECT conv_id, turn, CASE WHEN turn = conv_id % 3 THEN 'A' || turn ELSE 'A' || turn || ',B' || conv_id % 3 END AS links, CASE WHEN turn = conv_id % 3 THEN '' ELSE 'B' || conv_id % 3 END AS disallowed FROM (SELECT conv_id, turn FROM conversations)")
def citation_links(spark, d):
    t = table(spark, d, "conversations", "conv_id", "turn")
    second = F.when(F.col("turn") == F.col("conv_id") % 3, F.concat(F.lit("A"), "turn")).otherwise(F.concat(F.lit("B"), F.col("conv_id") % 3))
    found = gov.citation_links(F.concat(F.lit("see canonical://A"), "turn", F.lit(" and canonical://"), second, F.lit(".")))
    return t.select("conv_id", "turn", F.array_join(found, ",").alias("links"), F.array_join(gov.disallowed(found, F.array(F.concat(F.lit("A"), "turn"))), ",").alias("disallowed"))


@query("document_identity", f"{W}, m AS (SELECT document_id, first(regexp_extract(line, '[A-Z][a-z]+ [a-z]+') ORDER BY key) AS found FROM lines WHERE key <= 80 AND regexp_matches(line, '[A-Z][a-z]+ [a-z]+') GROUP BY 1) SELECT 'D' || doc_id AS document_id, coalesce(found, '') AS found FROM documents LEFT JOIN m ON document_id = 'D' || doc_id")
def document_identity(spark, d):
    return gov.identity(lines_of(spark, d), "[A-Z][a-z]+ [a-z]+").withColumn("found", F.coalesce("found", F.lit("")))


@query("dataset_issues", "WITH q AS (SELECT doc_id AS query_id, text AS query FROM documents), n AS (SELECT query_id, trim(regexp_replace(replace(lower(query), 'ß', 'ss'), '\\s+', ' ', 'g')) AS n FROM q) SELECT query_id, 'TOO_SHORT' AS code FROM q WHERE length(trim(query)) < 30 UNION ALL SELECT query_id, 'DUPLICATE' FROM n WHERE n IN (SELECT n FROM n GROUP BY n HAVING count(*) > 1)")
def dataset_issues(spark, d):
    return gov.dataset_issues(table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), 30)


@query("last_wins_union", "SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source")
def last_wins_union(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source")
    return gov.last_wins(docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1")), "source", "doc_id").select("source", "doc_id")


@query("review_freeze", "SELECT l.quality AS batch, count(*) AS n, count(*) FILTER (toxic = 0) AS approved, count(*) = count(*) FILTER (toxic = 0) AS frozen FROM labels l GROUP BY 1")
def review_freeze(spark, d):
    r = table(spark, d, "labels").select(F.col("quality").alias("batch"), F.when(F.col("toxic") == 0, " Approved ").otherwise("open").alias("status"))
    return gov.frozen(r, "batch", "status")


@query("review_context", "SELECT conv_id, turn, sha256(string_agg(text, ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS context_sha256 FROM conversations")
def review_context(spark, d):
    return gov.context(table(spark, d, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn", F.sha2("context", 256).alias("context_sha256"))


@query("lock_issues", "SELECT 'D' || doc_id AS name, CASE WHEN doc_id % 50 = 0 THEN 'GONE' ELSE 'CHANGED' END AS code FROM documents WHERE doc_id % 50 < 2")
def lock_issues(spark, d):
    lock = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.concat(F.lit("D"), "doc_id").alias("name"), X.content_hash(F.col("text")).alias("hash"))
    now = lock.where("doc_id % 50 <> 0").withColumn("hash", F.when(F.col("doc_id") % 50 == 1, F.lit("x")).otherwise(F.col("hash")))
    return gov.lock_issues(lock, now)


@query("review_metrics", "SELECT lang, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS precision, round(avg(CAST(toxic AS DOUBLE)), 6) AS missing FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def review_metrics(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents", "doc_id", "lang"), "doc_id")
    return gov.review_metrics(r.select("lang", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("missed")), "lang")


@query("provenance_coverage", "SELECT conv_id AS document_id, round(avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM conversations GROUP BY 1")
def provenance_coverage(spark, d):
    t = table(spark, d, "conversations", "conv_id", "turn", "role")
    return validate.provenance_coverage(t.select(F.col("conv_id").alias("document_id"), F.when(F.col("role") == "user", F.col("turn")).alias("page")))


@query("truncated_pages", "SELECT document_id, page, block FROM (SELECT conv_id AS document_id, turn AS page, 0 AS block, text, lead(turn) OVER w AS np, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE np > page AND nr <> 'user' AND NOT regexp_matches(trim(text), '[.;:!?)\\]\"”]$')")
def truncated_pages(spark, d):
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.lit(0).alias("block"), "text", (F.col("role") == "user").alias("marked"))
    return validate.truncated_pages(b)


@query("template_queries", "WITH n AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, 'Which ' || lang || ' text is number ' || doc_id || ' of ' || source || '?' AS query FROM n WHERE i = CAST(round_even((n - 1) / 2.0, 0) AS BIGINT) OR i = 0 OR i = n - 1")
def template_queries(spark, d):
    rows = selection.spread(table(spark, d, "documents", "doc_id", "source", "lang"), "source", "doc_id", 3)
    return rows.select("source", F.format_string("Which %s text is number %d of %s?", "lang", "doc_id", "source").alias("query"))


@query("quota_sample", "WITH a AS (SELECT doc_id, 0 AS quota FROM documents WHERE lang = 'de' ORDER BY n_chars, doc_id LIMIT 5), b AS (SELECT doc_id, 1 FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY n_chars, doc_id LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b")
def quota_sample(spark, d):
    return selection.quota_sample(table(spark, d, "documents", "doc_id", "lang", "n_chars"), [("lang = 'de'", 5), ("n_chars > 500", 5)], "n_chars", "doc_id").select("doc_id", "quota")


@query("structural_gold", f"{W}, h AS (SELECT document_id, node_id, type, parent_id FROM nodes WHERE type <> 'document'), g AS (SELECT document_id, node_id, parent_id FROM nodes WHERE type = 'clause' AND key = 1) SELECT h.document_id, h.node_id, g.node_id IS NOT NULL AS exact, g.node_id IS NOT NULL OR p.parent_id IS NOT NULL AS structural FROM h LEFT JOIN g ON g.node_id = h.node_id LEFT JOIN g p ON p.parent_id = h.node_id")
def structural_gold(spark, d):
    n = nodes(spark, d)
    q = lambda df: df.select(F.lit(1).alias("query_id"), "document_id", "node_id")
    return evidence.structural_gold(q(n.where("type <> 'document'")), q(n.where("type = 'clause' and key = 1")), n).drop("query_id")


@query("semantic_edges", "SELECT doc_id AS row, CASE WHEN doc_id % 5 = 0 THEN 'UNKNOWN_RELATION' WHEN doc_id % 5 = 1 THEN 'EVIDENCE_NOT_FOUND' ELSE 'SELF_LOOP' END AS reason FROM documents WHERE doc_id % 5 < 3")
def semantic_edges(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    k = F.col("doc_id") % 5
    me = F.concat(F.lit("D"), "doc_id")
    rows = docs.select(F.col("doc_id").alias("row"), me.alias("source"), F.when(k == 2, me).otherwise(F.lit("D0")).alias("target"), F.when(k == 0, "LIKES").otherwise("CITES").alias("relation"), F.when(k == 1, F.lit("\u0001 nowhere")).otherwise(F.substring("text", 1, 5)).alias("evidence"), me.alias("node_id"))
    texts = docs.select(me.alias("node_id"), "text")
    return graph.semantic(rows, texts, texts.select("node_id"), ["CITES"])[1]


# ---- evidence of resolved citations -----------------------------------------------------------------------------


@query(
    "direct_evidence",
    f"""{W}, p AS (SELECT t.node_id AS query_id, n.node_id, n.ordinal, n.text FROM nodes t JOIN nodes n ON n.document_id = t.document_id AND (n.node_id = t.node_id OR n.parent_id = t.node_id)
      WHERE t.type IN ('article', 'clause') AND (t.type = 'clause' OR trim(n.text) <> '')),
    e AS (SELECT query_id, count(*) AS included, coalesce(string_agg(trim(text), chr(10) ORDER BY ordinal) FILTER (trim(text) <> ''), '') AS text FROM p GROUP BY query_id)
    SELECT t.node_id AS query_id, coalesce(included, 0) AS included, sha256(coalesce(e.text, '')) AS evidence_sha256, CAST(len(regexp_extract_all(coalesce(e.text, ''), '\\S+')) AS INTEGER) AS tokens,
      CASE WHEN len(regexp_extract_all(coalesce(e.text, ''), '\\S+')) > {evidence.MAX_TOKENS} THEN 'TOO_LONG' END AS problem
    FROM nodes t LEFT JOIN e ON e.query_id = t.node_id WHERE t.type IN ('article', 'clause')""",
)
def direct_evidence(spark, d):
    """Each article and each clause is what a citation resolved to."""
    n = nodes(spark, d)
    targets = n.where("type <> 'document'").select(F.col("node_id").alias("query_id"), F.lit(0).alias("position"), "document_id", "node_id")
    titles = n.where("type = 'document'").select("document_id", F.col("document_id").alias("title"))
    out = evidence.direct(targets, n, titles)
    return out.select("query_id", F.size("included_ids").cast("long").alias("included"), F.sha2("evidence", 256).alias("evidence_sha256"), "tokens", "problem")


# ---- rounds, providers, releases --------------------------------------------------------------------------------

_RUNS = "r AS (SELECT source AS strategy, doc_id % 2 AS retriever, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS recall, avg(n_chars) / 1000 AS evidence FROM documents GROUP BY ALL)"


def runs(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "n_chars").groupBy(F.col("source").alias("strategy"), (F.col("doc_id") % 2).alias("retriever"))
    return docs.agg(F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)).alias("recall"), (F.avg("n_chars") / 1000).alias("evidence"))


@query(
    "second_round",
    f"""WITH {_RUNS}, m AS (SELECT strategy, round(avg(recall), 9) AS recall, round(avg(evidence), 9) AS evidence FROM r GROUP BY 1 HAVING count(DISTINCT retriever) >= 2),
    p AS (SELECT *, row_number() OVER (ORDER BY recall DESC, strategy) AS place FROM m), b AS (SELECT * FROM m WHERE strategy = 'src0'),
    t AS (SELECT coalesce(bool_or(p.place <= 3), false) AS in_top, coalesce(bool_or(round(p.evidence - b.evidence, 9) >= 0.03 AND round(b.recall - p.recall, 9) <= 0.02), false) AS by_evidence FROM p LEFT JOIN b ON true WHERE p.strategy IN ('src1', 'src2'))
    SELECT *, in_top OR by_evidence AS triggered FROM t""",
)
def second_round(spark, d):
    return selection.second_round(runs(spark, d), "src0", ["src1", "src2"])


@query(
    "challenger",
    f"""WITH {_STRATEGIES}, f AS (SELECT strategy FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.strategy <> a.strategy AND b.recall >= a.recall AND b.mrr >= a.mrr AND b.evidence >= a.evidence AND b.tokens <= a.tokens AND b.duplicates <= a.duplicates AND (b.recall > a.recall OR b.mrr > a.mrr OR b.evidence > a.evidence OR b.tokens < a.tokens OR b.duplicates < a.duplicates))),
    p AS (SELECT strategy, row_number() OVER (ORDER BY recall DESC, mrr DESC, evidence DESC, tokens, duplicates, strategy) AS place FROM s)
    SELECT (SELECT strategy FROM p WHERE place = 1) AS winner, (SELECT strategy FROM p WHERE place > 1 ORDER BY strategy NOT IN (SELECT strategy FROM f), place LIMIT 1) AS challenger""",
)
def challenger(spark, d):
    return selection.challenger(strategies(spark, d))


@query("release_candidate", f"WITH {_STRATEGIES} SELECT strategy, recall, tokens FROM s ORDER BY recall DESC, mrr DESC, evidence DESC, tokens, duplicates, list_transform(string_split(strategy, ''), lambda x: -unicode(x)) DESC LIMIT 1")
def release_candidate(spark, d):
    return selection.release_candidate(strategies(spark, d)).select("strategy", "recall", "tokens")


_REVIEWS = """r AS (SELECT lang AS provider, CASE doc_id % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'relationship' ELSE 'article_coverage' END AS kind, CASE WHEN doc_id % 7 = 0 THEN 'wrong' ELSE 'correct' END AS verdict,
  n_chars % 5 <> 0 AS direction, n_chars % 11 <> 0 AS source_valid, true AS mapping, doc_id % 13 = 2 AS missing FROM documents)"""


def extraction_reviews(spark, d):
    docs, k = table(spark, d, "documents", "doc_id", "lang", "n_chars"), F.col("doc_id")
    text = lambda c: F.when(c, F.lit("True")).otherwise(F.lit("false"))
    kind = F.when(k % 3 == 0, "entity").when(k % 3 == 1, "relationship").otherwise("article_coverage")
    return docs.select(
        F.col("lang").alias("provider"), kind.alias("kind"), F.when(k % 7 == 0, "wrong").otherwise("correct").alias("verdict"), text(F.col("n_chars") % 5 != 0).alias("direction_correct"),
        text(F.col("n_chars") % 11 != 0).alias("source_valid"), F.lit("TRUE").alias("mapping_valid"), text(k % 13 == 2).alias("missing_relation"),
    )


@query(
    "provider_selection",
    f"""WITH {_REVIEWS}, q AS (SELECT provider, round(coalesce(count(*) FILTER (kind = 'entity' AND verdict = 'correct') / nullif(count(*) FILTER (kind = 'entity'), 0), 0), 9) AS entity_precision,
      round(coalesce(count(*) FILTER (kind = 'relationship' AND verdict = 'correct') / nullif(count(*) FILTER (kind = 'relationship'), 0), 0), 9) AS relationship_precision,
      round(coalesce(count(*) FILTER (kind = 'relationship' AND direction) / nullif(count(*) FILTER (kind = 'relationship'), 0), 0), 9) AS direction_accuracy,
      round(coalesce(count(*) FILTER (kind <> 'article_coverage' AND source_valid) / nullif(count(*) FILTER (kind <> 'article_coverage'), 0), 0), 9) AS source_accuracy,
      round(coalesce(count(*) FILTER (kind = 'article_coverage' AND missing) / nullif(count(*) FILTER (kind = 'article_coverage'), 0), 0), 9) AS missing_rate,
      count(*) FILTER (kind = 'relationship' AND verdict = 'correct') AS accepted_edges, count(*) AS reviews FROM r GROUP BY provider),
    g AS (SELECT *, entity_precision >= 0.8 AND relationship_precision >= 0.8 AND missing_rate <= 0.3 AS passed FROM q),
    n AS (SELECT *, passed AND round(max(relationship_precision) FILTER (passed) OVER () - relationship_precision, 9) < 0.05 AS near FROM g)
    SELECT provider, entity_precision, relationship_precision, direction_accuracy, source_accuracy, missing_rate, accepted_edges, reviews, passed,
      near AND row_number() OVER (ORDER BY near DESC, reviews / accepted_edges, entity_precision DESC, provider) = 1 AS winner FROM n""",
)
def provider_selection(spark, d):
    q = gov.extraction_quality(extraction_reviews(spark, d), "provider")
    q = q.withColumns({"failures": F.lit(0), "cost_per_edge": F.try_divide(F.col("reviews"), F.col("accepted_edges")), "latency": F.lit(1.0)})
    gates = {"mapping_accuracy": 1.0, "entity_precision": 0.8, "relationship_precision": 0.8, "missing_rate": 0.3}
    out = gov.select_provider(q, gates, 0.05)
    return out.select("provider", "entity_precision", "relationship_precision", "direction_accuracy", "source_accuracy", "missing_rate", "accepted_edges", "reviews", "passed", "winner")


@query("release_health", "SELECT CAST(1 AS BIGINT) AS active, 'src0' AS dataset_id, count(*) AS passages, count(*) FILTER (lang <> 'de') AS embeddings, true AS lock_match, count(*) = 100 AND count(*) FILTER (lang <> 'de') = 100 AS ready FROM documents WHERE source = 'src0'")
def release_health(spark, d):
    docs = table(spark, d, "documents", "source", "lang").select(F.col("source").alias("dataset_id"), F.when(F.col("lang") != "de", "READY").otherwise("STALE").alias("status"))
    releases = docs.select("dataset_id").distinct().select("dataset_id", F.when(F.col("dataset_id") == "src0", "ACTIVE").otherwise("RETIRED").alias("state"), F.lit("m").alias("model"), F.lit("1").alias("revision"), F.lit("x").alias("lock"))
    return gov.release_health(releases, docs, docs, "m", "1", 100, "x")


@query("applied_reviews", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN 'draft' ELSE 'approved' END AS review_status FROM documents")
def applied_reviews(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source").withColumn("review_status", F.lit("draft"))
    review = docs.select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.upper("source")).alias("source"), F.when(F.col("doc_id") % 4 != 0, " Approved ").alias("review_status"))
    return gov.apply_reviews(docs, review, "doc_id", ["lang"], ["source"])[0].select("doc_id", "source", "review_status")


@query("migration_state", "SELECT source AS name, CASE WHEN max(doc_id) % 4 = 0 THEN 'PENDING' WHEN max(doc_id) % 4 = 1 THEN 'CHANGED' WHEN max(doc_id) % 4 = 2 THEN 'GONE' ELSE 'APPLIED' END AS state FROM documents GROUP BY source")
def migration_state(spark, d):
    rows = table(spark, d, "documents", "doc_id", "source").groupBy(F.col("source").alias("name")).agg((F.max("doc_id") % 4).alias("k"))
    applied = rows.where("k <> 0").select("name", F.when(F.col("k") == 1, "old").otherwise("new").alias("checksum"))
    return gov.migration_state(applied, rows.where("k <> 2").select("name", F.lit("new").alias("checksum")))


@query("regression_snapshot", "SELECT doc_id, lang, sha256(text) AS index_text_hash, sha256(lang) AS evidence_text_hash FROM documents")
def regression_snapshot(spark, d):
    return files.snapshot(table(spark, d, "documents", "doc_id", "lang", "text").select("doc_id", "lang", F.col("text").alias("index_text"), F.col("lang").alias("evidence_text")))


@query("markdown_report", "SELECT unnest([1, 2, 3, 4]) AS line_no, unnest(['# Languages', '', '| lang | n |', '| --- | --- |']) AS value UNION ALL SELECT CAST(row_number() OVER (ORDER BY lang, count(*)) + 4 AS INTEGER), '| ' || lang || ' | ' || count(*) || ' |' FROM documents GROUP BY lang")
def markdown_report(spark, d):
    return files.markdown(table(spark, d, "documents", "lang").groupBy("lang").agg(F.count("*").alias("n")), "Languages")


# ---- typed edges, required nodes, extracted entities ------------------------------------------------------------


@query("repealed_by", f"{W} SELECT parent_id AS node_id, string_agg(node_id, ',' ORDER BY ordinal) AS found FROM nodes WHERE parent_id IS NOT NULL AND key % 3 = 0 GROUP BY parent_id")
def repealed_by(spark, d):
    """Each node amends, refers to or repeals the one above it, by its number."""
    relation = F.when(F.col("key") % 3 == 0, "REPEALS").when(F.col("key") % 3 == 1, "AMENDS").otherwise("REFERENCES")
    edges = nodes(spark, d).where("parent_id is not null").select(F.col("ordinal").alias("position"), F.col("node_id").alias("source_id"), F.col("parent_id").alias("target_id"), relation.alias("relation"))
    return tree.typed_targets(edges, "REPEALS", reverse=True).select("node_id", F.array_join("found_ids", ",").alias("found"))


@query("required_nodes", f"{W} SELECT a.node_id, concat_ws(',', a.node_id, string_agg(c.node_id, ',' ORDER BY c.ordinal)) AS required FROM nodes a LEFT JOIN nodes c ON c.parent_id = a.node_id AND c.type = 'clause' WHERE a.type = 'article' GROUP BY a.node_id")
def required_nodes(spark, d):
    n = nodes(spark, d)
    return tree.required_with_children(n.where("type = 'article'").select("document_id", "node_id"), n, "clause").select("node_id", F.array_join("required_ids", ",").alias("required"))


@query(
    "semantic_entities",
    """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'UNKNOWN_ENTITY_TYPE' WHEN doc_id % 5 = 0 THEN 'CROSS_ARTICLE_PROVENANCE' WHEN doc_id % 4 = 0 THEN 'EVIDENCE_NOT_IN_CANONICAL_TEXT' WHEN doc_id % 3 = 0 THEN 'DUPLICATE_LOCAL_KEY' END AS reason FROM documents)
    SELECT 'D' || doc_id AS article_id, 2 AS row, reason FROM r WHERE reason IS NOT NULL
    UNION ALL SELECT 'D' || doc_id, 2, 'NO_VALID_PROVENANCE' FROM r WHERE reason IN ('CROSS_ARTICLE_PROVENANCE', 'EVIDENCE_NOT_IN_CANONICAL_TEXT')
    UNION ALL SELECT 'D' || doc_id, 1, 'ACCEPTED ' || CASE WHEN reason IS NULL THEN 2 ELSE 1 END FROM r""",
)
def semantic_entities(spark, d):
    """Two entities a document, under one key: the second has an unknown type, a place that does not hold, or another label."""
    docs, k, me = table(spark, d, "documents", "doc_id", "text", "lang"), F.col("doc_id"), F.concat(F.lit("D"), "doc_id")
    two = F.col("row") == 2
    place = F.struct(F.when(two & (k % 5 == 0), "elsewhere").otherwise(me).alias("node_id"), F.when(two & (k % 4 == 0), "\u0001 nowhere").otherwise(F.substring("text", 1, 12)).alias("evidence"))
    rows = docs.withColumn("row", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        me.alias("article_id"), "row", F.lit("k").alias("local_key"), F.when(two & (k % 7 == 0), "THING").otherwise("TERM").alias("kind"), F.when(two & (k % 3 == 0), "other").otherwise(F.col("lang")).alias("label"),
        F.array(F.concat(F.lit("alias "), F.col("row").cast("string"))).alias("aliases"), F.array(place).alias("provenance"),
    )
    good, bad = graph.semantic_entities(rows, docs.select(me.alias("article_id"), me.alias("node_id"), "text"), ["TERM"])
    return bad.unionByName(good.select("article_id", F.lit(1).alias("row"), F.concat(F.lit("ACCEPTED "), F.size("aliases").cast("string")).alias("reason")))
