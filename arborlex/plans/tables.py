"""The driver tables as the engine's own shapes: a document's lines are articles, its sentences clauses.

Long lines have many sentences, so trees have three levels; every node id says where it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, key, text): lines by number, from 1."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lines = docs.select(F.concat(F.lit("D"), F.col("doc_id")).alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("document_id", (F.col("pos") + 1).alias("key"), "text")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document, article and clause nodes in one table; ordinal = line * 2^31 + sentence."""
    docs = table(spark, sf_dir, "documents", "doc_id").select(F.concat(F.lit("D"), F.col("doc_id")).alias("document_id"))
    root = docs.select("document_id", F.col("document_id").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("type"), F.lit(0).cast("long").alias("ordinal"), F.lit(None).cast("int").alias("key"), F.lit("").alias("text"))
    lines = articles(spark, sf_dir).withColumn("article_id", F.concat_ws("__A", "document_id", "key"))
    sentences = lines.select("document_id", "key", "article_id", F.posexplode(F.split("text", r"\. ")).alias("s", "sentence"), F.size(F.split("text", r"\. ")).alias("n"))
    sentences = sentences.where("n > 1")
    first = F.element_at(F.split("text", r"\. "), 1)
    ordinal = F.col("key").cast("long") * (1 << 31)
    arts = lines.select("document_id", F.col("article_id").alias("node_id"), F.col("document_id").alias("parent_id"), F.lit("article").alias("type"), ordinal.alias("ordinal"), "key", first.alias("text"))
    clauses = sentences.where("s > 0").select("document_id", F.concat_ws("__C", "article_id", "s").alias("node_id"), F.col("article_id").alias("parent_id"), F.lit("clause").alias("type"), (ordinal + F.col("s")).alias("ordinal"), F.col("s").alias("key"), F.col("sentence").alias("text"))
    return root.unionByName(arts).unionByName(clauses)


#: The same node table in SQL, for the oracles.
NODES_SQL = """
lines AS (SELECT 'D' || doc_id AS document_id, generate_subscripts(a, 1) AS key, unnest(a) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
sentences AS (SELECT document_id, key, document_id || '__A' || key AS article_id, generate_subscripts(b, 1) - 1 AS s, unnest(b) AS sentence
              FROM (SELECT document_id, key, string_split(line, '. ') AS b FROM lines)),
nodes AS (
  SELECT 'D' || doc_id AS document_id, 'D' || doc_id AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'document' AS type, CAST(0 AS BIGINT) AS ordinal, CAST(NULL AS INTEGER) AS key, '' AS text FROM documents
  UNION ALL SELECT document_id, article_id, document_id, 'article', CAST(key AS BIGINT) * 2147483648, CAST(key AS INTEGER), sentence FROM sentences WHERE s = 0
  UNION ALL SELECT document_id, article_id || '__C' || s, article_id, 'clause', CAST(key AS BIGINT) * 2147483648 + s, CAST(s AS INTEGER), sentence FROM sentences WHERE s > 0)
"""
