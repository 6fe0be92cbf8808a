"""BM25: index statistics and ranking, zero scores included.

The index is (passage_id, term, tf) with passage lengths; statistics hold per corpus. Scoring joins query terms to
postings on the term, so the shuffle carries only postings of query terms, and partial sums are combined per
(query, passage). Passages without a shared term score 0 and only matter as padding: the k smallest ids are enough
of them, so no query-by-passage product is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlex.functions import text as X

K1, B = 1.5, 0.75
#: Scores are rounded before ranking: summation order differs between engines and runs.
DIGITS = 9


def term_table(passages: DataFrame, id_col: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, length); only: the terms (term) that matter. Others are dropped before anything is shuffled if Spark
    finds these small enough to broadcast, and at the join if not."""
    words = passages.select(F.col(id_col).alias("id"), X.tokens(F.col(text)).alias("words"))
    rows = words.select("id", F.size("words").alias("length"), F.explode("words").alias("term"))
    if only is not None:
        rows = rows.join(only, "term", "left_semi")
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def corpus_stats(passages: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row: n passages and their average length."""
    return passages.select(F.size(X.tokens(F.col(text))).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))


def idf(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    # one row joins every term: its size is fixed
    return df.crossJoin(F.broadcast(stats)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")


def search(passages: DataFrame, queries: DataFrame, top_k: int = 10, id_col: str = "passage_id", text: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, rank, id, score): order by score, then id; every query gets top_k rows where the corpus has them."""
    stats = corpus_stats(passages, id_col, text)
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(X.tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = term_table(passages, id_col, text, asked.select("term").distinct())
    hits = terms.join(asked, "term")
    weights = idf(terms, stats)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    scores = hits.join(weights, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    ids = passages.select(F.col(id_col).alias("id")).distinct().orderBy("id").limit(top_k)
    # top_k ids at most, for padding
    padding = queries.select(F.col(query_id).alias("query_id")).distinct().crossJoin(F.broadcast(ids)).withColumn("score", F.lit(0.0))
    every = scores.unionByName(padding).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "rank", F.col("id").alias(id_col), "score")
