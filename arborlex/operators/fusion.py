"""Two-granularity fusion: article scouts and fine hits by reciprocal rank, under diversity caps, in windows only.

Inputs: article hits A (query_id, rank, article_id), fine global hits G (query_id, rank, id), guided leaves L
(query_id, group_rank, local_rank, id, article_id) and fine passages F (id, primary_id, article_id); an article's primary id is
its own. Two passes with caps at 5 and 10 become running counts: a first-pass row is one within its cap at 5 whose running
count is 5 at most; the rest follows in order under the caps at 10.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HybridConfig:
    """The defaults of the fusion."""

    rrf_k: int = 60
    article_weight: float = 1.0
    fine_weight: float = 1.0
    article_top_k: int = 10
    fine_top_k: int = 50
    leaves_per_article: int = 3
    articles_at_5: int = 1
    articles_at_10: int = 2
    fine_per_article: int = 3
    first: int = 5
    final: int = 10

    def __post_init__(self):
        if min(self.rrf_k, self.article_top_k, self.fine_top_k, self.leaves_per_article, self.fine_per_article) < 1 or self.articles_at_5 > self.articles_at_10:
            raise ValueError("ranks, depths and caps must be positive and the cap at 5 no larger than at 10")


def rrf(rank: Column, weight: float, k: int) -> Column:
    return F.lit(weight) / (k + rank)


def candidates(a: DataFrame, g: DataFrame, leaves: DataFrame, fine: DataFrame, c: HybridConfig = HybridConfig()) -> DataFrame:
    """(query_id, primary_id, source, passage_id, article_id, score, evidence_ids): the pool before caps."""
    guided = leaves.withColumn("guided", c.leaves_per_article * (F.col("group_rank") - 1) + F.col("local_rank"))
    first = guided.groupBy("query_id", "id").agg(F.min("guided").alias("guided"))
    both = g.select("query_id", "id", F.col("rank").alias("fine")).join(first, ["query_id", "id"], "full")
    score = F.coalesce(rrf(F.col("fine"), c.fine_weight, c.rrf_k), F.lit(0.0)) + F.coalesce(rrf(F.col("guided"), c.article_weight, c.rrf_k), F.lit(0.0))
    fine_side = both.join(fine, "id").select("query_id", "primary_id", F.col("id").alias("f_id"), F.col("article_id").alias("f_article"), score.alias("f_score"))
    met = guided.join(g.select("query_id", "id", F.col("rank").alias("fine")), ["query_id", "id"], "left")
    per = met.groupBy("query_id", "article_id").agg(F.min("fine").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("local_rank", "id"))), lambda x: x["id"]).alias("evidence_ids"))
    own = a.join(per, ["query_id", "article_id"], "left")
    a_score = rrf(F.col("rank"), c.article_weight, c.rrf_k) + F.coalesce(rrf(F.col("best"), c.fine_weight, c.rrf_k), F.lit(0.0))
    article_side = own.select("query_id", F.col("article_id").alias("primary_id"), F.col("article_id").alias("a_id"), a_score.alias("a_score"), "evidence_ids")
    pool = fine_side.join(article_side, ["query_id", "primary_id"], "full")
    fine_wins = F.col("f_id").isNotNull()
    return pool.select(
        "query_id",
        "primary_id",
        F.when(fine_wins, "fine").otherwise("article").alias("source"),
        F.coalesce("f_id", "a_id").alias("passage_id"),
        F.coalesce("f_article", "a_id").alias("article_id"),
        F.round(F.greatest(F.coalesce("f_score", F.lit(0.0)), F.coalesce("a_score", F.lit(0.0))), 9).alias("score"),
        F.when(~fine_wins, F.coalesce("evidence_ids", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
    )


def ordered(pool: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), (F.col("source") == "article").cast("int"), "passage_id")
    return pool.withColumn("o", F.row_number().over(w))


def hybrid(a: DataFrame, g: DataFrame, leaves: DataFrame, fine: DataFrame, c: HybridConfig = HybridConfig()) -> DataFrame:
    """(query_id, rank, passage_id, source, score, evidence_ids, complete): complete tells whether `final` rows were found."""
    scope = F.when(F.col("source") == "article", F.lit("")).otherwise(F.col("article_id"))
    rows = ordered(candidates(a, g, leaves, fine, c)).withColumn("scope", scope)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source", "scope").orderBy("o")))
    cap = lambda n: F.when(F.col("source") == "article", F.lit(n)).otherwise(F.lit(c.fine_per_article))
    rows = rows.withColumn("e1", F.col("r") <= cap(c.articles_at_5)).withColumn("e2", F.col("r") <= cap(c.articles_at_10))
    running = F.sum(F.col("e1").cast("int")).over(Window.partitionBy("query_id").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("late", (~(F.col("e1") & (running <= c.first))).cast("int")).where("e2")
    w = Window.partitionBy("query_id").orderBy("late", "o")
    rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= c.final)
    complete = F.count("*").over(Window.partitionBy("query_id")) == c.final
    return rows.select("query_id", "rank", "passage_id", "source", "score", "evidence_ids", complete.alias("complete"))


def scoped(hits: DataFrame, scope: DataFrame) -> DataFrame:
    """Post-filter of final hits to a query's documents (query_id, document_id), re-ranked from 1. A query without scope keeps all."""
    named = scope.select("query_id").distinct().withColumn("has", F.lit(True))
    rows = hits.join(scope.withColumn("ok", F.lit(True)), ["query_id", "document_id"], "left").join(named, "query_id", "left").where("has is null or ok")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("ok", "has")
