"""Exact dense retrieval: cosine over unit vectors, whole corpus or guided within groups.

Every vector meets every query, which is what an exact scan is. Vectors and queries are dealt into blocks by a hash of
their ids, and each pair of blocks is scored once, in one task; neither side is broadcast, and any number of queries may
be asked. A pair of blocks answers with top_k rows per query at most. Guided limits are windows with a group limit, which
Spark applies before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
TOLERANCE = 1e-5
#: Vectors and queries in a block, and queries scored at a time.
BLOCK, QUERIES, SLICE = 4096, 4096, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either side has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_issues(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code) of vectors of a wrong shape, not finite, or not of unit length, in this order of precedence."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    code = F.when(v.isNull() | (F.size(v) != dim), "WRONG_SHAPE").when(~finite, "NOT_FINITE").when(F.abs(norm(v) - 1) > TOLERANCE, "NOT_UNIT")
    return vectors.select(F.col(id_col), code.alias("code")).where("code is not null")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A row for each vector, of NaN where it is null, of another length or not finite."""
    col = column.combine_chunks()
    out = np.full((len(col), dim), np.nan)
    ok = pc.equal(pc.list_value_length(col), dim).fill_null(False)
    out[ok.to_numpy(zero_copy_only=False)] = col.filter(ok).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def _best(vectors: pa.Table, queries: pa.Table, top_k: int) -> pa.Table:
    """(query_id, id, score) of one pair of blocks: the top_k of each query by score, then id."""
    vectors = vectors.take(pc.sort_indices(vectors["id"]))
    rows, found, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    lengths = pc.list_value_length(queries["query"]).fill_null(0).to_numpy() if len(vectors) else np.zeros(0, np.int64)
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        x, y = _matrix(vectors["vector"], dim), _matrix(queries["query"].take(pa.array(own)), dim)
        for at in range(0, len(own), SLICE):
            raw = y[at : at + SLICE] @ x.T
            score = np.copysign(np.floor(np.abs(raw) * 10**DIGITS + 0.5), raw) / 10**DIGITS
            key = np.where(np.isnan(score), -np.inf, score)
            least = np.partition(key, max(len(x) - top_k, 0), axis=1)[:, max(len(x) - top_k, 0)]
            for i in range(len(key)):
                some = np.flatnonzero(key[i] >= least[i])
                some = some[np.argsort(-key[i][some], kind="stable")[:top_k]]
                rows.append(np.full(len(some), own[at + i]))
                found.append(some)
                values.append(score[i][some])
    query_id, id_ = queries["query_id"].take(pa.array(np.concatenate(rows))), vectors["id"].take(pa.array(np.concatenate(found)))
    return pa.table({"query_id": query_id, "id": id_, "score": pa.array(np.concatenate(values) + 0.0, from_pandas=True)})


def global_search(vectors: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): order by score, then id. A vector that is not finite or has not the query's length has
    no score and comes last."""
    v, q = vectors.select("id", "vector"), queries.select("query_id", "query")
    n_v, n_q = -(-v.count() // BLOCK) or 1, -(-q.count() // QUERIES) or 1
    all_of = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    v = v.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n_v)).cast("int").alias("v"), all_of(n_q, "q"))
    q = q.select("query_id", "query", all_of(n_v, "v"), F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("q"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = v.groupBy("v", "q").cogroup(q.groupBy("v", "q")).applyInArrow(lambda a, b: _best(a, b, top_k), f"query_id {kind(q, 'query_id')}, id {kind(v, 'id')}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "score")


def guided_search(vectors: DataFrame, queries: DataFrame, groups: DataFrame, per_group: int = 3) -> DataFrame:
    """(query_id, group, group_rank, local_rank, id, score): best rows of each scouted group (query_id, group, rank)."""
    w = Window.partitionBy("query_id", "group").orderBy(F.col("score").desc(), "id")
    asked = groups.select("query_id", "group", F.col("rank").alias("group_rank")).join(queries, "query_id")
    pairs = vectors.select("id", "vector", "group").join(asked, "group")
    rows = pairs.withColumn("score", F.round(dot(F.col("vector"), F.col("query")), DIGITS)).drop("vector", "query")
    return rows.withColumn("local_rank", F.row_number().over(w)).where(F.col("local_rank") <= per_group).select("query_id", "group", "group_rank", "local_rank", "id", "score")
