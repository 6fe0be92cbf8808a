"""Exact top-k inner products by a vector-approximation file.

Vectors are integers, component by component floor(scale * x), packed into blocks. A block's approximation is written
beside its exact vectors, in columns of its own: a byte for each component, the number of one of CELLS equal ranges
between the component's extremes. The search has three steps:

1. Query blocks meet the approximations, each pair once; exact vectors are not read. A product of codes and queries
   bounds every score from both sides. A block answers with the candidates whose upper bound reaches the k-th best
   lower bound, of the block or of those that its task has seen before it.
2. The k-th best lower bound over all blocks leaves out most of these.
3. Exact vectors are read in the order of upper bounds, in two waves: the first k of each query, and then only those
   whose bound reaches the k-th exact score. None left can reach it, so the result is certain. (In terms of distance,
   upper bounds of a product are lower bounds.)

Vectors that are null, hold null or non-finite components, or have another length than the query take no part, nor
do rows without id. Candidates with the query's own id are left out; repeated candidate rows count each, repeated
query ids once, by their least valid vector. Equal scores go to the smaller id. Fewer than k candidates give fewer
rows. Of rows with equal vectors, the 2k of smallest ids (k at most of one id) stay in a block: no other can be
among anyone's k best, so a vector that a third of all rows share costs a block 2k rows. Queries all stay, whatever
vectors they share. Integers beyond 2^61 count as
2^61, and scores beyond the long range as its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import materialise, tidy

#: Ranges of a component; a range's number takes a byte.
CELLS = 256
#: Vectors in a candidate block and queries in a query block.
BLOCK, QUERIES = 4096, 1024
#: Queries that meet a block's codes together, and pairs that read a block's exact vectors together.
TOGETHER, CHUNK = 128, 4096
_LIMIT, _LONG = 1 << 61, (1 << 63) - 1


def _array(data: bytes, dtype: type, *shape: int) -> np.ndarray:
    return (np.frombuffer(data, dtype) if data else np.zeros(0, dtype)).reshape(shape or -1)


def leading(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among someone's k best, as far as rows of equal vectors tell."""
    if values.shape[1]:
        group = np.unique(values, axis=0, return_inverse=True)[1].reshape(-1)
    else:
        group = np.zeros(len(ids), np.int64)

    def nth(keys: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """A row's number among those with equal keys, in the order of rows."""
        new = np.ones(len(rows), bool)
        if len(rows):
            new[1:] = np.any([x[rows][1:] != x[rows][:-1] for x in keys], axis=0)
        first = np.flatnonzero(new)
        return np.arange(len(rows)) - first[np.cumsum(new) - 1]

    rows = np.lexsort((ids, group))
    rows = rows[nth([group, ids], rows) < k]
    return np.sort(rows[nth([group], rows) < 2 * k])


class Approximation:
    """A block's codes, and where each component's ranges begin and how wide they are."""

    def __init__(self, code: np.ndarray, low: np.ndarray, step: np.ndarray):
        self.code, self.low, self.step = code, low, step

    @classmethod
    def of(cls, values: np.ndarray) -> Approximation:
        low, high = values.min(0), values.max(0)
        step = (high - low) // CELLS + 1
        return cls(((values - low) // step).astype(np.uint8), low, step)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of every score, a row for each query; widened by what rounding can take."""
        q, low, step = queries.astype(np.float64), self.low.astype(np.float64), self.step.astype(np.float64)
        middle = (q * step) @ self.code.astype(np.float64).T + (q @ low)[..., None]
        spread = (step - 1) * q
        most = np.maximum(np.abs(low), np.abs(low + step * CELLS))
        slack = (np.abs(q) @ most) * (len(low) + 4) * 2.0**-50
        lower = middle + (np.minimum(spread, 0).sum(-1) - slack)[..., None]
        upper = middle + (np.maximum(spread, 0).sum(-1) + slack)[..., None]
        return np.clip(lower, -(2.0**63), 2.0**63), np.clip(upper, -(2.0**63), 2.0**63)


def candidates(cells: Approximation, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query's place, row, lower, upper) of the rows that may be among a query's k best. reached: the k best lower
    bounds of each query so far, ascending; this block's are added."""
    lower, upper = cells.bounds(queries)
    not_own = ids != own[:, None]
    lower = np.where(not_own, lower, -np.inf)
    k = reached.shape[1]
    both = np.concatenate((reached, lower), axis=1)
    reached[:] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
    place, row = np.nonzero(not_own & (upper >= reached[:, :1]))
    return place, row, lower[place, row], upper[place, row]


def scores(values: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows: exact, and at the ends of the long range where they lie beyond."""
    high = lambda x: int(np.abs(x).max(initial=0))
    if high(values) * high(queries) * values.shape[1] < 1 << 62:
        return np.einsum("ij,ij->i", values, queries)
    return np.array([max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(v, q, strict=True)))) for v, q in zip(values.tolist(), queries.tolist(), strict=True)], np.int64)


_PACK = "dim int, block long, ids binary, codes binary, low binary, step binary, values binary"


def pack(vectors: DataFrame, id_col: str, vector: str, scale: int, rows: int, k: int | None) -> DataFrame:
    """Blocks of integer vectors of one length, in the order of the input's partitions: ids, approximation, values.
    k: leaves out candidates that cannot be among anyone's k best; None keeps every row, as queries need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        block = TaskContext.get().partitionId() << 32

        def out(dim: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            block += 1
            if k is not None:
                stays = leading(ids, x, k)
                ids, x = ids[stays], x[stays]
            cells = Approximation.of(x)
            parts = [pa.array([v.tobytes()], pa.binary()) for v in (ids, cells.code, cells.low, cells.step, x)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int64()), *parts], names=["dim", "block", "ids", "codes", "low", "step", "values"])

        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            ok = ids.is_valid().to_numpy(zero_copy_only=False) & col.is_valid().to_numpy(zero_copy_only=False)
            lengths = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten()
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            start = np.cumsum(lengths) - lengths
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            ok &= bad[start + lengths] == bad[start]
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[ok]).tolist():
                own = np.flatnonzero(ok & (lengths == dim))
                with np.errstate(over="ignore"):
                    values = np.clip(np.floor(x[start[own][:, None] + np.arange(dim)] * scale), -_LIMIT, _LIMIT).astype(np.int64)
                before = held.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
                all_ids, all_values = np.concatenate((before[0], ids[own])), np.concatenate((before[1], values))
                while len(all_ids) >= rows:
                    yield out(dim, all_ids[:rows], all_values[:rows])
                    all_ids, all_values = all_ids[rows:], all_values[rows:]
                held[dim] = (all_ids, all_values)
        for dim, (ids, x) in held.items():
            if len(ids):
                yield out(dim, ids, x)

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, _PACK)


def _scan(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, block, row, lower, upper): what the approximations leave of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        asked, reached = None, np.zeros((0, k))
        for batch in batches:
            for dim, no, block, ids, codes, low, step, query_ids, queries in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                ids, query_ids = _array(ids, np.int64), _array(query_ids, np.int64)
                cells = Approximation(_array(codes, np.uint8, len(ids), dim), _array(low, np.int64), _array(step, np.int64))
                queries = _array(queries, np.int64, len(query_ids), dim)
                if asked != (dim, no):
                    asked, reached = (dim, no), np.full((len(query_ids), k), -np.inf)
                for i in range(0, len(query_ids), TOGETHER):
                    part = slice(i, i + TOGETHER)
                    place, row, lower, upper = candidates(cells, ids, queries[part], query_ids[part], reached[part])
                    made = [query_ids[part][place], np.full(len(row), block), row.astype(np.int32), lower, upper]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["query_id", "block", "row", "lower", "upper"])

    return pairs.select("dim", "no", "block", "ids", "codes", "low", "step", "query_ids", "queries").mapInArrow(run, "query_id long, block long, row int, lower double, upper double")


def _rows(asked: DataFrame) -> DataFrame:
    """(query_id, query): the query blocks, a row for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, queries in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = [queries[i : i + 8 * dim] for i in range(0, len(queries), 8 * dim)] if dim else [b""] * (len(ids) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(_array(ids, np.int64)), pa.array(own, pa.binary())], names=["query_id", "query"])

    return asked.select("dim", "query_ids", "queries").mapInArrow(run, "query_id long, query binary")


def _read(wanted: DataFrame, queries: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, id, score) of wanted rows (query_id, block, row). A block that many queries want is read in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for dim, ids, values, pairs in zip(*(batch.column(c) for c in range(4)), strict=True):
                ids, pairs = _array(ids.as_py(), np.int64), pairs.values
                values = _array(values.as_py(), np.int64, len(ids), dim.as_py())
                row = pairs.field("row").to_numpy(zero_copy_only=False)
                asked = _array(b"".join(pairs.field("query").to_pylist()), np.int64, len(row), dim.as_py())
                yield pa.RecordBatch.from_arrays([pairs.field("query_id"), pa.array(ids[row]), pa.array(scores(values[row], asked))], names=["query_id", "id", "score"])

    number = F.row_number().over(Window.partitionBy("block").orderBy("query_id", "row"))
    chunks = wanted.withColumn("chunk", F.floor((number - 1) / CHUNK)).join(queries, "query_id")
    chunks = chunks.groupBy("block", "chunk").agg(F.collect_list(F.struct("query_id", "row", "query")).alias("pairs"))
    return exact.join(chunks, "block").select("dim", "ids", "values", "pairs").mapInArrow(run, "query_id long, id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) over all candidate vectors."""
    file = materialise(pack(vectors, id_col, vector, scale, BLOCK, k))
    cells, exact = file.select("dim", "block", "ids", "codes", "low", "step"), file.select("dim", "block", "ids", "values")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    once = queries.where(finite).groupBy(id_col).agg(F.min(vector).alias(vector))
    # pairs of blocks meet by number: query blocks are numbered per length, candidate blocks spread over salts
    number = F.row_number().over(Window.partitionBy("dim").orderBy("block")) - 1
    asked = pack(once, id_col, vector, scale, QUERIES, None).select("dim", "block", F.col("ids").alias("query_ids"), F.col("values").alias("queries"))
    asked = materialise(asked).withColumn("no", number).drop("block")
    counts = asked.groupBy("dim").agg(F.count("*").alias("asked"))
    salts = max(1, cells.count() // 4)
    dealt = cells.join(counts, "dim").withColumn("no", F.explode(F.sequence(F.lit(0), (F.col("asked") - 1).cast("int")))).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    # the stated query set against all rows, in blocks
    found = _scan(dealt.join(salted, ["dim", "no", "salt"]), k)
    best = Window.partitionBy("query_id").orderBy(F.col("lower").desc())
    reach = F.nth_value("lower", k).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = found.withColumn("reach", reach).where("reach is null or upper >= reach")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "block", "row"))
    left = materialise(left.select("query_id", "block", "row", "upper", turn.alias("turn")))
    rows = _rows(asked)
    first = materialise(_read(left.where(F.col("turn") <= k), rows, exact))
    certain = first.groupBy("query_id").agg(F.min("score").cast("double").alias("certain"))
    second = _read(left.where(F.col("turn") > k).join(certain, "query_id").where("upper >= certain").drop("certain"), rows, exact)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
