"""Choosing between strategies: frontiers, winners, gates, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What is better when larger, then what is better when smaller, in order of precedence.
MAXIMISE = ("recall", "mrr", "evidence")
MINIMISE = ("tokens", "duplicates")


def pareto_frontier(rows: DataFrame, id_col: str = "strategy", up: tuple[str, ...] = MAXIMISE, down: tuple[str, ...] = MINIMISE) -> DataFrame:
    """Rows that no other row dominates. Rows are one per strategy, a short table by nature."""
    both = (*up, *down)
    other = rows.select(F.col(id_col).alias("_o"), *[F.col(c).alias(f"_{c}") for c in both])
    no_worse = reduce(lambda a, b: a & b, [F.col(f"_{c}") >= F.col(c) for c in up] + [F.col(f"_{c}") <= F.col(c) for c in down])
    better = reduce(lambda a, b: a | b, [F.col(f"_{c}") > F.col(c) for c in up] + [F.col(f"_{c}") < F.col(c) for c in down])
    return rows.join(other, (F.col("_o") != F.col(id_col)) & no_worse & better, "left_anti")


def ranked(rows: DataFrame, by: list[str] | None = None, id_col: str = "strategy", up: tuple[str, ...] = MAXIMISE, down: tuple[str, ...] = MINIMISE) -> DataFrame:
    """Adds place: strictly lexicographic, then by id; within `by` if given."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*[F.col(c).desc() for c in up], *[F.col(c) for c in down], id_col)
    return rows.withColumn("place", F.row_number().over(w))


def challenger(rows: DataFrame, id_col: str = "strategy", up: tuple[str, ...] = MAXIMISE, down: tuple[str, ...] = MINIMISE) -> DataFrame:
    """(winner, challenger): the best row, and the next best of the frontier; without one there, the second in rank."""
    front = pareto_frontier(rows, id_col, up, down).select(id_col, F.lit(True).alias("front"))
    placed = ranked(rows, None, id_col, up, down).join(front, id_col, "left")
    next_ = F.min(F.when(F.col("place") > 1, F.struct(F.col("front").isNull().alias("x"), "place", F.col(id_col).alias("id"))))
    return placed.agg(F.min(F.when(F.col("place") == 1, F.col(id_col))).alias("winner"), next_.getField("id").alias("challenger")).where("winner is not null")


def second_round(runs: DataFrame, base: str, candidates: list[str], top: int = 3, gain: float = 0.03, loss: float = 0.02, retrievers: int = 2) -> DataFrame:
    """runs: (strategy, retriever, recall, evidence). One row (in_top, by_evidence, triggered): a candidate is among the
    `top` strategies by mean recall, or gains `gain` of evidence over the base for a recall loss of `loss` at most. Strategies
    that lack a retriever do not take part; equal recalls go by name."""
    means = runs.groupBy("strategy").agg(F.countDistinct("retriever").alias("n"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("evidence"), 9).alias("evidence")).where(F.col("n") >= retrievers)
    # one row per strategy
    placed = means.withColumn("place", F.row_number().over(Window.orderBy(F.col("recall").desc(), "strategy")))
    is_base, mine = F.col("strategy") == base, F.col("strategy").isin(candidates)
    b = F.max(F.when(is_base, F.struct("recall", "evidence"))).over(Window.partitionBy(F.lit(1)))
    joined = placed.withColumn("b", b)
    better = F.round(F.col("evidence") - F.col("b.evidence"), 9) >= gain
    close = F.round(F.col("b.recall") - F.col("recall"), 9) <= loss
    tests = joined.agg(F.bool_or(mine & (F.col("place") <= top)).alias("in_top"), F.bool_or(mine & better & close).alias("by_evidence"))
    tests = tests.select(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_top", "by_evidence")])
    return tests.withColumn("triggered", F.col("in_top") | F.col("by_evidence"))


def release_candidate(runs: DataFrame, id_col: str = "strategy", up: tuple[str, ...] = MAXIMISE, down: tuple[str, ...] = MINIMISE) -> DataFrame:
    """runs: one row per strategy and retriever. The best strategy by mean metrics; of equal ones the one whose id comes
    first by code points, a longer id before its own beginning."""
    means = runs.groupBy(id_col).agg(*[F.round(F.avg(c), 9).alias(c) for c in (*up, *down)])
    negated = F.transform(F.split(F.col(id_col), ""), lambda c: -F.ascii(c))
    order = [*[F.col(c).desc() for c in up], *[F.col(c) for c in down], negated.desc()]
    return means.orderBy(*order).limit(1)


def gate_failures(rows: DataFrame, base: str, gates: dict[str, tuple[str, float]], id_col: str = "strategy") -> DataFrame:
    """(id, failures): gates by metric: ("gain", least absolute gain), ("ratio", largest multiple) or ("rise", largest rise)."""
    metrics = list(gates)
    b = rows.where(F.col(id_col) == base).select(*[F.col(m).alias(f"_{m}") for m in metrics])
    test = {"gain": lambda m, x: F.col(m) - F.col(f"_{m}") < x, "ratio": lambda m, x: F.col(m) > F.col(f"_{m}") * x, "rise": lambda m, x: F.col(m) - F.col(f"_{m}") > x}
    # the base is one row
    joined = rows.where(F.col(id_col) != base).crossJoin(F.broadcast(b))
    return joined.select(id_col, F.array_compact(F.array(*[F.when(test[k](m, x), F.lit(m)) for m, (k, x) in gates.items()])).alias("failures"))


def round_robin(rows: DataFrame, category: str, order: str, count: int) -> DataFrame:
    """The first `count` rows, taking one of each category in turn."""
    w = Window.partitionBy(category).orderBy(order)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", category).limit(count)


def spread(rows: DataFrame, group: str, order: str, count: int) -> DataFrame:
    """`count` rows of each group, evenly spaced: index round(i (n - 1) / (count - 1)), half to even; groups that are
    too small give none; one row is the middle one."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    numbered = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", n).where(F.col("n") >= count)
    if count == 1:
        return numbered.where(F.col("i") == F.floor(F.col("n") / 2)).drop("n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(k * (F.col("n") - 1) / F.lit(count - 1), 0).cast("int"))
    return numbered.where(F.array_contains(wanted, F.col("i"))).drop("n")


def shadow_diff(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(query_id, rank, code) where two ranked lists differ: a row missing on one side, another id, or another score."""
    r = right.select("query_id", "rank", F.col("id").alias("id2"), F.col("score").alias("score2"))
    j = left.select("query_id", "rank", "id", "score").join(r, ["query_id", "rank"], "full")
    code = F.when(F.col("id").isNull(), "MISSING_LEFT").when(F.col("id2").isNull(), "MISSING_RIGHT").when(F.col("id") != F.col("id2"), "OTHER_ID").when(F.abs(F.col("score") - F.col("score2")) > tolerance, "OTHER_SCORE")
    return j.select("query_id", "rank", code.alias("code")).where("code is not null")


def quota_sample(rows: DataFrame, quotas: list[tuple[str, int]], order: str, id_col: str) -> DataFrame:
    """Ranked quotas in turn: (condition, count); a row counts for the first quota that takes it."""
    taken, out = None, None
    for k, (condition, count) in enumerate(quotas):
        free = rows.where(condition) if taken is None else rows.where(condition).join(taken, id_col, "left_anti")
        part = free.orderBy(order, id_col).limit(count).withColumn("quota", F.lit(k))
        out = part if out is None else out.unionByName(part)
        taken = out.select(id_col)
    return out
