"""Mixing sources to target weights by Pareto order sampling.

Source targets: the budget is shared by weight; a source stops at max_copies times its size and its excess is
reshared by weight among the others until none is above. In closed form target = min(cap, level * weight), and the
level follows from running sums over the sources in order of cap / weight.

Documents: with r = target / source size, every document gets floor(r) certain copies; the rest of the target goes
to a sample. A document's inclusion probability is the rest's share, times its importance over its source's mean
importance where an importance is given; where that reaches 1 the copy is certain. U being a hash of the document
in (0, 1), the documents with the least (U / (1 - U)) / (p / (1 - p)) are taken, as many as fit into the
source's target; of the last ones, those that bring the taken words nearer to it.

The cut is found in two steps, so that no task sees a whole source: sums over LEVELS ranges of the rank value,
then running sums inside the ranges. No document gets more than max_copies copies.

A null id is no id: the row's number comes from its other columns. Null texts have size 0 and are never taken more than a document without words is: such documents take 0 words.
A null source is a source of its own. Equal rows are taken together; ties in rank go by id, then by the hash of the
row. An empty table gives an empty one. The result depends on the rows only.
Other columns pass through, but for those named like a new column (or _id, _tie, _i, _t), which are dropped.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import drop, materialise

LEVELS = 4096
#: Passes down the ranking: what a document too long for the rest leaves open goes to later, shorter ones.
PASSES = 4
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_copies: float) -> DataFrame:
    """sizes: (source, source_size). Adds weight and target. One row per source goes through one sorted window."""
    order = Window.orderBy(F.hex("source").asc_nulls_last())  # UTF-8 bytes order as code points do
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth.cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.hex("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    filled, open_ = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    rows = rows.withColumn("level", (budget - filled) / open_)
    # the first source, by ratio, that the level does not fill sets it; if all are filled, all stop at their caps
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.hex("source"), F.col("level")))).over(everything)
    return rows.withColumn("target", F.least("cap", F.coalesce(level.getField("level") * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def key_of(source: str) -> Column:
    """A key of a source that joins a null with a null."""
    return F.struct(F.col(source).isNull().alias("x"), F.coalesce(source, F.lit("")).alias("y"))


def _ranked(own: str, max_copies: int) -> dict[str, Column]:
    """By name, one after the other: certain copies (fixed), place in the ranking of the source (rank, null if that is all)
    and its range (cell), from the columns of a document and its source, whose names begin with own."""
    col = lambda c: F.col(own + c)
    ratio = F.when(col("source_size") > 0, col("target") / col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio + 1e-12), F.lit(max_copies))
    p = (ratio - whole) * F.when(col("gained") > 0, col("gain") * col("source_size") / col("gained")).otherwise(F.lit(1.0))
    # rank / (mean odds + rank) is near uniform, so that the ranges are near equal; rows without a rank are spread
    mean = F.greatest(F.least(ratio - F.floor(ratio), F.lit(1 - 1e-9)), F.lit(1e-9))
    spread = col("rank") * mean / (1 - mean)
    return {
        "whole": whole.cast("int"),
        "p": p,
        "sure": (col("p") >= 1) & (col("whole") < max_copies),
        "rank": F.when((col("p") > 0) & ~col("sure") & (col("whole") < max_copies), col("u") / (1 - col("u")) / (col("p") / (1 - col("p")))),
        "cell": F.when(col("rank").isNull(), F.pmod(col("tie"), F.lit(LEVELS))).otherwise(F.least(F.floor(spread / (1 + spread) * LEVELS), F.lit(LEVELS - 1))).cast("int"),
        "fixed": (col("whole") + col("sure").cast("int")).cast("int"),
    }


def mix(
    documents: DataFrame,
    weights: tuple[float, ...],
    share: float = 1.5,
    max_copies: int = 2,
    seed: int = 11,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    importance: str | None = None,
) -> DataFrame:
    """The input's rows with size, source_size, target, copies and taken (= copies * size)."""
    documents = documents.drop("size", "source_size", "target", "copies", "taken", "_id", "_tie", "_i", "_t")
    gain = F.coalesce(F.greatest(F.col(importance).cast("double"), F.lit(0.0)), F.lit(1.0)) if importance else F.lit(1.0)
    tie = F.xxhash64(*(F.col(c) for c, t in documents.dtypes if not t.startswith(("map", "variant"))))
    # rows without id are told apart by their other columns; a hash passes over nulls
    u = (F.pmod(F.xxhash64(F.when(F.col(id_col).isNull(), tie), F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    unit = {"_id": F.col(id_col), "source": F.col(source).cast("string"), "one": word_count(text), "gain": gain, "u": u, "tie": tie}
    rows = documents.select(*(made.alias(name) for name, made in unit.items()))
    # equal rows are one unit: all of them are taken as often
    rows = rows.groupBy("_id", "tie").agg(*(F.first(c).alias(c) for c in ("source", "one", "gain", "u")), F.count("*").alias("rows"), (F.first("one") * F.count("*")).alias("size"))
    rows = materialise(rows)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("gain")).alias("gained"))
    named = sums.select("source", "source_size")
    targets = source_targets(named, weights, share, max_copies).select(F.col("source").alias("s"), "target")
    # the sources' table is materialised: a join then may split a source that holds many of the rows
    sources = materialise(sums.join(targets, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", "gained"))

    ranked = rows.withColumn("k", key_of("source")).join(sources.withColumn("k", key_of("s")).drop("s"), "k")
    for name, made in _ranked("", max_copies).items():
        ranked = ranked.withColumn(name, made)
    state = materialise(ranked.select("_id", "tie", "k", "one", "size", "rows", "target", "rank", "cell", F.col("fixed").alias("copies"), F.lit(None).cast("int").alias("taken_in")))
    drop(rows)
    limits = []
    for n in range(PASSES):
        last = n == PASSES - 1
        rest = materialise(state.groupBy("k").agg((F.first("target") - F.sum((F.col("copies") + F.col("taken_in").isNotNull().cast("int")) * F.col("size"))).alias("rest")))
        limits.append(rest)
        now = state.join(rest, "k")
        fits = F.col("rank").isNotNull() & F.col("taken_in").isNull() & (F.col("size") <= F.col("rest") * (2 if last else 1))
        now = materialise(now.withColumn("free", fits))
        cells = now.where("free").groupBy("k", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        cells = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("k").orderBy("cell")))
        cut = materialise(cells.where("upto > rest").groupBy("k").agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("words")).alias("missing"))).alias("cut")))
        # a running sum inside each range; only the one in which the target lies matters
        inside = F.sum(F.when(F.col("free"), F.col("size")).otherwise(0)).over(Window.partitionBy("k", "cell").orderBy("rank", "_id", "tie").rowsBetween(Window.unboundedPreceding, 0))
        room = F.col("cut.missing") + (F.col("size") / 2 if last else F.lit(0.0))
        take = F.col("free") & (F.col("cut").isNull() | (F.col("cell") < F.col("cut.cell")) | ((F.col("cell") == F.col("cut.cell")) & (F.col("inside") <= room)))
        new = now.withColumn("inside", inside).join(cut, "k", "left").withColumn("taken_in", F.when(take, F.lit(n)).otherwise(F.col("taken_in")))
        new = materialise(new.select(*state.columns))
        for old in (state, now, cut):
            drop(old)
        state = new
    # In each pass, those taken are the first in rank of those that fit: a row knows from its source's limits and the last
    # one taken whether it is, so that no text is moved to a plan. Equal rows, which fit together or not, are looked up.
    place = F.struct("cell", "rank", "_id", "tie")
    ends = materialise(state.groupBy("k").agg(*(F.max(F.when(F.col("taken_in") == n, place)).alias(f"end{n}") for n in range(PASSES))))
    choice = sources.withColumn("k", key_of("s")).join(ends, "k")
    for n, rest in enumerate(limits):
        choice = choice.join(rest.select("k", (F.col("rest") * (2 if n == PASSES - 1 else 1)).alias(f"most{n}")), "k")
    choice = materialise(choice.drop("s"))
    equal = materialise(state.where("rows > 1").select("_id", "tie", (F.col("copies") + F.col("taken_in").isNotNull().cast("int")).alias("copies")))
    for old in (state, sources, ends, *limits):
        drop(old)

    # names of its own, which no column of the input has
    own = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in documents.columns), default=0))
    as_own = lambda df: df.select(*(F.col(c).alias(own + c) for c in df.columns))
    out = documents
    for name, made in unit.items():
        out = out.withColumn(own + name, made)
    out = out.withColumn(own + "key", key_of(own + "source")).join(as_own(choice), F.col(own + "key") == F.col(own + "k"))
    for name, made in _ranked(own, max_copies).items():
        out = out.withColumn(own + name, made)
    place = F.struct(*(F.col(own + c).alias(c) for c in ("cell", "rank", "_id", "tie")))
    taken = [F.col(own + "rank").isNotNull() & (F.col(own + "one") <= F.col(f"{own}most{n}")) & (place <= F.col(f"{own}end{n}")) for n in range(PASSES)]
    taken = F.coalesce(reduce(or_, (F.coalesce(x, F.lit(False)) for x in taken)), F.lit(False)).cast("int")
    out = out.withColumn(own + "copies", F.col(own + "fixed") + taken)
    same = as_own(equal.select(F.col("_id").alias("i"), F.col("tie").alias("t"), F.col("copies").alias("n")))
    out = out.join(same, F.col(own + "_id").eqNullSafe(F.col(own + "i")) & (F.col(own + "tie") == F.col(own + "t")), "left")
    out = out.withColumn(own + "n", F.coalesce(own + "n", own + "copies"))
    made = {"size": "one", "source_size": "source_size", "target": "target", "copies": "n"}
    return out.select(*documents.columns, *(F.col(own + c).alias(name) for name, c in made.items()), (F.col(own + "n") * F.col(own + "one")).alias("taken"))
