"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact confirmation, components.

1. Equal shingle sets collapse to one class; only its smallest doc_id goes on.
2. Classes that share a band of signature rows are candidates. A bucket is not expanded into pairs: one member,
   the pivot, is compared with the others, links are confirmed, and the bucket goes into the next round without
   its pivot unless all its members are in one component by then. A pair is thus left out only if it is linked
   through others already. After ROUNDS rounds, what is left is compared in blocks of BLOCK members,
   texts at hand, and only links that join components leave a task.
3. A candidate pair's signatures are compared BATCH rows at a time; it is dropped once the posterior probability
   that its similarity reaches the threshold, under a uniform prior, is below MISS. Survivors are confirmed by
   intersection and union of the full shingle sets, made of the words themselves and not of hashes. (Step 1 goes by
   128 bits of hashes of a whole set.)

Definitions: words are maximal runs of bytes other than the six ASCII separators, A-Z lower-cased; a text with
fewer words than a shingle is one shingle; one without words has an empty set and no links. A doc_id names one
document: rows that repeat it are joined. A row without doc_id has no links and a null component. Rows come back
one for one, whatever other columns they have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .core import LOWER, U64, column_bytes, drop, filtered, materialise, mix64, slices, tidy, words

BANDS, ROWS = 24, 5
BATCH = 20
#: Probability at which a pair that reaches the threshold may be pruned.
MISS = 1e-6
ROUNDS = 3
BLOCK = 256
#: Bytes of text whose shingles a block counts together; blocks of longer texts compare them pair by pair.
TOGETHER = 1 << 21
#: Shingles of a block that are counted at once.
_COLUMNS = 1 << 12

_HASHES = BANDS * ROWS
_COEFFICIENTS = (mix64(np.arange(1, _HASHES + 1, dtype=U64) * U64(0xA24BAED4963EE407)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (mix64(np.arange(1, _HASHES + 1, dtype=U64) * U64(0x9FB21C651E98DF25)) >> U64(32)).astype(np.uint32)
_SLICE = 1 << 15


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each document."""
    h, _, _, first = words(buf, offsets, fold_case=True)
    parts = [mix64(h + U64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) for k in range(width)]
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, U64)
    for k in range(width):
        rolled = mix64(rolled + parts[k][k : k + n]) if k else parts[0][:n].copy()
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            own = np.array([b - a], U64)
            for k in range(b - a):
                own = mix64(own + parts[k][a + k])
            yield own
        else:
            yield np.zeros(0, U64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash rows of non-empty sets, (documents, hashes) of 32 bits."""
    out = np.full((len(sets), _HASHES), 0xFFFFFFFF, np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= _SLICE):
            size += len(sets[j])
            j += 1
        flat = (np.concatenate(sets[i:j]) >> U64(17)).astype(np.uint32)
        for lo in range(0, len(flat), _SLICE) if j == i + 1 else (0,):
            part = flat[lo : lo + _SLICE] if j == i + 1 else flat
            starts = np.zeros(1, np.int64) if j == i + 1 else np.cumsum([0, *map(len, sets[i : j - 1])])
            x = np.empty_like(part)
            for k in range(_HASHES):
                np.multiply(part, _COEFFICIENTS[k], out=x)
                np.add(x, _OFFSETS[k], out=x)
                np.bitwise_xor(x, x >> np.uint32(15), out=x)
                np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
                np.minimum(out[i:j, k], np.minimum.reduceat(x, starts), out=out[i:j, k])
        i = j
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(documents, bands) of 64 bits; different bands never share a value on purpose."""
    x = sig.reshape(len(sig), BANDS, ROWS).astype(U64)
    h = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=U64)), x.shape[:2]).copy()
    for k in range(ROWS):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + x[:, :, k])
    return h


@lru_cache(8)
def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(rows compared, matches needed to go on): fewer matches put P(similarity >= threshold) below miss."""
    out = []
    for n in range(BATCH, _HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survives(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of signature rows are still possible after each batch."""
    left, matches, before = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in least_matches(threshold):
        matches[left] += (a[left, before:n] == b[left, before:n]).sum(1, dtype=np.int32)
        left, before = left[matches[left] >= least], n
    keep = np.zeros(len(a), bool)
    keep[left] = True
    return keep


def _sig_rows(col: pa.Array) -> np.ndarray:
    return column_bytes(col)[0].view(np.uint32).reshape(-1, _HASHES)


def _digest(documents: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(id, n, h1, h2, sig) of each row; h1 and h2 name the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            buf, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets):
                sets = list(shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width))
                n = np.array([len(x) for x in sets], np.int64)
                some = [x for x in sets if len(x)]
                sig = iter(signatures(some))
                ones = [(int(x.sum(dtype=U64)), int(np.bitwise_xor.reduce(mix64(x + U64(77))))) for x in sets]
                h = np.array(ones, U64).reshape(-1, 2).view(np.int64)
                sigs = pa.array([next(sig).tobytes() if len(x) else None for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), sigs], names=["id", "n", "h1", "h2", "sig"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, h1 long, h2 long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            if batch.num_rows:
                h = band_hashes(_sig_rows(batch.column(1)))
                rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(rep)], names=["bucket", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "bucket long, rep long")


def _pruned(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            if batch.num_rows:
                keep = survives(_sig_rows(batch.column(2)), _sig_rows(batch.column(3)), threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda x: sigs.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _word_numbers(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal words, from 0, and the first word of each text."""
    h, start, end, first = words(buf, offsets, fold_case=True)
    _, one, number = np.unique(h, return_index=True, return_inverse=True)
    folded, length, like = LOWER[buf], end - start, one[number]
    if len(h) and (same := bool((length == length[like]).all())):
        ends = np.cumsum(length)
        step = np.arange(ends[-1]) - np.repeat(ends - length, length)
        same = bool((folded[step + np.repeat(start, length)] == folded[step + np.repeat(start[like], length)]).all())
    if len(h) and not same:  # two words of one hash
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(folded[a:b].tobytes(), len(seen)) for a, b in zip(start, end, strict=True)], np.int64)
    return number, first


def alike(x: np.ndarray, y: np.ndarray, width: int, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of the shingle sets of two texts, both with words."""
    number, first = _word_numbers(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]))
    a, b = number[: first[1]], number[first[1] :]
    if not len(a) or not len(b):
        return False
    if min(len(a), len(b)) < width:
        return np.array_equal(a, b)
    cut, codes = len(a) - width + 1, [np.concatenate((a[k : len(a) - width + 1 + k], b[k : len(b) - width + 1 + k])) for k in range(width)]
    code, many = codes[0], len(number)
    for nxt in codes[1:]:
        code = np.unique(code * many + nxt, return_inverse=True)[1]  # products stay below 2^62
    kinds = int(code.max()) + 1
    left, right = np.zeros(kinds, bool), np.zeros(kinds, bool)
    left[code[:cut]] = right[code[cut:]] = True
    return bool(100 * (left & right).sum() >= percent * (left | right).sum())


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            (x, i), (y, j) = (column_bytes(batch.column(k)) for k in (2, 3))
            keep = [alike(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], width, percent) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _common(texts: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that left texts share with right ones, (left, right), and the set size of each text, 0 with fewer words
    than a shingle. Shingles are made of the words themselves."""
    number, first = _word_numbers(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    owner, many = np.repeat(np.arange(len(texts)), np.diff(first)), len(number)
    at = np.arange(max(0, many - width + 1))
    at = at[owner[at] == owner[at + width - 1]]
    code = number[at]
    for k in range(1, width):
        code = np.unique(code * many + number[at + k], return_inverse=True)[1]
    code, own = np.divmod(np.unique(code * len(texts) + owner[at]), len(texts))  # in order of the shingles
    sizes, shared = np.bincount(own, minlength=len(texts)), np.zeros((len(left), len(right)), np.int64)
    several = np.bincount(code)[code] > 1
    code, own = np.unique(code[several], return_inverse=True)[1], own[several]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, _COLUMNS):
        a, b = np.searchsorted(code, (lo, lo + _COLUMNS))
        has = np.zeros((len(texts), _COLUMNS), np.float32)
        has[own[a:b], code[a:b] - lo] = 1
        shared += (has[left] @ has[right].T).astype(np.int64)
    return shared, sizes


def _linked(rep: np.ndarray, comp: np.ndarray, side: np.ndarray, sig: np.ndarray, texts: list[np.ndarray], width: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join components, between side 0 and side 1, or within side 0 if there is no other."""
    root = {int(c): int(c) for c in comp}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    within, out = not len(right), []
    right = left if within else right
    counted = len(texts) > 2 and sum(map(len, texts)) <= TOGETHER
    if counted:
        shared, sizes = _common(texts, left, right, width)
    for k, i in enumerate(left):
        at = np.arange(k + 1 if within else 0, len(right))
        at = at[comp[right[at]] != comp[i]]
        at = at[survives(np.broadcast_to(sig[i], (len(at), _HASHES)), sig[right[at]], percent / 100)]
        if counted and sizes[i]:
            n = shared[k, at]
            at = at[100 * n >= percent * (sizes[i] + sizes[right[at]] - n)]
        for j in right[at]:
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b and (counted and sizes[i] or alike(texts[i], texts[j], width, percent)):
                root[max(a, b)] = min(a, b)
                out.append((int(rep[i]), int(rep[j])))
    return out


def _leftover(members: DataFrame, sigs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components in the buckets that pivots have not settled. Classes that reach each other through
    shared buckets are compared in blocks, with their texts at hand; only links that join components come out."""
    low = materialise(members.groupBy("bucket").agg(F.min("rep").alias("low")))
    clusters = connected_components(members.join(low, "bucket").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    sizes = materialise(clusters.groupBy("component").agg(F.count("*").alias("size")))
    rows = clusters.join(sizes, "component").select(F.col("node").alias("rep"), F.col("component").alias("cluster"), "size")
    rows = materialise(rows.join(materialise(members.select("rep", "component").distinct()), "rep"))
    cells = max(1, rows.where(F.col("size") <= BLOCK).count() // BLOCK)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    small = rows.where(F.col("size") <= BLOCK).select("rep", "cluster", "component", F.lit(0).alias("side"), F.pmod(F.xxhash64("cluster"), F.lit(cells)).alias("key"), F.lit(-1).alias("x"), F.lit(-1).alias("y"))
    large = rows.where(F.col("size") > BLOCK).select("rep", "cluster", "component", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    large = large.select("rep", "cluster", "component", (F.col("own") > F.col("other")).cast("int").alias("side"), F.col("cluster").alias("key"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    dealt = small.unionByName(large).join(sigs, "rep").join(texts, "rep")

    def run(table: pa.Table) -> pa.Table:
        tidy()
        rep, comp, side, cluster = (table.column(c).to_numpy() for c in ("rep", "component", "side", "cluster"))
        sig = _sig_rows(table.column("sig"))
        buf, offsets = column_bytes(table.column("text"))
        own = [buf[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        order, out = np.argsort(cluster, kind="stable"), []
        for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            out += _linked(rep[part], comp[part], side[part], sig[part], [own[i] for i in part], width, percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return dealt.groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable) and kept (it is that id)."""
    threshold = percent / 100
    held: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        held.append(materialise(df))
        return held[-1]

    rows = materialise(_digest(documents, id_col, text, width))
    some = rows.where("n > 0 and id is not null")
    # one class may hold a third of all rows: its minimum is combined before the shuffle
    grouped = some.groupBy("h1", "h2").agg(F.min(F.struct("id", "sig")).alias("m"), F.count("*").alias("size"))
    classes = kept(grouped.select("h1", "h2", F.col("m.id").alias("rep"), F.col("m.sig").alias("sig"), "size"))
    # random order of a round; a bucket's first member is its pivot
    first = lambda k: F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("o"), F.col("rep").alias("r"), F.col("component").alias("c"))).alias("p")
    pivot = ("bucket", F.col("p.r").alias("pivot"), F.col("p.c").alias("pc"))
    bands = _bands(classes).withColumn("component", F.col("rep"))
    pivots = kept(bands.groupBy("bucket").agg(F.count("*").alias("size"), first(0)).where("size > 1").select(*pivot))
    members = kept(bands.join(pivots.select("bucket"), "bucket"))
    # few rows are members: the others' texts and signatures are not moved
    reps = kept(members.select("rep").distinct())
    texts = documents.select(F.col(id_col).cast("long").alias("rep"), F.col(text).alias("text"))
    texts, sigs = (kept(filtered(x, "rep", reps).join(reps, "rep", "left_semi")) for x in (texts, classes.select("rep", "sig")))
    links = None
    for k in range(ROUNDS + 1):
        if k < ROUNDS:
            pairs = members.join(pivots, "bucket").where("component <> pc").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
            found = _confirmed(kept(_pruned(kept(pairs), sigs, threshold)), texts, width, percent)
        else:
            found = _leftover(kept(members.join(pivots.select("bucket"), "bucket")), sigs, texts, width, percent)
        found = kept(found)
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)
        held.append(labels)
        if k == ROUNDS:
            break
        rest = members.join(pivots, "bucket").where("rep <> pivot").select("bucket", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        members = kept(rest.select("bucket", "rep", F.coalesce("component", "rep").alias("component")))
        # buckets with members of several components stay open; only they have a pivot in the next round
        spread = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), first(k + 1))
        pivots = kept(spread.where("lo <> hi").select(*pivot))
        if pivots.isEmpty():
            break
    by_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").where("size > 1 or component is not null")
    by_class = materialise(by_class.select("h1", "h2", F.coalesce("component", "rep").alias("component")))
    for old in held:  # the result reads rows and by_class only
        drop(old)
    out = rows.select("id", "n", "h1", "h2").join(by_class, ["h1", "h2"], "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
