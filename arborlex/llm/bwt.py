"""Burrows-Wheeler transforms of string collections, merged by iterative interleave refinement.

A shard's transform comes from its own suffix array. Shards are merged without sorting suffixes again: the
interleave starts as shard after shard and is refined `step` symbols at a time. If it orders suffixes by their
first h symbols, stably dealing each row's `step` preceding symbols into place orders their extensions by h + step
symbols, and the rows are followed through the shards' LF mappings. Rows equal in h symbols form a block, so that
a block's suffixes have a common prefix of h symbols at least; the blocks left after `depth` symbols are the
intervals of strings of that length. Suffixes that end before do not take part; they cannot repeat at that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """sa: text position of each row, sentinels included; before: the step symbols preceding it, packed, 0 where the
    string starts earlier; lf: the row of the suffix that these symbols extend it to."""

    sa: np.ndarray
    before: np.ndarray
    lf: np.ndarray


def symbols(buf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes + 1, a 0 after each string, as 16 bits."""
    out = np.zeros(len(buf) + len(lengths), np.uint16)
    out[np.arange(len(buf)) + np.repeat(np.arange(len(lengths)), lengths)] = buf.astype(np.uint16) + np.uint16(1)
    return out


def build(text: np.ndarray, step: int = 1) -> Shard:
    """The transform of one shard. Sentinels order by their position, before every symbol."""
    n = len(text)
    ends = text == 0
    m = int(ends.sum())
    rank = text.astype(np.uint64) + np.uint64(m)
    rank[ends] = np.arange(m, dtype=np.uint64)
    bits = np.uint64(max(9, n.bit_length()))
    if 3 * int(bits) > 64:
        raise ValueError("a shard is too large for its sort keys")
    if m + 257 >= 1 << int(bits):
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    low, index, h = np.uint64((1 << int(bits)) - 1), np.arange(n, dtype=np.uint64), 1
    while True:
        key = rank << bits
        key[: n - h] |= rank[h:]
        key <<= bits
        key |= index
        key.sort()
        sa = (key & low).astype(np.int32)
        key >>= bits
        new = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[sa] = np.cumsum(new, dtype=np.int32) - 1
        if new.all():
            break
        h *= 2
    packed = np.zeros(n, np.uint64)
    short = np.zeros(n, bool)
    for k in range(step, 0, -1):
        packed[k:] = packed[k:] << np.uint64(9) | text[: n - k]
        short[:k] = True
        short[k:] |= ends[: n - k]
    packed[short] = 0
    lf = np.zeros(n, np.int32)
    lf[step:] = rank[: n - step]
    return Shard(sa, packed[sa], lf[sa])


def merge(shards: list[Shard], depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(rows, interval): the suffixes of depth symbols or more, as rows counted over the shards in turn, ordered by
    these symbols, and the running number of the interval that each is in."""
    if depth % step:
        raise ValueError("depth must be a multiple of step")
    base = np.cumsum([0, *(len(s.sa) for s in shards)])
    before = np.concatenate([s.before for s in shards])
    found = np.sort(before)
    found = found[np.append(True, found[1:] != found[:-1])]
    code = np.searchsorted(found, before).astype(np.uint16 if len(found) <= 1 << 16 else np.uint32)
    if found[0]:  # no string starts here, so 0 is no code
        code = code.astype(np.uint32) + np.uint32(1)
    lf = np.concatenate([s.lf + np.int32(b) for s, b in zip(shards, base[:-1], strict=True)])
    rows, block = np.arange(base[-1], dtype=np.int32), np.zeros(base[-1], np.int32)
    for _ in range(depth // step):
        symbol = code[rows]
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        gone = int(np.searchsorted(symbol, 1))
        order, symbol = order[gone:], symbol[gone:]
        was = block[order]
        edge = np.zeros(len(order), bool)
        edge[1:] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
        rows, block = lf[rows[order]], np.cumsum(edge, dtype=np.int32)
    return rows, block


def repeated_intervals(interval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of every interval of two rows or more."""
    edge = np.flatnonzero(np.append(True, interval[1:] != interval[:-1])) if len(interval) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(interval))
    many = ends - edge > 1
    return edge[many], ends[many]
