"""Removal of repeated byte strings: every byte covered by a string of `length` bytes that also starts earlier.

Whole texts count; matches never cross documents; earlier means smaller id, or the same document and an earlier
start. Overlaps count, and strings are judged on the input.

1. Rows are packed into shards, the unit that later messages address.
2. Each window of `length` bytes has an anchor: its least hashed substring of _WINDOW - 1 bytes less than `length`,
   leftmost of equals, so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor are
   cut in two: those that hold the _WINDOW / 2 bytes before the anchor, and those that hold as many after it. These
   bytes and the anchor are the part's context; equal windows lie in parts of equal contexts. Each shard says a
   context's hash once, however often it has it, and hears by one bit whether the corpus has it again.
3. Parts of repeated contexts go to the bucket of their context, once per shard and text. There, parts that are equal
   byte for byte collapse to the earliest. Where a context has several texts, all of them are indexed: shards of them
   get Burrows-Wheeler transforms, the transforms are merged, and each repeated interval keeps its earliest window.
4. Each shard hears which windows of its parts to remove, and cuts them out.

A text that a third of all documents share is thus one message per shard, and contexts, not passages, are dealt to
buckets, so that a passage's parts spread. Texts are UTF-8 bytes; a null is an
empty text. Null ids come last, and rows that share an id (or have none) order by their place in the input, so
of repeated rows one copy stays. Texts shorter than `length` stay as they are. Other columns pass through, those
named like a new column are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bwt
from .core import U64, _BYTES, _powers, column_bytes, materialise, mix64, tidy
from .shards import bucket_cuts, pack, unpack

#: Text bytes in a shard, for each bucket of contexts that shards ask about, and for each bucket of parts.
SHARD_BYTES = 2 << 20
#: Shards that go to a Python worker together.
_BATCH = 8
ASK_BYTES, BUCKET_BYTES = 8 << 20, 2 << 20
#: Consecutive windows that an anchor is the least of, at most.
_WINDOW = 64
#: Symbols in a shard of an index, and in an index, unless one context alone has more; bytes hashed together.
_SORT, _INDEX, _PIECE = 1 << 16, 1 << 18, 1 << 18
_POS_BITS = 24


class _Parts:
    """Parts of a shard: start p, number of windows n (half of _WINDOW at most) and hash of the context, key."""

    def __init__(self, packed: bytes, id_at: int, text_at: int, length: int):
        self.table = unpack(packed)
        self.buf, self.offsets = column_bytes(self.table.column(text_at))
        self.ids = self.table.column(id_at).to_numpy() if not self.table.column(id_at).null_count else None
        if self.ids is None:
            self.ids = self.table.column(id_at).fill_null(np.iinfo(np.int64).max).to_numpy()
        gram, half, n = length - _WINDOW + 1, _WINDOW // 2, len(self.buf)
        valid = np.zeros(n + 1, np.int8)
        starts, ends = self.offsets[:-1], self.offsets[1:]
        long = ends - starts >= length
        valid[starts[long]] += 1
        valid[ends[long] - length + 1] -= 1
        valid = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
        ps, ns, ks = [], [], []
        mask = U64((1 << _POS_BITS) - 1)
        for s in range(0, n, _PIECE):
            part = self.buf[s : s + _PIECE + length - 1]
            here = np.flatnonzero(valid[s : s + _PIECE])
            if not len(here):
                continue
            hashes = _Hashes(part)
            least = (hashes.every(gram) & ~mask) | np.arange(len(part) - gram + 1, dtype=U64)
            step = 1
            while step < _WINDOW:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            q = (least[here] & mask).astype(np.int64)
            new = np.ones(len(here), bool)
            new[1:] = (q[1:] != q[:-1]) | (here[1:] != here[:-1] + 1)
            first = np.flatnonzero(new)
            p, count, q = here[first], np.diff(np.append(first, len(here))), q[first]
            before = np.clip(q - p - half + 1, 0, count)
            for start, windows, context, after in ((p, before, q - half, 0), (p + before, count - before, q, 1)):
                some = windows > 0
                at = context[some]
                ps.append(start[some] + s)
                ns.append(windows[some])
                ks.append(mix64(hashes.at(at, np.full(len(at), gram + half)) + U64(after)))
        cat = lambda x, kind: np.concatenate(x).astype(kind, copy=False) if x else np.zeros(0, kind)
        self.p, self.n, self.key = cat(ps, np.int64), cat(ns, np.int64), cat(ks, U64)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, sorted, and how often each occurs."""
        return np.unique(self.key, return_counts=True)

    def only(self, again: np.ndarray, length: int) -> None:
        """Keeps the parts whose key again (one flag for each distinct key) marks, and finds equal ones: first is the
        place of each distinct part's earliest run, in the order in which messages list them, name its hash."""
        keep = again[np.searchsorted(self.asked()[0], self.key)] if len(self.key) else np.zeros(0, bool)
        self.p, self.n, self.key = self.p[keep], self.n[keep], self.key[keep]
        name = np.zeros(len(self.p), U64)
        order = np.argsort(self.p, kind="stable")
        for lo in range(0, len(order), 1 << 16):
            at = order[lo : lo + (1 << 16)]
            base, end = int(self.p[at[0]]), int((self.p[at] + self.n[at]).max()) + length - 1
            name[at] = _Hashes(self.buf[base:end]).at(self.p[at] - base, self.n[at] + length - 1)
        name = mix64(self.key + mix64(name + self.n.astype(U64)))
        order = np.lexsort((self.p, name, self.key))  # the earliest run of each comes first
        new = _distinct(self.buf, self.p[order], self.n[order] + length - 1, name[order])
        self.first, self.name = order[new], name[order][new]


class _Hashes:
    """Polynomial hashes of the substrings of some bytes."""

    def __init__(self, part: np.ndarray):
        power, self.inverse = _powers(len(part) + 1)
        self.total = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTES[part] * power[:-1], dtype=U64, out=self.total[1:])

    def every(self, width: int) -> np.ndarray:
        x = self.total[width:] - self.total[:-width]
        return mix64(x * self.inverse[: len(x)])

    def at(self, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mix64((self.total[start + lengths] - self.total[start]) * self.inverse[start])


def _gather(buf: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many slices, one after the other."""
    ends = np.cumsum(lengths)
    return buf[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - lengths), lengths)]


def _distinct(buf: np.ndarray, start: np.ndarray, lengths: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Flags the strings that differ from the first one of their run of equal names, which are hashes, and the first ones."""
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = np.flatnonzero(~new)
    new[other[lengths[other] != lengths[first[other]]]] = True
    other = np.flatnonzero(~new)
    for lo in range(0, len(other), 1 << 14):
        i = other[lo : lo + (1 << 14)]
        differs = _gather(buf, start[i], lengths[i]) != _gather(buf, start[first[i]], lengths[i])
        new[i] = np.logical_or.reduceat(differs, np.cumsum(lengths[i]) - lengths[i])
    return new


def _step(length: int) -> int:
    return next(k for k in (4, 2, 1) if length % k == 0)


def _windows_to_remove(texts: np.ndarray, lengths: np.ndarray, n: np.ndarray, doc: np.ndarray, pos: np.ndarray, tie: np.ndarray, length: int) -> np.ndarray:
    """For distinct parts, a bit for each of their windows that has an equal one earlier."""
    masks, shards, seg, off = np.zeros(len(n), np.uint32), [], [], []
    ends = np.cumsum(lengths + 1)
    i = 0
    while i < len(n):
        start = int(ends[i] - lengths[i] - 1)
        j = max(i + 1, int(np.searchsorted(ends, start + _SORT, "right")))
        sym = bwt.symbols(texts[start - i : ends[j - 1] - j], lengths[i:j])
        shards.append(bwt.build(sym, _step(length)))
        s = np.repeat(np.arange(i, j, dtype=np.int32), lengths[i:j] + 1)
        o = np.arange(start, ends[j - 1], dtype=np.int32) - np.repeat((ends - lengths - 1)[i:j].astype(np.int32), lengths[i:j] + 1)
        seg.append(s[shards[-1].sa])
        off.append(o[shards[-1].sa])
        i = j
    rows, interval = bwt.merge(shards, length, _step(length))
    first, end = bwt.repeated_intervals(interval)
    many = np.zeros(len(rows) + 1, np.int32)
    many[first] += 1
    many[end] -= 1
    many = np.cumsum(many[:-1]) > 0
    rows, interval = rows[many], interval[many]
    seg, off = np.concatenate(seg)[rows], np.concatenate(off)[rows]
    order = np.lexsort((tie[seg], pos[seg] + off, doc[seg], interval))
    later = np.zeros(len(order), bool)
    later[1:] = interval[order][1:] == interval[order][:-1]
    hit = order[later]
    np.bitwise_or.at(masks, seg[hit], np.uint32(1) << off[hit].astype(np.uint32))
    return masks


def remove_repeats(documents: DataFrame, length: int = 100, id_col: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """The input's rows and columns, and kept (binary: the bytes that stay), n_bytes, n_removed and n_spans (long).
    as_text: kept is a string instead, without the characters of which a cut took a byte; counts stay those of bytes."""
    if length <= _WINDOW + 8:
        raise ValueError("strings must be longer than 72 bytes")
    documents = documents.drop("kept", "n_bytes", "n_removed", "n_spans")
    names = documents.columns
    at = (names.index(id_col), names.index(text), length)
    packs = materialise(pack(documents, text, SHARD_BYTES, id_col), 256)
    total = packs.agg(F.sum("size")).first()[0] or 0
    ask_buckets, buckets = (max(32, -(-total // n)) for n in (ASK_BYTES, BUCKET_BYTES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, count = _Parts(packed.as_py(), *at).asked()
                b, cut, ends = bucket_cuts(h, ask_buckets)
                hashes = [h[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]
                many = [np.packbits(count[i:j] > 1).tobytes() for i, j in zip(cut, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.full(len(cut), shard)), pa.array(hashes, pa.binary()), pa.array(many, pa.binary())], names=["bucket", "shard", "hashes", "many"])

    def answer(table: pa.Table) -> pa.Table:
        tidy()
        buf, offsets = column_bytes(table.column("hashes"))
        h, cuts = buf.view(U64), offsets // 8
        many = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=int(n)) for x, n in zip(table.column("many"), np.diff(cuts), strict=True)]
        order = np.argsort(h)
        group = np.cumsum(np.append(False, h[order][1:] != h[order][:-1])) if len(h) else order
        again = (np.bincount(group) > 1) | (np.bincount(group, np.concatenate(many)[order]) > 0)
        hit = np.zeros(len(h), bool)
        hit[order] = again[group]
        bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    said = packs.select("shard", "batch").mapInArrow(ask, "bucket long, shard long, hashes binary, many binary")
    told = said.groupBy("bucket").applyInArrow(answer, "shard long, bucket long, bits binary")
    known = materialise(told.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")), _BATCH)

    def shard_parts(packed: pa.Scalar, told: pa.Scalar) -> _Parts:
        parts = _Parts(packed.as_py(), *at)
        h = parts.asked()[0]
        again = np.zeros(len(h), bool)
        if told.as_py() is not None:
            bits = {x["bucket"]: x["bits"] for x in told.as_py()}
            for b, i, j in zip(*bucket_cuts(h, ask_buckets), strict=True):
                again[i:j] = np.unpackbits(np.frombuffer(bits[int(b)], np.uint8), count=int(j - i))
        parts.only(again, length)
        return parts

    columns = ["key", "name", "doc", "pos", "n", "texts"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for shard, packed, bits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                r = shard_parts(packed, bits)
                f = r.first
                b, cut, ends = bucket_cuts(r.key[f], buckets)
                doc = np.searchsorted(r.offsets, r.p[f], "right") - 1
                made = {"key": r.key[f], "name": r.name, "doc": r.ids[doc].astype(np.int64), "pos": r.p[f] - r.offsets[doc], "n": r.n[f].astype(np.uint8)}
                rows = []
                for i, j in zip(cut, ends, strict=True):
                    texts = _gather(r.buf, r.p[f[i:j]], r.n[f[i:j]] + length - 1)
                    rows.append([made[c][i:j].tobytes() for c in columns[:-1]] + [pa.compress(texts.tobytes(), "zstd", asbytes=True)])
                arrays = [pa.array([x[k] for x in rows], pa.binary()) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.full(len(cut), shard)), *arrays], names=["bucket", "shard", *columns])

    def judge(table: pa.Table) -> pa.Table:
        tidy()
        raw = {c: column_bytes(table.column(c)) for c in columns[:-1]}
        key, name, doc, pos = (raw[c][0].view(k) for c, k in (("key", U64), ("name", U64), ("doc", np.int64), ("pos", np.int64)))
        n, cuts = raw["n"][0].astype(np.int64), raw["n"][1]
        lengths = n + length - 1
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sizes = [int(lengths[a:b].sum()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        texts = np.frombuffer(b"".join(pa.decompress(x.as_py(), size, "zstd", asbytes=True) for x, size in zip(table.column("texts"), sizes, strict=True)), np.uint8)
        tie = np.repeat(table.column("shard").to_numpy(), np.diff(cuts))
        order = np.lexsort((tie, pos, doc, name, key))
        new = _distinct(texts, starts[order], lengths[order], name[order])
        masks = ((U64(1) << n.astype(U64)) - U64(1)).astype(np.uint32)  # a part with an equal one before it goes
        own = order[new]
        masks[own] = 0
        edge = np.flatnonzero(np.append(True, key[own][1:] != key[own][:-1]))
        sizes = np.diff(np.append(edge, len(own)))
        keep = np.repeat(sizes > 1, sizes)
        several, ends = own[keep], np.cumsum(sizes[sizes > 1])
        size = np.cumsum(lengths[several] + 1)
        cut, i = ends[np.append(size[ends - 1][1:] // _INDEX != size[ends - 1][:-1] // _INDEX, True)] if len(ends) else ends, 0
        for j in cut:
            part = several[i:j]
            masks[part] = _windows_to_remove(_gather(texts, starts[part], lengths[part]), lengths[part], n[part], doc[part], pos[part], tie[part], length)
            i = j
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "masks": pa.array([masks[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    sent = packs.join(known, "shard").select("shard", "batch", "bits").mapInArrow(send, "bucket long, shard long, " + ", ".join(f"{c} binary" for c in columns))
    judged = sent.groupBy("bucket").applyInArrow(judge, "shard long, bucket long, masks binary")
    # written, so that the shuffled texts are gone before the shards are dealt again
    masks = materialise(judged.groupBy("shard").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks")), _BATCH)
    schema = T.StructType([*documents.schema.fields, T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])

    def cut_shard(packed: pa.Scalar, told: pa.Scalar, answer: pa.Scalar) -> pa.RecordBatch | None:
        r = shard_parts(packed, told)
        change = np.zeros(len(r.buf) + 1, np.int32)
        if len(r.p):
            mask = np.frombuffer(b"".join(x["masks"] for x in sorted(answer.as_py(), key=lambda x: x["bucket"])), np.uint32)
            all_ = np.ones(len(r.p), bool)
            all_[r.first] = False
            np.add.at(change, r.p[all_], 1)
            np.add.at(change, r.p[all_] + r.n[all_] + length - 1, -1)
            for bit in range(_WINDOW // 2):
                p = r.p[r.first[(mask >> np.uint32(bit)) & np.uint32(1) == 1]] + bit
                np.add.at(change, p, 1)
                np.add.at(change, p + length, -1)
        np.cumsum(change, out=change)
        gone = change[:-1] > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        edge = r.offsets[:-1][r.offsets[:-1] < len(gone)]
        begin[edge] = gone[edge]

        def count(x: np.ndarray) -> np.ndarray:
            np.cumsum(x, dtype=np.int32, out=change[1:])
            change[0] = 0
            return np.diff(change[r.offsets]).astype(np.int64)

        removed, spans, lengths = count(gone), count(begin), np.diff(r.offsets)
        if as_text and len(gone):
            lead = np.flatnonzero((r.buf & np.uint8(0xC0)) != 0x80)
            gone = np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, len(gone))))
        left, sizes = r.buf[~gone].tobytes(), lengths - count(gone)
        ends = np.cumsum(sizes)
        kept = [left[a:b] for a, b in zip(ends - sizes, ends, strict=True)]
        if r.table.num_rows:
            made = [pa.array(kept, pa.binary()).cast(pa.string()) if as_text else pa.array(kept, pa.binary()), *(pa.array(x) for x in (lengths, removed, spans))]
            return pa.RecordBatch.from_arrays([*r.table.to_batches()[0].columns, *made], names=schema.names)
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                tidy()
                if (out := cut_shard(*row)) is not None:
                    yield out
                del out

    return packs.join(known, "shard", "left").join(masks, "shard", "left").select("batch", "bits", "masks").mapInArrow(cut, schema)
