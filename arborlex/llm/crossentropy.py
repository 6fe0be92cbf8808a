"""Cross-entropy difference: per-token loss under a target and a background word bigram model.

Both models share one vocabulary, the words that all documents hold MIN_COUNT times or more; other words are one
unknown word. The background counts come from all documents, the target's from the rows marked so. A word's
probability is its bigram count with Dirichlet smoothing towards the add-DELTA unigram estimate; a document's first
word and words after an unknown one have the unigram estimate. The score is the mean target loss less the mean
background loss, in nats: the lower, the more like the target.

With without_own a document is scored by all others: its own words and pairs are taken out of the counts of the models
that hold it, so that what it has in common with no other document does not speak for it, and a document that occurs
twice is known by its copy. The vocabulary stays that of all documents.

Counts are exact over all whole documents and are never gathered in one place: each shard counts its own words and
pairs, buckets add them up over shards and send each shard the counts of what it asked for. What a task holds follows
its shard or bucket, not the corpus. Only five totals reach the driver.

Null and empty texts have no tokens and null losses. Words are runs other than the six ASCII separators, A-Z
lower-cased. Repeated rows count each; other columns pass through, those
named like a new column are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import U64, column_bytes, materialise, mix64, slices, tidy, words
from .shards import bucket_cuts, pack, unpack

MIN_COUNT = 2
DELTA, MU = 0.1, 20.0
SHARD_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20


def _squeeze(x: np.ndarray) -> bytes:
    """Sorted or small numbers: differences or values by byte plane, compressed."""
    if x.dtype == U64:
        x = np.diff(x, prepend=U64(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _expand(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=U64) if kind is U64 else x


class _Tokens:
    """Words and pairs of a shard. The pair hash has its lowest bit set, a word's has not."""

    def __init__(self, packed: bytes, text_at: int, target_at: int):
        self.table = unpack(packed)
        buf, offsets = column_bytes(self.table.column(text_at))
        parts, firsts = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
        for i, j in slices(offsets):  # a slice at a time: hashing takes many bytes per byte of text
            h, _, _, first = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold_case=True)
            parts.append(h)
            firsts.append(firsts[-1][-1] + first[1:])
        h, self.first = np.concatenate(parts), np.concatenate(firsts)
        self.word = h & ~U64(1)
        self.starts = np.zeros(len(h), bool)
        self.starts[self.first[:-1][self.first[:-1] < self.first[1:]]] = True
        self.pair = np.zeros(len(h), U64)  # with the word before; no pair at a document's start
        self.pair[1:] = mix64(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]) | U64(1)
        marked = self.table.column(target_at).fill_null(False).to_numpy()
        self.target = np.repeat(marked, np.diff(self.first))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = ~self.starts
        every, n = np.unique(np.concatenate((self.word, self.pair[inner])), return_counts=True)
        own, m = np.unique(np.concatenate((self.word[self.target], self.pair[inner & self.target])), return_counts=True)
        target = np.zeros(len(every), np.uint32)
        target[np.searchsorted(every, own)] = m
        return every, target, n.astype(np.uint32)


def score(documents: DataFrame, target: str, text: str = "text", min_count: int = MIN_COUNT, without_own: bool = False) -> DataFrame:
    """The input's rows and columns with n_tokens, target_loss, background_loss and score. target: a boolean column.
    without_own: whether a document's own counts are left out of the models that score it."""
    added = ("n_tokens", "target_loss", "background_loss", "score")
    documents = documents.drop(*set(added) - {target, text})
    at = (documents.columns.index(text), documents.columns.index(target))
    packs = materialise(pack(documents, text, SHARD_BYTES))
    total = packs.agg(F.sum("size")).first()[0] or 0
    buckets = max(32, -(-total // BUCKET_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, t, n = _Tokens(packed.as_py(), *at).counts()
                b, first, end = bucket_cuts(h, buckets)
                made = [pa.array([_squeeze(x[i:j]) for i, j in zip(first, end, strict=True)], pa.binary()) for x in (h, t, n)]
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.full(len(b), shard)), *made], names=["bucket", "shard", "h", "t", "n"])

    said = packs.select("shard", "batch").mapInArrow(count, "bucket long, shard long, h binary, t binary, n binary")

    def add_up(table: pa.Table) -> pa.Table:
        tidy()
        h, t, n = ([_expand(x.as_py(), kind) for x in table.column(c)] for c, kind in (("h", U64), ("t", np.uint32), ("n", np.uint32)))
        ends = np.cumsum([len(x) for x in h])
        h, t, n = np.concatenate(h), np.concatenate(t).astype(np.int64), np.concatenate(n).astype(np.int64)
        order = np.argsort(h)
        s = h[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        t, n = np.add.reduceat(t[order], first), np.add.reduceat(n[order], first)
        word = s[first] & U64(1) == 0
        known = word & (n >= min_count)
        back = np.empty(len(h), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        sums = [int(x) for x in (t[word].sum(), n[word].sum(), t[known].sum(), n[known].sum(), known.sum())]
        cut = [slice(a, b) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
        answers = [[_squeeze(x[back[c]].astype(np.uint32)) for c in cut] for x in (t, n)]
        rows = table.num_rows
        totals = [pa.array([x] + [0] * (rows - 1), pa.int64()) for x in sums]
        return pa.Table.from_arrays([table.column("shard"), table.column("bucket"), *(pa.array(x, pa.binary()) for x in answers), *totals], names=["shard", "bucket", "t", "n", *_TOTALS])

    summed = materialise(said.groupBy("bucket").applyInArrow(add_up, "shard long, bucket long, t binary, n binary, " + ", ".join(f"{c} long" for c in _TOTALS)))
    totals = [x or 0 for x in summed.agg(*(F.sum(c) for c in _TOTALS)).first()]
    answers = summed.groupBy("shard").agg(F.collect_list(F.struct("bucket", "t", "n")).alias("answers"))
    schema = T.StructType([*documents.schema.fields, T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in added[1:])])

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for packed, told in zip(batch.column(0), batch.column(1), strict=True):
                x = _Tokens(packed.as_py(), *at)
                told = sorted(told.as_py() or [], key=lambda y: y["bucket"])
                answer = {c: np.concatenate([_expand(y[c], np.uint32) for y in told] or [np.zeros(0, np.uint32)]).astype(np.float64) for c in "tn"}
                yield x.table.to_batches()[0].from_arrays([*x.table.to_batches()[0].columns, *_losses(x, answer, totals, min_count, without_own)], names=schema.names)

    return packs.join(answers, "shard", "left").select("batch", "answers").mapInArrow(losses, schema)


_TOTALS = ("target_words", "words", "target_known", "known", "vocabulary")


def _within(index: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each token's index occurs in its own document."""
    key = doc * (int(index.max(initial=0)) + 1) + index
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[place]


def _losses(x: _Tokens, answer: dict[str, np.ndarray], totals: list[int], min_count: int, without_own: bool) -> list[pa.Array]:
    every = np.unique(np.concatenate((x.word, x.pair[~x.starts])))
    word, pair = np.searchsorted(every, x.word), np.minimum(np.searchsorted(every, x.pair), max(0, len(every) - 1))
    in_vocabulary = answer["n"][word] >= min_count
    after_known = np.zeros(len(word), bool)
    after_known[1:] = in_vocabulary[:-1]
    after_known &= in_vocabulary & ~x.starts
    n = np.diff(x.first)
    doc = np.repeat(np.arange(len(n)), n)
    own_word, own_pair, own_unknown, own_size = (np.zeros(len(word), np.int64) for _ in range(4))
    if without_own:
        own_word, own_pair[~x.starts] = _within(word, doc), _within(pair[~x.starts], doc[~x.starts])
        own_unknown, own_size = np.bincount(doc[~in_vocabulary], minlength=len(n))[doc], n[doc]
    sums = []
    for c, words_, known in (("t", totals[0], totals[2]), ("n", totals[1], totals[3])):
        held = x.target if c == "t" else np.ones(len(word), bool)  # tokens of documents that the model holds
        seen = answer[c][word] - own_word * held
        one = np.where(in_vocabulary, seen, float(words_ - known) - own_unknown * held)
        p = (one + DELTA) / (words_ - own_size * held + DELTA * (totals[4] + 1))
        before = np.zeros(len(word))
        before[1:] = seen[:-1]
        p = np.where(after_known, (answer[c][pair] - own_pair * held + MU * p) / (before + MU), p)
        sums.append(np.diff(np.concatenate(([0.0], np.cumsum(-np.log(p))))[x.first]))
    target, background = (np.divide(s, n, out=np.zeros(len(n)), where=n > 0) for s in sums)
    return [pa.array(n.astype(np.int64)), *(pa.array(v, mask=n == 0) for v in (target, background, target - background))]
