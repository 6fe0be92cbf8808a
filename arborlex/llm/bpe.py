"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

Encoding. After a prefix of a pre-token, the tokens ending there are known up to a short tail: what follows
can only reach back to positions from which the bytes read so far are a proper prefix of some token. A state
keeps those positions, each with its token path since the last boundary that all of them share; tokens before
that boundary are emitted. Two tokens may stand side by side only if the merges leave them so. A state is
its last emitted token, the bytes not yet emitted and the paths. It is built when met, remembered when met again,
and all are forgotten together when there are too many, so memory stays bounded on any input, and what occurs once
(most long pre-tokens) takes none of it.

Most pre-tokens that are not remembered are short and occur once: building states for them costs more than it saves.
Those of a batch run through the same transducer side by side (Lockstep). Instead of a state, each keeps the last token
of its path at every position, in arrays; joins are judged by undoing merges, and remembered.

Decoding. Token bytes run through an incremental UTF-8 automaton whose state is the open sequence; a malformed
or cut sequence becomes U+FFFD, as bytes.decode(errors="replace") would give.

Nulls are empty texts; an empty text has no tokens. Rows, repeated or not, are encoded one by one, so ties and
skew play no part; other columns pass through, but columns that have the new ones' names are replaced. An empty
table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .core import CACHES, tidy

#: States and remembered pre-tokens that one worker keeps (about 0.5 and 0.25 kB each), and joins that it has judged.
MAX_STATES = 120_000
MAX_PIECES = 300_000
MAX_JOINS = 250_000
#: Longer pre-tokens are not remembered and run one by one.
MAX_PIECE_CHARS = 48
#: Pre-tokens that run side by side, at least (fewer run one by one) and at most.
SIDE_LEAST, SIDE_MOST = 64, 1 << 12
#: Documents that are turned into Python strings together, and characters that are split together; a longer text stands alone.
BATCH_ROWS, BATCH_CHARS = 64, 1 << 20


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


_BYTE = [bytes((i,)) for i in range(256)]


class _Met:
    """Tells what was met before, by a bit per hash; may forget, and may take one thing for another."""

    BITS = 20

    def __init__(self) -> None:
        self.bits, self.count = bytearray(1 << (self.BITS - 3)), 0

    def again(self, x: object) -> bool:
        h = hash(x) & ((1 << self.BITS) - 1)
        at, bit = h >> 3, 1 << (h & 7)
        if self.bits[at] & bit:
            return True
        if self.count >= 1 << (self.BITS - 1):
            self.bits, self.count = bytearray(len(self.bits)), 0
        self.bits[at] |= bit
        self.count += 1
        return False


#: The state before the first byte: no token emitted, no bytes pending, one empty path.
_START = (-1, b"", ())


class Transducer:
    """Bytes of one pre-token in, token ids out.

    keys holds each remembered state, ids its number, moves by number and byte the next one's number, alone or with
    the tokens emitted on the way. A state that is not remembered has the number -1.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.prefixes = {b[:k] for b in ranks for k in range(1, len(b))}
        self.joins: dict[int, bool] = {}
        self.met = _Met()
        self.reset()

    def reset(self) -> None:
        self.keys: list[tuple] = [_START]
        self.ids: dict[tuple, int] = {_START: 0}
        self.moves: dict[int, int | tuple[int, tuple]] = {}

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The tokens of a short string by repeated merging: lowest rank first, leftmost of equals. least: parts to leave."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _judge(self, left: int, right: int) -> bool:
        """Whether the merges keep the two tokens apart where they meet."""
        a, b = self.tokens[left], self.tokens[right]
        if len(self.joins) >= MAX_JOINS:
            self.joins.clear()
        found = self.joins[left << 32 | right] = self.merged(a + b) == [a, b]
        return found

    def step(self, state: tuple, number: int, byte: int) -> tuple[tuple, int, tuple]:
        """The next state, its number, and the tokens emitted."""
        prev, pending = state[0], state[1] + _BYTE[byte]
        path, live, prefixes, joins, length = None, [], self.prefixes, self.joins, self.length
        for tokens in state[2:]:
            tail = pending[sum([length[t] for t in tokens]) :]
            if path is None and (token := self.ranks.get(tail)) is not None:
                before = tokens[-1] if tokens else prev
                if before >= 0 and (fits := joins.get(before << 32 | token)) is None:
                    fits = self._judge(before, token)
                if before < 0 or fits:
                    path = (*tokens, token)
            if tail in prefixes:
                live.append(tokens)
        if path is None:
            raise ValueError("the ranks do not cover every byte or are no merge order")
        shared = len(path)
        for tokens in live:
            k = 0
            for x, y in zip(tokens, path[:shared]):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                k += 1
            shared = k
        live.append(path)
        emitted = path[:shared]
        if shared:
            prev, pending = emitted[-1], pending[sum([length[t] for t in emitted]) :]
            live = [p[shared:] for p in live]
        if live[0]:
            prev = -1  # every path has a token of its own, so the last emitted one no longer matters
        key = (prev, pending, *live)
        found = self.ids.get(key, -1)
        if found < 0 and self.met.again(key):
            if len(self.keys) >= self.max_states:
                self.reset()
                number = -1
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
        if found >= 0 and number >= 0:
            self.moves[number << 8 | byte] = (found, emitted) if emitted else found
        return key, found, emitted

    def encode(self, data: bytes) -> list[int]:
        state, number, out, moves = _START, 0, [], self.moves
        for byte in data:
            if number >= 0:
                known = moves.get(number << 8 | byte)
                if known is not None:
                    if known.__class__ is int:
                        number = known
                    else:
                        number, emitted = known
                        out += emitted
                    continue
                state = self.keys[number]
            state, number, emitted = self.step(state, number, byte)
            moves = self.moves
            out += emitted
        out += (self.keys[number] if number >= 0 else state)[-1]
        return out


class _Table:
    """Values from 0 by distinct keys from 0 to below 2^62, looked up for whole arrays; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = _slots(keys, self.bits)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = _slots(keys, self.bits)
        there = self.keys[slot]
        same = there == keys
        out = np.where(same, self.values[slot], np.int32(-1))
        left = np.flatnonzero(~same & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            same = there == keys[left]
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (there >= 0)]
        return out


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Lockstep:
    """The transducer on many short pre-tokens at once, position by position, without building states.

    Of the tokens that end at a position, exactly one may stand behind the last token of the path that leads to its start.
    Two tokens may stand side by side if, while their merges at the border are undone from the last one on, no merge across
    the border would have come before the one undone; of equal ranks the left one comes first. usable tells whether merges
    make every token of two of lower rank, without which this does not hold. Tokens are numbered in the order of their ranks.
    """

    JOIN_BITS = 20

    def __init__(self, transducer: Transducer):
        ranks = transducer.ranks
        tokens = sorted(ranks, key=ranks.__getitem__)
        number = {b: k for k, b in enumerate(tokens)}
        left, right = (np.arange(len(tokens), dtype=np.int64) for _ in range(2))
        self.usable = all(b in number for b in _BYTE) and max(ranks.values()) < 1 << 32
        for b, k in number.items():
            if len(b) > 1 and self.usable:
                parts = transducer.merged(b, 2)
                left[k], right[k] = (number[x] for x in parts) if len(parts) == 2 else (k, k)
                self.usable = max(left[k], right[k]) < k
        if not self.usable:
            return
        made = np.flatnonzero(left != np.arange(len(tokens)))
        self.left, self.right = left, right
        self.merges = _Table(left[made] << 31 | right[made], made)
        self.ranks = np.array([ranks[b] for b in tokens], "<u4")
        self.length = np.array([len(b) for b in tokens], np.int32)
        # nodes: the bytes by value, then the longer prefixes and tokens
        nodes = {b: k for k, b in enumerate(_BYTE)}
        for b in sorted((transducer.prefixes | ranks.keys()) - nodes.keys(), key=len):
            nodes[b] = len(nodes)
        longer = [b for b in nodes if len(b) > 1]
        self.edges = _Table(np.array([nodes[b[:-1]] << 8 | b[-1] for b in longer], np.int64), np.array([nodes[b] for b in longer], np.int32))
        self.token = np.array([number.get(b, -1) for b in nodes], np.int32)
        self.inner = np.array([b in transducer.prefixes for b in nodes])
        self.joins = np.full(1 << self.JOIN_BITS, -1, np.int64)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges keep tokens a and b apart where they meet. A join is remembered until another takes its place."""
        keys = a.astype(np.int64) << 31 | b
        slot = _slots(keys, self.JOIN_BITS)
        found = self.joins[slot]
        out = (found & 1).astype(bool)
        new = np.flatnonzero(found >> 1 != keys)
        if len(new):
            out[new] = self._judge(a[new], b[new])
            self.joins[slot[new]] = keys[new] << 1 | out[new]
        return out

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), len(self.ranks), np.int64)
        while len(at):
            across = self.merges.get(a << 31 | b)
            keep = (across < 0) | (across >= limit)
            at, a, b = at[keep], a[keep], b[keep]
            inner_a, inner_b = self.right[a], self.left[b]
            whole_a, whole_b = inner_a == a, inner_b == b
            undo_a = ~whole_a & (whole_b | (a > b))
            limit = np.where(undo_a, a, b + 1)
            both = whole_a & whole_b
            out[at[both]] = True
            a, b = np.where(undo_a, inner_a, a), np.where(undo_a, b, inner_b)
            at, a, b, limit = at[~both], a[~both], b[~both], limit[~both]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each; no piece may be empty."""
        size = np.array([len(x) for x in pieces], np.int64)
        end = np.cumsum(size)
        first = end - size
        data, stop, start = np.frombuffer(b"".join(pieces), np.uint8), np.repeat(end, size), np.repeat(first, size)
        # all tokens in the pieces: where they start, where the last byte is, which
        at, node, found, depth = np.arange(len(data)), data.astype(np.int64), [], 0
        while len(at):
            token = self.token[node]
            own = np.flatnonzero(token >= 0)
            found.append((at[own], at[own] + depth, token[own]))
            depth += 1
            more = np.flatnonzero(self.inner[node] & (at + depth < stop[at]))
            at, node = at[more], self.edges.get(node[more] << 8 | data[at[more] + depth])
            more = np.flatnonzero(node >= 0)
            at, node = at[more], node[more].astype(np.int64)
        at, last, token = (np.concatenate(x) for x in zip(*found, strict=True))
        # the last token of the path up to each byte
        path = np.full(len(data), -1, np.int32)
        whole = at == start[at]
        path[last[whole]] = token[whole]
        at, last, token = at[~whole], last[~whole], token[~whole]
        position = (last - start[last]).astype(np.uint16)
        order = np.argsort(position, kind="stable")
        at, last, token = at[order], last[order], token[order]
        cuts = np.cumsum(np.bincount(position)).tolist()
        for i, j in zip([0, *cuts], cuts, strict=False):
            if i < j:
                before, here, what = path[at[i:j] - 1], last[i:j], token[i:j]
                good = np.flatnonzero(self.fits(before, what))
                path[here[good]] = what[good]
        if len(path) and path.min() < 0:
            raise ValueError("the ranks do not cover every byte or are no merge order")
        # back along the paths
        at, own, taken, count = end - 1, np.arange(len(pieces)), [], np.zeros(len(pieces), np.int64)
        while len(own):
            token = path[at]
            taken.append((own, token))
            count[own] += 1
            at = at - self.length[token]
            more = np.flatnonzero(at >= first[own])
            at, own = at[more], own[more]
        to = np.cumsum(count)
        ids = np.zeros(to[-1] if len(to) else 0, "<u4")
        for k, (own, token) in enumerate(taken):
            ids[to[own] - 1 - k] = self.ranks[token]
        packed, to = ids.tobytes(), (4 * to).tolist()
        return [packed[i:j] for i, j in zip([0, *to], to, strict=False)]


class Encoder:
    """Whole texts in, packed little-endian 32-bit ids out; frequent pre-tokens are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.lockstep = Lockstep(self.transducer)
        self.split = regex.compile(pattern).findall
        self.known = _Known(self.transducer)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out, i = [], 0
        while i < len(texts):
            j, chars = i + 1, len(texts[i])
            while j < len(texts) and (chars := chars + len(texts[j])) <= BATCH_CHARS:
                j += 1
            split = [self.split(x) for x in texts[i:j]]
            self._prepare(split)
            out += [b"".join(map(self.known.__getitem__, x)) for x in split]
            i = j
        self.known.fresh = {}
        return out

    def _prepare(self, split: list[list[str]]) -> None:
        """Encodes side by side what is short and not remembered."""
        known = self.known
        known.turn()
        if not self.lockstep.usable:
            return
        new = [x for x in filterfalse(known.old.__contains__, filterfalse(known.__contains__, set(chain.from_iterable(split)))) if 0 < len(x) <= MAX_PIECE_CHARS]
        if len(new) >= SIDE_LEAST:
            for i in range(0, len(new), SIDE_MOST):
                part = new[i : i + SIDE_MOST]
                known.fresh.update(zip(part, self.lockstep.encode([x.encode() for x in part]), strict=True))


class _Known(dict):
    """Ids of the pre-tokens that were met before: the later half, and in old those that were there when it began.
    fresh has those that the current texts brought. Nothing is forgotten while these are looked up."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.met, self.old, self.fresh = transducer, _Met(), {}, {}

    def turn(self) -> None:
        """Before other texts are looked up."""
        self.fresh = {}
        if len(self) >= MAX_PIECES // 2:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.fresh.get(piece)
            if ids is None:
                ids = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
            if len(piece) > MAX_PIECE_CHARS or not self.met.again(piece):
                return ids
        if len(self) < MAX_PIECES // 2:
            self[piece] = ids
        return ids


def _utf8_next(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """state: continuation bytes still due, and the range of the next one. None: byte does not fit here."""
    due, low, high = state
    if due:
        return (due - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


class Decoder:
    """Token ids in, text out, in pieces of any size: push() as ids come, flush() at the end."""

    _CLOSED = (0, 0, 0)

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: b for b, i in ranks.items()}
        self.whole = [None] * (max(self.tokens, default=-1) + 1)  # texts of the tokens that open and close by themselves
        for i, b in self.tokens.items():
            try:
                self.whole[i] = b.decode()
            except UnicodeDecodeError:
                pass
        self.memo: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.open = b""

    def _run(self, open_: bytes, token: int) -> tuple[str, bytes]:
        out, held, state = [], b"", self._CLOSED
        for byte in open_:
            state, held = _utf8_next(state, byte), held + bytes((byte,))
        for byte in self.tokens[token]:
            nxt = _utf8_next(state, byte)
            if nxt is None and held:
                out.append("�")
                held, nxt = b"", _utf8_next(self._CLOSED, byte)
            if nxt is None:
                out.append("�")
                held, state = b"", self._CLOSED
                continue
            state, held = nxt, held + bytes((byte,))
            if not state[0]:
                out.append(held.decode())
                held = b""
        return "".join(out), held

    def push(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        if not self.open:
            texts = list(map(self.whole.__getitem__, ids))
            if None not in texts:
                return "".join(texts)
        out, held, whole, memo = [], self.open, self.whole, self.memo
        for i in ids:
            if not held and (text := whole[i]) is not None:
                out.append(text)
                continue
            found = memo.get((held, i))
            if found is None:
                if len(memo) >= MAX_JOINS:
                    memo.clear()
                found = memo[held, i] = self._run(held, i)
            out.append(found[0])
            held = found[1]
        self.open = held
        return "".join(out)

    def flush(self) -> str:
        held, self.open = self.open, b""
        return "�" if held else ""


@lru_cache(1)
def _codec(ranks: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """A worker process keeps its states from task to task."""
    table = parse_ranks(ranks)
    return Encoder(table, pattern), Decoder(table)


CACHES["bpe"] = _codec.cache_clear


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(i, BATCH_ROWS)


def _with_columns(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.BinaryType() if n.endswith("ids") else T.StringType()) for n in names)])


def _mapped(df: DataFrame, text: str, ranks: bytes, pattern: str, names: tuple[str, ...], keep_text: bool = True) -> DataFrame:
    """names: the new columns for the packed ids and, if two, the text decoded from them."""
    df = df.drop(*set(names) - {text})
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file: its size is fixed
    schema = _with_columns(df if keep_text else df.drop(text), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy("bpe")
        encoder, decoder = _codec(shared.value, pattern)
        for big in batches:
            for batch in _batches(big):
                ids = encoder.encode_all([x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()])
                made = [pa.array(ids, pa.binary())]
                if len(names) > 1:
                    made.append(pa.array([decoder.push(np.frombuffer(x, "<u4").tolist()) + decoder.flush() for x in ids], pa.string()))
                own = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if keep_text or n != text]
                yield pa.RecordBatch.from_arrays([*own, *made], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the packed token ids of each whole text. ranks: the content of a ranks file; pattern: its pre-tokens."""
    return _mapped(df, text, ranks, pattern, (to,))


def round_trip(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", to: tuple[str, str] = ("ids", "decoded"), keep_text: bool = True) -> DataFrame:
    """Adds the packed token ids and the text that the decoder makes of them, in one pass over the rows."""
    return _mapped(df, text, ranks, pattern, to, keep_text)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of packed token ids; null ids give an empty text."""
    df = df.drop(to)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = _with_columns(df, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(parse_ranks(shared.value))
        for big in batches:
            for batch in _batches(big):
                packed = batch.column(batch.schema.get_field_index(ids)).to_pylist()
                texts = [decoder.push(np.frombuffer(x or b"", "<u4").tolist()) + decoder.flush() for x in packed]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
