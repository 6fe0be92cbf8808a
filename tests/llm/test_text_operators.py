"""The training-data operators against brute force on small fixtures, with nulls, empties, ties and repeats."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from arborlex.llm import bpe, bwt, core, crossentropy, licences, minhash, mixing, quality, queries, repeats, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    base = [" ".join(word() for _ in range(n)) for n in (60, 80, 200)]
    texts = [None, "", " \n\t", "one", "One", "one two", "a b c", "A  b\nc", "x" * 150, "x" * 300, "ééé ß Straße 東京 \U0001f600"]
    for b in base:
        texts += [b, b, b + " tail", word() + " " + b[: len(b) // 2], b.replace(" a", " b", 1)]
    texts += ["line one here\nline one here\n" + word() for _ in range(5)] + [" ".join(["hot"] * 30), " ".join(word() for _ in range(3000))]
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_tiktoken(docs, empty):
    ranks = bpe.parse_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    clash = docs.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    out = {r["doc_id"]: r for r in bpe.round_trip(clash, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in pairs(docs):
        assert np.frombuffer(bytes(out[i]["ids"]), "<u4").tolist() == enc.encode_ordinary(t or "")
        assert out[i]["decoded"] == (t or "")
    assert bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_fuzz():
    ranks = bpe.parse_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e, d, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks), random.Random(1)
    e.transducer.max_states = 500  # states are forgotten on the way
    for _ in range(3000):
        x = "".join(rng.choice([chr(rng.randrange(1, 0x250)), chr(rng.randrange(1, 0x3000)), rng.choice(" \n\t\x1c\x85　ab'"), rng.choice(["the", "ing", "    ", "aaaa"])]) for _ in range(rng.randrange(14)))
        assert np.frombuffer(e.encode(x), "<u4").tolist() == enc.encode_ordinary(x)
        ids = [rng.randrange(256) if rng.random() < 0.5 else rng.randrange(50256) for _ in range(rng.randrange(8))]
        assert d.push(ids[:3]) + d.push(ids[3:]) + d.flush() == enc.decode(ids)


def test_bpe_side_by_side(monkeypatch):
    """Short pre-tokens that occur once build no states, and their ids are those of the transducer and of tiktoken."""
    ranks = bpe.parse_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e, rng, steps = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(3), []
    step = bpe.Transducer.step
    monkeypatch.setattr(bpe.Transducer, "step", lambda *a: steps.append(1) or step(*a))
    parts = ["th", "er", "ing", "é", "ß", "東", "京", "\U0001f600", "a", "aa", "q", "z", "ción", "7", "--", "'s", " ", "  ", "\n"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)) for _ in range(12)]
    assert [np.frombuffer(e.encode(x), "<u4").tolist() for x in texts] == [enc.encode_ordinary(x) for x in texts]
    assert not steps
    pieces = sorted({p.encode() for x in texts for p in e.split(x)})
    assert [np.frombuffer(x, "<u4").tolist() for x in e.lockstep.encode(pieces)] == [e.transducer.encode(x) for x in pieces]


def test_bpe_joins_and_odd_ranks():
    """Joins judged by undoing merges are those of merging; ranks with a token that no merge makes run one by one."""
    ranks = bpe.parse_ranks(RANKS)
    t, rng = bpe.Transducer(ranks), random.Random(5)
    side = bpe.Lockstep(t)
    tokens = sorted(ranks, key=ranks.get)
    near = [b for b in tokens if len(b) < 5 and set(b) <= set(b"aehinrt ")]
    a, b = ([rng.choice(near if k % 2 else tokens) for k in range(6000)] for _ in range(2))
    number = {x: k for k, x in enumerate(tokens)}
    found = [side.fits(np.array([number[x] for x in a]), np.array([number[x] for x in b])).tolist() for _ in range(2)]
    want = [t.merged(x + y) == [x, y] for x, y in zip(a, b, strict=True)]
    assert found == [want, want] and {True, False} == set(want)
    odd = {bytes((i,)): 2 * i + 1 for i in range(256)} | {b"ab": 1000, b"abab": 2000, b"xyz": 3000}
    words = ["".join(rng.choice("abxzé") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    for own in (odd, {b: i for b, i in odd.items() if b != b"xyz"}):
        e = bpe.Encoder(own, r"\S+|\s+")
        assert e.lockstep.usable == (b"xyz" not in own)
        want = [i for p in e.split(" ".join(words)) for i in bpe.Transducer(own).encode(p.encode())]
        assert np.frombuffer(e.encode(" ".join(words)), "<u4").tolist() == want
    assert bpe.Encoder(ranks, r"\S+|\s+").encode("") == b""


def test_mixing(spark, docs, empty):
    clash = docs.withColumn("size", F.lit("x"))
    out = mixing.mix(clash, (3.0, 1.0, 2.0)).collect()
    assert len(out) == docs.count()
    again = mixing.mix(docs, (3.0, 1.0, 2.0)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)
    sizes, by = {i: len(WORD.findall(t or "")) for i, t in pairs(docs)}, defaultdict(list)
    for r in out:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    total = sum(sizes.values())
    weights = dict(zip(["s1", "s2", None], (3.0, 1.0, 2.0), strict=True))
    own = {s: sum(r["size"] for r in v) for s, v in by.items()}
    left, target, open_ = 1.5 * total, {}, set(own)
    while open_:  # share by weight, stop at twice the size, share the excess again
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * own[s]}
        if not full:
            target |= {s: level * weights[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * own[s]
            left -= target[s]
        open_ -= full
    for s, v in by.items():
        assert v[0]["source_size"] == own[s] and v[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in v) - target[s]) <= max(r["size"] for r in v) / 2
    assert mixing.mix(empty, (1.0,)).count() == 0
    twice = docs.unionByName(docs)
    assert mixing.mix(twice, (1.0, 2.0)).count() == 2 * docs.count()


def test_mixing_without_ids(spark):
    """Rows without id are drawn apart, not all or none of them; the result does not depend on partitions."""
    df = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    out = sorted((r["text"], r["copies"]) for r in mixing.mix(df, (1.0,), 0.5).collect())
    assert sum(c for _, c in out) == 200
    assert sorted((r["text"], r["copies"]) for r in mixing.mix(df.repartition(5), (1.0,), 0.5).collect()) == out


def test_long_text_of_notices():
    """Hundreds of repeated notices in one text: spans stay disjoint and each notice is found."""
    text = licences.TEMPLATES[0][1]
    scanner = licences.Scanner()
    found = scanner.scan(licences.tokens([" zzz ".join([text] * 300)])[0])
    own = sorted((x["first"], x["end"]) for x in found["spans"] if x["label"] == licences.TEMPLATES[0][0])
    assert len(own) >= 300 and all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


def test_mixing_prefers_importance(spark):
    rows = [(i, "w w w w", "s", 9.0 if i % 2 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    out = mixing.mix(df, (1.0,), 0.25, importance="q").collect()
    taken = [sum(r["taken"] for r in out if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert abs(sum(taken) - 400) <= 4 and taken[1] > 4 * taken[0]


def quality_row(t, df, limit):
    w = WORD.findall(t)
    seen, dup, removed = set(), 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
            if df[normal(line)] > limit:
                removed += len(WORD.findall(line))
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    left = len(w) - removed
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), removed, failed, not failed and left >= 10 and left >= 0.5 * len(w))


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", lower(line)).strip(" ")


def test_quality(docs, empty):
    df = docs.withColumn("n_words", F.lit("clash"))
    out = {r["doc_id"]: tuple(r)[1:] for r in quality.line_frequency(df, max_docs=2).collect()}
    hosts = defaultdict(lambda: defaultdict(set))
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]
    for i, t, s in rows:
        for line in t.split("\n"):
            if WORD.search(line):
                hosts[s][normal(line)].add(i)
    for i, t, s in rows:
        assert out[i] == quality_row(t, defaultdict(int, {k: len(v) for k, v in hosts[s].items()}), 2), (i, t)
    assert quality.line_frequency(empty).count() == 0


def test_crossentropy(docs, empty):
    import math

    marked = docs.withColumn("target", F.col("doc_id") % 4 == 0).withColumn("score", F.lit("clash"))
    out = {r["doc_id"]: r for r in crossentropy.score(marked, "target").collect()}
    toks = {i: WORD.findall(lower(t or "")) for i, t in pairs(docs)}
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in toks.items():
        for k in (0, 1) if i % 4 == 0 else (1,):
            uni[k].update(w)
            bi[k].update(zip(w, w[1:], strict=False))
    vocabulary = {w for w, n in uni[1].items() if n >= 2}
    size = [sum(c.values()) for c in uni]
    unknown = [size[k] - sum(uni[k][w] for w in vocabulary) for k in (0, 1)]
    for i, w in toks.items():
        if not w:
            assert out[i]["score"] is None and out[i]["n_tokens"] == 0
            continue
        loss = [0.0, 0.0]
        for k in (0, 1):
            for j, x in enumerate(w):
                p = ((uni[k][x] if x in vocabulary else unknown[k]) + crossentropy.DELTA) / (size[k] + crossentropy.DELTA * (len(vocabulary) + 1))
                if j and x in vocabulary and w[j - 1] in vocabulary:
                    p = (bi[k][w[j - 1], x] + crossentropy.MU * p) / (uni[k][w[j - 1]] + crossentropy.MU)
                loss[k] -= math.log(p) / len(w)
        assert out[i]["score"] == pytest.approx(loss[0] - loss[1], abs=1e-9)
    assert crossentropy.score(empty.withColumn("target", F.lit(True)), "target").count() == 0


def test_bwt_merge():
    rng = np.random.default_rng(0)
    for _ in range(40):
        step = int(rng.choice([1, 2, 4]))
        depth, shards, suffixes = step * int(rng.integers(1, 4)), [], []
        for _ in range(rng.integers(1, 5)):
            lens = rng.integers(1, 30, size=rng.integers(1, 6))
            sym = bwt.symbols(rng.integers(97, 99, size=lens.sum()).astype(np.uint8), lens)
            shards.append(bwt.build(sym, step))
            text = sym.tolist()
            suffixes += [bytes(text[p : text.index(0, p)]) for p in shards[-1].sa]
        rows, interval = bwt.merge(shards, depth, step)
        found = [suffixes[r][:depth] for r in rows]
        assert sorted(rows) == [i for i, s in enumerate(suffixes) if len(s) >= depth] and found == sorted(found)
        assert all((a == b) == (x == y) for a, b, x, y in zip(found, found[1:], interval, interval[1:], strict=False))


def cut(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (bytes(c for c, g in zip(b, gone, strict=True) if not g), len(b), sum(gone), spans)
    return out


def test_repeats(docs, empty):
    want = cut(sorted(pairs(docs)), 100)
    clash = docs.withColumn("kept", F.lit(1))
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(clash, 100).collect()}
    assert got == want and sum(w[2] for w in want.values()) > 0
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_across_shards(docs, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 500)
    want = cut(sorted(pairs(docs)), 100)
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs.repartition(3), 100).collect()}
    assert got == {i: w[2] for i, w in want.items()}


def test_repeats_of_a_hot_passage(spark, monkeypatch):
    """A passage that most documents hold in other surroundings, periodic texts, and rows that share an id."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    monkeypatch.setattr(repeats, "_INDEX", 2000)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, rows = noise(260), []
    for i in range(120):
        text = noise(rng.randrange(200)) + (hot[rng.randrange(60) : 260 - rng.randrange(60)] if i % 4 else "") + noise(rng.randrange(200))
        rows.append((i, "ab" * rng.randrange(40, 120) if i % 15 == 0 else text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(df).collect()}
    assert got == cut(rows, 100)
    same = spark.createDataFrame([(7, hot), (7, hot), (None, hot), (None, None)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in repeats.remove_repeats(same).collect()) == [0, 0, 260, 260]


def test_repeats_as_text(spark):
    """A cut inside a character takes that character; replacement characters of the input stay."""
    twice = "".join(chr(0x4E00 + i) for i in range(40))
    rows = [(1, "\ufffd " + twice + "\u6f22"), (2, "keep \ufffd this " + twice + "\u6f23 \ufffd"), (3, None), (4, "\ufffd")]
    out = {r["doc_id"]: (r["kept"], r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect()}
    want = cut(rows, 100)
    assert out[1] == (rows[0][1], 0) and out[3] == ("", 0) and out[4] == ("\ufffd", 0)
    assert out[2] == ("keep \ufffd this \ufffd", 123) and want[2][2] == 123  # a space, 40 characters, two bytes of the last


def components(rows, width, percent):
    def shingles(t):
        w = WORD.findall(lower(t or ""))
        return frozenset([tuple(w)] if w and len(w) < width else zip(*(w[k:] for k in range(width)), strict=False))

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, width, percent):
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(docs.withColumn("component", F.lit(1)), width, percent).collect()}
    assert got == components(pairs(docs), width, percent)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_without_pivots(spark, monkeypatch):
    """Groups near the threshold, left to the block comparison."""
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng, texts = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for _ in range(3):
        base = [word() for _ in range(90)]
        for _ in range(30):
            x = list(base)
            for _ in range(rng.randrange(0, 4)):
                x[rng.randrange(len(x))] = word()
            texts.append(" ".join(x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == components(list(enumerate(texts)), 3, 85)


def test_blocks_count_shingles_together(monkeypatch):
    """A block compares no pair of texts by itself, and links the same components as pair by pair."""
    rng, texts = random.Random(8), ["", "w", "w x", "W  x", "w x y", "w x y w x y"]
    base = [f"w{rng.randrange(40)}" for _ in range(60)]
    for _ in range(60):
        x = list(base)
        for _ in range(rng.randrange(0, 7)):
            x[rng.randrange(len(x))] = f"é{rng.randrange(9)}"
        texts.append(" ".join(x))
    one = [np.frombuffer(x.encode(), np.uint8) for x in texts]
    n, sig = len(texts), np.zeros((len(texts), minhash.BANDS * minhash.ROWS), np.uint32)
    alike = minhash.alike

    def joined(links, side):
        own = list(range(n))
        for a, b in links:
            assert alike(one[a], one[b], 3, 85) and (side[a] < side[b] or not side.any())
            own = [own[a] if x == own[b] else x for x in own]
        return sorted(min(j for j in range(n) if own[j] == own[i]) for i in range(n))

    for side in (np.zeros(n, np.int64), np.arange(n) % 2):
        want = [(a, b) for a in range(n) for b in range(n) if (side[a] < side[b] or not side.any() and a < b) and alike(one[a], one[b], 3, 85)]
        assert 40 < len(want) < n * n // 4
        asked = []
        monkeypatch.setattr(minhash, "alike", lambda x, y, *a: asked.append(min(len(bytes(t).split()) for t in (x, y))) or alike(x, y, *a))  # noqa: B023
        for columns in (7, 1 << 12):
            monkeypatch.setattr(minhash, "_COLUMNS", columns)
            got = minhash._linked(np.arange(n), np.arange(n), side, sig, one, 3, 85)
            assert joined(got, side) == joined(want, side)
        assert all(k < 3 for k in asked)  # only texts without a whole shingle
        monkeypatch.setattr(minhash, "TOGETHER", 0)
        assert joined(minhash._linked(np.arange(n), np.arange(n), side, sig, one, 3, 85), side) == joined(want, side)
        monkeypatch.setattr(minhash, "TOGETHER", 1 << 21)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "q")], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(df, 3, 85).collect())
    assert out == [(-1, -1, False), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_crossentropy_without_own(docs, empty):
    """Each document against models that are counted anew over all others."""
    import math

    marked = docs.withColumn("target", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 == 1))
    out = {r["doc_id"]: r for r in crossentropy.score(marked, "target", without_own=True).collect()}
    toks = {i: WORD.findall(lower(t or "")) for i, t in pairs(docs)}
    n = Counter(x for w in toks.values() for x in w)
    vocabulary = {x for x in n if n[x] >= 2}
    for i, w in toks.items():
        if not w:
            assert out[i]["score"] is None and out[i]["n_tokens"] == 0
            continue
        for column, held in (("target_loss", lambda j: j % 3 == 1), ("background_loss", lambda j: True)):
            others = [v for j, v in toks.items() if j != i and held(j)]
            uni, bi = Counter(x for v in others for x in v), Counter(g for v in others for g in zip(v, v[1:], strict=False))
            size, unknown, loss = sum(uni.values()), sum(c for x, c in uni.items() if x not in vocabulary), 0.0
            for j, x in enumerate(w):
                p = ((uni[x] if x in vocabulary else unknown) + crossentropy.DELTA) / (size + crossentropy.DELTA * (len(vocabulary) + 1))
                if j and x in vocabulary and w[j - 1] in vocabulary:
                    p = (bi[w[j - 1], x] + crossentropy.MU * p) / (uni[w[j - 1]] + crossentropy.MU)
                loss -= math.log(p) / len(w)
            assert out[i][column] == pytest.approx(loss, abs=1e-9)
    assert crossentropy.score(empty.withColumn("target", F.lit(True)), "target", without_own=True).count() == 0


def thue_morse(n):
    """A word and its complement, which every polynomial hash modulo 2^64 confuses from some length on."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 65, 1024, 4096])
def test_equality_of_words(spark, n):
    from arborlex.llm.core import words

    x, y = thue_morse(n)
    h = words(np.frombuffer(f"{x} {y} {x} {x}c".encode(), np.uint8), np.array([0, 4 * n + 4]))[0]
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    df = spark.createDataFrame([(1, x), (2, y), (3, x + " tail"), (4, x)], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(df, 3, 85).collect()) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 3, True), (4, 1, 1, False)]
    scored = {r["doc_id"]: r["score"] for r in crossentropy.score(df.withColumn("target", F.col("doc_id") != 2), "target").collect()}
    assert scored[1] == scored[4] != scored[2]


def test_alike():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randrange(1, 3)))
    for _ in range(300):
        width, base = rng.choice([1, 3, 5]), [word() for _ in range(rng.randrange(1, 14))]
        other = [w if rng.random() < 0.9 else word() for w in base]
        x, y = " ".join(base), " \n".join(other).swapcase()
        want = components([(1, x), (2, y)], width, 60)[2][1] == 1
        assert minhash.alike(np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8), width, 60) == want


def test_bayes_bound():
    for n, least in minhash.least_matches(0.85):
        assert 0 < least < n
        tail = lambda m: sum(__import__("math").comb(n + 1, k) * 0.85**k * 0.15 ** (n + 1 - k) for k in range(m + 1))  # noqa: B023, E731
        assert tail(least - 1) < minhash.MISS <= tail(least)


def test_automaton():
    rng = random.Random(5)
    for _ in range(200):
        strings = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        a, x = licences.Automaton(strings), [rng.randrange(4) for _ in range(15)]
        longest = [max([n for n in range(1, i + 2) if any(x[i + 1 - n : i + 1] == s[k : k + n] for s in strings for k in range(len(s)))], default=0) for i in range(15)]
        want = [(i + 1, longest[i]) for i in range(15) if longest[i] and (i == 14 or longest[i + 1] <= longest[i])]
        assert [(e, n) for e, n, _ in a.matches(x)] == want
        for e, n, state in a.matches(x):
            assert a.ends[state] == {(t, k + n) for t, s in enumerate(strings) for k in range(len(s) - n + 1) if s[k : k + n] == x[e - n : e]}


def test_licences(spark, empty):
    mit = dict(licences.TEMPLATES)["mit"]
    rows = [(1, None), (2, ""), (3, "The MIT License, twice: mit-license"), (4, "intro " + licences.TEMPLATES[0][1] + " end"), (5, "GNU General Public License"), (6, licences.TEMPLATES[9][1].replace("binary", "BINARY").replace("source code", "Quellcode")), (7, "the of and to in is this software")]
    out = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    assert (out[1]["n_words"], out[1]["n_base"], out[1]["first_word"], out[1]["labels"], out[1]["score"]) == (0, 0, None, "", 0.0)
    assert (out[3]["n_base"], out[3]["first_word"], out[3]["last_word"], out[3]["base_labels"]) == (2, 1, 4, "mit")
    assert out[4]["labels"] == "mit" and out[4]["base_labels"] == "" and out[4]["score"] == 1.0 and mit
    assert out[4]["spans"][0]["first"] == 1
    assert out[5]["base_labels"] == "gpl" and out[6]["labels"] == "bsd" and 0.6 <= out[6]["score"] <= 1 and out[7]["labels"] == ""
    assert licences.scan(empty).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randrange(2, 8)))
    bad, rows, labels = ["vileword", "nastything"], [], []
    for i in range(900):
        w = [word() for _ in range(60)]
        if i % 3 == 0:
            for _ in range(6):
                w[rng.randrange(60)] = rng.choice(bad) + (rng.choice("xyz") if i >= 700 else "")  # misspelt in the test part
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:700], "doc_id long, label int"))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs.withColumn("score", F.lit("x")), model).collect()}
    right = [(out[i] >= 0.5) == (y == 1) for i, y in labels[700:]]
    assert sum(right) / len(right) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {1 / (1 + np.exp(-model.bias))}
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, label int")).bias < -5


def test_held_out(spark):
    import zlib

    got = {r["doc_id"]: r["h"] for r in spark.range(300).withColumnRenamed("id", "doc_id").select("doc_id", queries.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)}


def test_digests(spark, sf):
    r = queries.op6_repeats(spark, sf).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == r["doc_id"]).first()["text"]
    assert r["n_bytes"] == len(text.encode()) and (r["n_removed"] or r["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest())


def moved(spark, run):
    """Bytes that run's shuffles wrote."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    run()
    time.sleep(1)  # the store hears of the last tasks a little later
    return written() - before


@pytest.fixture
def texts_unlike(spark, tmp_path):
    """3,000 texts of 5 KB each, hardly compressible; the last 20 are near copies of others."""
    rng = random.Random(3)
    texts = [" ".join("%x" % rng.getrandbits(60) for _ in range(320)) for _ in range(2980)]
    texts += [x + " end" for x in texts[:20]]
    spark.createDataFrame([(i, x, "ab"[i % 2]) for i, x in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/texts")
    return spark.read.parquet(f"{tmp_path}/texts"), sum(map(len, texts))


@pytest.fixture
def small_broadcasts(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "24k")
    yield
    spark.conf.set(name, before)


def test_near_duplicates_move_few_texts(spark, texts_unlike, small_broadcasts):
    """Only texts that share a band with another, and their signatures, are dealt out."""
    df, size = texts_unlike
    out = []
    assert moved(spark, lambda: out.extend(minhash.near_duplicates(df, 3, 85).collect())) < size / 2
    assert sorted(r["doc_id"] for r in out if not r["kept"]) == list(range(2980, 3000))


def test_mixing_moves_no_text(spark, texts_unlike, small_broadcasts, tmp_path):
    """A text's copies follow from its source's limits; it is not dealt out to meet a plan with a row per text."""
    df, size = texts_unlike
    assert moved(spark, lambda: mixing.mix(df, (3.0, 1.0), 0.7).write.parquet(f"{tmp_path}/out")) < size / 4
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert len(own) == 1500 and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 161


def test_mixing_takes_equal_rows_together(spark):
    rows = [(i % 150, "w " * (i % 150 % 7), "s") for i in range(450)] + [(i, "w w w", "s") for i in range(150, 300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1.0,), 0.4).collect()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r["copies"])
    assert all(len(v) == (3 if i < 150 else 1) and len(set(v)) == 1 for i, v in by.items())
    assert abs(sum(r["taken"] for r in out) - out[0]["target"]) <= 9


def test_filter_keeps_all_keys(spark):
    rows = spark.range(-20000, 20000).withColumn("x", F.lit("y")).unionByName(spark.createDataFrame([(None, "z")], "id long, x string"))
    for keys in (spark.range(0, 1000).withColumnRenamed("id", "k"), spark.range(0).withColumnRenamed("id", "k")):
        n = keys.count()
        out = core.filtered(rows, "id", keys)
        assert out.columns == rows.columns
        assert out.join(keys, out["id"] == keys["k"], "left_semi").count() == n and out.count() <= n + 0.1 * 40000 * (n > 0)
