"""Vector search, transcripts, components and the pipeline."""

import random

import numpy as np
from pyspark.sql import functions as F

from arborlex.llm import components, transcripts, vafile


def test_vafile(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    x[50:90] = x[50]  # equal vectors
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [1.0, 2.0]), (None, [1.0] * 8), (10, [float(v) for v in x[10]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vafile.top_k(df, df.where("vec_id % 20 = 0"), 10).collect()}
    ids = np.array([*range(300), 10])
    v = np.floor(np.vstack([x, x[10]]) * 1024).astype(np.int64)
    want = {}
    for q in range(0, 300, 20):
        s = v @ v[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:10]
        want |= {(q, k + 1): (int(ids[j]), int(s[j])) for k, j in enumerate(order)}
    assert got == want
    assert vafile.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert vafile.top_k(few, few).count() == 6


def test_bounds():
    rng = np.random.default_rng(2)
    for high in (3, 900, 1 << 40, 1 << 61):
        x = rng.integers(-high, high, (500, 6))
        cells = vafile.Approximation.of(x)
        q = rng.integers(-900, 900, (20, 6))
        exact = x.astype(object) @ q.T.astype(object)
        low, up = cells.bounds(q)
        assert all(low[j, i] <= exact[i, j] <= up[j, i] or abs(exact[i, j]) >= 1 << 63 for i in range(500) for j in range(20))
        reached = np.full((20, 10), -np.inf)
        place, row, _, _ = vafile.candidates(cells, np.arange(500), q, np.full(20, 7), reached)
        assert 7 not in row
        if high < 1 << 61:  # else half of the scores lie beyond the long range and are equal there
            assert len(row) < 20 * 100  # most exact vectors stay unread
        for j in range(20):
            best = sorted((i for i in range(500) if i != 7), key=lambda i: (-exact[i, j], i))[:10]
            assert set(best) <= set(row[place == j].tolist())


def test_vafile_hot_and_huge(spark):
    """One vector shared by thousands of rows, repeated ids, integers beyond 64 bits, and vectors of length 0."""
    rows = [(i, [0.5, 0.25]) for i in range(6000)] + [(3, [0.5, 0.25])] * 30 + [(7000, [1e300, -1.0]), (7001, [1e300, 1.0]), (8000, []), (8001, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3, "vec_id")
    out = {}
    for r in vafile.top_k(df, df.where("vec_id in (0, 3, 7000, 8000)"), 4).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    top, hot = (1 << 63) - 1, 512 * 512 + 256 * 256
    huge = [(7000, (1 << 61) * 512 - 1024 * 256), (7001, (1 << 61) * 512 + 1024 * 256)]
    assert all(s > top for _, s in huge)  # at the end of the long range
    assert out[0] == [(7000, top), (7001, top), (1, hot), (2, hot)]
    assert out[3] == [(7000, top), (7001, top), (0, hot), (1, hot)]
    assert out[7000] == [(0, top), (1, top), (2, top), (3, top)]
    assert out[8000] == [(8001, 0)]


def test_vafile_queries_share_a_vector(spark):
    """Hundreds of queries with one vector, more than a block keeps of candidates: each gets its k best."""
    rows = [(i, [0.5, 0.25]) for i in range(3000)] + [(9000, [0.5, 0.5]), (9001, [-0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2, "vec_id")
    out = {}
    for r in vafile.top_k(df, df.where("vec_id % 10 = 0"), 3).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hot, best = 512 * 512 + 256 * 256, 512 * 512 + 256 * 512
    want = {q: [(1, 9000, best), *((n, i, hot) for n, i in zip((2, 3), [i for i in (0, 1, 2) if i != q], strict=False))] for q in range(0, 3000, 10)}
    want[9000] = [(n, i, best) for n, i in ((1, 0), (2, 1), (3, 2))]
    assert out == want


def conversations(spark, marked=0.5):
    rng, rows = random.Random(7), []
    for c in range(120):
        turn = 0
        if c % 3 == 0:
            rows.append((c, turn, "system", "You answer briefly."))
            turn = 1
        for k in range(rng.randrange(2, 9)):
            role = "user" if k % 2 == 0 else "assistant"
            text = " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(3, 9) if role == "user" else rng.randrange(15, 60))) + ("?" if role == "user" else ".")
            if rng.random() < marked:
                text = {"user": "User: ", "assistant": "**Assistant:** "}[role] + text
            rows.append((c, turn, role, text))
            turn += 1
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_transcripts(spark, monkeypatch):
    df = conversations(spark)
    model = transcripts.fit(df.where("conv_id % 2 = 0"))
    out = transcripts.parse(df.drop("role").withColumn("place", F.lit(1)), model)
    both = out.where("part = 0").join(df.withColumnRenamed("role", "true"), ["conv_id", "turn"]).collect()
    assert len(both) == df.count() and sum(r["role"] == r["true"] for r in both) / len(both) > 0.95
    assert not any("User:" in r["rendered"] for r in both)
    plain = sorted(map(tuple, out.collect()))
    monkeypatch.setattr(transcripts, "BLOCK", 2)  # several levels of blocks
    assert sorted(map(tuple, transcripts.parse(df.drop("role"), model).collect())) == plain


def turns(spark, model, rows):
    out = transcripts.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).orderBy("conv_id", "turn", "part").collect()
    return [(r["conv_id"], r["role"], r["rendered"].split("\n", 1)[1].rsplit("\n<|end|>", 1)[0]) for r in out]


def test_markers_decide(spark):
    """The model saw one turn a row, no markers, and each conversation opened by the system."""
    rows = [(c, t, role, "w w w" + "?" * (role == "user")) for c in range(300) for t, role in enumerate(("system", "user", "assistant", "user", "assistant"))]
    model = transcripts.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    inner = [(1, 0, "User: one\nmore\nAssistant: two?\nUser: three\nAssistant: four")]
    assert turns(spark, model, inner) == [(1, "user", "one\nmore"), (1, "assistant", "two?"), (1, "user", "three"), (1, "assistant", "four")]
    apart = [(1, 0, "Assistant: one two three"), (1, 1, "User: why?"), (1, 2, "Assistant: because")]
    assert turns(spark, model, apart) == [(1, "assistant", "one two three"), (1, "user", "why?"), (1, "assistant", "because")]
    plain = [(1, 0, "w w w"), (1, 1, "w w w?\nw w"), (1, 2, "w w w")]
    assert [x[:2] for x in turns(spark, model, plain)] == [(1, "system"), (1, "user"), (1, "assistant")]


def test_counts_and_order(spark):
    """Transitions across partitions count once, and a conversation without turn numbers is cut into blocks by its rows."""
    df = conversations(spark, 0.0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = transcripts.fit(df.coalesce(1))
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        other = transcripts.fit(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert np.allclose(one.move, other.move) and all(np.allclose(x, y) for x, y in zip(one.show, other.show, strict=True))
    rows = [(5, None, f"User: {i:03d}\nAssistant: {i:03d}") for i in range(300)]
    found = turns(spark, one, rows)
    assert len(found) == 600 and sorted(x[2] for x in found) == sorted(f"{i:03d}" for i in range(300) for _ in range(2))
    clash = spark.createDataFrame([(1, 2, "User: x")], "conv_id long, turn long, text string").withColumn("role", F.lit("q")).withColumn("part", F.lit("q")).withColumn("rendered", F.lit(1))
    assert [(r["role"], r["part"]) for r in transcripts.parse(clash, one).collect()] == [("user", 0)]


def test_viterbi_against_every_path(spark):
    from itertools import product

    model = transcripts.fit(conversations(spark))
    rng = random.Random(9)
    for _ in range(25):
        lines = [x for text in (rng.choice(["User: a b", "w w w w w w w w w w w w w", "why?\nAssistant: no", "a\nb"]) for _ in range(2)) for x in transcripts._lines(text)]
        steps = [model.move + e for e in model.emissions([v for v, _, _ in lines])]
        score = lambda path: sum(m[i, j] for m, i, j in zip(steps, (transcripts.START, *path[:-1]), path, strict=True))  # noqa: B023, E731
        best = max(map(score, product(range(transcripts.STATES), repeat=len(steps))))
        whole = steps[0]
        for m in steps[1:]:
            whole = transcripts._times(whole, m)
        end = int(whole[transcripts.START].argmax())
        assert np.isclose(whole[transcripts.START, end], best) and np.isclose(score(transcripts._path(steps, transcripts.START, end)), best)


def test_transcripts_odd_rows(spark):
    model = transcripts.fit(conversations(spark))
    rows = [(None, None, None), (None, 3, ""), (1, 0, "a\nb"), (1, 0, "a\nb"), (2, 5, "User: hi?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    assert transcripts.parse(df, model).where("part = 0").count() == 5
    assert transcripts.parse(df.limit(0), model).count() == 0
    assert transcripts.fit(df.withColumn("role", F.lit("other"))).move.shape == (transcripts.STATES, transcripts.STATES)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (102, 102), (200, 7)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in [*range(61), 200]) and out[101] == 100 and 102 not in out
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """Two written tables for a small graph; a larger one is contracted first, with the same result."""
    rng, written, write = random.Random(5), [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df: written.append(df) or write(df))
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1040)] + [(rng.randrange(2000, 2150), rng.randrange(2000, 2150)) for _ in range(90)] + [(7, 7), (1, 0)]
    edges = [(a, b) for a, b in edges if a != b or a < 2000]
    want = {x: x for a, b in edges if a != b for x in (a, b)}
    for _ in range(len(want)):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == want
    assert len(written) <= 2
    for few in (20, 0):
        monkeypatch.setattr(components, "FEW", few)
        assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == want
    assert len(written) > 10
