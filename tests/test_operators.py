"""Literal cases on small inline tables."""

import pytest
from pyspark.sql import functions as F

from arborlex.functions import text as X
from arborlex.operators import bm25, dense, evidence, fusion, governance, graph, metrics, parsing, passages, routing, selection, tree, validate
from arborlex.sources import files

NODES = "document_id string, node_id string, parent_id string, type string, ordinal long, key int, text string"


@pytest.fixture(scope="module")
def small(spark):
    rows = [("d", "d", None, "document", 0, None, ""), ("d", "a1", "d", "article", 1, 1, "Heading one"), ("d", "c1", "a1", "clause", 2, 1, "clause text"), ("d", "p1", "c1", "point", 3, 1, "point text"), ("d", "a2", "d", "article", 4, 2, "Heading two")]
    return spark.createDataFrame(rows, NODES)


def one(df, c):
    return df.select(c).first()[0]


def test_tokens(spark):
    df = spark.createDataFrame([("  ĐƯỜNG-bộ, đường  ",)], "t string")
    assert one(df, X.tokens(F.col("t"))) == ["đường", "bộ", "đường"]


def test_nfc(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string")
    assert [r[0] for r in df.select(X.nfc("t")).collect()] == ["é", None]


def test_normalize(spark):
    df = spark.createDataFrame([("  a  b­ \n\n c\t d ",)], "t string")
    assert one(df, X.normalize_text("t")) == "a b c d"
    assert one(spark.createDataFrame([("Trang 12 / 340",)], "t string"), X.frequency_key(F.col("t"))) == "trang # / #"


def test_bm25_tie_and_zero(spark):
    p = spark.createDataFrame([("p2", "xe máy"), ("p1", "xe máy"), ("p3", "nhà")], "passage_id string, text string")
    q = spark.createDataFrame([("q", "xe"), ("z", "không")], "query_id string, query string")
    rows = bm25.search(p, q, 3).orderBy("query_id", "rank").collect()
    assert [r["passage_id"] for r in rows] == ["p1", "p2", "p3", "p1", "p2", "p3"]
    assert [r["score"] for r in rows][2:] == [0.0] * 4


@pytest.mark.parametrize("text, kind, key", [("Chương IV", "chapter", "IV"), ("Mục 2", "section", "2"), ("Điều 10. Phạm vi", "article", "10"), ("12. Nội dung", "clause", "12"), ("đ) Nội dung", "point", "đ"), ("Đ) Nội dung", "point", "đ"), ("1.000.000 đồng", None, None), ("35/2024/QH15", None, None), ("Điều này không có số", None, None)])
def test_markers(spark, text, kind, key):
    m = one(spark.createDataFrame([(text,)], "t string"), parsing.marker(F.col("t")))
    assert (m and (m["kind"], m["key"])) == (kind and (kind, key))


def test_bold_share(spark):
    df = spark.sql("select array(named_struct('text', 'abc', 'font', 'X-Bold', 'flags', 0), named_struct('text', 'a', 'font', 'X', 'flags', 0)) as s")
    assert one(df, parsing.bold_share(F.col("s"))) == 0.75


def test_hierarchy(spark):
    m = [("d", 1, "chapter", "I"), ("d", 2, "article", "10"), ("d", 3, "clause", "2"), ("d", 4, "point", "đ"), ("d", 5, "section", "1"), ("d", 6, "clause", "9"), ("d", 7, "chapter", "II"), ("d", 8, "point", "a")]
    rows = parsing.hierarchy(spark.createDataFrame(m, "document_id string, position long, kind string, key string")).orderBy("position").collect()
    assert (rows[3]["chapter"], rows[3]["article"], rows[3]["clause"], rows[3]["point"], rows[3]["parent_position"]) == ("I", "10", "2", "đ", 3)
    assert rows[5]["orphan"] and rows[5]["article"] is None
    assert rows[7]["orphan"] and rows[7]["chapter"] == "II" and not rows[1]["orphan"]


def test_tree(spark, small):
    assert {r[0] for r in tree.leaf_targets(small).select("node_id").collect()} == {"p1", "a2"}
    assert {r["node_id"]: r["ancestor_ids"] for r in tree.ancestors(small).collect()}["p1"] == ["c1", "a1", "d"]
    assert {r["node_id"]: r["descendant_ids"] for r in tree.descendants(small).collect()}["d"] == ["a1", "c1", "p1", "a2"]
    assert tree.violations(small).count() == 0
    bad = small.unionByName(spark.createDataFrame([("d", "x", "nowhere", "clause", 9, 1, ""), ("d", "a1", "d", "article", 9, 3, ""), ("d", "y", "a1", "point", 10, 1, ""), ("d", "u", "w", "clause", 11, 1, ""), ("d", "w", "u", "article", 12, 1, "")], NODES))
    codes = {(r["node_id"], r["code"]) for r in tree.violations(bad).collect()}
    assert {("x", "DANGLING_PARENT"), ("a1", "DUPLICATE_NODE_ID"), ("y", "WRONG_PARENT_TYPE"), ("u", "UNREACHABLE"), ("w", "UNREACHABLE")} <= codes


def test_passages(spark, small):
    two = lambda df: {r["primary_id"]: r["text"] for r in df.collect()}
    assert two(passages.articles(small)) == {"a1": "Heading one\nclause text\npoint text", "a2": "Heading two"}
    assert set(two(passages.clauses(small))) == {"c1", "a2"}
    assert two(passages.leaves_in_context(small, "B4"))["p1"] == "Heading one\nclause text\npoint text"
    titles = spark.createDataFrame([("d", "Luật thử")], "document_id string, title string")
    assert two(passages.leaves_in_context(small, "B4e", titles)) == {"p1": "Luật thử\nHeading one\nclause text\npoint text", "a2": "Luật thử\nHeading two"}
    assert two(passages.leaves_in_context(small, "B4c"))["p1"] == "clause text\npoint text"
    targets = spark.createDataFrame([("d", "p1")], "document_id string, node_id string")
    assert evidence.expand(small, targets).first()["evidence"] == "Heading one\nclause text\npoint text"


def test_windows(spark):
    df = spark.createDataFrame([("d", "a b c d e f g"), ("e", "a b"), ("f", "")], "id string, t string")
    rows = passages.fixed_windows(df, "id", "t", 4, 1).orderBy("document_id", "window_no").collect()
    assert [(r["document_id"], r["passage"]) for r in rows] == [("d", "a b c d"), ("d", "d e f g"), ("e", "a b")]


def test_fusion_caps(spark):
    a = spark.createDataFrame([("q", i, f"A{i}") for i in range(1, 4)], "query_id string, rank int, article_id string")
    fine = spark.createDataFrame([(f"P{i}{j}", f"P{i}{j}", f"A{i}") for i in range(1, 4) for j in range(1, 6)], "id string, primary_id string, article_id string")
    g = spark.createDataFrame([("q", 5 * (i - 1) + j, f"P{i}{j}") for i in range(1, 4) for j in range(1, 6)], "query_id string, rank int, id string")
    leaves = spark.createDataFrame([("q", i, j, f"P{i}{j}", f"A{i}") for i in range(1, 4) for j in range(1, 4)], "query_id string, group_rank int, local_rank int, id string, article_id string")
    rows = fusion.hybrid(a, g, leaves, fine).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and all(r["complete"] for r in rows)
    assert sum(r["source"] == "article" for r in rows[:5]) <= 1 and sum(r["source"] == "article" for r in rows) <= 2
    per = [r["passage_id"][1] for r in rows if r["source"] == "fine"]
    assert max(map(per.count, per)) <= 3
    assert one(spark.range(1), fusion.rrf(F.lit(1), 1.0, 60)) == pytest.approx(1 / 61)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 1.0]), (4, [float("nan"), 0.0]), (5, None)], "vec_id int, embedding array<double>")
    assert {r["vec_id"]: r["code"] for r in dense.vector_issues(df, 2).collect()} == {2: "WRONG_SHAPE", 3: "NOT_UNIT", 4: "NOT_FINITE", 5: "WRONG_SHAPE"}


def test_redundancy_and_metrics(spark):
    c = spark.createDataFrame([("q", "same", 3), ("q", "a", 2), ("q", "same", 3), ("q", "c", 2)], "query_id string, hash string, tokens int")
    r = metrics.redundancy(c, ["query_id"]).first()
    assert (r["total"], r["unique_tokens"], r["ratio"]) == (10, 7, 0.3)
    q = spark.createDataFrame([("q", ["n1"])], "query_id string, required_ids array<string>")
    rows = spark.createDataFrame([("q", 1, True, ["n1"], 4)], "query_id string, rank int, exact_hit boolean, included array<string>, evidence_tokens int")
    m = {r["k"]: r for r in metrics.aggregate(q, rows).collect()}
    assert m[1]["recall"] == m[1]["mrr"] == m[1]["evidence_coverage"] == 1.0


def test_structural_gold(spark, small):
    hits = spark.createDataFrame([("q", "d", "a1"), ("q", "d", "c1"), ("q", "d", "a2"), ("q", "d", "p1")], "query_id string, document_id string, node_id string")
    gold = spark.createDataFrame([("q", "d", "c1")], "query_id string, document_id string, node_id string")
    out = {r["node_id"]: (r["exact"], r["structural"]) for r in evidence.structural_gold(hits, gold, small).collect()}
    assert out == {"a1": (False, True), "c1": (True, True), "a2": (False, False), "p1": (False, True)}


def test_ranges(spark):
    df = spark.createDataFrame([("q", "Các điểm c đến g khoản 1 Điều 7a")], "query_id string, query string")
    r = routing.parse(df).first()
    assert (r["article"], r["clause"], r["points"]) == ("7a", "1", ["c", "d", "đ", "e", "f", "g"])
    with pytest.raises(ValueError):
        routing.route(df, "B7d")


def test_selection(spark):
    s = spark.createDataFrame([("x", 0.61, 0.1, 0.1, 9.0, 0.9), ("y", 0.60, 0.9, 0.9, 1.0, 0.1), ("z", 0.59, 0.9, 0.9, 1.0, 0.1)], "strategy string, recall double, mrr double, evidence double, tokens double, duplicates double")
    assert [r["strategy"] for r in selection.ranked(s).orderBy("place").collect()] == ["x", "y", "z"]
    assert {r["strategy"] for r in selection.pareto_frontier(s).collect()} == {"x", "y"}
    rows = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10)], "id int, c string")
    assert [r["id"] for r in selection.round_robin(rows, "c", "id", 5).orderBy("turn", "c").collect()] == [0, 8, 1, 9, 2]
    assert sorted(r["id"] for r in selection.spread(rows.where("c = 'a'"), "c", "id", 3).collect()) == [0, 4, 7]
    q = selection.quota_sample(rows, [("id > 5", 2), ("id > 4", 2)], "id", "id").collect()
    assert sorted((r["id"], r["quota"]) for r in q) == [(5, 1), (6, 0), (7, 0), (8, 1)]


def test_graph(spark):
    e = spark.createDataFrame([("e1", "a", "b", "X"), ("e2", "b", "a", "Y"), ("e3", "b", "c", "X"), ("e4", "c", "d", "X")], "edge_id string, source string, target string, relation string").withColumn("description", F.lit("t"))
    p = spark.createDataFrame([("e1", 0, "n1"), ("e2", 0, "n1"), ("e2", 1, "n2")], "edge_id string, ordinal int, node_id string")
    m = {(r["left"], r["right"]): r for r in graph.mirror(e, p).collect()}
    assert m["a", "b"]["relations"] == "X, Y" and m["a", "b"]["weight"] == 2.0 and m["b", "c"]["weight"] == 1.0
    nodes, edges = graph.subgraph(e, "a", 2)
    assert {r["node_id"]: r["level"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2} and edges.count() == 3
    assert [r["node_id"] for r in graph.subgraph(e, "a", 2, max_nodes=2)[0].orderBy("place").collect()] == ["a", "b"]
    assert graph.provenance_of(p).where("edge_id = 'e2'").first()["citations"] == ["n1", "n2"]
    rel = spark.createDataFrame([("r1", "ACTIVE"), ("r2", "READY"), ("r3", "BUILDING")], "release_id string, state string")
    assert {r["release_id"]: r["state"] for r in graph.activate(rel, "r2").collect()} == {"r1": "RETIRED", "r2": "ACTIVE", "r3": "BUILDING"}
    n = spark.createDataFrame([("a",), ("b",)], "node_id string")
    x = spark.createDataFrame([(1, "a", "b", "X", "has", "t1"), (2, "a", "b", "Z", "has", "t1"), (3, "a", "q", "X", "has", "t1"), (4, "a", "a", "X", "has", "t1"), (5, "a", "b", "X", "none", "t1"), (6, "a", "b", "X", "it", "t2")], "row int, source string, target string, relation string, evidence string, node_id string")
    texts = spark.createDataFrame([("t1", "text has it"), ("t2", "it is")], "node_id string, text string")
    good, rejected = graph.semantic(x, texts, n, ["X"])
    assert [len(r["provenance"]) for r in good.collect()] == [2]
    assert {r["row"]: r["reason"] for r in rejected.collect()} == {2: "UNKNOWN_RELATION", 3: "UNKNOWN_END", 4: "SELF_LOOP", 5: "EVIDENCE_NOT_FOUND"}


def test_checks(spark):
    b = spark.createDataFrame([("d", 1, 1, "and so", False), ("d", 2, 1, "it goes on", False), ("d", 3, 1, "Done.", False)], "document_id string, page int, block int, text string, marked boolean")
    assert [r["page"] for r in validate.truncated_pages(b).collect()] == [1, 2]
    pairs = spark.createDataFrame([("q", "a b c d", "x b c d y a")], "id string, l string, r string")
    assert validate.longest_common_run(pairs, ["id"], "l", "r").first()["run"] == 3
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    assert {(r["c"], r["n"], r["wanted"]) for r in validate.quota_issues(rows, "c", {"a": 2, "b": 2}).collect()} == {("b", 1, 2)}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("x", ["a", "b"], 1), ("y", [], 2)], "id string, tags array<string>, n int")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), df.schema).orderBy("id").collect() == df.orderBy("id").collect()
    files.write_sheet(df, str(tmp_path / "c"))
    back = files.read_sheet(spark, str(tmp_path / "c"), ("tags",)).orderBy("id").collect()
    assert [(r["id"], r["tags"]) for r in back] == [("x", ["a", "b"]), ("y", [])]
    up = files.upsert(df, spark.createDataFrame([("y", None, 5), ("z", ["q"], 3)], df.schema), ["id"]).orderBy("id").collect()
    assert [(r["id"], r["n"]) for r in up] == [("x", 1), ("y", 5), ("z", 3)] and up[1]["tags"] == []
    base = files.write_release({"t": df}, str(tmp_path / "r"), "v1")
    assert files.read_release(spark, base, "t").count() == 2


def test_global_search_blocks(spark, monkeypatch):
    """Several blocks on both sides give what one gives; ties go to the smaller id; vectors without a score come last."""
    rows = [(f"V{i}", [float(i % 7), 1.0]) for i in range(40)] + [("A", None), ("B", [1.0])]
    v = spark.createDataFrame(rows, "id string, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "query_id long, query array<double>")
    want = {i: sorted(((-(x[0] + i), k) for k, x in rows[:40]))[:5] for i in range(9)}
    for size in (4096, 4):
        monkeypatch.setattr(dense, "BLOCK", size)
        monkeypatch.setattr(dense, "QUERIES", size)
        got = {}
        for r in dense.global_search(v, q, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
        assert got == want
    assert [(r["id"], r["score"]) for r in dense.global_search(v, q.where("query_id = 0"), 50).orderBy("rank").collect()][40:] == [("A", None), ("B", None)]


def test_searches_ask_every_20th_vector(spark, sf):
    import arborlex.queries as registered

    got = registered.QUERIES["dense_top10"](spark, sf).groupBy("query_id").count().collect()
    assert {r["query_id"] for r in got} == set(range(0, 500, 20)) and {r["count"] for r in got} == {10}


def test_oracle_recall_looks_30_deep(spark):
    """Gold at rank 20 counts, gold at 6 to 30 is an ordering failure, gold at 5 is not; documents 1 to 40 rank in order."""
    from arborlex.operators import governance

    docs = spark.createDataFrame([(i, "word " + "filler " * i) for i in range(1, 41)], "doc_id int, text string")
    asked = spark.createDataFrame([(i, "word") for i in range(4)], "query_id int, query string")
    gold = spark.createDataFrame([(0, 5), (1, 6), (2, 20), (3, 31)], "query_id int, id int")
    pool = bm25.search(docs, asked, 30, "doc_id", "text").withColumnRenamed("doc_id", "id")
    assert tuple(governance.oracle_recall(pool, gold).first()) == (4, 0.75, 2)


def test_partial_leaks(spark):
    """A passage in other case and spacing, with one word changed, or cut short is found; at the threshold or below it is not."""
    words = [f"w{i}" for i in range(20)]
    docs = {1: "\n ".join(words).upper(), 2: " ".join(["x", *words[:9], "y", *words[10:]]), 3: " ".join(["x", "x", *words[3:12]]), 4: " ".join(words[:8]), 5: " ".join(sorted(words[:14])), 6: " ".join(sorted(words[:13]))}
    b = spark.createDataFrame([(7, " ".join(words)), (8, "w0 w1")], "item_id int, query string")
    d = spark.createDataFrame(list(docs.items()), "doc_id int, source string")
    pairs = lambda found: found.join(b, "item_id").join(d, "doc_id")
    leaks = validate.lexical_leaks(pairs(validate.overlap_candidates(b, d))).where("leak and item_id = 7")
    assert {r["doc_id"]: r["overlap"] for r in leaks.collect()} == {1: 1.0, 2: 0.95, 5: 0.7}
    runs = validate.longest_common_run(pairs(validate.run_candidates(b, d)), ["item_id", "doc_id"], "query", "source").where("run >= 9")
    assert {(r["item_id"], r["doc_id"]): r["run"] for r in runs.collect()} == {(7, 1): 20, (7, 2): 10, (7, 3): 9}


def test_aggregate_duplication(spark):
    q = spark.createDataFrame([("q", ["g", "h"], [("a", 4), ("z", 9)]), ("none", ["g"], [("a", 4)])], "query_id string, gold_ids array<string>, required array<struct<id:string,tokens:int>>")
    cols = "query_id string, rank int, covered array<string>, nodes array<struct<id:string,tokens:int>>, contexts array<string>, components array<struct<hash:string,tokens:int>>, index_tokens int, evidence_tokens int"
    parts = [[("x", 4), ("y", 6)], [("x", 4), ("w", 6)]]
    rows = [("q", 1, ["g"], [("a", 4), ("b", 6)], ["c"], parts[0], 3, 10), ("q", 2, ["g"], [("a", 4), ("c", 6)], ["c"], parts[1], 5, 10)]
    for with_parts in (True, False):
        got = {r["k"]: r for r in metrics.aggregate_duplication(q, spark.createDataFrame([r if with_parts else (*r[:5], [], *r[6:]) for r in rows], cols), (1, 2)).collect()}
        one, two = got[1], got[2]
        assert (one["queries"], one["structural_coverage"], one["avg_index_tokens"], one["relevant_token_density"], one["duplicate_token_ratio"]) == (2, 0.25, 1.5, 0.2, 0.0)
        assert (two["structural_coverage"], two["avg_index_tokens"], two["relevant_token_density"], two["duplicate_node_ratio"], two["duplicate_context_ratio"]) == (0.25, 4.0, 0.1, 0.125, 0.25)
        assert (two["duplicate_token_ratio"], two["duplicate_token_ratio_median"], two["duplicate_token_ratio_p95"]) == (0.1, 0.1, 0.2)
        assert (two["avg_duplicate_token_count"], two["avg_total_component_tokens"], two["unique_source_node_coverage"]) == (2.0, 10.0, 1.5)


def test_direct_evidence(spark):
    rows = [("d", None, "document", 0, ""), ("a7", "d", "article", 1, "Heading\nbody"), ("c1", "a7", "clause", 2, "Clause one"), ("p1", "c1", "point", 3, "a) first"), ("p2", "c1", "point", 4, "b) second"), ("c2", "a7", "clause", 5, " "), ("p3", "c2", "point", 6, "a) other")]
    tree_ = spark.createDataFrame([("D", i, p, t, o, x) for i, p, t, o, x in rows], "document_id string, node_id string, parent_id string, type string, ordinal long, text string")
    asked = [("list", 0, "p2"), ("list", 1, "p1"), ("one", 0, "p1"), ("clause", 0, "c1"), ("article", 0, "a7"), ("mixed", 0, "p1"), ("mixed", 1, "c1"), ("split", 0, "p1"), ("split", 1, "p3")]
    targets = spark.createDataFrame([(q, k, "D", n) for q, k, n in asked], "query_id string, position int, document_id string, node_id string")
    titles = spark.createDataFrame([("D", "Title")], "document_id string, title string")
    out = {r["query_id"]: r for r in evidence.direct(targets, tree_, titles).collect()}
    assert out["list"]["evidence"] == "Title\nHeading\nClause one\nb) second\na) first" and out["list"]["primary_id"] == "p2"
    assert out["list"]["context_ids"] == ["d", "a7", "c1"] and out["list"]["citation_ids"] == ["p2", "p1"]
    assert out["one"]["evidence"] == "Title\nHeading\nClause one\na) first"
    assert out["clause"]["included_ids"] == ["c1", "p1", "p2"] and out["clause"]["context_ids"] == []
    assert out["article"]["included_ids"] == ["a7", "c1", "p1", "p2", "p3"]
    assert {q: out[q]["problem"] for q in ("list", "one", "mixed", "split")} == {"list": None, "one": None, "mixed": "NOT_POINTS", "split": "SPLIT_PARENT"}
    assert evidence.direct(targets, tree_, titles, 3).where("query_id = 'article'").first()["problem"] == "TOO_LONG"


def test_citations_in_other_normal_forms(spark):
    import unicodedata

    df = spark.createDataFrame([(1, unicodedata.normalize("NFD", "Điều 8 khoản 2"))], "query_id int, query string")
    row = routing.parse(df).first()
    assert (row["article"], row["clause"]) == ("8", "2")


def test_containing_candidates(spark):
    b = spark.createDataFrame([(1, "ab cd ef gh"), (2, "x"), (3, "not there at all")], "item_id int, query string")
    d = spark.createDataFrame([(1, "zab cd ef ghz"), (2, "cd ef"), (3, "exit"), (4, None)], "doc_id int, source string")
    pairs = validate.containing_candidates(b, d).join(b, "item_id").join(d, "doc_id").where(F.contains(F.col("source"), F.col("query")))
    assert sorted((r["item_id"], r["doc_id"]) for r in pairs.collect()) == [(1, 1), (2, 3)]


def test_entry_without_optional_modules(monkeypatch):
    import sys

    import __spark_entry__
    import arborlex.queries as registered

    for name in ("arborlex.llm", "arborlex.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(__spark_entry__.queries()) == set(registered.QUERIES)


def test_apply_reviews_all_or_nothing(spark):
    """One changed immutable column, one missing and one repeated row: nothing is applied."""
    data = spark.createDataFrame([(1, "a", "q1", "draft"), (2, "a", "q2", "draft")], "id int, split string, query string, review_status string")
    review = "id int, split string, query string, review_status string"
    good = spark.createDataFrame([(1, "a", "new", " Approved "), (2, None, None, None)], review)
    done, issues = governance.apply_reviews(data, good, "id", ["split"], ["query"])
    assert issues.count() == 0 and sorted(map(tuple, done.collect())) == [(1, "a", "new", "approved"), (2, "a", "q2", "draft")]
    for rows, codes in ([(1, "b", "new", "x"), (2, "a", None, None)], ["FIXED_CHANGED"]), ([(1, "a", "new", "x")], ["MISSING"]), ([(1, "a", "n", "x"), (1, "a", "m", "x"), (2, "a", "q", "x"), (3, "a", "q", "x")], ["EXTRA", "TWICE"]):
        done, issues = governance.apply_reviews(data, spark.createDataFrame(rows, review), "id", ["split"], ["query"])
        assert sorted(r["code"] for r in issues.collect()) == codes
        assert sorted(map(tuple, done.collect())) == sorted(map(tuple, data.collect()))


def test_release_candidate_ties(spark):
    """Equal metrics: the first id by code points, a longer id before its own beginning."""
    rows = [(s, 1.0, 1.0, 1.0, 5.0, 0.0) for s in ("B6", "B4", "B4e", "B4a") for _ in range(2)]
    df = spark.createDataFrame(rows, "strategy string, recall double, mrr double, evidence double, tokens double, duplicates double")
    assert one(selection.release_candidate(df), "strategy") == "B4a"
    assert one(selection.release_candidate(df.where("strategy in ('B4', 'B4e')")), "strategy") == "B4e"


def test_second_round(spark):
    rows = [(s, r, recall, ev) for s, recall, ev in (("B0", 0.9, 0.5), ("B1", 0.8, 0.5), ("B2", 0.7, 0.5), ("B3", 0.60, 0.50), ("B4", 0.58, 0.53), ("B5", 0.57, 0.9)) for r in ("bm25", "dense")]
    df = spark.createDataFrame(rows, "strategy string, retriever string, recall double, evidence double")
    assert tuple(selection.second_round(df, "B3", ["B4", "B5"]).first()) == (False, True, True)
    assert tuple(selection.second_round(df, "B3", ["B5"]).first()) == (False, False, False)
    assert tuple(selection.second_round(df, "B3", ["B2"]).first()) == (True, False, True)
    assert tuple(selection.second_round(df.limit(0), "B3", ["B2"]).first()) == (False, False, False)


def test_provider_gates(spark):
    schema = "provider string, entity_precision double, relationship_precision double, missing_rate double, failures int, benchmark_issues int, cost_per_edge double, latency double"
    rows = [("a", 0.9, 0.95, 0.1, 0, 0, 3.0, 1.0), ("b", 0.9, 0.93, 0.1, 0, 0, 2.0, 1.0), ("c", 0.9, 0.80, 0.1, 0, 0, 1.0, 1.0), ("d", 0.9, 0.99, 0.1, 1, 0, 0.5, 1.0)]
    out = governance.select_provider(spark.createDataFrame(rows, schema), {"entity_precision": 0.8, "missing_rate": 0.2}, 0.05)
    assert sorted((r["provider"], r["passed"], r["winner"]) for r in out.collect()) == [("a", True, False), ("b", True, True), ("c", True, False), ("d", False, False)]


def test_release_health_needs_one_active(spark):
    schema = "dataset_id string, state string, model string, revision string, lock string"
    rows = spark.createDataFrame([("x", "p")] * 2, "dataset_id string, id string").withColumn("status", F.lit("READY"))
    check = lambda states, lock=None: governance.release_health(spark.createDataFrame([(k, s, "m", "1", "l") for k, s in states], schema), rows, rows, "m", "1", 2, lock).first()
    assert check([("x", "ACTIVE"), ("y", "RETIRED")])["ready"] and not check([("x", "ACTIVE")], "other")["ready"]
    for states in ([("x", "READY")], [("x", "ACTIVE"), ("y", "ACTIVE")]):
        out = check(states)
        assert not out["ready"] and out["dataset_id"] is None


def test_json_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([("v|w\nx", None, 3)], "b string, a string, n int")
    files.write_json(df, str(tmp_path / "j"))
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "j"), "b string, a string, n int").collect()] == [("v|w\nx", None, 3)]
    lines = [r["value"] for r in files.markdown(df, "T").orderBy("line_no").collect()]
    assert lines == ["# T", "", "| b | a | n |", "| --- | --- | --- |", "| v\\|w x |  | 3 |"]
