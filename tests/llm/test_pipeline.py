"""The pipeline's stages, each against its own input."""

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from arborlex.llm import bpe
from arborlex.llm.core import materialise, read_table

from .test_text_operators import RANKS, components, cut


def test_stages(spark, sf):
    docs = read_table(spark, sf, "documents").withColumn("extra", F.lit(1)).where("doc_id < 400")
    seen = {}
    for name, stage in p.STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf))
        seen[name] = (before, docs)
        if name != "bpe":
            assert tuple(docs.columns) == p.COLUMNS
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    a, b = map(rows, seen["near_duplicates"])
    assert set(b) == {i for i, x in components(list(a.items()), 5, 80).items() if x[2]}
    a, b = map(rows, seen["repeats"])
    want = cut(sorted(a.items()), 100)
    assert {i: t.encode() for i, t in b.items()} == {i: w[0].decode(errors="ignore").encode() for i, w in want.items()}
    before, after = seen["mixing"]
    assert after.count() > before.count() and after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    before, after = seen["bpe"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(RANKS), special_tokens={})
    texts = rows(before)
    for r in after.collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == enc.encode_ordinary(texts[r["doc_id"]])


def test_empty(spark, sf):
    docs = read_table(spark, sf, "documents").limit(0)
    for _, stage in p.STAGES:
        docs = materialise(stage(spark, docs, sf))
    assert docs.count() == 0


def test_stages_give_back_heap(spark, sf):
    """Every stage begins with a full collection in the executors, whose heap would else stay as the stages before left it."""
    beans = [b for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName()]
    full = lambda: sum(b.getCollectionCount() for b in beans)
    docs = read_table(spark, sf, "documents").limit(0)
    for name, stage in p.STAGES:
        before = full()
        docs = stage(spark, docs, sf)
        assert full() > before, name
