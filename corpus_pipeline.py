"""From raw documents to token ids: toxicity, near duplicates, repeated passages, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the
last return the columns of documents. Stages are written as Parquet in the shared folder and read again. A stage sets
how many rows go to a Python worker together, for itself and what runs after it in the session; memory follows that number.
It begins by having the executors give back the heap that the stage before filled, which would else add up with its own.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlex.llm import bpe, minhash, mixing, queries, repeats, toxicity
from arborlex.llm.core import BATCH_ROWS, drop, materialise, read_table, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is toxic from this score on.
TOXIC = 0.5
#: Near duplicates: words in a shingle, and similarity in percent.
WIDTH, PERCENT = 5, 80
#: Bytes of a repeated passage.
LENGTH = 100
#: Rows that go to a Python worker together: documents, and shards of many documents.
DOCUMENT_ROWS, SHARD_ROWS = 256, 8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model, trained on labels that are not held out, scores TOXIC or more."""
    release(spark)
    spark.conf.set(BATCH_ROWS, DOCUMENT_ROWS)
    labels = read_table(spark, sf_dir, "labels").where(~queries.held_out()).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model, to="_score").where(F.col("_score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group; rows without id have no group and stay."""
    release(spark)
    spark.conf.set(BATCH_ROWS, DOCUMENT_ROWS)
    found = minhash.near_duplicates(docs, WIDTH, PERCENT)
    gone = found.where(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(materialise(gone), "doc_id", "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts. Characters of which a cut took a byte go too."""
    release(spark)
    spark.conf.set(BATCH_ROWS, SHARD_ROWS)
    out = repeats.remove_repeats(docs.select(*COLUMNS), LENGTH, as_text=True)
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target words."""
    release(spark)
    out = mixing.mix(docs.select(*COLUMNS), queries.OP1_WEIGHTS, queries.OP1_SHARE, queries.OP1_COPIES)
    return out.where("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed 32-bit), and digests of the ids and of the text decoded from them."""
    release(spark)
    spark.conf.set(BATCH_ROWS, DOCUMENT_ROWS)
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), Path(queries.RANKS_PATH).read_bytes(), public_tokenizers.PATTERN, keep_text=False)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return out.select("doc_id", "lang", "source", n_tokens, "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express a trained model or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        before, docs = docs, materialise(made)
        drop(before)
    return docs
