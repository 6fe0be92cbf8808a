"""The registered queries of this subpackage, over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crossentropy, licences, minhash, mixing, quality, repeats, toxicity, transcripts, vafile
from .core import read_table

RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Link threshold of op7, in percent, and its shingle width in words.
OP7_PERCENT, OP7_WIDTH = 85, 3


#: Source weights of op1, repeating over the sources in code point order, and the share of all words to take.
OP1_WEIGHTS, OP1_SHARE, OP1_COPIES = (3.0, 1.0, 2.0), 1.5, 2
#: Labels whose crc32(doc_id) has this remainder by 5 are held out of training.
HELD_OUT = 0
OP6_LENGTH = 100
OP8_K = 10


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix(docs, OP1_WEIGHTS, OP1_SHARE, OP1_COPIES)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str = RANKS_PATH) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, Path(ranks_path).read_bytes(), public_tokenizers.PATTERN, keep_text=False)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_frequency(read_table(spark, sf_dir, "documents"))


def op4_crossentropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality. Background: all documents. Each is scored by the others."""
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("target")).distinct()
    # labels grow with the documents: a merge join at every size
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    return crossentropy.score(docs, "target", without_own=True).select("doc_id", "n_tokens", "target_loss", "background_loss", "score")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == HELD_OUT


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fitted on at most toxicity.MAX_POSITIVE + toxicity.MAX_NEGATIVE labelled rows that are not held out."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit(docs, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), OP6_LENGTH)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), OP7_WIDTH, OP7_PERCENT)


def op8_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vafile.top_k(vectors, vectors.where("vec_id % 100 = 0"), OP8_K)


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles train on conversations that are not held out and are recovered in all of them."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    model = transcripts.fit(turns.where(~held_out("conv_id")))
    out = transcripts.parse(turns.drop("role"), model)
    return out.select("conv_id", "turn", "part", "role", "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "spans")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_frequency": op3_line_frequency,
    "op4_crossentropy": op4_crossentropy,
    "op5_toxicity": op5_toxicity,
    "op6_repeats": op6_repeats,
    "op7_minhash": op7_minhash,
    "op8_vafile": op8_vafile,
    "op9_transcripts": op9_transcripts,
    "op10_licences": op10_licences,
}

_WORD = r"[^\x20\x09-\x0D]+"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: SQL for the queries that it can express: 3, 7 and 8. The others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_line_frequency": f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
    k AS (SELECT *, trim(regexp_replace({_FOLD.format('line')}, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS normal, len(regexp_extract_all(line, '{_WORD}')) AS n FROM l WHERE regexp_matches(line, '{_WORD}')),
    f AS (SELECT source, normal FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) > {quality.MAX_DOCS}),
    r AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (f.normal IS NOT NULL), 0) AS removed FROM k LEFT JOIN f ON f.normal = k.normal AND f.source IS NOT DISTINCT FROM k.source GROUP BY doc_id),
    i AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i : i + 4]) AS n FROM i),
    c AS (SELECT doc_id, count(DISTINCT i + j) AS covered FROM g, (SELECT unnest(range(5)) AS j) WHERE n > 1 GROUP BY doc_id),
    s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
          CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words FROM d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
    SELECT *, NOT base_failed AND n_words - removed_words >= {quality.MIN_WORDS} AND n_words - removed_words >= n_words * {quality.MIN_SHARE} AS kept FROM b""",
    "op7_minhash": f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {OP7_WIDTH} THEN w ELSE w[i : i + {OP7_WIDTH - 1}] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {OP7_WIDTH - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= {OP7_PERCENT} * (x.n + y.n - met)),
    reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
    SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op8_vafile": f"""
    WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS x FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= {OP8_K}""",
}
