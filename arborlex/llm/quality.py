"""Quality rules: text statistics, and line frequency across the documents of a host. DataFrame functions only.

A line is normalised (A-Z lower-cased, runs of the six ASCII separators to one space, ends trimmed) and hashed.
Per host, documents that hold a line are counted, each once. Lines in more than max_docs documents are removed; a
document is depleted, and rejected, if fewer than min_words words or less than min_share of its words are left.

The text is read once: a narrow table of statistics and line hashes is kept. Counting is a two-step aggregate, so a
line that a third of all documents hold is combined before the shuffle; the few lines above the limit are written,
so that the join on them can split a line with many documents. A null or empty text has no words or lines; a null
host is a host of its own; a document that repeats (same id) counts once per line, and each of its rows gets a
verdict of its own. Other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import drop, materialise

WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Words of a window; shares and counts below are of words.
WINDOW = 5
MAX_DOCS = 50
MIN_WORDS, MIN_SHARE = 10, 0.5
MAX_REPEAT_PERCENT = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def window_hashes(w: Column) -> Column:
    """A hash of each run of WINDOW words."""
    at = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    return F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), at)).otherwise(F.array().cast("array<long>"))


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and lines (hash and words of each)."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    normal = lambda x: F.trim(F.regexp_replace(F.translate(x, _UPPER, _LOWER), rf"{SEPARATOR}+", " "))
    df = documents.withColumn("_lines", with_word).withColumn("_words", words(t))
    df = df.withColumn("_hashes", window_hashes(F.col("_words")))
    df = df.withColumn("_distinct", F.size(F.array_distinct("_hashes")) == F.size("_hashes"))
    long = lambda c: c.cast("long")
    df = (
        df.withColumn("n_words", long(F.size("_words")))
        .withColumn("word_chars", long(F.char_length(t) - F.regexp_count(t, F.lit(SEPARATOR))))
        .withColumn("n_symbols", long(F.regexp_count(t, F.lit(SYMBOL))))
        .withColumn("n_dup_lines", long(F.size("_lines") - F.size(F.array_distinct("_lines"))))
        .withColumn("_sorted", F.when(~F.col("_distinct"), F.array_sort(F.transform("_hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    )
    df = df.withColumn("n_repeat_words", long(F.when(F.col("_distinct"), F.lit(0)).otherwise(_covered(F.col("_sorted")))))
    lines = F.transform("_lines", lambda x: F.struct(F.xxhash64(normal(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return df.withColumn("lines", lines).drop("_lines", "_words", "_hashes", "_distinct", "_sorted")


def _covered(pairs: Column) -> Column:
    """Words in windows found twice or more: pairs are the windows' (hash, place), sorted."""
    place = lambda x, k: F.when((F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]), x["i"])
    places = F.array_sort(F.filter(F.transform(pairs, place), lambda x: x.isNotNull()))
    total = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
    )
    return total["n"]


def line_frequency(documents: DataFrame, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: id, the statistics, removed_words, base_failed and kept."""
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"), F.col(text).alias("text"))
    rows = materialise(statistics(docs).drop("text").withColumn("row", F.monotonically_increasing_id()))
    names = rows.select("host", F.xxhash64("id").alias("doc"), F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counted = names.groupBy("host", "h").agg(F.countDistinct("doc").alias("docs"))
    common = materialise(counted.where(F.col("docs") > max_docs).select("host", "h"))
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    removed = materialise(lines.join(common, ["host", "h"]).groupBy("row").agg(F.sum("n").alias("removed_words")))
    drop(common)
    out = rows.drop("lines", "host").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= min_words) & (left >= F.col("n_words") * F.lit(min_share)))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")
