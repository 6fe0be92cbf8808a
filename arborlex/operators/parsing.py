"""From page lines to a hierarchy: margins, markers, segments, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlex.functions import text as X

# Marker patterns, outermost first, with the group that holds the key and the one that holds the title.
MARKERS = (
    ("chapter", r"(?iu)^Chương\s+([IVXLCDM]+|\d+)(?![\p{L}\p{N}_])\s*[.:]?\s*([^\n]*)$"),
    ("section", r"(?iu)^Mục\s+(\d+)(?![\p{L}\p{N}_])\s*[.:]?\s*([^\n]*)$"),
    ("article", r"(?iu)^Điều\s+(\d+[A-Za-z]?)\s*[.]?\s*([^\n]*)$"),
    ("clause", r"(?s)^(\d{1,3})\.\s+(.+)$"),
    ("point", r"(?s)^([a-zA-ZđĐ])\)\s+(.+)$"),
)
KINDS = tuple(k for k, _ in MARKERS)
PAGE_NUMBER = r"^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$"
#: Share of a page's height that counts as its margin, and share of pages on which a line repeats.
MARGIN, REPEAT = 0.08, 0.60


def marker(text: Column) -> Column:
    """struct(kind, key, title) of the first pattern that fits, else null."""
    t = F.trim(text)
    out = F.lit(None)
    for kind, pattern in reversed(MARKERS):
        key = F.regexp_extract(t, pattern, 1)
        key = F.upper(key) if kind == "chapter" else F.lower(key) if kind == "point" else key
        title = F.trim(F.regexp_extract(t, pattern, 2))
        out = F.when(F.rlike(t, F.lit(pattern)), F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.when(title != "", title).alias("title"))).otherwise(out)
    return out


def is_kind(text: Column, kind: str) -> Column:
    return F.coalesce(marker(text).getField("kind") == kind, F.lit(False))


def bold_share(spans: Column) -> Column:
    """Share of a line's characters in bold spans (struct text, font, flags)."""
    size = lambda s: F.char_length(F.trim(s["text"]))
    bold = F.aggregate(spans, F.lit(0), lambda n, s: n + F.when(s["flags"].bitwiseAND(16) != 0, size(s)).when(F.contains(F.lower(s["font"]), F.lit("bold")), size(s)).otherwise(0))
    return F.try_divide(bold, F.aggregate(spans, F.lit(0), lambda n, s: n + size(s)))


def margin_lines(lines: DataFrame) -> DataFrame:
    """lines: (document_id, page, line_no, top, bottom, height, text). Adds key, marginal and removed: the reason or null.

    Keys are counted over the document; a key repeats from max(2, ceil(0.6 pages)) on. The counts' join is an equi-join on
    (document_id, key) whose right side holds repeated keys only."""
    top = F.col("top") <= F.col("height") * MARGIN
    rows = lines.withColumn("line", X.normalize_text("text")).withColumn("key", X.frequency_key(F.col("text"))).withColumn("marginal", top | (F.col("bottom") >= F.col("height") * (1 - MARGIN)))
    pages = lines.groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    counts = rows.where("marginal and key <> ''").groupBy("document_id", "key").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(2), F.floor(F.col("pages") * REPEAT + 0.999))
    repeated = counts.join(pages, "document_id").where(F.col("n") >= least).select("document_id", "key", F.lit(True).alias("again"))
    joined = rows.join(repeated, ["document_id", "key"], "left")
    reason = (
        F.when(F.col("marginal") & F.rlike("line", F.lit(PAGE_NUMBER)), "page_number")
        .when(F.col("marginal") & F.coalesce("again", F.lit(False)), F.when(top, "header").otherwise("footer"))
        .when(top & F.startswith(X.fold(F.col("line")), F.lit("người ký:")), "signature")
    )
    return joined.withColumn("removed", F.when(F.col("line") != "", reason)).drop("again")


def segments(lines: DataFrame) -> DataFrame:
    """lines: (document_id, block_id, line_no, text). A marker line opens a new segment of its block: (.., segment, text)."""
    rows = lines.withColumn("line", X.normalize_text("text")).where("line <> ''").withColumn("marker", marker(F.col("line")))
    w = Window.partitionBy("document_id", "block_id").orderBy("line_no")
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("opens", (F.col("marker").isNotNull() & ~first).cast("int"))
    rows = rows.withColumn("segment", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = rows.groupBy("document_id", "block_id", "segment").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    return listed.select("document_id", "block_id", "segment", F.array_join(F.transform("parts", lambda x: x["line"]), " ").alias("text"))


def hierarchy(markers: DataFrame) -> DataFrame:
    """markers: (document_id, position, kind, key). Adds the open chapter, section, article, clause and point at each
    marker, its level's parent position, and orphan: a clause outside an article or a point outside a clause.

    A level is open if it was opened after every marker of a level that closes it; all of it is running maxima."""
    w = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = markers
    for kind in KINDS:
        here = F.when(F.col("kind") == kind, F.col("position"))
        rows = rows.withColumn(f"at_{kind}", F.max(here).over(w)).withColumn(f"key_{kind}", F.last(F.when(F.col("kind") == kind, F.col("key")), ignorenulls=True).over(w))
    # what closes a level: chapters close everything below, sections articles and below, and so on
    for i, kind in enumerate(KINDS):
        closed = F.greatest(*[F.coalesce(f"at_{k}", F.lit(-1)) for k in KINDS[:i]], F.lit(-1), F.lit(-1))
        open_ = F.col(f"at_{kind}").isNotNull() & (F.col(f"at_{kind}") > closed)
        rows = rows.withColumn(f"open_{kind}", open_)
    for kind in KINDS:
        rows = rows.withColumn(kind, F.when(F.col(f"open_{kind}"), F.col(f"key_{kind}")))
    parent = F.lit(None).cast("long")
    for i, kind in enumerate(KINDS):
        above = {"section": ("chapter",), "article": ("section", "chapter"), "clause": ("article",), "point": ("clause", "article")}.get(kind, ())
        found = F.coalesce(*[F.when(F.col(f"open_{k}"), F.col(f"at_{k}")) for k in above], F.lit(None)) if above else F.lit(None)
        parent = F.when(F.col("kind") == kind, found.cast("long")).otherwise(parent)
    orphan = ((F.col("kind") == "clause") & ~F.col("open_article")) | ((F.col("kind") == "point") & ~F.col("open_clause"))
    return rows.select("document_id", "position", F.col("kind"), F.col("key"), *KINDS, parent.alias("parent_position"), orphan.alias("orphan"))


def stable_id(document: Column, chapter: Column, section: Column, article: Column, clause: Column, point: Column) -> Column:
    """An id from the open levels: deterministic, empty levels left out."""
    part = lambda p, c: F.when(c.isNotNull(), F.concat(F.lit(p), c))
    return F.concat_ws("__", document, part("CH", chapter), part("S", section), part("A", article), part("C", clause), part("P", point))
