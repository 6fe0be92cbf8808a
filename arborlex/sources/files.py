"""Sources and sinks: line-delimited JSON, CSV review sheets, versioned releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per line with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Keys sorted, nulls kept."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a file, over as many lines as it likes."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A report's one row as JSON of sorted keys, indented by two, into a folder that every worker reaches."""
    text = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))
    text.coalesce(1).write.text(path)


def markdown(df: DataFrame, title: str) -> DataFrame:
    """(line_no, value): a report of a summary's rows as a Markdown table, in the order of its columns' values."""
    cell = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    # a summary's rows, few by nature
    body = df.select(*df.columns, row(*map(cell, df.columns)).alias("value")).withColumn("line_no", F.row_number().over(Window.orderBy(*df.columns)) + 4)
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines = df.sparkSession.createDataFrame([(k + 1, v) for k, v in enumerate(head)], "line_no int, value string")
    return lines.unionByName(body.select("line_no", "value"))


def snapshot(passages: DataFrame) -> DataFrame:
    """What a regression run compares: every column, with texts (names ending in _text) as hashes."""
    return passages.select(*[F.sha2(c, 256).alias(f"{c}_hash") if c.endswith("_text") else F.col(c) for c in passages.columns])


def sheet(df: DataFrame) -> DataFrame:
    """Columns as a review sheet has them: lists of strings joined by |, other nested values as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_sheet(df: DataFrame, path: str) -> None:
    sheet(df).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_sheet(spark: SparkSession, path: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """A sheet back, its named columns as lists again."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumns({c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, r"\|")) for c in lists}) if lists else df


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key; null columns of new keep the old value."""
    o, n = old.alias("o"), new.alias("n")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return o.join(n, on, "full").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def write_release(tables: dict[str, DataFrame], path: str, release_id: str) -> str:
    """Tables under a directory of the release, and its marker last: a release without marker is not read."""
    spark = next(iter(tables.values())).sparkSession
    base = f"{path}/release={release_id}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/{name}")
    spark.createDataFrame([(release_id, len(tables))], "release_id string, tables int").coalesce(1).write.json(f"{base}/_manifest")
    return base


def read_release(spark: SparkSession, base: str, name: str) -> DataFrame:
    spark.read.schema("release_id string, tables int").json(f"{base}/_manifest").head(1)  # raises without marker
    return spark.read.parquet(f"{base}/{name}")
