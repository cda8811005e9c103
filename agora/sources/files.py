"""Files in and out: URL lists, CSV with inferred columns, backups, HTML corpora, reports and model artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora.functions.urls import normalized_input

#: Headers that hold addresses, the first found wins.
URL_HEADERS = ("url", "site", "website", "link", "href", "domain")
BACKUP_TABLES = ("jobs", "jobItems", "manualReviewTargets", "jobEvents")


def normalized_header(name: str) -> str:
    return name.strip().lstrip("﻿").strip().replace(" ", "_").lower()


def url_column(headers: list[str], preferred: str | None = None) -> str:
    """The preferred header, else the first that usually holds addresses, else the first of all."""
    if preferred:
        if (want := normalized_header(preferred)) not in headers:
            raise ValueError(f"no column named {preferred}")
        return want
    return next((h for h in URL_HEADERS if h in headers), headers[0])


def records(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Rows of a CSV with an ``input_url`` and its normalized form; quoted fields may span lines; blank rows go."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    df = raw.toDF(*map(normalized_header, raw.columns))
    filled = df.where(F.concat_ws("", *(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in df.columns)) != "")
    url = F.trim(F.coalesce(F.col(f"`{url_column(df.columns, column)}`"), F.lit("")))
    return filled.withColumns({"input_url": url, "normalized_url": normalized_input(url)})


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One address a line; blank lines go."""
    url = F.trim(F.col("value"))
    return spark.read.text(path).where(url != "").select(url.alias("input_url"), normalized_input(url).alias("normalized_url"))


def categorized(lines: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """Numbered rows of a list with the category line above them; one list is one window."""
    numbered = F.col(text).rlike(r"^\s*\d+[.)]\s+")
    held = F.last(F.when(~numbered & (F.trim(text) != ""), F.trim(text)), ignorenulls=True).over(Window.partitionBy("list_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("category", held).where(numbered).withColumn("entry", F.regexp_replace(text, r"^\s*\d+[.)]\s+", ""))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """HTML files below ``prompt_*`` folders: prompt, path and html."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(path)
    return files.select(F.regexp_extract("path", r"(prompt_[^/]+)/", 1).alias("prompt"), "path", F.decode("content", "UTF-8").alias("html"))


def backup_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a backup, a JSON document, plain or gzipped; missing tables are absent."""
    whole = spark.read.json(path, multiLine=True)
    return {t: whole.select(F.explode(t).alias("r")).select("r.*") for t in BACKUP_TABLES if t in whole.columns}


def write_backup(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as gzipped JSON lines in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def restored(held: dict[str, DataFrame], backup: dict[str, DataFrame], key: str = "id") -> dict[str, DataFrame]:
    """Rows of a backup that are not held yet, table by table."""
    return {t: df.join(held[t].select(key), key, "left_anti") if t in held else df for t, df in backup.items()}


def flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON and nulls as nothing, ready for CSV."""
    nested = lambda kind: kind.startswith(("array", "struct", "map"))
    return df.select(*(F.coalesce(F.to_json(F.col(f"`{c}`")) if nested(kind) else F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c, kind in df.dtypes))


def write_csv(df: DataFrame, path: str, first: list[str] = ()) -> None:
    """CSV with the columns of ``first`` in front and the others by name."""
    order = [c for c in first if c in df.columns] + sorted(c for c in df.columns if c not in first)
    flat(df.select(*(F.col(f"`{c}`") for c in order))).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_by_status(df: DataFrame, path: str, status: str = "status") -> None:
    df.write.mode("overwrite").partitionBy(status).csv(path, header=True, quote='"', escape='"')


def write_artifact(spark: SparkSession, artifact: dict, path: str) -> None:
    """A model artifact, one small JSON document."""
    spark.createDataFrame([(json.dumps(artifact, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_artifact(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
