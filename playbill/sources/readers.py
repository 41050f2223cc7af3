"""Input tables and files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.functions.text import strip
from playbill.functions.urls import content_type_for
from playbill.schemas import struct


def read_table(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    reader = spark.read.schema(struct(ddl)) if ddl else spark.read
    return reader.parquet(path)


def read_feed(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Incoming rows from feed documents ``{"generated": ..., "events": [...]}``, one a file or one a line."""
    item = "struct<id:string,eventName:string,venue:string,url:string,date:string,summary:string,thumbnailUrl:string>"
    docs = spark.read.schema(f"generated string, events array<{item}>").option("multiLine", multi_line).json(path)
    rows = docs.select(F.posexplode("events").alias("ord", "e")).filter("e is not null")
    return rows.select(
        F.col("e.id").alias("id"),
        F.when(strip("e.venue") != "", F.concat(strip("e.eventName"), F.lit(" @ "), strip("e.venue"))).otherwise(strip("e.eventName")).alias("title"),
        F.coalesce("e.url", F.lit("")).alias("url"),
        F.coalesce("e.date", F.lit("")).alias("date"),
        F.coalesce("e.summary", F.lit("")).alias("summary"),
        F.nullif(strip("e.thumbnailUrl"), F.lit("")).alias("thumbnail_url"),
        F.col("ord"),
    )


def read_assets(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Image rows from a folder of files. ``index`` has ``id, file, source``; files it misses keep a file address."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,png,webp,gif,avif}").load(folder)
    named = files.select(F.substring_index("path", "/", -1).alias("id"), F.col("content").alias("data"))
    known = index.filter(strip("file") != "").groupBy(strip("file").alias("id")).agg(F.max_by("source", "id").alias("_source"))
    return named.join(known, "id", "left").select(
        "id",
        F.coalesce(F.nullif(strip("_source"), F.lit("")), F.concat(F.lit("file://"), F.col("id"))).alias("source_url"),
        content_type_for(F.regexp_extract("id", r"(\.[^.]*)$", 1)).alias("content_type"),
        "data",
        F.sha2("data", 256).alias("sha256"),
    )


@dataclass(frozen=True)
class Rules:
    """Exclusion rules written by people: a short list of words and a short list of phrases."""

    drop_terms: tuple[str, ...] = field(default=())
    exclusions: tuple[str, ...] = field(default=())

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [("drop_term", t) for t in self.drop_terms] + [("exclusion", e) for e in self.exclusions]
        return spark.createDataFrame(rows, "kind string, rule string")


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Rules from a JSON document; a missing or malformed one gives no rules. Any other trouble with reading it is raised."""
    try:
        text = "\n".join(r[0] for r in spark.read.text(path).collect())  # one small settings file
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return Rules()
    try:
        data = json.loads(text)
    except ValueError:
        return Rules()
    if not isinstance(data, dict):
        return Rules()
    lists = [data.get(k) or [] for k in ("drop_terms", "exclusions")]
    if not all(isinstance(x, list) and all(isinstance(t, str) for t in x) for x in lists):
        return Rules()
    return Rules(tuple(lists[0]), tuple(lists[1]))
