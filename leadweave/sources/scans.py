"""Sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.text import fold_accents
from leadweave.schemas import PLACE_CARDS, TABLES, upgrade

LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\w+)\s*\| (.*)$"
LOG_DAY = r"(\d{4}-\d{2}-\d{2})\.log$"


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One stored table with its declared schema (no inference, no file listing of footers)."""
    return spark.read.schema(TABLES[table]).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose files give fewer splits than the session has task slots, dealt out evenly over all slots.

    One small file is one split, and costly work on its rows (pages, patterns) would keep one core
    busy. A scan of many splits is returned as it is: no exchange is added where there is much to
    move. Column pruning and filters still reach the files, rows and values are the same either way.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= slots else scan.repartition(slots)


def read_snapshot(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A snapshot of any schema version, brought to the current columns."""
    return upgrade(spark.read.parquet(path), table)


def _line_number() -> Column:
    """A sortable place of each line: file name, start of its split, place in the split."""
    return F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def contact_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a pasted contact list; byte-order mark and blank lines removed, file order kept."""
    lines = spark.read.text(path)
    lines = lines.select(F.regexp_replace("value", "^﻿", "").alias("line"), _line_number().alias("line_no"))
    return lines.filter(F.trim("line") != "")


def place_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Place names of region files, distinct, folded, with the ambiguous flag.

    A file holds one document over several lines, or one document on each line.
    """
    lines = F.filter(F.split("value", "\n"), lambda line: F.trim(line) != "")
    by_line = F.forall(lines, lambda line: F.try_parse_json(line).isNotNull())
    text = spark.read.text(path, wholetext=True).select(F.explode(F.when(by_line, lines).otherwise(F.array("value"))).alias("value"))
    schema = "regiones map<string,array<string>>, ambiguas array<string>"
    return catalog_from_json(text.select(F.from_json("value", schema).alias("c")))


def catalog_from_json(catalogs: DataFrame) -> DataFrame:
    """Flatten parsed catalogs (column ``c``): region to names, first appearance kept."""
    names = catalogs.select(
        F.explode(F.flatten(F.map_values("c.regiones"))).alias("name"), F.coalesce("c.ambiguas", F.array().cast("array<string>")).alias("_amb"))
    once = names.groupBy("name").agg(F.bool_or(F.array_contains("_amb", F.col("name"))).alias("ambiguous"))
    return once.select("name", fold_accents("name").alias("folded"), "ambiguous")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Daily log files as rows: day of the file, moment, level, message."""
    raw = spark.read.text(path).select(
        "value", F.regexp_extract(F.col("_metadata.file_name"), LOG_DAY, 1).alias("_day"), _line_number().alias("line_no"))
    return parse_log_lines(raw.withColumn("day", F.col("_day").try_cast("date")).drop("_day"))


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Split log lines into moment, level and message; lines of another form keep only the text."""
    v = F.col(value)
    return lines.withColumns({
        "logged_at": F.nullif(F.regexp_extract(v, LOG_LINE, 1), F.lit("")).try_cast("timestamp"),
        "level": F.nullif(F.trim(F.regexp_extract(v, LOG_LINE, 2)), F.lit("")),
        "message": F.when(v.rlike(LOG_LINE), F.regexp_extract(v, LOG_LINE, 3)).otherwise(v),
    })


def last_log_lines(logs: DataFrame, day: Column, limit: int | None = None) -> DataFrame:
    """The newest lines of one day, newest first; all of them, or ``limit``."""
    lines = logs.filter(F.col("day") == day).orderBy(F.desc("line_no"))
    return lines if limit is None else lines.limit(limit)


def kept_logs(logs: DataFrame, today: Column, keep_days: int = fv.LOG_KEEP_DAYS) -> DataFrame:
    """Rows to keep: days inside the window; files whose date cannot be read stay."""
    return logs.filter(F.col("day").isNull() | (F.col("day") >= F.date_sub(today, keep_days)))


def place_cards(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Captured listing cards, as a table or as a growing stream of files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(PLACE_CARDS).parquet(path)
