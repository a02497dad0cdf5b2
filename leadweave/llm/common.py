"""Helpers the corpus operators share: column checks, folds, word splitting, staged tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.session import shared_folder, work_folder

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The word separators of the corpus operators, x20 and x09 to x0D, inside a character class.
SPACES = "\\x20\\x09-\\x0D"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lowered. ``bytes.split`` splits at exactly x20 and x09 to x0D."""
    return text.translate(LOWER_ASCII).split() if text else []


class Hidden:
    """``docs`` with those columns renamed that an operator's own could clash with: a leading underscore, or a name in ``also``."""

    def __init__(self, docs: DataFrame, also: tuple[str, ...] = ()):
        self.names = {c: f"kept column {i}" if c.startswith("_") or c.lower() in also else c for i, c in enumerate(docs.columns)}
        self.docs = docs.withColumnsRenamed({c: n for c, n in self.names.items() if c != n})

    def columns(self) -> list[Column]:
        """The original columns, under their own names."""
        return [F.col(f"`{n}`").alias(c) for c, n in self.names.items()]


def presence_bits(places: DataFrame, bits: int) -> np.ndarray:
    """One bit for each number of the only column of ``places`` (0 to 2**bits - 1): 2**bits / 8 bytes, whatever the rows.

    Read a bit with ``has_bit``. Different things may share a place, so a set bit says "maybe" and a clear one "no".
    """
    place = F.col(places.columns[0])
    parts = places.where(place.isNotNull()).groupBy(F.shiftright(place, 15).alias("bucket")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("part")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts:
        part = np.frombuffer(row["part"], np.uint8)[: len(out)]
        out[row["bucket"] * 4096 : row["bucket"] * 4096 + len(part)] = part
    return out


def has_bit(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and a lost executor never replays it."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    return shared_folder(spark)


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Add the position of each row in a total order, counted from 0, without sorting all rows in one task.

    Rows are dealt out by range, kept, counted by partition, and numbered inside their partition on
    top of the counts before it. The window over counts has one row for each partition.
    """
    from pyspark.sql import Window

    keys = [f"_order{i}" for i in range(len(order))]
    dealt = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(*keys)
    kept = stage(dealt.withColumn("_part", F.spark_partition_id()), "ranked")
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return kept.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(
        rank, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before", *keys)
