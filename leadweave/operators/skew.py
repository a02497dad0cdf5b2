"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 1000
MIN_HOT_ROWS = 100_000


def hot_safe_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", hot_share: int = MAX_HOT_KEYS,
                    min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Join ``rows`` to ``lookup`` (at most one row per key) without sending a hot key to one task.

    Keys carrying more than a thousandth of all rows (there can be at most a thousand of them,
    which bounds what is broadcast) are looked up by broadcast where their rows already are; the
    others take an ordinary shuffled join. Below ``min_hot_rows`` rows per key nothing is hot and
    the join runs as it is. ``rows`` is read more than once: pass a materialised frame.
    """
    total = rows.count()
    threshold = max(min_hot_rows, total // hot_share)
    if total <= threshold:
        return rows.join(lookup, keys, how)
    hot = rows.groupBy(*keys).count().filter(F.col("count") > threshold).select(*keys)
    hot_rows = hot.collect()  # fewer than ``hot_share`` keys, because each holds that share of the rows
    if not hot_rows:
        return rows.join(lookup, keys, how)
    hot_keys = rows.sparkSession.createDataFrame(hot_rows, hot.schema)
    hot_lookup = lookup.join(F.broadcast(hot_keys), keys, "left_semi")
    hot_part = rows.join(F.broadcast(hot_keys), keys, "left_semi").join(F.broadcast(hot_lookup), keys, how)
    cold_part = rows.join(F.broadcast(hot_keys), keys, "left_anti").join(lookup, keys, how)
    return hot_part.unionByName(cold_part)


def lookup_known(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join in which rows with a NULL key are dealt out evenly: each gets a salt of its own, which matches nothing.

    A plain left join would send all rows without a key to one task.
    """
    columns = [c for c in lookup.columns if c != key]
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]), F.lit(100_003))).otherwise(-1)
    right = lookup.select(F.col(key).cast("string").alias("_known_key"), F.lit(-1).cast("long").alias("_known_salt"), *columns)
    salted = rows.withColumns({"_salt": salt.cast("long"), "_key": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    match = (F.col("_key") == F.col("_known_key")) & (F.col("_salt") == F.col("_known_salt"))
    return salted.join(right, match, "left").select(*rows.columns, *columns)
