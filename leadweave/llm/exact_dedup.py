"""Exact deduplication: sorted runs of text digests, merged in rounds.

Column functions only. Every row becomes (digest, length, second digest, doc_id); no text is
shuffled. Rows are first sorted and combined into runs, one for each group of input partitions; in
binomial rounds run r then meets run r XOR 2^k, and the two are merged in digest order, until one run is
left. Every level keeps, for each text, the identifier that survives and the number of rows. A run is
not one task: it is spread over the shuffle by digest, so the last run of a large table is as parallel
as the first.

A digest alone doesn't decide: the length in characters and an independent 64-bit hash are part of the
key at every level, so two texts are called equal only where all three agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import Hidden

DIGEST = ["_sha", "_length", "_check"]


def text_digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the binary SHA-256, the length and a 64-bit hash of its text. Null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", F.unhex(F.sha2(text.cast("binary"), 256)).alias("_sha"), F.length(text).alias("_length"), F.xxhash64(text).alias("_check"))


def merged_runs(digests: DataFrame, id_col: str, keep: str = "max", rounds: int = 4) -> DataFrame:
    """One row for each text: its digest columns, ``keep_id`` and ``group_size``.

    Tasks sort their rows by digest and combine equal ones before anything is shuffled, so a text with
    very many copies leaves each task as one row. That gives ``2 ** rounds`` sorted runs. In round k the
    runs r and r XOR 2^k meet: both are dealt by digest, sorted and merged, and of equal keys the
    surviving identifier and the number of rows stay. The survivor is kept with a flag before it, so a
    null identifier loses; such a pair has no hash aggregate, which makes every level a sort and a merge.
    """
    best = F.max if keep == "max" else F.min
    known = F.col(id_col).isNotNull() if keep == "max" else F.col(id_col).isNull()
    rows = digests.select(F.pmod(F.spark_partition_id(), F.lit(1 << rounds)).alias("_run"), *DIGEST, F.struct(known.alias("flag"), F.col(id_col).alias("id")).alias("_best"))
    run = rows.groupBy("_run", *DIGEST).agg(best("_best").alias("_best"), F.count("*").alias("group_size"))
    for k in range(rounds):
        met = run.withColumn("_run", F.col("_run").bitwiseAND(F.lit(~(1 << k)))).repartition("_run", "_sha")
        run = met.groupBy("_run", *DIGEST).agg(best("_best").alias("_best"), F.sum("group_size").alias("group_size"))
    return run.select(*DIGEST, F.col("_best.id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    * A null text equals the empty text. Texts are compared as they are.
    * Of equal texts the row with the largest (``keep="max"``) or smallest identifier stays; null
      identifiers lose against any other, and where all are null all those rows stay.
    * Rows that repeat identifier and text are one document and share their decision.
    * An empty table gives an empty result. Other columns pass through, except those with the four
      result names, which are replaced.
    """
    hidden = Hidden(docs.drop("keep_id", "group_size", "kept", "text_sha256"))
    plain = hidden.docs
    rows = text_digests(plain, text_col)
    # Only texts with copies need the lookup: a row without a match is the only one of its text. Where one text holds
    # very many rows, adaptive execution splits that side of the join; the other has one row for each text.
    copies = merged_runs(text_digests(plain.select(id_col, text_col), text_col), id_col, keep).where("group_size > 1")
    found = rows.join(copies, DIGEST, "left")
    size = F.coalesce("group_size", F.lit(1))
    return found.select(
        *hidden.columns(), F.when(size > 1, F.col("keep_id")).otherwise(F.col(id_col)).alias("keep_id"), size.cast("long").alias("group_size"),
        (F.when(size > 1, F.col("keep_id")).otherwise(F.col(id_col)).eqNullSafe(F.col(id_col))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows whose text another row keeps, with the columns of ``docs``."""
    hidden = Hidden(docs, ("keep_id", "group_size", "kept", "text_sha256"))
    return exact_dedup(hidden.docs, id_col, text_col, keep).where("kept").select(*hidden.columns())
