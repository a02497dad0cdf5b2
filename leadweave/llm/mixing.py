"""Mixing sources to target weights by weighted fair queueing.

Column functions only. Every source queues its documents in shuffled order, as often as it may
repeat; a document's virtual finish time is the source's words up to and including it, divided by
the source's target. The merged queue is served in order of finish time until the total budget is
spent, so all sources advance together and each ends near its target.

No source, however large, is summed or sorted in one task: the shuffled order is cut into blocks by
its leading bits, blocks are summed first, and running sums start from the blocks before. The global
order is cut by finish time in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.common import SPACES, Hidden, ranked, stage

WEIGHTS = (3, 1, 2)
_BEFORE = Window.unboundedPreceding, -1


def word_count(text: F.Column) -> F.Column:
    """Number of words between x20 and x09 to x0D; 0 for null."""
    marks = F.translate(F.regexp_replace(text, f"[^{SPACES}]+", "x"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """``source, source_size, target`` for each source of ``sizes`` (``source, size``).

    Sources by code point, null last, weigh ``weights`` in turn and share ``budget_share`` of all
    words; no target passes ``max_repeats`` times its source, and the rest is shared anew by weight
    until none does. Each round finds the level that the open sources share from three sums; a
    source that would pass its limit is closed. Rounds end because each closes at least one source,
    and in practice after two or three.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    table = stage(ranked(per_source, order, "_rank").select("source", "source_size", weight.alias("weight")), "sources")
    limit = F.col("source_size") * float(max_repeats)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, closed = 0.0, -1
    while True:  # a handful of scalars comes back, whatever the number of sources
        shut = limit <= F.lit(level) * F.col("weight")
        row = table.agg(
            F.coalesce(F.sum(F.when(shut, limit)), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~shut, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(shut).alias("closed")).first()
        if row["closed"] == closed or not row["open"]:
            break
        closed, level = row["closed"], (budget_share * total - row["taken"]) / row["open"]
    return table.select("source", "source_size", F.least(limit, F.lit(level) * F.col("weight")).alias("target"))


def _named(docs: DataFrame, source_col: str) -> DataFrame:
    """Sources as join keys: a null source has a mark of its own."""
    return docs.withColumn("_none", F.col(source_col).isNull()).withColumn("_source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS,
        budget_share: float = 1.5, max_repeats: int = 2, block_bits: int = 10, time_bits: int = 12) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``taken``.

    * The shuffle is the order of md5 of the id, so reruns agree. Rows that repeat an id are queued
      one after the other, the smaller first; which of two equal rows is served first doesn't matter.
    * ``taken`` is 0, the document's size, or a repeat of it, ``max_repeats`` times at most.
    * Null texts and texts without words have size 0 and are never taken. A null source is a source.
    * The document that crosses the budget isn't taken, so the mix never passes the budget.
    * An empty table gives an empty result; result columns replace columns of the same name.
    """
    hidden = Hidden(docs.drop("size", "source_size", "target", "taken"))
    plain = hidden.docs
    who, place = ["_none", "_source"], ["_key", "_size"]

    def queue(rows: DataFrame) -> DataFrame:
        key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
        block = F.shiftright(F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"), 16 - block_bits)
        return _named(rows, source_col).withColumn("_size", word_count(F.col(text_col))).withColumn("_key", key).withColumn("_block", block)

    # Words of a source before each block of its shuffled order, from sums over blocks.
    narrow = stage(queue(plain.select(id_col, source_col, text_col)).select(*who, *place, "_block", F.col(source_col).cast("string").alias("source")), "sizes")
    targets = source_targets(narrow.select("source", F.col("_size").alias("size")), weights, budget_share, max_repeats)
    goals = _named(targets, "source").select(*who, "source_size", "target")
    blocks = narrow.groupBy(*who, "_block").agg(F.sum("_size").alias("_words"))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy(*who).orderBy("_block").rowsBetween(*_BEFORE)), F.lit(0))
    starts = stage(blocks.withColumn("_start", before).join(goals, who).drop("_words"), "starts")

    def finished(rows: DataFrame) -> DataFrame:
        """Add the virtual finish time of each pass as ``_times``; null where nothing is to be taken."""
        inside = F.sum("_size").over(Window.partitionBy(*who, "_block").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
        done = rows.join(starts, [*who, "_block"]).withColumn("_done", F.col("_start") + inside)
        time = [(F.col("source_size") * p + F.col("_done")) / F.col("target") for p in range(max_repeats)]
        return done.withColumn("_times", F.when((F.col("_size") > 0) & (F.col("target") > 0), F.array(*time)))

    # The end of the budget in the global order of finish times: by slots of time first, then inside the one slot where it ends.
    entries = finished(narrow).select(*who, *place, F.posexplode("_times").alias("_pass", "_finish"))
    slot = F.floor(F.least(F.col("_finish"), F.lit(4.0)) * (1 << time_bits)).cast("int")
    entries = stage(entries.withColumn("_slot", slot), "entries")
    budget = (targets.agg(F.sum("source_size")).first()[0] or 0) * budget_share
    slots = entries.groupBy("_slot").agg(F.sum("_size").alias("_words")).withColumn("_sum", F.sum("_words").over(Window.orderBy("_slot")))
    edge = slots.where(F.col("_sum") > budget).agg(F.min(F.struct("_slot", (F.col("_sum") - F.col("_words")).alias("before"))).alias("edge")).first()["edge"]
    place_of = lambda finish, number: F.struct(finish.alias("finish"), *[F.col(c) for c in who], F.col("_key"), number.alias("pass"), F.col("_size"))
    if edge is None:
        served = lambda finish, number: F.lit(True)
    else:
        last = entries.where(F.col("_slot") == edge["_slot"]).withColumn("_place", place_of(F.col("_finish"), F.col("_pass")))
        running = F.sum("_size").over(Window.partitionBy("_slot").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
        end = last.withColumn("_sum", running + edge["before"]).where(F.col("_sum") <= budget).agg(F.max("_place").alias("end")).first()["end"]
        if end is None:
            served = lambda finish, number: finish * (1 << time_bits) < edge["_slot"]
        else:
            limit = F.struct(F.lit(end["finish"]).alias("finish"), F.lit(end["_none"]).alias("_none"), F.lit(end["_source"]).alias("_source"),
                             F.lit(end["_key"]).alias("_key"), F.lit(end["pass"]).alias("pass"), F.lit(end["_size"]).alias("_size"))
            served = lambda finish, number: place_of(finish, number) <= limit
    passes = [F.when(served(F.col("_times")[p], F.lit(p)), 1).otherwise(0) for p in range(max_repeats)]
    times = F.when(F.col("_times").isNotNull(), sum(passes[1:], passes[0])).otherwise(0)
    return finished(queue(plain)).select(
        *hidden.columns(), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * times).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    hidden = Hidden(docs, ("size", "source_size", "target", "taken"))
    mixed = mix(hidden.docs, **options).where("taken > 0")
    return mixed.select("*", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))).alias("_copy")).select(*hidden.columns())
