"""Contact lists pasted from a spreadsheet, parsed line by line with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.expr import blank_to_null
from leadweave.functions.phones import normalize_phone


def _outside(cell: Column) -> Column:
    return cell != ""


def parse_contact_lines(lines: DataFrame, region: str = "CL", line: str = "line", order: str = "line_no") -> DataFrame:
    """Each non-blank line as a contact row; ``ok`` is false where no valid number was found.

    The first cell holding a valid number splits name (before) from status, time and notes
    (after). Lines without cells are searched for a number inside the text.
    """
    text = F.trim(F.regexp_replace(F.col(line), r"^[\s﻿]+|\s+$", ""))
    rows = lines.withColumn("_text", text).filter(F.col("_text") != "")
    rows = rows.withColumn("_cells", F.transform(F.split("_text", r"\t| {2,}"), lambda c: F.trim(c)))
    rows = rows.withColumn(
        "_phones", F.transform("_cells", lambda c: F.when(c.rlike(fv.PHONE_CELL_PATTERN), normalize_phone(c, region)))
    )
    at = F.try_element_at(F.filter(
        F.transform("_phones", lambda p, i: F.when(p.isNotNull(), i)), lambda i: i.isNotNull()), F.lit(1))
    rows = rows.withColumns({"_at": at, "_written": F.regexp_extract(line, fv.PHONE_IN_TEXT_PATTERN, 0)})
    rows = rows.withColumn("_found", F.when(F.col("_at").isNull() & (F.col("_written") != ""), normalize_phone("_written", region)))
    start = F.instr(F.col(line), F.col("_written"))
    in_text = F.array(
        F.trim(F.substring(F.col(line), F.lit(1), start - 1)), F.trim("_written"),
        F.trim(F.substring(F.col(line), start + F.length("_written"), F.length(line))),
    )
    rows = rows.withColumns({
        "_parts": F.when(F.col("_at").isNotNull(), F.col("_cells")).when(F.col("_found").isNotNull(), in_text),
        "_split": F.when(F.col("_at").isNotNull(), F.col("_at")).otherwise(F.lit(1)),
        "phone_e164": F.when(F.col("_at").isNotNull(), F.get("_phones", F.col("_at"))).otherwise(F.col("_found")),
    })
    after = F.filter(F.slice("_parts", F.col("_split") + 2, F.greatest(F.size("_parts"), F.lit(1))), _outside)
    rows = rows.withColumns({
        "_before": F.filter(F.slice("_parts", F.lit(1), F.col("_split")), _outside),
        "_notes": F.filter(after, lambda c: F.lower(c).isin(fv.NOTE_CELLS)),
        "_rest": F.filter(after, lambda c: ~F.lower(c).isin(fv.NOTE_CELLS)),
    })
    first = F.get("_rest", F.lit(0))
    rows = rows.withColumn("_status", F.when(first.isNotNull() & ~first.rlike(fv.TIME_CELL_PATTERN), first))
    when_cells = F.when(F.col("_status").isNotNull(), F.slice("_rest", F.lit(2), F.greatest(F.size("_rest"), F.lit(1)))).otherwise(F.col("_rest"))
    kept = [c for c in lines.columns if c != line]
    return rows.select(
        *kept, F.col("_text").alias("line"), F.col("phone_e164").isNotNull().alias("ok"),
        F.when(F.col("phone_e164").isNotNull(), F.coalesce(blank_to_null(F.array_join("_before", " ")), F.lit(fv.NO_NAME))).alias("name"),
        F.get("_parts", F.col("_split")).alias("phone_raw"), "phone_e164",
        F.lower("_status").alias("status"), blank_to_null(F.array_join(when_cells, ", ")).alias("contacted_on"),
        blank_to_null(F.array_join("_notes", ", ")).alias("note"),
    )


def import_totals(parsed: DataFrame, contacted: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Lines that add a contact, update one, hold no number; and stored leads flagged."""
    known = contacted.select("phone_e164", F.lit(True).alias("_known"))
    per_number = parsed.filter("ok").groupBy("phone_e164").agg(F.count("*").alias("n")).join(known, "phone_e164", "left")
    new = F.when(F.col("_known").isNull(), 1).otherwise(0)
    actions = per_number.select(F.lit("added").alias("action"), new.cast("long").alias("n")).unionByName(
        per_number.select(F.lit("updated").alias("action"), (F.col("n") - new).alias("n"))
    ).unionByName(parsed.filter(~F.col("ok")).groupBy().agg(F.count("*").alias("n")).select(F.lit("invalid").alias("action"), "n"))
    if flagged is not None:
        actions = actions.unionByName(flagged.groupBy().agg(F.count("*").alias("n")).select(F.lit("flagged").alias("action"), "n"))
    return actions.groupBy("action").agg(F.sum("n").alias("lines"))
