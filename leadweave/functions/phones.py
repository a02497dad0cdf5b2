"""Phone numbers as column functions over a numbering plan.

The plan is a table of one row per region: calling code, trunk prefix, valid national numbers,
possible mobiles and display grouping. ``DEFAULT_PLAN`` holds the regions of the fixed values;
``plan_from_table`` reads another one. Calling codes are free of each other's prefixes, so the one
code that begins a number is its longest match: the codes form one digit tree, written as one
pattern that looks at each leading digit once. Numbers of regions outside the plan come back
NULL, which follows the rule that an unconfirmed value is never invented.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.expr import ColumnLike, as_col, barrier, blank_to_null, drop_prefixed, exact_lookup, text_or_empty

#: Rows a plan may have; all calling codes and their regions are fewer than 300.
MAX_PLAN_ROWS = 1000


class PlanRow(NamedTuple):
    """One region: patterns are for national numbers, ``display`` pairs a pattern of the full number with its grouping."""

    region: str
    code: str
    trunk: str
    valid: str
    mobile: str
    display: tuple[tuple[str, str], ...]


def digit_tree(entries: Iterable[tuple[str, str]]) -> str:
    """One pattern for all (code, rest) pairs that branches on each digit of the codes once."""
    here, below = [], {}
    for code, rest in entries:
        if code:
            below.setdefault(code[0], []).append((code[1:], rest))
        else:
            here.append(f"(?:{rest})")
    return "(?:" + "|".join(here + [digit + digit_tree(below[digit]) for digit in sorted(below)]) + ")"


class NumberingPlan:
    """The patterns of a plan's rows. Regions that share a code are told apart in row order."""

    def __init__(self, rows: Iterable[PlanRow]):
        self.rows = [PlanRow(*row) for row in rows]
        codes = sorted({row.code for row in self.rows})
        for row in self.rows:
            if not re.fullmatch(r"[1-9]\d{0,2}", row.code) or not re.fullmatch(r"\d*", row.trunk):
                raise ValueError(f"region {row.region}: code {row.code!r}, trunk {row.trunk!r}")
        for shorter, longer in zip(codes, codes[1:]):
            if longer.startswith(shorter):
                raise ValueError(f"code {shorter} begins code {longer}")

    @cached_property
    def codes(self) -> dict[str, str]:
        return {row.region: row.code for row in self.rows}

    @cached_property
    def valid_full(self) -> str:
        return "^(" + digit_tree((row.code, row.valid) for row in self.rows) + ")$"

    @cached_property
    def mobile_full(self) -> str:
        return r"^\+?" + digit_tree((row.code, row.mobile) for row in self.rows if row.mobile) + "$"

    @cached_property
    def rewrites(self) -> list[tuple[str, str]]:
        """Trunk digits after a code go; then the legacy forms of single regions."""
        trunks = {row.trunk for row in self.rows if row.trunk}
        by_trunk = [(t, digit_tree((row.code, "") for row in self.rows if row.trunk == t)) for t in sorted(trunks)]
        return [(rf"^({tree}){trunk}(\d+)$", "$1$2") for trunk, tree in by_trunk] + fv.PHONE_REWRITES


DEFAULT_PLAN = NumberingPlan(fv.NUMBERING_PLAN)


def plan_from_table(plan: DataFrame, max_rows: int = MAX_PLAN_ROWS) -> NumberingPlan:
    """A plan from ``(region, code, trunk, valid, mobile, display array<struct<pattern, shown>>)`` rows.

    The patterns become part of the query, so the table is read once; more than ``max_rows`` rows are
    refused. Rows keep the order of column ``place`` where there is one, else of code and region.
    Null trunk, mobile or display stand for none.
    """
    order = ["place"] if "place" in plan.columns else ["code", "region"]
    rows = plan.orderBy(*order).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a numbering plan has at most {max_rows} rows")
    return NumberingPlan(
        PlanRow(r["region"], r["code"], r["trunk"] or "", r["valid"], r["mobile"] or "", tuple((x[0], x[1]) for x in r["display"] or ()))
        for r in rows)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def canonical_number(digits: ColumnLike) -> Column:
    """One spelling per number: MX legacy ``521`` and AR mobile ``549`` lose the extra digit."""
    plain = _digits(text_or_empty(digits))
    return F.regexp_replace(F.regexp_replace(plain, r"^521(\d{10})$", "52$1"), r"^549(\d{10})$", "54$1")


def number_key(raw: ColumnLike) -> Column:
    """Join key of a number; NULL under eight digits."""
    return F.when(F.length(_digits(as_col(raw))) >= 8, canonical_number(raw))


def _confirmed(full: Column, plan: NumberingPlan) -> Column:
    """E.164 form of full digits (country code first) after the trunk rewrites, NULL if not valid."""
    for pattern, modern in plan.rewrites:
        full = F.regexp_replace(full, pattern, modern)
    return F.concat(F.lit("+"), blank_to_null(F.regexp_extract(full, plan.valid_full, 1)))


def normalize_phone(raw: ColumnLike, region: ColumnLike = "CL", plan: NumberingPlan = DEFAULT_PLAN) -> Column:
    """E.164 form of a written number, or NULL when it cannot be confirmed.

    ``region`` is the default region of numbers written without country code: a region name or
    a Column of them.
    """
    region_col = F.lit(region) if isinstance(region, str) else region
    code = exact_lookup(F.upper(region_col), plan.codes)
    # The number starts at the first digit, plus or bracket; an extension after it is cut.
    core = F.regexp_replace(
        F.regexp_extract(text_or_empty(raw), r"(?s)([+0-9(].*)$", 1), r"(?i)\s*(?:ext\.?|anexo|x|#)\s*\d+\s*$", ""
    )
    digits = _digits(core)
    international = core.rlike(r"^\(?\+") | digits.rlike(r"^521\d{10}$")
    first = F.when(international, digits).otherwise(F.concat(code, digits))
    second = F.when(
        ~international,
        F.when(digits.startswith("00"), F.substring(digits, 3, 30)).when(digits.startswith(code), digits),
    )
    return F.when((digits != "") & ~core.rlike(r"\p{L}"), F.coalesce(_confirmed(first, plan), _confirmed(second, plan)))


def e164_digits(e164: ColumnLike) -> Column:
    return F.ltrim(as_col(e164), F.lit("+"))


def phone_region(e164: ColumnLike, default: ColumnLike = "CL", plan: NumberingPlan = DEFAULT_PLAN) -> Column:
    """Region of a confirmed number; the default when unknown."""
    plain = e164_digits(e164)
    digits = F.regexp_replace(plain, r"^521(\d{10})$", "52$1")
    chain = F.when(~digits.rlike(plan.valid_full), F.lit(None))
    for row in plan.rows:
        begins = plain.startswith(row.code)
        shared = sum(other.code == row.code for other in plan.rows) > 1
        chain = chain.when(begins & digits.rlike(f"^{row.code}(?:{row.valid})$") if shared else begins, F.lit(row.region))
    return F.coalesce(chain, F.lit(default) if isinstance(default, str) else default)


def is_probable_mobile(e164: ColumnLike, plan: NumberingPlan = DEFAULT_PLAN) -> Column:
    """Could this number be a mobile (and so open a chat)? Never NULL."""
    return F.coalesce(as_col(e164).rlike(plan.mobile_full), F.lit(False))


def pretty_number(digits: ColumnLike, plan: NumberingPlan = DEFAULT_PLAN) -> Column:
    """Number grouped for reading: ``56993557317`` becomes ``+56 9 9355 7317``.

    The first rule of the number's code that fits counts; only rules of that code are tried.
    """
    plain = e164_digits(digits)
    shown = None
    for code in dict.fromkeys(plan.codes.values()):
        grouped = plain
        for pattern, form in (rule for row in plan.rows if row.code == code for rule in row.display):
            grouped = F.regexp_replace(grouped, pattern, form)
        begins = plain.startswith(code)
        shown = F.when(begins, grouped) if shown is None else shown.when(begins, grouped)
    shown = plain if shown is None else shown.otherwise(plain)
    return F.when(
        F.length(plain) > 0, F.when(plain.rlike(r"^\d+$"), F.regexp_replace(shown, r"^(?=\d)", "+")).otherwise(F.concat(F.lit("+"), plain))
    )


def phone_from_tel(href: ColumnLike, region: ColumnLike = "CL", plan: NumberingPlan = DEFAULT_PLAN) -> Column:
    """E.164 number of a ``tel:`` or ``callto:`` link."""
    from leadweave.functions.urls import unquote

    target = F.regexp_extract(text_or_empty(href), r"(?is)^\s*(?:tel|callto):(.*)", 1)
    return normalize_phone(F.regexp_extract(unquote(target), r"(?s)^([^?]*)", 1), region, plan)


def contact_digits(raw: ColumnLike) -> Column:
    """Digits written in a contact link (percent-decoded)."""
    from leadweave.functions.urls import unquote

    return _digits(unquote(text_or_empty(raw)))


def with_contact_number(df: DataFrame, raw: str, out: str, region: ColumnLike = "CL", plan: NumberingPlan = DEFAULT_PLAN) -> DataFrame:
    """Adds ``<out>_number``, ``<out>_note`` and ``<out>_broken`` for the number of a contact link (F16).

    All NULL when it is no number. A link without country code is completed with the region's
    and flagged broken: as published it does not open the chat.
    """
    t = "_cn_" + out + "_"
    region_col = F.lit(region) if isinstance(region, str) else region
    df = df.withColumn(t + "d", contact_digits(raw))
    df = df.withColumns({
        t + "full": e164_digits(_confirmed(F.col(t + "d"), plan)),
        t + "local": e164_digits(normalize_phone(t + "d", region_col, plan)),
    })
    d, full, local = F.col(t + "d"), F.col(t + "full"), F.col(t + "local")
    legacy = (full != d) & (canonical_number(d) == full)
    df = df.withColumn(
        out + "_number", F.when(F.length(d) < 7, None).when(legacy, d).otherwise(F.coalesce(full, local))
    )
    number = F.col(out + "_number")
    rewritten = F.concat(F.lit("El enlace usa "), d, F.lit("; el formato correcto para WhatsApp es "), number, F.lit("."))
    without_code = F.concat(
        F.lit("El número del enlace no trae código de país ("), d, F.lit("); se completó con el de "), F.upper(region_col),
        F.lit(". Tal como está en la web, ese botón no abre el chat correcto."),
    )
    df = df.withColumns({
        out + "_note": F.when(number.isNull() | (number == d), None).when(full.isNotNull(), rewritten).otherwise(without_code),
        out + "_broken": F.when(number.isNotNull(), full.isNull()),
    })
    return barrier(drop_prefixed(df, t), out + "_number", out + "_note", out + "_broken")


PHONE_CANDIDATE_PATTERN = (
    r"(?<![\w+.,/-])(\+?(?:\(\+?\d{1,4}\)[ .-]?|\d{1,4}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,11}(?:[ .-]\d{1,8}){0,4})(?![\w-])"
)


def phones_in_text(text: ColumnLike, region: ColumnLike = "CL", plan: NumberingPlan = DEFAULT_PLAN) -> Column:
    """Valid numbers written in a text, distinct, in order of appearance."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(PHONE_CANDIDATE_PATTERN), F.lit(1))
    long_enough = F.filter(found, lambda c: F.length(_digits(c)).between(7, 15))
    numbers = F.transform(long_enough, lambda c: normalize_phone(c, region, plan))
    return F.array_distinct(F.filter(numbers, lambda p: p.isNotNull()))
