"""Small expression combinators.

Two kinds of building blocks are used throughout:

* *column functions* take Columns and return a Column. They may mention their input several
  times, so they expect a plain column rather than a long expression;
* *frame functions* (``with_...``) chain column functions through intermediate columns. Each
  step is a projection, so the expression tree stays small and the whole chain runs inside
  one generated-code stage.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_or_empty(value: ColumnLike) -> Column:
    return F.coalesce(as_col(value), F.lit(""))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def suffix_lookup(host: Column, table: Mapping[str, str | int]) -> Column:
    """Value of the first domain of ``table`` that equals ``host`` or is a dotted suffix of it.

    The table is a handful of fixed domains, so a chain of comparisons inside generated code
    replaces exploding host suffixes into a join (and the shuffle to fold them back).
    """
    chain = F.when(F.lit(False), F.lit(None))
    for domain, value in table.items():
        chain = chain.when((host == domain) | host.endswith("." + domain), F.lit(value))
    return chain


def exact_lookup(key: Column, table: Mapping, default: Column | None = None) -> Column:
    chain = F.when(F.lit(False), F.lit(None))
    for known, value in table.items():
        chain = chain.when(key == known, F.lit(value))
    return chain if default is None else chain.otherwise(default)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_true(condition: Column) -> Column:
    """Two-valued logic: NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def barrier(df: DataFrame, *names: str) -> DataFrame:
    """Keep later filters and join keys on ``names`` above the projections that compute them.

    Catalyst moves a predicate below a projection by writing the projected expression out in
    its place. Over a chain of string rewrites that multiplies the expression at every step;
    a predicate on the output of a generator stays where it is. It also keeps a column that is
    used inside an array lambda from being written out there and computed once per element. One
    struct per row, generated code, no exchange.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])
