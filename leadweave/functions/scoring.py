"""Scores from fixed tables, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.expr import ColumnLike, as_col


def speed_score(load_ms: ColumnLike, psi: ColumnLike) -> Column:
    """Score of parameter 5: the page-speed figure rounded half to even, else bands of seconds; NULL unmeasured."""
    seconds = as_col(load_ms) / F.lit(1000.0)
    bands = F.when(F.lit(False), F.lit(None).cast("int"))
    for limit, points in fv.SPEED_BANDS:
        bands = bands.when(seconds < limit, points)
    by_psi = F.greatest(F.lit(1), F.bround(as_col(psi).cast("double") / F.lit(10.0)).cast("int"))
    return F.when(as_col(psi).isNotNull(), by_psi).when(as_col(load_ms).isNotNull(), bands.otherwise(fv.SPEED_REST))


def speed_reason(load_ms: ColumnLike, psi: ColumnLike) -> Column:
    shown = F.replace(F.format_string("%.1f", as_col(load_ms) / F.lit(1000.0)), F.lit("."), F.lit(","))
    return F.when(
        as_col(psi).isNotNull(), F.concat(F.lit("PageSpeed móvil: "), as_col(psi).cast("string"), F.lit("/100."))
    ).when(
        as_col(load_ms).isNotNull(),
        F.concat(F.lit("Cargó en "), shown, F.lit(" s (medido desde este computador: es referencial).")),
    )


def links_score(errors: ColumnLike) -> Column:
    """Score of parameter 9 by number of broken links and buttons."""
    bands = F.when(F.lit(False), F.lit(None).cast("int"))
    for limit, points in fv.LINK_BANDS:
        bands = bands.when(as_col(errors) <= limit, points)
    return bands.otherwise(fv.LINK_REST)


def links_reason(errors: ColumnLike) -> Column:
    n = as_col(errors)
    return F.when(n == 0, "Ningún enlace o botón roto.").otherwise(
        F.concat(n.cast("string"), F.lit(" enlace(s) o botón(es) que no funcionan."))
    )


def opportunity_level(score: ColumnLike, own_site: Column, rating: ColumnLike, reviews: ColumnLike) -> Column:
    good = (F.coalesce(as_col(rating), F.lit(0.0)) >= fv.GOOD_RATING) & (F.coalesce(as_col(reviews), F.lit(0)) >= fv.GOOD_REVIEWS)
    by_reputation = F.when(good, "ALTA").otherwise("MEDIA")
    return (
        F.when(~own_site, by_reputation)
        .when(as_col(score).isNull(), None)
        .when(as_col(score) < fv.HIGH_SCORE_BELOW, by_reputation)
        .when(as_col(score) < fv.LOW_SCORE_FROM, "MEDIA")
        .otherwise("BAJA")
    )
