"""Text, label, message and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.expr import ColumnLike, as_col, blank_to_null, exact_lookup

# FIXED VALUES: accented Latin letters and their plain form, position by position.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīŁłŃńŇňŌōŐőŘřŚśŞşŠšŢţŤťŪūŮůŰűŹźŻżŽž"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiLlNnNnOoOoRrSsSsSsTtTtUuUuUuZzZzZz"


def fold_accents(text: ColumnLike) -> Column:
    """Plain letters, case kept (F17). Combining marks are dropped as well."""
    return F.translate(F.regexp_replace(as_col(text), r"\p{M}", ""), ACCENTED, UNACCENTED)


def collapse_spaces(text: ColumnLike) -> Column:
    """Runs of white space become one blank; NULL when nothing is left."""
    return blank_to_null(F.trim(F.regexp_replace(F.coalesce(as_col(text), F.lit("")), r"(?U)\s+", " ")))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


# ------------------------------------------------------------------ F18, F19
def address_locality(address: ColumnLike) -> Column:
    """Locality of a postal address, read from the right; the street, regions and countries are skipped."""
    parts = F.filter(F.transform(F.split(F.coalesce(as_col(address), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")

    tail = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    names = F.transform(tail, lambda p: F.trim(F.regexp_replace(p, fv.POSTAL_CODE_PATTERN, "")))
    kept = F.filter(names, lambda n: (n != "") & ~n.rlike(r"\d") & ~n.rlike(fv.NOT_LOCALITY_PATTERN))
    return F.try_element_at(kept, F.lit(-1))


def rating_from_label(label: ColumnLike) -> Column:
    value = F.regexp_extract(F.coalesce(as_col(label), F.lit("")), fv.RATING_LABEL_PATTERN, 1)
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def reviews_from_label(label: ColumnLike) -> Column:
    value = F.regexp_extract(F.coalesce(as_col(label), F.lit("")), fv.REVIEWS_LABEL_PATTERN, 1)
    return F.regexp_replace(value, r"\D", "").try_cast("int")


# ------------------------------------------------------------------ F20, F21
def copyright_years(text: ColumnLike) -> Column:
    """Distinct sorted years of copyright notices; a range counts with its end year."""
    source = F.coalesce(as_col(text), F.lit(""))
    found = F.concat(*[F.regexp_extract_all(source, F.lit(fv.COPYRIGHT_PATTERN), F.lit(group)) for group in (1, 2, 3)])
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda y: y != ""), lambda y: y.cast("int"))))


def snippet(line: Column, pattern: str, width: int = fv.SNIPPET_WIDTH) -> Column:
    """Up to ``width`` characters around the first match, with ellipses where text was cut."""
    start = F.greatest(F.regexp_instr(line, F.lit(pattern)) - 1 - width // 2, F.lit(0))
    cut = F.concat(
        F.when(start > 0, "…").otherwise(""),
        F.trim(F.substring(line, start + 1, F.lit(width))),
        F.lit("…"),
    )
    return F.when(F.length(line) <= width, line).otherwise(cut)


# ------------------------------------------------------------------ F22 - F25, F32
def page_words(title: ColumnLike, text: ColumnLike) -> Column:
    """Title and text in plain lower-case letters, as the dead-site patterns expect them."""
    return F.lower(fold_accents(F.concat(F.coalesce(as_col(title), F.lit("")), F.lit("\n"), F.coalesce(as_col(text), F.lit("")))))


def dead_reason_of(words: Column, text: ColumnLike, placeholder_length: int = fv.PLACEHOLDER_MAX_TEXT) -> Column:
    """``dead_site_reason`` over words already prepared (they are tested several times). Only a text of at most ``placeholder_length`` characters can be a placeholder."""
    short = F.length(F.coalesce(as_col(text), F.lit(""))) <= placeholder_length
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for reason, pattern in fv.DEAD_SITE_PATTERNS.items():
        chain = chain.when(words.rlike(pattern), reason)
    for reason, pattern in fv.PLACEHOLDER_PATTERNS.items():
        chain = chain.when(short & words.rlike(pattern), reason)
    return chain


def dead_site_reason(title: ColumnLike, text: ColumnLike) -> Column:
    """Why a page that loads is no real site, else NULL."""
    return dead_reason_of(page_words(title, text), text)


def is_bot_wall(title: ColumnLike, text: ColumnLike, head_length: int = fv.BOT_WALL_TEXT) -> Column:
    """A wall says so in its title or in the first ``head_length`` characters; farther down the words are content (a rule of the product)."""
    head = F.substring(F.coalesce(as_col(text), F.lit("")), 1, head_length)
    return F.concat(F.coalesce(as_col(title), F.lit("")), F.lit("\n"), head).rlike(fv.BOT_WALL_PATTERN)


def needs_render(text: ColumnLike, least: int = fv.RENDER_MIN_TEXT) -> Column:
    return F.length(F.trim(F.coalesce(as_col(text), F.lit("")))) < least


def http_error_reason(status: ColumnLike) -> Column:
    code = as_col(status).cast("int")
    words = F.coalesce(exact_lookup(code, fv.HTTP_REASONS), F.lit(fv.HTTP_REASON_OTHER))
    return F.concat(F.lit("La web responde con error "), code.cast("string"), F.lit(" ("), words, F.lit(")"))


def _mentions(text: Column, hints: list[str]) -> Column:
    hit = text.contains(hints[0])
    for hint in hints[1:]:
        hit = hit | text.contains(hint)
    return hit


def friendly_error(error_type: ColumnLike, message: ColumnLike, most: int = 300) -> Column:
    """A failure message in plain words; unknown ones keep their type and first line, of ``most`` characters."""
    text = F.coalesce(as_col(message), F.lit(""))
    chain = F.when(as_col(error_type) == "ReviewTimeout", text)
    for hints, words in fv.FRIENDLY_ERRORS:
        chain = chain.when(_mentions(text, hints), words)
    first_line = F.substring(F.regexp_extract(text, r"^([^\n\r]*)", 1), 1, most)
    return chain.otherwise(F.concat(as_col(error_type), F.lit(": "), first_line))


def connect_reason(message: ColumnLike) -> Column:
    text = F.lower(F.coalesce(as_col(message), F.lit("")))
    return (
        F.when(_mentions(text, fv.DNS_HINTS), fv.DNS_REASON)
        .when(_mentions(text, fv.REFUSED_HINTS), fv.REFUSED_REASON)
        .otherwise(fv.NO_CONNECTION_REASON)
    )


def browser_error_reason(message: ColumnLike) -> Column:
    text = F.coalesce(as_col(message), F.lit(""))
    return (
        F.when(text.contains("ERR_CERT") | text.contains("SSL"), fv.TLS_REASON)
        .when(text.contains("ERR_NAME_NOT_RESOLVED"), fv.DNS_REASON)
        .when(text.contains("ERR_CONNECTION_REFUSED"), fv.REFUSED_REASON)
        .when(text.contains("Timeout") | text.contains("ERR_TIMED_OUT"), fv.LOAD_TIMEOUT_REASON)
        .otherwise(fv.BROWSER_REASON)
    )


def block_reason(url: ColumnLike, text: ColumnLike) -> Column:
    """Why a listing page is a block page: by address first, then by text (F32)."""
    found = F.regexp_extract(F.coalesce(as_col(text), F.lit("")), fv.BLOCK_TEXT_PATTERN, 0)
    return (
        F.when(F.coalesce(as_col(url), F.lit("")).rlike(fv.BLOCK_URL_PATTERN), "Google mostró su página de verificación (captcha).")
        .when(found != "", F.concat(F.lit('Google mostró un aviso de bloqueo ("'), found, F.lit('").')))
    )


# ------------------------------------------------------------------ F26 - F28
def local_day(moment: ColumnLike, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(as_col(moment), tz))


def local_time(moment: ColumnLike, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(as_col(moment), tz), "dd-MM-yyyy HH:mm")


def spanish_date(day: ColumnLike) -> Column:
    """``sábado 4 de octubre``."""
    d = as_col(day)
    days = F.array(*[F.lit(x) for x in fv.DAY_NAMES])
    months = F.array(*[F.lit(x) for x in fv.MONTH_NAMES])
    return F.concat(
        F.element_at(days, F.weekday(d) + 1), F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(" de "),
        F.element_at(months, F.month(d)),
    )


def decimal_comma(value: ColumnLike) -> Column:
    number = as_col(value).cast("double")
    return F.when(number.isNotNull(), F.replace(F.format_string("%.1f", number), F.lit("."), F.lit(",")))


def provenance_text(value: ColumnLike) -> Column:
    """Readable source of one field: known names are translated, others shown as they are."""
    text = as_col(value)
    return F.coalesce(exact_lookup(text, fv.SOURCE_NAMES), text)


def provenance_list_text(values: ColumnLike) -> Column:
    items = as_col(values)
    return F.when(F.size(items) > 0, F.array_join(items, " · ")).otherwise("ninguno")


# ------------------------------------------------------------------ F30
_ENTITIES = {
    # FIXED VALUES: the entities that occur inside links and attribute values.
    "&quot;": '"', "&#34;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">",
    "&#47;": "/", "&#x2f;": "/", "&#x2F;": "/", "&sol;": "/", "&equals;": "=", "&#61;": "=", "&#63;": "?",
    "&nbsp;": " ", "&amp;": "&", "&#38;": "&", "&#x26;": "&",
}


def unescape_entities(text: Column) -> Column:
    column = text
    for entity, char in _ENTITIES.items():
        column = F.replace(column, F.lit(entity), F.lit(char))
    # Numeric references of any letter: each distinct one is replaced once.
    numeric = F.array_distinct(F.regexp_extract_all(column, F.lit(r"(&#(?:[0-9]{2,5}|[xX][0-9A-Fa-f]{2,4});)"), F.lit(1)))

    def letter(reference: Column) -> Column:
        digits = F.regexp_extract(reference, r"#[xX]?([0-9A-Fa-f]+)", 1)
        number = F.when(reference.rlike("#[xX]"), F.conv(digits, 16, 16)).otherwise(F.conv(digits, 10, 16))
        return F.when(number.rlike("^(?:[0-9A-C]?[0-9A-F]{1,3}|D[0-7][0-9A-F]{2}|[EF][0-9A-F]{3})$"), F.decode(F.unhex(F.lpad(number, 4, "0")), "UTF-16BE")).otherwise(reference)

    decoded = F.aggregate(numeric, column, lambda done, reference: F.replace(done, reference, letter(reference)))
    return F.when(text.contains("&#"), decoded).when(text.contains("&"), column).otherwise(text)


def scan_variants(text: Column) -> Column:
    """The text with entities and JSON slashes resolved, plus its percent-decoded form when different."""
    from leadweave.functions.urls import unquote

    plain = unescape_entities(text)
    for escaped in ("\\/", "\\u002F", "\\u002f"):
        plain = F.replace(plain, F.lit(escaped), F.lit("/"))
    return F.array_distinct(F.array(plain, unquote(plain)))
