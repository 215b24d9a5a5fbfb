"""What kind of value a text is, value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from limpid.functions.literals import is_literal_collection
from limpid.functions.numbers import GROUPED, SPECIAL, loose_number

BOOLEANS = ["true", "false", "t", "f", "yes", "no", "y", "n"]
# Units and currencies that may stand beside a number.
UNITS = [
    "$", "€", "¥", "£", "USD", "EUR", "~", "+/-", ">=", "<=",
    "%", "percent",
    "kg", "lbs", "oz", "oz.", "ounce", "g", "t", "stone",
    "C", "F",
    "cm", "m", "km", "miles", "yd", "mm",
    "s", "sec", "second", "seconds", "min", "minutes", "h", "hours", "d", "days", "yrs", "years",
    "km/h", "mph", "m/s", "knots",
    "V", "Volt", "W", "watt", "Hz", "dB", "Ω",
    "pcs", "items", "units", "dozen",
    "times",
]
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it", "its", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "we", "were", "will", "with", "you"]
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DAY = r"(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?"
CLOCK = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?: ?[ap]m)?(?: ?z|[+-][0-9]{2}:?[0-9]{2})?"
#: Dates are told by shape: ISO, day and month numbers, month names, weekdays, clock times.
DATE_SHAPE = (
    rf"(?i)^(?:{DAY},? )?(?:"
    r"[0-9]{4}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])"
    r"|(?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])[-/.](?:[0-9]{4}|[0-9]{2})"
    r"|(?:0?[1-9]|[12][0-9]|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:[0-9]{4}|[0-9]{2})"
    rf"|(?:[0-9]{{1,2}}[ -])?{MONTH}\.?(?:[ -][0-9]{{1,2}})?(?:,?[ -][0-9]{{4}})?"
    rf")(?:[ t]{CLOCK})?$|(?i)^{CLOCK}$|(?i)^{DAY}$"
)
DELIMITERS = [",", ";", "|", "/", "\\"]


def is_boolean(c: Column) -> Column:
    return F.lower(c).isin(BOOLEANS)


def is_number(c: Column) -> Column:
    text = F.replace(c, F.lit(","), F.lit(""))
    return text.rlike(GROUPED) | text.rlike(SPECIAL)


def is_integer(c: Column) -> Column:
    """A number with no fraction, commas removed: ``1,234`` and ``2.0`` count, ``nan`` does not."""
    x = loose_number(c)
    return F.coalesce(~F.isnan(x) & (x == F.floor(x)) & (F.abs(x) < float("inf")), F.lit(False))


def is_float(c: Column) -> Column:
    return is_number(c) & ~is_integer(c)


def is_datetime(c: Column) -> Column:
    return F.trim(c).rlike(DATE_SHAPE)


def _first_number(text: Column) -> tuple[Column, Column, Column]:
    at = F.regexp_instr(text, F.lit(r"[-+]?[0-9]*\.?[0-9]+"))
    number = F.regexp_extract(text, r"[-+]?[0-9]*\.?[0-9]+", 0)
    before = F.trim(F.substr(text, F.lit(1), at - 1))
    after = F.trim(F.substr(text, at + F.char_length(number)))
    return number, before, after


def dirty_number(c: Column) -> Column:
    """``dirty_integer`` or ``dirty_float`` for a number beside a unit, in at most two words; else null."""
    text = F.trim(c)
    number, before, after = _first_number(text)
    shaped = (F.size(F.split(text, r"\s+")) <= 2) & (number != "") & (before.isin(UNITS) | after.isin(UNITS))
    return F.when(shaped, F.when(F.contains(number, F.lit(".")), "dirty_float").otherwise("dirty_integer"))


def is_delimited(c: Column) -> Column:
    """At least two non-empty parts around one of five delimiters; links and plain fractions are not."""
    text = F.trim(c)
    found = F.lit(False)
    for d in DELIMITERS:
        parts = F.split(text, "\\Q" + d + "\\E")
        ok = (F.size(parts) >= 2) & F.forall(parts, lambda p: F.trim(p) != "")
        if d == "/":
            ok = ok & ~text.rlike(r"^[0-9]+\s*/\s*[0-9]+$")
        found = found | ok
    return (text != "") & ~F.contains(text, F.lit("://")) & found


def entity_count(c: Column) -> Column:
    """Runs of two or more capitalised words: the default tagger. A model can be passed in its place."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"), F.lit(0)))


def text_class(c: Column, entities: Callable[[Column], Column] = entity_count) -> Column:
    """named_entity, natural_language_text or discrete_string."""
    text = F.trim(c)
    words = F.split(text, r"\s+")
    n = F.size(words)
    named = entities(text)
    first = F.regexp_extract(text, r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+", 0)
    covers = F.size(F.split(first, " ")) > n * 0.5
    stop = F.exists(words, lambda w: F.lower(w).isin(STOPWORDS))
    return (
        F.when(n == 1, "discrete_string")
        .when((n > 5) | (F.char_length(text) > 50), "natural_language_text")
        .when((named == 1) & covers, "named_entity")
        .when(named >= 1, "natural_language_text")
        .when(stop, "natural_language_text")
        .otherwise("discrete_string")
    )


def value_kind(c: Column) -> Column:
    """The kind of one text value; null for null and for blank text. The order of the tests matters."""
    return (
        F.when(is_boolean(c), "boolean")
        .when(is_integer(c), "integer")
        .when(is_float(c), "float")
        .when(c.isNull() | (F.trim(c) == ""), None)
        .when(is_datetime(c), "datetime")
        .when(dirty_number(c).isNotNull(), dirty_number(c))
        .when(is_literal_collection(c), "collection")
        .when(is_delimited(c), "delimited_string")
        .otherwise(text_class(c))
    )


def zero_one(c: Column) -> Column:
    return F.trim(c).isin("0", "1", "0.0", "1.0")
