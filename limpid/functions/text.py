"""Text shapes, masks and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a text reader takes for a missing value.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Placeholders that cleaning unifies to null, compared trimmed and in lower case.
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "nan", "null", "{null}", "none", "nil", "missing", "unknown", "tbd", "empty", "not available", "no comment", "xxxxx", "00-00-0000", "--:--"]
CUT_AT = 50


def null_token_to_null(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def placeholder_to_null(c: Column, more: tuple[str, ...] = ()) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(PLACEHOLDERS + [m.lower() for m in more]), c)


def shortened(c: Column, at: int = CUT_AT) -> Column:
    return F.when(F.char_length(c) > at, F.concat(F.substring(c, 1, at), F.lit("..."))).otherwise(c)


def noise_mask(c: Column) -> Column:
    """The text with each number replaced by ``{N}``; null where it is nothing but a number."""
    text = F.trim(c)
    return F.when(~text.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.regexp_replace(text, r"[0-9]+(\.[0-9]+)?", "{N}"))


def signature(c: Column) -> Column:
    """The text's shape as an anchored pattern, runs of a class counted: ``Brand#17`` is ``^[A-Z][a-z]{4}\\#\\d{2}$``.

    Each step is one regexp_replace over marker characters of the private use
    area, so the whole stays inside generated code.
    """
    digit, upper, lower, space, other = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
    x = F.regexp_replace(c, r"([()\[\]{}?*+\-|^$\\.&~#])", other + "$1")  # special characters are escaped
    for pattern, mark in ((r"\p{Nd}", digit), (r"\p{Lu}", upper), (r"\p{Ll}", lower), (r"\s", space)):
        x = F.regexp_replace(x, pattern, mark)
    runs = F.regexp_extract_all(x, F.lit("(\ue004[\\s\\S]|[\\s\\S])\\1*"), F.lit(0))
    class_of = {digit: "\\d", upper: "[A-Z]", lower: "[a-z]", space: "\\s"}

    def shown(run: Column) -> Column:
        escaped = F.substring(run, 1, 1) == other
        n = F.when(escaped, F.char_length(run) / 2).otherwise(F.char_length(run)).cast("int")
        unit = F.when(escaped, F.concat(F.lit("\\"), F.substring(run, 2, 1)))
        for mark, name in class_of.items():
            unit = unit.when(F.substring(run, 1, 1) == mark, F.lit(name))
        unit = unit.otherwise(F.substring(run, 1, 1))
        return F.concat(unit, F.when(n > 1, F.concat(F.lit("{"), n.cast("string"), F.lit("}"))).otherwise(F.lit("")))

    return F.concat(F.lit("^"), F.array_join(F.transform(runs, shown), ""), F.lit("$"))


def quoted(c: Column, is_number: bool = False) -> Column:
    """A cell as reports show it: text in quotes, numbers bare, missing as NaN."""
    shown = c.cast("string") if is_number else F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit("'")), F.lit('"'))
    return F.coalesce(shown, F.lit("NaN"))


def change_line(dirty: list[Column], cleaned: list[Column]) -> Column:
    """``"a", "b" => "c", "d"`` for the cells of one row before and after."""
    return F.concat(F.concat_ws(", ", *map(quoted, dirty)), F.lit(" => "), F.concat_ws(", ", *map(quoted, cleaned)))


def row_text(columns: list[Column]) -> Column:
    """Several cells as one text, missing ones as ``nan``."""
    return F.concat_ws(", ", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns])


def percent(c: Column) -> Column:
    """A share as ``12.3%``; undefined as a dash."""
    return F.coalesce(F.concat(F.format_number(c * 100, 1), F.lit("%")), F.lit("—"))


def strip_markup(c: Column) -> Column:
    """Free text without tags, links, symbols outside the basic plane and doubled blanks."""
    x = F.regexp_replace(c, r"<[^>]*>", " ")
    x = F.regexp_replace(x, r"https?://[^ \t\n\r<>]+", " ")
    x = F.regexp_replace(x, "[\\x{10000}-\\x{10FFFF}\\x{FFFD}]", "")
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))
