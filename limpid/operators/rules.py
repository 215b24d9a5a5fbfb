"""Cleaning rules as column expressions.

Rules that follow the dominant form of a column take that form from one
grouped aggregate of the column (:func:`dominant`) and are otherwise plain
expressions, so several rules fuse into one projection. Cleaned dates and
numbers stay text unless said otherwise, as the input was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.kinds import UNITS
from limpid.functions.numbers import half_even_integer, to_number
from limpid.functions.text import placeholder_to_null, strip_markup

#: Date formats in the order in which they are tried, and the shape that a text must have to be worth parsing.
DATE_SHAPES = {
    "yyyy-MM-dd": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "yyyy/MM/dd": r"[0-9]{4}/[0-9]{2}/[0-9]{2}",
    "dd/MM/yyyy": r"[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "MM/dd/yyyy": r"[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "dd-MM-yyyy": r"[0-9]{2}-[0-9]{2}-[0-9]{4}",
    "dd.MM.yyyy": r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    "d MMMM yyyy": r"[0-9]{1,2} \p{L}+ [0-9]{4}",
    "MMMM d, yyyy": r"\p{L}+ [0-9]{1,2}, [0-9]{4}",
    "yyyy-MM-dd HH:mm:ss": r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}",
    "M/d/yy": r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}",
    "yyyyMMdd": r"[0-9]{8}",
}
DATE_FORMATS = list(DATE_SHAPES)
#: Fixed pairs of words for true and false, the first of which a column uses most.
PAIRS = [("true", "false"), ("t", "f"), ("yes", "no"), ("y", "n"), ("1", "0")]
#: Letters that are taken for digits, and these. Fixed values.
ALIKE = ("OoIlSB", "001158")


def missing(c: Column, more: tuple[str, ...] = (), sentinels: tuple[float, ...] = ()) -> Column:
    """Null tokens, placeholders and, where named, numeric sentinels become null."""
    x = placeholder_to_null(c, more)
    return x if not sentinels else F.when(~F.coalesce(to_number(x).isin(list(sentinels)), F.lit(False)), x)


def dominant(df: DataFrame, form: Column, rid: str) -> str | None:
    """The commonest value of ``form``, ties by first appearance: one small row to the driver.

    ``form`` is told once for each distinct row of the columns beside ``rid``.
    """
    values = df.groupBy(*[F.col(f"`{c}`") for c in df.columns if c != rid]).agg(F.count("*").alias("__n"), F.min(rid).alias("__first"))
    row = values.where(form.isNotNull()).groupBy(form.alias("form")).agg(F.sum("__n").alias("n"), F.min("__first").alias("first_rid")).orderBy(F.desc("n"), "first_rid").first()
    return row["form"] if row else None


def date_format_of(c: Column, formats: list[str] | None = None) -> Column:
    """The first of the formats, by default of all known ones, that a text reads in."""
    text = date_text(c)
    return F.coalesce(*[F.when(parsed(text, f).isNotNull(), F.lit(f)) for f in formats or DATE_FORMATS])


def date_text(c: Column) -> Column:
    """A date's text: marks that no date has, and a note in brackets behind it, go."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", ""), r"[^0-9A-Za-z:/,. -]", ""))


def parsed(text: Column, form: str) -> Column:
    """A timestamp if the text has the format's shape and is a date, else null: most texts fail on the shape, which is cheap."""
    shaped = text.rlike(rf"^{DATE_SHAPES[form]}$") if form in DATE_SHAPES else F.lit(True)
    return F.when(shaped, F.try_to_timestamp(text, F.lit(form)))


def date_formats(df: DataFrame, rid: str) -> list[str]:
    """The known formats in which any value of the column beside ``rid`` reads, those that read most first; one aggregate.

    So of two orders of day and month the one that all dates have wins, however few of them only it can read.
    """
    (column,) = [c for c in df.columns if c != rid]
    values = df.groupBy(F.col(f"`{column}`").alias("v")).agg(F.count("*").alias("n"))
    text = date_text(F.col("v"))
    r = values.agg(*[F.sum(F.when(parsed(text, f).isNotNull(), F.col("n"))).alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)]).first()
    return [DATE_FORMATS[i] for i in sorted((i for i in range(len(DATE_FORMATS)) if r[f"f{i}"]), key=lambda i: (-r[f"f{i}"], i))]


def dates(c: Column, keep: str, formats: tuple[str, ...] | list[str] = ()) -> Column:
    """Dates of any known format in the column's own format ``keep``; impossible ones become null. ``formats`` are tried first, in their order."""
    text = date_text(c)
    return F.date_format(F.coalesce(*[parsed(text, f) for f in dict.fromkeys([keep, *formats, *DATE_FORMATS])]), keep)


def booleans(c: Column, pair: tuple[str, str] = PAIRS[0]) -> Column:
    """Any word for true or false, in any case and one letter off for longer words, as the column's own pair; else null."""
    x = F.lower(F.trim(c))
    yes, no = [p[0] for p in PAIRS], [p[1] for p in PAIRS]
    near = lambda words: F.exists(F.array(*[F.lit(w) for w in words if len(w) > 2]), lambda w: F.levenshtein(x, w) <= 1)
    return F.when(x.isin(yes), pair[0]).when(x.isin(no), pair[1]).when(near(yes), pair[0]).when(near(no) & (F.char_length(x) > 2), pair[1])


def without_unit(c: Column) -> Column:
    """The text without blanks, and without a unit or currency of the fixed list before or behind its number."""
    words = sorted({u.rstrip(".") for u in UNITS}, key=lambda u: (-len(u), u))
    units = "|".join(rf"(?i:\Q{u}\E)" if len(u) > 1 else rf"\Q{u}\E" for u in words)
    bare = F.regexp_replace(c, r"\s", "")
    return F.regexp_replace(F.regexp_replace(bare, rf"^([-+]?)(?:{units})(?=[-+.0-9])", "$1"), rf"(?<=[0-9.,])(?:{units})\.?$", "")


def unmistaken(x: Column) -> Column:
    """Letters that are taken for digits made digits, in a text that is of digits otherwise and half of digits at least."""
    shaped = x.rlike(rf"^[-+]?[0-9{ALIKE[0]}]+([.,][0-9{ALIKE[0]}]+)*$") & (F.char_length(F.regexp_replace(x, "[^0-9]", "")) * 2 >= F.char_length(x))
    return F.when(shaped, F.translate(x, *ALIKE)).otherwise(x)


def _us(x: Column) -> Column:
    return F.when(x.rlike(r"^[-+]?([0-9]*|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]*)?([eE][-+]?[0-9]+)?$"), to_number(F.replace(x, F.lit(","), F.lit(""))))


def _european(x: Column) -> Column:
    return F.when(x.rlike(r"^[-+]?([0-9]+|[0-9]{1,3}(\.[0-9]{3})+)(,[0-9]+)?$"), to_number(F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))


def decimal_mark(df: DataFrame, rid: str) -> str:
    """``.`` or ``,``: which of the two more numbers of the column beside ``rid`` need to be read at all; one aggregate."""
    (column,) = [c for c in df.columns if c != rid]
    x = without_unit(F.col(f"`{column}`"))
    us, european = _us(x).isNotNull(), _european(x).isNotNull()
    r = df.agg(F.count_if(us & ~european).alias("us"), F.count_if(european & ~us).alias("european")).first()
    return "," if r["european"] > r["us"] else "."


def plain_number(c: Column, mark: str | None = None, alike: bool = False) -> Column:
    """The number in a text without currency, unit, percent sign or grouping, as a double.

    ``mark`` is the column's decimal mark, by which what could be read in two
    ways is read; without it each number is read as it is likeliest alone.
    Percentages are not scaled. Units are those of the fixed list; with
    ``alike``, letters that are taken for digits are read as these. Text with
    other letters, with no number, or several, is null.
    """
    x = without_unit(c)
    x = unmistaken(x) if alike else x
    if mark is not None:
        return F.coalesce(_european(x), _us(x)) if mark == "," else F.coalesce(_us(x), _european(x))
    european = x.rlike(r"^[-+]?[0-9]{1,3}(\.[0-9]{3})*,[0-9]{1,2}$") | x.rlike(r"^[-+]?[0-9]{1,3}(\.[0-9]{3}){2,}$") | x.rlike(r"^[-+]?[0-9]+,[0-9]{1,2}$")
    return F.when(european, _european(x)).otherwise(_us(x))


def integers(c: Column, mark: str | None = None, alike: bool = False) -> Column:
    """Quantities as whole numbers, halves to the even neighbour. Not for identifiers: those stay text."""
    return half_even_integer(plain_number(c, mark, alike))


def fraction_digits(c: Column, mark: str | None = None) -> Column:
    return F.char_length(F.regexp_extract(plain_number(c, mark).cast("decimal(30,6)").cast("string"), r"\.([0-9]*?)0*$", 1))


def decimals(c: Column, digits: int | None = None, mark: str | None = None, alike: bool = False) -> Column:
    """Numbers as doubles, rounded to the column's own number of digits where given."""
    x = plain_number(c, mark, alike)
    return x if digits is None else F.round(x, digits)


def codes(c: Column, width: int | None = None) -> Column:
    """Identifiers and years of digits, as text: an empty fraction goes, letters that are taken for digits become these.

    With a width, that of nearly all, only where the result has it. Zeros in front stay, and so does what is no number.
    """
    text = identifiers(c)
    mended = unmistaken(F.regexp_replace(text, r"^([0-9]+)\.0+$", "$1"))
    fits = mended.rlike("^[0-9]+$" if width is None else f"^[0-9]{{{width}}}$")
    return F.when(fits, mended).otherwise(text)


def identifiers(c: Column) -> Column:
    """Codes: blanks around and invisible characters go, the rest stays."""
    return F.trim(F.regexp_replace(c, r"[\p{Cc}\p{Cf}�]", ""))


def free_text(c: Column) -> Column:
    return missing(strip_markup(c))


def delimited(c: Column, delimiter: str = ", ") -> Column:
    """Parts around any of the usual delimiters, trimmed, in the same order, joined by the column's own."""
    return F.array_join(F.filter(F.transform(F.split(c, r"\s*[,;|]\s*"), F.trim), lambda p: p != ""), delimiter)


def collections(c: Column) -> Column:
    """Bracketed lists with double quotes and one blank after commas; ``[NA]`` is empty; what cannot be read is null."""
    inner = F.trim(F.regexp_replace(F.trim(c), r"^[\[({]|[\])}]$", ""))
    parts = F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.trim(F.regexp_replace(p, "^['\"]|['\"]$", "")))
    real = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin("na", "nan", "null", "none"))
    shown = F.concat(F.lit("["), F.array_join(F.transform(real, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ", "), F.lit("]"))
    return F.when(F.trim(c).rlike(r"^[\[({].*[\])}]$"), shown)


def unit_stripped(c: Column, unit: str) -> Column:
    """``12 kg`` as ``12`` where the whole text is one number and the unit; other texts stay."""
    return F.regexp_replace(F.trim(c), rf"^([-+]?[0-9]*\.?[0-9]+)\s*\Q{unit}\E\.?$", "$1")


def dictionary(c: Column, words: dict[str, str | None]) -> Column:
    """Values replaced by a small dictionary; a value mapped to None becomes null."""
    x = F.when(F.lit(False), c)
    for old, new in words.items():
        x = x.when(c == old, F.lit(new))
    return x.otherwise(c)


def usual_digits(df: DataFrame, rid: str, share: float, mark: str | None = None) -> int | None:
    """The digits behind the point that at least ``share`` of the numbers in the column beside ``rid`` have or stay below; None if no number of them is so usual."""
    (column,) = [c for c in df.columns if c != rid]
    counted = df.groupBy(fraction_digits(F.col(f"`{column}`"), mark).alias("digits")).count().where("digits is not null").collect()  # a row a number of digits
    total = sum(r["count"] for r in counted)
    best = max(counted, key=lambda r: (r["count"], r["digits"]), default=None)
    return int(best["digits"]) if best and best["digits"] and best["count"] >= share * total else None


def capped_outliers(c: Column, median: float, low: float, high: float, policy: str = "keep", placeholders: tuple[float, ...] = ()) -> Column:
    """Outliers outside [low, high]: placeholders to null, the others kept, set to the median or to null."""
    x = to_number(c)
    out = (x < low) | (x > high)
    given = {"keep": x, "median": F.lit(median), "null": F.lit(None).cast("double")}[policy]
    is_placeholder = x.isin(list(placeholders)) if placeholders else F.lit(False)
    return F.when(is_placeholder, None).when(out, given).otherwise(x)


def capped(c: Column, median: float, low: float, high: float, policy: str, whole: bool = False) -> Column:
    """``capped_outliers`` of the numbers that are there; whole ones stay whole."""
    x = F.when(c.isNotNull(), capped_outliers(c.cast("double"), median, low, high, policy))
    return x.cast("bigint") if whole else x
