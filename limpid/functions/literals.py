"""Whether a text is a literal of lists, tuples, sets and maps: read as a grammar, in built-in functions.

Scalars shrink to one mark each, then brackets that hold only marks shrink to
marks, innermost first, in as many rounds as brackets may be deep. What shrinks
to one mark of a collection is a literal. All repetitions are possessive and of
single characters or of fixed length, so a long text needs no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks, which no text keeps: a scalar, a tuple of values that can be keys, any other collection.
SCALAR, KEY, HOLDER = "\x01", "\x02", "\x03"
DEPTH = 8

_POINT = r"(?:[0-9]++\.[0-9]*+|\.[0-9]++)(?:[eE][-+]?[0-9]++)?|[0-9]++[eE][-+]?[0-9]++"
# Other bases have at most 256 digits, for a group of one length or another takes stack each time it repeats.
_WHOLE = "0[xX](?:_?[0-9a-fA-F]){1,256}+|0[oO](?:_?[0-7]){1,256}+|0[bB](?:_?[01]){1,256}+|[1-9][0-9]*+|0++"
_IMAGINARY = rf"(?:{_POINT}|[0-9]++)[jJ]"
_NUMBER = rf"(?<![\w.])(?:{_IMAGINARY}|{_POINT}|{_WHOLE})(?![\w.])"
_STRING = r"""(?<!\w)(?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''[\s\S]*?'''|\"""[\s\S]*?\"""|'[^'\n]*+'|"[^"\n]*+")"""
_NAME = r"(?<![\w.])(?:True|False|None)(?![\w.])|(?<!\.)\.\.\.(?!\.)"
_ANY, _HASHED = f"[{SCALAR}{KEY}{HOLDER}]", f"[{SCALAR}{KEY}]"
#: What one round does, in this order: brackets around one value, tuples of keys, all other collections.
_ROUND = [
    (rf"\(({_ANY})\)", "$1"),
    (rf"\((?:{_HASHED},(?:{_HASHED}(?:,{_HASHED})*+,?)?)?\)", KEY),
    (rf"\({_ANY},(?:{_ANY}(?:,{_ANY})*+,?)?\)|\[(?:{_ANY}(?:,{_ANY})*+,?)?\]|\{{(?:{_HASHED}:{_ANY}(?:,{_HASHED}:{_ANY})*+,?)?\}}|\{{{_HASHED}(?:,{_HASHED})*+,?\}}", HOLDER),
]


def scalars_marked(text: Column) -> Column:
    """Strings, numbers and names as marks, blanks gone between brackets, commas and marks; two marks that only blanks part stay apart."""
    c = F.translate(text, SCALAR + KEY + HOLDER, "~~~")
    c = F.regexp_replace(c, r"\\[\s\S]", "~")  # escapes: outside strings no literal has them, nor the tilde
    c = F.regexp_replace(c, _STRING, SCALAR)
    c = F.regexp_replace(c, rf"(?<={SCALAR})\s*+{SCALAR}", "")  # strings side by side are one
    c = F.regexp_replace(c, "(?<=[0-9])_(?=[0-9])", "")
    # Signs and the two parts of a complex number belong to the number.
    c = F.regexp_replace(c, rf"(?:(?<=[\[({{,:])\s*+[-+]\s*+)?{_NUMBER}(?:\s*+[-+]\s*+(?<![\w.]){_IMAGINARY}(?![\w.]))?", SCALAR)
    c = F.regexp_replace(c, _NAME, SCALAR)
    c = F.regexp_replace(c, r"(?<!\w)set\s*+\(\s*+\)", HOLDER)
    return F.regexp_replace(c, r"\s++(?=[\[\](){},:])|(?<=[\[\](){},:])\s++", "")


def is_literal_collection(c: Column) -> Column:
    """Bracketed text that is a literal list, tuple, set or map, at most ``DEPTH`` brackets deep; ``set()`` is one, ``(1)`` is not.

    Sets and keys of maps hold only what can be a key. Escapes within strings
    are not checked, nor that a bytes and a text string stand side by side.
    """
    text = F.trim(c)
    reduced = scalars_marked(text)
    for _ in range(DEPTH):
        for pattern, mark in _ROUND:
            reduced = F.regexp_replace(reduced, pattern, mark)
    bracketed = text.rlike(r"^(?:\[[\s\S]*\]|\{[\s\S]*\}|\([\s\S]*\))$")
    return (text == "set()") | F.when(bracketed, reduced.isin(KEY, HOLDER)).otherwise(False)
