"""The dominant pattern of a column of codes, and values brought into it.

A value is cut into tokens, numbers and words, and the separators around them.
Values are alike on three levels: of one shape (tokens' kinds and separators),
of one skeleton (kinds alone), or of one string of digits. A value whose shape
is not the dominant one is aligned with it on the finest level that leaves one
way only: with the same skeleton its separators are replaced, and with one
string of as many digits as the dominant shape has, separators are put in.
Whatever else differs has no single alignment and stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the values present that has to be of one shape.
PATTERN_SHARE = 0.6
#: Share of the dominant values that agrees on a token's case, word, width or fraction.
TOKEN_SHARE = 0.9
#: Tokens of a pattern at most; longer values are text, not codes.
MOST_TOKENS = 8
TOKEN = r"[0-9]+(?:\.[0-9]+)?|\p{L}+"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def separators_of(text: Column) -> Column:
    """What stands before, between and behind the tokens: one more than these."""
    return F.split(text, TOKEN)


def skeleton_of(text: Column) -> Column:
    """``N`` for each number and ``A`` for each word."""
    return F.array_join(F.transform(tokens_of(text), lambda t: F.when(t.rlike("^[0-9]"), "N").otherwise("A")), "")


def token_traits(t: Column) -> Column:
    """What tokens at one place may have in common: digits behind the point, width of plain digits, case, and the word itself."""
    number = t.rlike("^[0-9]")
    case = F.when(t == F.upper(t), "upper").when(t == F.lower(t), "lower").otherwise("mixed")
    return F.struct(
        F.when(number, F.char_length(F.regexp_extract(t, r"\.([0-9]+)$", 1))).alias("fraction"),
        F.when(number & ~F.contains(t, F.lit(".")), F.char_length(t)).alias("width"),
        F.when(~number, case).alias("case"),
        F.when(~number, F.lower(t)).alias("word"),
    )


def dominant_pattern(df: DataFrame, rid: str) -> dict | None:
    """The pattern that most values of the column beside ``rid`` follow, as plain values; None without one.

    ``skeleton``, ``separators`` and, for each token, what nearly all agree on:
    ``fraction``, ``width``, ``case``, ``word``, each None where they don't.
    Values are counted first, so each distinct one is looked at once; of the
    shapes, and of each token's traits, one row reaches the driver. A pattern
    has at least one number: words alone are no codes.
    """
    (column,) = [c for c in df.columns if c != rid]
    text = F.trim(F.col(f"`{column}`").cast("string"))
    values = df.where(text.isNotNull() & (text != "")).groupBy(text.alias("v")).agg(F.count("*").alias("n"), F.min(rid).alias("first_rid"))
    total = values.agg(F.sum("n")).first()[0]
    short = values.where(F.size(tokens_of(F.col("v"))).between(1, MOST_TOKENS))
    shaped = short.groupBy(skeleton_of(F.col("v")).alias("skeleton"), separators_of(F.col("v")).alias("separators")).agg(F.sum("n").alias("n"), F.min("first_rid").alias("first_rid"))
    best = shaped.orderBy(F.desc("n"), "first_rid").first()
    if best is None or best["n"] < PATTERN_SHARE * total or "N" not in best["skeleton"]:
        return None
    own = short.where((skeleton_of(F.col("v")) == best["skeleton"]) & (separators_of(F.col("v")) == F.array(*[F.lit(s) for s in best["separators"]])))
    each = own.select("n", F.posexplode(tokens_of(F.col("v"))).alias("at", "t")).select("n", "at", token_traits(F.col("t")).alias("traits"))
    names = ("fraction", "width", "case", "word")
    long = each.select("n", "at", F.explode(F.array(*[F.struct(F.lit(k).alias("trait"), F.col(f"traits.{k}").cast("string").alias("value")) for k in names])).alias("x")).select("n", "at", "x.*")
    counted = long.groupBy("at", "trait", "value").agg(F.sum("n").alias("n"))
    agreed = counted.where(F.col("value").isNotNull() & (F.col("n") >= TOKEN_SHARE * best["n"])).collect()  # at most one a trait and place
    tokens = [dict.fromkeys(names) for _ in best["skeleton"]]
    for r in agreed:
        tokens[r["at"]][r["trait"]] = int(r["value"]) if r["trait"] in ("fraction", "width") else r["value"]
    return {"skeleton": best["skeleton"], "separators": list(best["separators"]), "tokens": tokens}


def _fitted(t: Column, traits: dict) -> Column:
    """A token as the pattern has it, or null where it can't be had without a loss."""
    word = traits["word"]
    if word is not None:
        cased = {"upper": word.upper(), "lower": word}.get(traits["case"])
        return F.when(F.lower(t) == word, F.lit(cased) if cased else t)
    if traits["case"] in ("upper", "lower"):
        return {"upper": F.upper, "lower": F.lower}[traits["case"]](t)
    digits = traits["fraction"]
    if digits is None:
        return t
    whole, fraction = F.substring_index(t, ".", 1), F.regexp_extract(t, r"\.([0-9]+)$", 1)
    bare = F.rtrim(fraction, F.lit("0"))
    kept = F.rpad(bare, digits, "0") if digits else F.lit("")
    # A number of plain digits stays as it is where the width counts; else zeros come and go behind the point only.
    return F.when(F.char_length(bare) <= digits, F.concat(whole, F.lit("." if digits else ""), kept))


def patterned(c: Column, pattern: dict) -> Column:
    """Values that align with the pattern in one way only, brought into it; all others as they are."""
    text, separators, traits = F.trim(c), pattern["separators"], pattern["tokens"]
    tokens = tokens_of(text)
    fitted = [_fitted(F.get(tokens, F.lit(i)), t) for i, t in enumerate(traits)]
    whole_widths = [F.lit(True) if t["width"] is None else F.char_length(F.get(tokens, F.lit(i))) == t["width"] for i, t in enumerate(traits)]
    joined = F.concat(F.lit(separators[0]), *[x for f, s in zip(fitted, separators[1:], strict=True) for x in (f, F.lit(s))])
    fits = F.lit(True)
    for w in whole_widths:
        fits = fits & w
    out = F.when((skeleton_of(text) == pattern["skeleton"]) & fits & joined.isNotNull(), joined)
    widths = [t["width"] for t in traits]
    if len(widths) > 1 and set(pattern["skeleton"]) == {"N"} and None not in widths:
        digits, pieces, at = F.regexp_replace(text, "[^0-9]", ""), [F.lit(separators[0])], 1
        for w, s in zip(widths, separators[1:], strict=True):
            pieces += [F.substring(digits, at, w), F.lit(s)]
            at += w
        out = out.when(~text.rlike(r"\p{L}") & (F.char_length(digits) == sum(widths)), F.concat(*pieces))
    return out.otherwise(c)
