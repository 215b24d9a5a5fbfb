"""Personal data by a semi-Markov conditional random field over rule-based finds.

Four kinds are found by fixed patterns and checks first; those finds stay.
Around each place with a digit or an at-sign the text's tokens are then
segmented: each stretch of up to seven tokens is a candidate entity of each
kind, described by features of the whole span (shape, checks, digit counts,
cue words before it), every other token is outside. Dynamic programming over
the candidates chooses boundaries and kinds jointly. Segments that overlap no
find of the rules are added.

The field is trained on a bounded sample of the corpus with the rules' finds
as labels, in part rewritten into forms that the rules miss.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import given, named

KINDS = ("email", "ip", "card", "phone")
# The base patterns; an address's part before the at-sign as its characters.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: What makes a token worth a look.
SIGN = re.compile(r"[0-9@]|(?i:[(\[{<](?:at|dot)[)\]}>])|(?i:\b(?:at|dot)\b(?=\s+\S+\s+dot\b)|\bdot\b)")
#: Characters behind a run of tokens that may tell whether its last ones are signs.
AHEAD = 200
TOKEN = re.compile(r"\S+")
LEAD, TRAIL = "([{<\"'", ")]}>\"'.,;:!?"
LONGEST = 7
Span = tuple[str, int, int]


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap, from each at-sign outwards, so that a long run without one is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The finds of the rules, by kind and start; failing matches are dropped without a retry."""
    found = [("email", s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


# ------------------------------------------------------------------ the field
CUES = {"email": ("mail", "email", "e-mail", "contact"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "iban"), "phone": ("tel", "phone", "call", "fax", "mobile")}
# A mark between the parts of an address: the sign, the word in brackets of any kind or between blanks.
AT = r"(?:@|(?i:[(\[{<]at[)\]}>]|(?<=\s)at(?=\s)))"
DOT = r"(?:\.|(?i:[(\[{<](?:dot|\.)[)\]}>]|(?<=\s)dot(?=\s)))"
SHAPES = {
    "email": re.compile(rf"[\w.%+-]+\s?{AT}\s?(?=[\w-]*[A-Za-z])[\w-]+(?:\s?{DOT}\s?[\w-]+)+"),
    "ip": re.compile(rf"[0-9]{{1,3}}(?:\s?{DOT}\s?[0-9]{{1,3}}){{3}}"),
    "card": re.compile(r"[0-9]{2,8}(?:[ ./_:,|*-]{1,2}[0-9]{1,8}){1,7}|[0-9]{16,19}"),
    "phone": re.compile(r"\(?(?:\+|0)?[ ]?\(?[0-9]{1,5}\)?(?:[ ./-]{0,2}\(?[0-9]{2,4}\)?){2,4}"),
}
#: Digits that are days, times or amounts.
DATED = re.compile(r"(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:[0-9]{4}|[0-9]{2}))(?:[T ][0-9:.]+Z?)?|[0-9]{1,3}(?:[., ][0-9]{3})*[.,][0-9]{2}|[0-9]{4}[-/][0-9]{4}")
MARKED = re.compile(AT)
#: How a number to be dialled begins.
LEADS = re.compile(r"\+|0[0-9]|\(0|\(\+")
FEATURES = ("bias", "shape", "checked", "shape_and_checked", "cue", "letters", "digits_8_15", "digits_16_19", "tokens", "lead", "at", "long_digits", "dated", "cut")


def span_features(kind: str, span: str, tokens: int, before: str, after: str = "") -> tuple[float, ...]:
    digits = digits_of(span)
    n = len(digits)
    shape = SHAPES[kind].fullmatch(span) is not None
    cue = any(c in before for c in CUES[kind])
    if kind == "card":
        checked = 16 <= n <= 19 and luhn(digits)
    elif kind == "ip":
        parts = re.findall("[0-9]+", span)
        checked = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    elif kind == "phone":
        # Without a prefix or a word before it a number is not known to be dialled.
        checked = 8 <= n <= 15 and not DATED.fullmatch(span) and (LEADS.match(span) is not None or cue)
    else:
        checked = MARKED.search(span) is not None
    letters = sum(map(str.isalpha, span)) / len(span)
    cut = after.isdigit() or before[-1:].isdigit()  # more digits stand beside the span
    return (1.0, shape, checked, shape and checked, cue, letters, 8 <= n <= 15, 16 <= n <= 19, tokens / LONGEST, LEADS.match(span) is not None, "@" in span, n > 19, DATED.fullmatch(span) is not None, cut)


class Region:
    """Tokens to be segmented, and the features of each candidate (start, length, kind)."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.tokens = []
        for s, e in tokens:
            while s < e - 1 and text[s] in LEAD and not (text[s] == "(" and ")" in text[s:e]):
                s += 1
            while e > s + 1 and text[e - 1] in TRAIL and not (text[e - 1] == ")" and "(" in text[s:e]):
                e -= 1
            self.tokens.append((s, e))
        begins = [s for s, _ in tokens]
        self.signs = [False] * len(tokens)
        # A sign may look at the words behind it, so signs are sought in the text, not token by token.
        for m in SIGN.finditer(text, begins[0], tokens[-1][1] + AHEAD) if tokens else ():
            if m.start() < tokens[-1][1]:
                self.signs[bisect_right(begins, m.start()) - 1] = True
        self.candidates: list[tuple[int, int, int]] = []
        features = []
        for i in range(len(self.tokens)):
            before = text[max(0, self.tokens[i][0] - 24) : self.tokens[i][0]].lower().rstrip()
            for n in range(1, min(LONGEST, len(self.tokens) - i) + 1):
                if not any(self.signs[i : i + n]):
                    continue
                end = self.tokens[i + n - 1][1]
                span, after = text[self.tokens[i][0] : end], text[end : end + 2].strip()[:1]
                for k, kind in enumerate(KINDS):
                    self.candidates.append((i, n, k))
                    features.append(span_features(kind, span, n, before, after))
        self.features = np.array(features, float).reshape(-1, len(FEATURES))
        self.kinds = np.array([k for _, _, k in self.candidates], int)

    def scores(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each candidate, and of each token being outside (weights' last row: bias, with a sign)."""
        inside = (self.features * weights[self.kinds]).sum(axis=1)
        return inside, weights[-1, 0] + weights[-1, 1] * np.array(self.signs, float)


def best_segments(text: str, tokens: list[tuple[int, int]], weights: np.ndarray, at_once: int = 2000) -> list[Span]:
    """Boundaries and kinds of the highest-scoring segmentation of a token run; ties go to fewer entities.

    Candidates are scored for ``at_once`` first tokens at a time, so a run of
    any length takes little memory; the result does not depend on it.
    """
    size = len(tokens)
    best, back = [-np.inf] * (size + 1), [None] * (size + 1)
    best[0] = 0.0
    for begin in range(0, size, at_once):
        region = Region(text, tokens[begin : begin + at_once + LONGEST - 1])
        inside, outside = region.scores(weights)
        c = 0
        for i in range(min(at_once, size - begin)):
            here = best[begin + i]
            while c < len(region.candidates) and region.candidates[c][0] == i:
                n = region.candidates[c][1]
                if (value := here + inside[c]) > best[begin + i + n]:
                    best[begin + i + n] = value
                    back[begin + i + n] = n, region.candidates[c][2], region.tokens[i][0], region.tokens[i + n - 1][1]
                c += 1
            if (value := here + outside[i]) >= best[begin + i + 1]:
                best[begin + i + 1], back[begin + i + 1] = value, None
    found, e = [], size
    while e:
        if back[e] is None:
            e -= 1
            continue
        n, k, start, end = back[e]
        found.append((KINDS[k], start, end))
        e -= n
    return found[::-1]


def _gradient(region: Region, truth: set[tuple[int, int, int]], weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the log-likelihood of the true segmentation, by forward and backward sums."""
    inside, outside = region.scores(weights)
    n = len(region.tokens)
    by_end, by_start = {}, {}
    for c, (i, m, _) in enumerate(region.candidates):
        by_end.setdefault(i + m, []).append(c)
        by_start.setdefault(i, []).append(c)
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    for e in range(1, n + 1):
        alpha[e] = np.logaddexp.reduce([alpha[e - 1] + outside[e - 1]] + [alpha[region.candidates[c][0]] + inside[c] for c in by_end.get(e, ())])
    for s in range(n - 1, -1, -1):
        beta[s] = np.logaddexp.reduce([beta[s + 1] + outside[s]] + [beta[s + region.candidates[c][1]] + inside[c] for c in by_start.get(s, ())])
    total = alpha[n]
    grad = np.zeros_like(weights)
    start = np.array([c[0] for c in region.candidates], int)
    end = start + np.array([c[1] for c in region.candidates], int)
    expected = np.exp(alpha[start] + inside + beta[end] - total)
    true = np.array([c in truth for c in region.candidates], float)
    np.add.at(grad, region.kinds, (true - expected)[:, None] * region.features)
    is_out = np.ones(n)
    for i, m, _ in truth:
        is_out[i : i + m] = 0
    diff = is_out - np.exp(alpha[:-1] + outside + beta[1:] - total)
    grad[-1, 0], grad[-1, 1] = diff.sum(), (diff * np.array(region.signs, float)).sum()
    return grad, float((true * inside).sum() + (is_out * outside).sum() - total)


def train(samples: list[tuple[str, list[Span]]], epochs: int = 12, rate: float = 0.3) -> np.ndarray:
    """Weights (a row of features for each kind, and one for outside tokens) by adaptive gradient steps."""
    weights = np.zeros((len(KINDS) + 1, len(FEATURES)))
    weights[-1, 0] = 2.0  # tokens are outside until shown otherwise
    squares = np.full_like(weights, 1e-3)
    data = []
    for text, spans in samples:
        region = Region(text, [m.span() for m in TOKEN.finditer(text)])
        starts = {s: i for i, (s, _) in enumerate(region.tokens)}
        ends = {e: i for i, (_, e) in enumerate(region.tokens)}
        truth = {(starts[s], ends[e] - starts[s] + 1, KINDS.index(k)) for k, s, e in spans if s in starts and e in ends}
        if len(truth) == len(spans) and truth <= set(region.candidates):
            data.append((region, truth))
    for _ in range(epochs):
        for region, truth in data:
            grad = _gradient(region, truth, weights)[0] - 1e-3 * weights
            squares += grad**2
            weights += rate * grad / np.sqrt(squares)
    return weights


def regions_of(text: str, margin: int = 2) -> list[list[tuple[int, int]]]:
    """Token runs around the tokens that hold a digit or an at-sign."""
    if not SIGN.search(text):
        return []
    tokens = [m.span() for m in TOKEN.finditer(text)]
    begins = [s for s, _ in tokens]
    active = sorted({bisect_right(begins, m.start()) - 1 for m in SIGN.finditer(text)})
    runs: list[list[int]] = []
    for a in active:
        low, high = max(0, a - margin), min(len(tokens), a + margin + 1)
        if runs and low <= runs[-1][1]:
            runs[-1][1] = high
        else:
            runs.append([low, high])
    return [tokens[a:b] for a, b in runs]


def apart(spans: list[Span]) -> bool:
    ordered = sorted((s, e) for _, s, e in spans)
    return all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:], strict=False))


def rewritten(text: str, spans: list[Span], draw: random.Random) -> tuple[str, list[Span]]:
    """The same region with its entities written in ways that the rules miss."""
    out, found, at = "", [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        entity = text[s:e]
        if kind == "email":
            entity = entity.replace("@", draw.choice([" (at) ", "(at)", "[at]"])).rpartition(".")
            entity = entity[0] + draw.choice([" (dot) ", "[dot]", "."]) + entity[2]
        elif kind == "card":
            entity = draw.choice([".", "/", "_"]).join(digits_of(entity)[i : i + 4] for i in range(0, len(digits_of(entity)), 4))
        elif kind == "phone":
            entity = draw.choice(["00", "tel "]) + entity[1:] if draw.random() < 0.5 else entity.replace(" ", "/")
        else:
            entity = entity.replace(".", "[dot]")
        out += text[at:s]
        begin = len(out) + (4 if entity.startswith("tel ") else 0)
        out += entity
        found.append((kind, begin, len(out)))
        at = e
    return out + text[at:], found


def training_samples(docs: DataFrame, text_col: str, sample_texts: int, regions_per_text: int, longest_region: int) -> list[tuple[str, list[Span]]]:
    """Regions of the ``sample_texts`` distinct texts with the smallest hashes among those with a digit or an at-sign.

    Of a text the first ``regions_per_text`` regions of at most
    ``longest_region`` tokens. Only these reach the driver; texts are cut by
    hash where they lie, so nothing that grows with the corpus moves.
    """
    space = 1 << 40

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, found = [], []
            for order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                short = [r for r in regions_of(text) if len(r) <= longest_region][:regions_per_text]
                found += [text[r[0][0] : r[-1][1]] for r in short]
                orders += [order] * len(short)
            yield pa.RecordBatch.from_arrays([pa.array(orders, pa.int64()), pa.array(found, pa.string())], names=["order", "region"])

    text = named(text_col).cast("string")
    signed_texts = docs.where(text.rlike("[0-9@]")).select(F.pmod(F.xxhash64(text), F.lit(space)).alias("order"), text.alias("text"))
    # Distinct texts, for copies of one pass the cut together or not at all.
    texts = signed_texts.select("order").distinct().count()
    cut = int(min(1.0, (sample_texts + 10 * sample_texts**0.5) / max(texts, 1)) * space)
    some = signed_texts.where(F.col("order") <= cut)
    found = {(r["order"], r["region"]) for r in some.mapInArrow(regions, "order long, region string").distinct().collect()}
    orders = set(sorted({o for o, _ in found})[:sample_texts])
    draw, out = random.Random(5), []
    for region in sorted({r for o, r in found if o in orders}):
        spans = base_spans(region)
        if apart(spans):
            out.append((region, spans))
            if spans:
                out.append(rewritten(region, spans, draw))
    return out


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """The rules' finds, and those with the field's additions."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    begins, reach = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]  # how far the first finds reach
    added = []
    for tokens in regions_of(text):
        for kind, s, e in best_segments(text, tokens, weights):
            if reach[bisect_left(begins, e)] <= s:
                added.append((kind, s, e))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted([*base, *added], key=lambda x: (order[x[0]], x[1], x[2]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("masked", T.StringType())])


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join([*out, text[at:]])


def _finder(weights):
    @F.pandas_udf(_FOUND)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for series in texts:
            rows = []
            for text in series:
                text = text or ""
                base, spans = all_spans(text, w)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), masked(text, spans) if spans else text))
            yield pd.DataFrame(rows, columns=_FOUND.names)

    return find


def find_personal_data(docs: DataFrame, text_col: str = "text", sample_texts: int = 400, regions_per_text: int = 20, longest_region: int = 80) -> DataFrame:
    """``docs`` with a struct ``found``: n_email, n_ip, n_card, n_phone, base_sha256, spans, masked.

    Counts and ``base_sha256`` are of the rules' finds; ``spans`` lists these
    and the added ones as kind:start:end (code points, end exclusive), by kind,
    then start. ``masked`` is the text with each span replaced by its kind.

    The field is trained on at most ``sample_texts`` texts, of each at most
    ``regions_per_text`` runs of at most ``longest_region`` tokens around a
    digit or an at-sign; all texts are searched, whole. Rows come back with
    their columns, but a column ``found``, in any case, is replaced. A null
    text is an empty one. Repeated rows get equal results.
    """
    weights = train(training_samples(docs, text_col, sample_texts, regions_per_text, longest_region))
    find = _finder(docs.sparkSession.sparkContext.broadcast(weights))
    return docs.select(*given(docs, "found"), find(named(text_col).cast("string")).alias("found"))
