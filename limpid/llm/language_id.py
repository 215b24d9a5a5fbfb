"""Language ID with a string kernel.

Two blocks of text are as alike as the share of distinct character n-grams (n
from 1 to 4, blended spectrum, presence only) that they have in common, and two
texts as the mean over their blocks, which cover all of them: so neither the
length of a text nor noise in a part of it makes all languages look alike. A
few labelled texts serve as Nyström landmarks: a text is described by its kernel
values with them, and kernel ridge regression, one language against the rest,
gives a score for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import given, named, stored

#: Dimensions that n-grams are hashed to.
GRAMS = 1 << 20
ORDERS = (1, 2, 3, 4)
#: Characters of a block at most; each n-gram of a text counts in the block that it starts in.
BLOCK = 4096


def presence(text: str, last: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct hashed n-grams of each block of a text; ``last`` is any scratch of GRAMS int32."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    n_blocks = -(-len(points) // BLOCK)
    for i in range(n_blocks):
        begin, end = i * len(points) // n_blocks, (i + 1) * len(points) // n_blocks
        piece = points[begin : end + ORDERS[-1] - 1]
        code, codes = np.zeros(len(piece), np.uint32), []
        for n in ORDERS:
            code = code[: len(piece) - n + 1] * np.uint32(0x9E3779B1) + piece[n - 1 :] if n <= len(piece) else code[:0]
            codes.append(code[: end - begin])
        code = np.concatenate(codes)
        hashed = (((code * np.uint32(0x85EBCA6B)) ^ (code >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(12)).astype(np.int32)
        at = np.arange(len(hashed), dtype=np.int32)
        last[hashed] = at
        yield hashed[last[hashed] == at]


def profile(text: str, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of a text's blocks, each a unit vector: the n-grams held, and their values."""
    blocks = list(presence(text, last))
    if not blocks:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    grams, place = np.unique(np.concatenate(blocks), return_inverse=True)
    each = np.repeat([len(b) ** -0.5 / len(blocks) for b in blocks], [len(b) for b in blocks])
    return grams, np.bincount(place, weights=each).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    places: np.ndarray  # for each of GRAMS its row in weights; 0 if no landmark holds it
    weights: np.ndarray  # n-grams of the landmarks x languages, after a row of zeros

    def scores(self, texts: list[str]) -> np.ndarray:
        """Mean scores over the blocks of each text: as kernel values are linear in it, weights of landmarks are those of n-grams."""
        last = np.zeros(GRAMS, np.int32)
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        for row, text in zip(out, texts, strict=True):
            n = 0
            for held in presence(text, last):
                row += np.ones(len(held), np.float32) @ self.weights.take(self.places[held], axis=0) / np.float32(len(held) ** 0.5)
                n += 1
            row /= max(n, 1)
        return out


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = np.zeros(GRAMS, np.int32)
    for batch in batches:
        found = [profile(t, last) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1))], names=["lang", "order", "grams", "held"])


def _met(landmarks):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, begins = landmarks.value
        last, dense = np.zeros(GRAMS, np.int32), np.zeros(GRAMS, np.float32)
        for batch in batches:
            kernels = []
            for text in batch.column(2).to_pylist():
                own, values = profile(text, last)
                dense[own] = values
                kernels.append(np.add.reduceat(dense[grams] * held, begins).tobytes())
                dense[own] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kernels, pa.binary())], names=["lang", "order", "kernels"])

    return meet


def _up_to(limits: dict[str, float]) -> Column:
    """Whether a row's order is at most the limit of its language."""
    limit = F.lit(None).cast("double")
    for lang, most in limits.items():
        limit = F.when(F.col("lang") == lang, F.lit(float(most))).otherwise(limit)
    return F.col("order") <= limit


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 400, landmarks_per_language: int = 40, ridge: float = 1e-2) -> LanguageModel | None:
    """Fits on at most ``sample_per_language`` labelled texts of each language.

    The sample is the distinct texts with the smallest text hashes among the rows
    with a language and some text; it is the only bound in this module,
    and the first ``landmarks_per_language`` of it are the landmarks. Only the
    hashed n-grams of the landmarks and the kernel values of the sample with
    them reach the driver. Languages
    themselves must be few, as classes are. None if no row can be learned from.
    """
    spark = docs.sparkSession
    text = named(text_col).cast("string")
    labelled = docs.where(named(lang_col).isNotNull() & (F.length(F.trim(text)) > 0)).select(named(lang_col).cast("string").alias("lang"), text.alias("text"), F.abs(F.xxhash64(text) % 1_000_000_007).alias("order"))
    # Distinct texts, for copies of one pass any cut together or not at all.
    counts = {r["lang"]: r["n"] for r in labelled.select("lang", "order").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # Few more texts than are wanted pass this cut of the hashes, so what is stored is bounded.
    cut = _up_to({lang: min(1.0, (sample_per_language + 10 * sample_per_language**0.5) / n) * 1_000_000_007 for lang, n in counts.items()})
    few = stored(labelled.where(cut).groupBy("lang", "order").agg(F.min("text").alias("text")).select("lang", "order", "text"))
    orders: dict[str, list[int]] = {}
    for r in few.select("lang", "order").collect():
        orders.setdefault(r["lang"], []).append(r["order"])
    if not orders:
        return None
    languages = sorted(orders)
    sampled = {lang: sorted(o)[:sample_per_language] for lang, o in orders.items()}
    first = few.where(_up_to({lang: o[:landmarks_per_language][-1] for lang, o in sampled.items()}))
    found = sorted(first.mapInArrow(_profiled, "lang string, order long, grams binary, held binary").collect(), key=lambda r: (r["lang"], r["order"]))
    grams, held = ([np.frombuffer(r[c], kind) for r in found] for c, kind in (("grams", np.int32), ("held", np.float32)))
    sizes = np.array([len(g) for g in grams])
    grams, held = np.concatenate(grams), np.concatenate(held)
    landmarks = spark.sparkContext.broadcast((grams, held, np.cumsum(sizes) - sizes))  # n-grams of the landmarks: bounded by the parameters
    rows = sorted(few.where(_up_to({lang: o[-1] for lang, o in sampled.items()})).mapInArrow(_met(landmarks), "lang string, order long, kernels binary").collect(), key=lambda r: (r["lang"], r["order"]))
    k = np.array([np.frombuffer(r["kernels"], np.float32) for r in rows]).astype(float)
    marked = {(r["lang"], r["order"]) for r in found}
    among = k[[(r["lang"], r["order"]) in marked for r in rows]]  # landmarks with landmarks
    labels = np.array([languages.index(r["lang"]) for r in rows])
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = np.bincount(labels, minlength=len(languages)) / len(labels)
    weight = (1 / share)[labels] / len(languages)
    # Kernel ridge regression on the Nyström features: (K'WK + ridge n K_landmarks) a = K'Wy
    left = k.T @ (k * weight[:, None]) + ridge * len(labels) * among / 100
    alpha = np.linalg.solve(left + 1e-6 * np.eye(len(left)), k.T @ (target * weight[:, None]))
    known, at = np.unique(grams, return_inverse=True)
    weights = np.zeros((len(known) + 1, len(languages)), np.float32)
    for i in range(len(languages)):
        weights[1:, i] = np.bincount(at, weights=held * np.repeat(alpha[:, i], sizes), minlength=len(known))
    places = np.zeros(GRAMS, np.int32)
    places[known] = np.arange(1, len(known) + 1)
    return LanguageModel(languages, places, weights)


_PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def _predictor(model):
    @F.pandas_udf(_PREDICTED)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m: LanguageModel | None = model.value
        for series in texts:
            rows = [("und", 0.0)] * len(series)
            known = [i for i, t in enumerate(series) if m is not None and t is not None and any(map(str.isalpha, t))]
            for begin in range(0, len(known), 256):
                some = known[begin : begin + 256]
                scores = m.scores([series.iloc[i] for i in some])
                odds = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
                best = scores.argmax(axis=1)
                for i, b, s in zip(some, best, odds[np.arange(len(some)), best] / odds.sum(axis=1), strict=True):
                    rows[i] = (m.languages[b], float(s))
            yield pd.DataFrame(rows, columns=_PREDICTED.names)

    return predict


def predict_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``language``: lang, score.

    Rows come back with their columns, but a column ``language``, in any case,
    is replaced. Only the text counts. A text without a letter, a null or empty text, and
    any text when nothing could be learned, is ``und`` with score 0. Ties go
    to the language that sorts first. ``score`` is the softmax of the
    one-versus-rest scores. Repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most GRAMS x languages floats
    return docs.select(*given(docs, "language"), _predictor(shared)(named(text_col).cast("string")).alias("language"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
