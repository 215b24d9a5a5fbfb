"""Small corpora with the awkward cases that every operator has to stand."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    syllables = ["an", "th", "re", "ing", "on", "ed", "er", "st", "ou", "bl", "ß", "é"]
    return ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n)]


def texts() -> list[str | None]:
    """Copies, near copies, shared lines and passages, personal data, and odd texts."""
    base = " ".join(prose(1, 160))
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (5, 60, 110)]
    far = " ".join([w if i % 4 else "other" for i, w in enumerate(words)])
    line = "This very line of more than forty characters is shared by many."
    shared = [f"{' '.join(prose(10 + i, 30))}\n  {line.upper() if i % 2 else line}\t\n{' '.join(prose(30 + i, 20))}" for i in range(7)]
    passage = " ".join(prose(99, 50))
    holders = [f"{' '.join(prose(200 + i, 40))} {passage} {' '.join(prose(300 + i, 25))}" for i in range(3)]
    private = ["mail a.b+c@x-y.example.org now, host 10.0.255.1 and 300.1.1.1, card 4111 1111 1111 1111", "call +1 (269) 555-3296 4524132264652876 or jane (at) site (dot) com"]
    odd = [None, "", " ", "\n\n", "a", "one two three four", "one two three four five", "7 8 9 !!", " x　y", "x " * 300, "BM RIFF \x89PNG PK\x03\x04"]
    long = " ".join(prose(7, 9000))
    return [base, base, base, *near, far, *shared, *holders, *private, *odd, long, long + " end"]


def documents(spark: SparkSession) -> DataFrame:
    """All of these, with a null id, rows that are there twice, and languages and sources that are missing."""
    rows = [(i, t, ("en", "fr", None)[i % 3], "src0" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts())]
    rows += [(None, "a document without an id " + " ".join(prose(55, 40)), "en", "src0", 0), rows[0], rows[8]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
