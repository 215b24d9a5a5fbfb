"""The grammar of literal collections against Python's own reading."""

import ast
import random

from pyspark.sql import functions as F

from limpid.functions.literals import is_literal_collection

CASES = [
    "[]", "()", "{}", "set()", "[1]", "(1)", "(1,)", "(1, 2)", "(1, 2,)", "[1, 2,]", "[,]", "[1,,2]", "{1}", "{1, 2}", "{1: 2}", "{1: 2,}", "{'a': [1, (2, {'b': None})]}", "{1: 2, 3}",
    "{[1]: 2}", "{[1]}", "{(1, [2])}", "{(1, 2)}", "{(1, 2): 'x'}", "{{}}", "[a]", "[1 2]", "['a' 'b']", "['a', \"b\"]", "[\"it's\"]", "['it\\'s']", "['a]", "[']']", "['[', '(']", "['''x'y''']", '["""x"y"""]', "[r'a\\d']", "[b'x']", "[u'x']", "[f'x']",
    "[True, False, None]", "[true]", "[null]", "[Truee]", "[...]", "[....]", "[-1, +2, - 3]", "[--1]", "[1.5, .5, 5., 1e5, 1E-3, 1_000]", "[1__0]", "[007]", "[00]", "[007.5]", "[0x1F, 0o17, 0b11]", "[0b2]", "[1j, 1+2j, -1.5-2J]", "[1+2]", "[1-2]",
    "[1.2.3]", "[set()]", "[ 1 ,\n2 ]", "( )", "[( )]", "([1])", "(('a'))", "(('a',))", "('a', )", "[1](2)", "[1][0]", "{'a' 1}", "{'a': }", "{: 1}", "[x for x in y]", "['a\nb']", "[1;2]", "[NA]", "[~]", "[\\]", "[[1, 2], [3, 4]]", "((1, 2), (3, 4))", "[1, (2)]", "{'a': 1, 'a': 2}", "(,)", "[1_]", "[1 .5]", "['a'1]", "[1'a']", "[()]", "{()}", "{(): ()}", "[True1]", "[1True]",
]


def python_says(text):
    try:
        return isinstance(ast.literal_eval(text), (list, dict, set, tuple))
    except (ValueError, SyntaxError, TypeError):
        return text == "set()"


def random_text(draw, depth):
    if depth == 0 or draw.random() < 0.3:
        return draw.choice(["1", "-2.5", "'a, b'", '"(["', "None", "True", "1e3", "'it\\'s'", "x", "''"])
    parts = [random_text(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    if draw.random() < 0.3:
        parts = [f"{draw.choice(['1', repr('k'), '(1, 2)', '[1]'])}: {p}" for p in parts]
    opened, closed = draw.choice(["[]", "()", "{}", "[]", "{}"])
    return opened + draw.choice([",", ", ", " ,\n"]).join(parts) + draw.choice(["", "", ","]) + closed


def test_collections_agree_with_the_language(spark):
    draw = random.Random(8)
    texts = sorted({*CASES, *(random_text(draw, 4) for _ in range(1500))})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["is"] for r in df.select("t", is_literal_collection(F.col("t")).alias("is")).collect()}
    assert [(t, got[t]) for t in texts if got[t] != (python_says(t) and t.strip()[0] in "[({s")] == []


def test_long_deep_and_null(spark):
    long = ["[" + ", ".join(["'it\\'s', (1, 2)"] * 50_000) + "]", "{" + ", ".join(f"'{i}': {i}" for i in range(50_000)) + "}", "[" + "'" * 100_001 + "]", "[" + "1_" * 50_000 + "1]"]
    df = spark.createDataFrame([(t,) for t in [*long, "[" * 8 + "]" * 8, "[" * 9 + "]" * 9, "", " ", None, " [1] "]], "t string")
    got = [r[0] for r in df.select(is_literal_collection(F.col("t"))).collect()]
    assert got[0] and got[1] and not got[2] and got[3] and got[4:] == [True, False, False, False, None, True]
