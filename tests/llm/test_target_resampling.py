"""Resampling to a target against counting one n-gram after another."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from limpid.llm import queries, target_resampling
from limpid.llm.target_resampling import Words, bucket_places, ranked, resample_to_target, shared_prefixes, suffix_order
from tests.llm.corpus import documents, empty, prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams_of(words, grams):
    return [" ".join(words[i : i + m]) for m in range(1, grams + 1) for i in range(len(words) - m + 1)]


def brute(docs, target, grams=2, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams_of(words_of(t), grams))
    t = Counter(bucket(g) for x in target for g in grams_of(words_of(x), grams))
    s_all, t_all = float(s.total() + buckets), float(t.total() + buckets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all)))
    rows = []
    for doc, text in docs:
        words = words_of(text)
        found = [gain(bucket(g)) for g in grams_of(words, grams)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for place, r in enumerate(drawn[: len(drawn) * percent // 100], 1):
        r[5] = place
    return rows


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("grams", [1, 2, 3])
def test_awkward_corpus(spark, grams):
    docs = documents(spark)
    target = [" ".join(prose(1, 60)), None, "", "One TWO three-four five"]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], target, grams)
    got = resample_to_target(docs, spark.createDataFrame([(t,) for t in target], "text string"), grams=grams)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    same(got.collect(), want)


def test_query_and_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.ORACLE["op11_target_resampling"])
    got = queries.op11_target_resampling(spark, SF)
    assert got.columns == want.columns
    same(got.collect(), want.fetchall())


def test_texts_longer_than_a_block(spark, monkeypatch):
    """Blocks of few words, in this process: pieces of a text meet again, and no n-gram is lost or counted twice at an edge."""
    monkeypatch.setattr(target_resampling, "BLOCK_WORDS", 7)
    draw = random.Random(3)
    texts = [[draw.choice([b"a", b"b", b"c"]) for _ in range(draw.choice([0, 1, 5, 7, 8, 40]))] for _ in range(60)]
    found = Counter()
    for of, buckets in target_resampling.text_buckets(texts, Words(), 3, 1000):
        found.update(zip(of.tolist(), buckets.tolist(), strict=True))
    want = Counter((i, zlib.crc32(g.encode()) % 1000) for i, t in enumerate(texts) for g in grams_of([w.decode() for w in t], 3))
    assert found == want


def test_suffixes_are_in_order():
    """Against sorting the suffixes themselves; shared prefixes stop at the end of a text."""
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3, 5, 8):
        ids = rng.integers(0, 4, 200)
        order = suffix_order(ids, depth)
        key = lambda i: np.r_[ids, np.zeros(depth, int)][i : i + depth].tolist()  # noqa: B023, E731
        assert sorted(order.tolist()) == list(range(200)) and all(key(a) <= key(b) for a, b in zip(order, order[1:], strict=False))
        shared = shared_prefixes(ids, order, depth)
        for a, b, n in zip(order, order[1:], shared[1:], strict=False):
            k = 0
            while k < depth and max(a, b) + k < 200 and ids[a + k] == ids[b + k] > 0:
                k += 1
            assert n == k


def test_each_distinct_n_gram_is_hashed_once(monkeypatch):
    hashed = Counter()
    monkeypatch.setattr(target_resampling, "crc32", lambda b, s=0: (hashed.update([(b, s)]), zlib.crc32(b, s))[1])
    words = Words()
    ids = words.of([b"x", b"y", b"x", b"y", b"x"])
    assert sum(len(p) for p, _ in bucket_places(ids, words, 2, 100)) == 9
    assert max(hashed.values()) == 1 and len(hashed) == 4


def test_ranks_over_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 as score", "id as place").repartition(5)
    got = ranked(rows, [rows["score"].desc(), rows["id"].asc(), rows["place"].asc()]).collect()
    want = {i: k for k, i in enumerate(sorted(range(5000), key=lambda i: (-(i % 7), i)), 1)}
    assert {r["id"]: r["rank"] for r in got} == want


def test_no_rows_and_clashing_names(spark):
    assert resample_to_target(empty(spark), empty(spark)).count() == 0
    docs = spark.createDataFrame([(1, "a b " * 30, 5, "x"), (1, "a b " * 30, 6, "y"), (2, "c", 7, None)], "doc_id long, text string, rank int, score string")
    got = resample_to_target(docs, empty(spark), percent=100).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (r["doc_id"], r["rank"] or 0))] == [1, 2, None]
