"""Sketch duplicates against comparing all pairs of sets."""

import random

import duckdb
import numpy as np
import pytest

from limpid.llm import minhash, queries
from limpid.llm.confirm import confirmed, linked, shingle_set
from limpid.llm.common import WordHashes
from limpid.llm.minhash import agreements, band_tokens, fingerprint, runs, similarity_sketch, sketch_duplicates
from tests.llm.corpus import documents, empty, prose
from tests.llm.test_operators import WORD, ascii_lower, same

SF = "/root/testdata/sf0.001"


def brute(rows, width=2):
    sets = []
    for _, t in rows:
        w = WORD.findall(ascii_lower(t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), c := least.get(find(i), doc), doc == c) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def found(df):
    return sketch_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()


def graded(n, step, words=120):
    """Copies, each of a group a little further from the first."""
    base, made = prose(6, words), []
    for i in range(n):
        w = list(base)
        for j in range(i // step):
            w[(j * 17 + i) % words] = f"new{i}x{j}"
        made.append((100 + i, " ".join(w)))
    return made


def test_awkward_corpus(spark):
    docs = documents(spark)
    same(found(docs), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_small_and_graded_sets(spark):
    made = [(i, " ".join(prose(5, n))) for i, n in enumerate(range(1, 17))] + graded(90, 6)
    same(found(spark.createDataFrame(made, "doc_id long, text string")), brute(made))


def test_groups_in_blocks(spark, monkeypatch):
    """Copies too far from their least one to be tied to it, in tiny blocks, and texts that share much but not enough."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    draw, base = random.Random(9), prose(8, 100)
    made = graded(40, 4)
    made += [(300 + i, " ".join(w if draw.random() > 0.06 else f"own{i}x{j}" for j, w in enumerate(base))) for i in range(80)]
    made += [(500 + i, " ".join(base[:70] + prose(600 + i, 30))) for i in range(30)]
    same(found(spark.createDataFrame(made, "doc_id long, text string").repartition(5)), brute(made))


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(queries.ORACLE["op12_minhash"])
    got = queries.op12_minhash(spark, SF)
    assert got.columns == want.columns
    same(got.collect(), want.fetchall())


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 160, 1000])
def test_all_coordinates_fill(n):
    s = np.random.default_rng(n).integers(1, 2**63, n).astype(np.uint64)
    values = similarity_sketch(s)
    assert len(values) == minhash.COORDINATES and (values != minhash._EMPTY).all() and ((values >> np.uint64(32)) < 2 * minhash.COORDINATES).all()
    assert (similarity_sketch(s[::-1].copy()) == values).all() and len(set(band_tokens(values).tolist())) == minhash.BANDS


def test_sketch_is_that_of_rounds_one_by_one():
    """Rounds that are made at once change nothing."""
    s = np.random.default_rng(1).integers(1, 2**63, 50).astype(np.uint64)
    t, want = minhash.COORDINATES, {}
    for r in range(2 * t):
        for x in s:
            with np.errstate(over="ignore"):
                h = int(minhash.mixed(np.array([x + (np.uint64(r) * minhash._SEED + minhash._SEED)]))[0])
            place = ((h >> 32) * t) >> 32 if r < t else r - t
            if place not in want or want[place] >> 32 == r:
                want[place] = min(want.get(place, 2**64), r << 32 | h & 0xFFFFFFFF)
        if len(want) == t:
            break
    assert similarity_sketch(s).tolist() == [want[i] for i in range(t)]


@pytest.mark.parametrize(("n", "shared"), [(5, 4), (50, 45), (800, 700), (800, 400)])
def test_agreement_is_concentrated_about_the_similarity(n, shared):
    rng, got = np.random.default_rng(n + shared), []
    for _ in range(60):
        x = rng.integers(1, 2**63, 2 * n - shared).astype(np.uint64)
        a, b = (np.frombuffer(fingerprint(similarity_sketch(s)), np.uint16) for s in (x[:n], x[n - shared :]))
        got.append(agreements(a, b) / minhash.COORDINATES)
    j = shared / (2 * n - shared)
    assert abs(np.mean(got) - j) < 4 * np.sqrt(j * (1 - j) / minhash.COORDINATES / 60) and np.std(got) < 1.3 * np.sqrt(j * (1 - j) / minhash.COORDINATES)


def test_pairs_are_confirmed_in_groups(spark, monkeypatch):
    """A set with many partners is dealt out, and every pair is still told right."""
    monkeypatch.setattr("limpid.llm.confirm.GROUP_PAIRS", 8)
    made = graded(60, 3)
    texts = spark.createDataFrame([(i, t.encode()) for i, t in made], "set_key long, text binary")
    pairs = spark.createDataFrame([(i, 100) for i, _ in made[1:]] + [(150, 149)], "a long, b long")
    sets = {i: shingle_set(t.encode(), WordHashes(), 2) for i, t in made}
    want = {(r["a"], r["b"]) for r in pairs.collect() if linked(sets[r["a"]], sets[r["b"]])}
    got = confirmed(pairs, texts, 2).collect()
    assert 0 < len(got) == len(want) < 60 and {(r["a"], r["b"]) for r in got} == want


def test_runs_over_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4]
    table = pa.table({"k": keys, "v": list(range(8))})
    for size in (1, 2, 3, 8):
        got = [(r.column("k")[0].as_py(), r.column("v").to_pylist()) for r in runs(iter(table.to_batches(size)), 1)]
        assert got == [(1, [0, 1]), (2, [2, 3, 4]), (3, [5]), (4, [6, 7])]


def test_no_rows(spark):
    assert sketch_duplicates(empty(spark)).count() == 0
