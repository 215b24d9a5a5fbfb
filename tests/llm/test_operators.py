"""Each operator against a brute-force version, over the awkward corpus."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from limpid.llm import media, ngram_join, packing, pii, quality, sharding
from limpid.llm.components import components
from limpid.llm.decontaminate import decontaminate
from limpid.llm.language_id import fit, held_out, predict_language
from limpid.llm.common import text_hash
from limpid.llm.line_dedup import NO_ID, dedup_lines, keep_bitmaps
from limpid.llm.media import media_features, sniff, sniff_media
from limpid.llm.ngram_join import light_boundary, near_duplicates, one_of_each
from limpid.llm.packing import pack_documents
from limpid.llm.substring_dedup import compacted, dedup_substrings
from tests.llm.corpus import documents, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# ---------------------------------------------------------------- substring dedup
def brute_substrings(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def test_substrings(docs, rows):
    got = dedup_substrings(docs).select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256").collect()
    same(got, brute_substrings(rows))


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(spark, seed):
    """Tiny vocabularies: edges branch everywhere and windows repeat inside a document."""
    rng = np.random.default_rng(seed)
    made = [(int(i), " ".join(rng.choice(["a", "b"], size=int(n), p=[0.9, 0.1]))) for i, n in enumerate(rng.integers(0, 90, 25))]
    got = dedup_substrings(spark.createDataFrame(made, "doc_id long, text string"), window=9, k=3).select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256").collect()
    same(got, brute_substrings(made, 9))


@pytest.mark.parametrize(("window", "k"), [(400, 8), (6, 6), (9, 1)])
def test_substrings_of_other_widths(spark, window, k):
    base = prose(21, 1500)
    texts = [base, base[100:700] + prose(22, 90), prose(23, 50) + base[600:1400], base[:window], base[3 : window + 2], prose(24, 7) * 12]
    made = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = dedup_substrings(spark.createDataFrame(made, "doc_id long, text string"), window=window, k=k).select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256").collect()
    same(got, brute_substrings(made, window))


def test_windows_that_do_not_fit_are_refused(docs):
    for window in (7, 70_000):
        with pytest.raises(ValueError):
            dedup_substrings(docs, window=window)


def test_paths_compact_to_their_first_nodes(spark):
    """A chain of 200 nodes, a node with two followers, one with fewer copies than what follows, and a cycle of two."""
    nodes = [(i, 3, 2, i + 1, i + 1) for i in range(1, 200)] + [(200, 3, 2, 0, 0), (300, 4, 1, 301, 302), (301, 2, 1, 0, 0), (302, 4, 5, 0, 0), (400, 2, 1, 302, 302), (500, 2, 1, 501, 501), (501, 2, 1, 500, 500)]
    table = spark.createDataFrame(nodes, "node long, copies long, windows long, low long, high long")
    got = {r["head"]: r["extra"] for r in compacted(table, rounds=60).collect()}
    assert got[1] == 2 * 199 and not set(range(2, 201)) & set(got)
    assert {k: got[k] for k in (300, 301, 302, 400)} == {300: 0, 301: 0, 302: 0, 400: 0}
    some = {r["head"]: r["extra"] for r in compacted(table, rounds=2).collect()}
    assert sum(2 + some[h] for h in some if h <= 200) == 400


# ---------------------------------------------------------------- line dedup
def brute_lines(rows, min_chars=40, min_docs=5):
    strip = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, t in rows:
        for x in (t or "").split("\n"):
            if len(strip(x)) >= min_chars:
                holders[strip(x)].add(doc)
    keeper = {k: max(v, key=lambda d: -1 if d is None else d) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(strip(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def test_lines(docs, rows):
    got = dedup_lines(docs).select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept_sha256").collect()
    assert sum(r["n_dropped"] for r in got) > 4
    same(got, brute_lines(rows))


def test_bitmaps_are_of_the_lines(docs, rows):
    """What comes back for a document that loses lines is a bitmap of its lines; no text."""
    bitmaps = keep_bitmaps(docs)
    assert bitmaps.columns == ["doc", "text_key", "n_lines", "n_dropped", "keep_bitmap"]
    keys = {r["k"]: r["text"] for r in docs.select("text", text_hash(F.col("text")).alias("k")).collect()}
    got = []
    for r in bitmaps.collect():
        keep = np.unpackbits(np.frombuffer(zlib.decompress(r["keep_bitmap"]), np.uint8))[: r["n_lines"]]
        lines = keys[r["text_key"]].split("\n")
        got.append((None if r["doc"] == NO_ID else r["doc"], len(lines), r["n_dropped"], sha("\n".join(x for x, k in zip(lines, keep, strict=True) if k))))
        assert len(lines) == r["n_lines"] and r["n_dropped"] == r["n_lines"] - keep.sum()
    same(got, {x for x in brute_lines(rows) if x[2]})


@pytest.mark.parametrize("seed", range(4))
def test_lines_across_ranges(spark, seed):
    """Few keys over many partitions: runs cross the edges of ranges, and one line is everywhere."""
    rng = np.random.default_rng(seed)
    made = [(int(d), "\n".join(["x" * int(rng.integers(1, 6)) for _ in range(int(rng.integers(0, 5)))] + ["always here"])) for d in rng.permutation(60)]
    made += [made[0]] * 50  # rows that are there again
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = dedup_lines(spark.createDataFrame(made, "doc_id long, text string"), min_chars=1, min_docs=5).select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept_sha256").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    same(got, brute_lines(made, 1, 5))


# ---------------------------------------------------------------- n-gram join
def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(ascii_lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
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
    return [(doc, len(s), least.get(find(i), doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates(docs, rows):
    same(near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect(), brute_components(rows))


def test_small_and_graded_sets(spark):
    """Sets of one to twelve shingles, and a chain of copies each a little further from the first."""
    made = [(i, " ".join(prose(5, n))) for i, n in enumerate(range(1, 17))]
    base = prose(6, 120)
    for i in range(90):
        words = list(base)
        for j in range(i // 6):
            words[(j * 17 + i) % 120] = f"new{i}x{j}"
        made.append((100 + i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    same(got, brute_components(made))


def test_boundary_follows_cost():
    assert light_boundary(0) < light_boundary(0.5) <= light_boundary(5) <= light_boundary(60)
    for partners in (0, 0.5, 5):
        n = light_boundary(partners)
        cost = lambda n: sum(math.comb(n, c) for _, c in ngram_join.subsets_of(n, n)) - ngram_join.prefix_size(n) * (1 + partners * ngram_join.PAIR_COST)
        assert cost(n) <= 0 < cost(n + 1)


def test_lists_scanned_in_blocks(spark, monkeypatch):
    """Graded copies, a boilerplate with own words, and sets of all sizes, with nearly all lists long and blocks tiny."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base, made = prose(6, 120), []
    for i in range(60):
        words = list(base)
        for j in range(i // 4):
            words[(j * 17 + i) % 120] = f"new{i}x{j}"
        made.append((i, " ".join(words)))
    made += [(100 + i, " ".join(base[: 40 + i] + prose(400 + i, i))) for i in range(0, 60, 2)]
    made += [(200 + i, " ".join(prose(500 + i, 8 + i) + base)) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    same(got, brute_components(made))


def test_rows_of_a_boilerplate_are_bounded(spark):
    """20 000 documents with one head: what is dealt out follows what may still link, not their square."""
    n, block = 20_000, ngram_join.BLOCK
    entries = spark.range(n).select(F.lit(1).alias("head"), F.col("id").alias("set_key"), F.lit(230).alias("n"), F.lit(200).alias("room"), F.col("id").alias("root"))
    # They share 200 of 230 shingles: no partner of their own size is left.
    assert ngram_join.dealt_members(entries).count() == 0
    # One component, and ten outsiders that may link to it: its sets meet the outsiders' block only.
    mixed = entries.withColumn("room", F.lit(230)).withColumn("root", F.when(F.col("set_key") < n - 10, F.lit(0).cast("long")).otherwise(F.col("set_key")))
    assert ngram_join.dealt_members(mixed).count() <= 2 * (n + 10 * (n // block + 2))
    # Nothing known: every block meets every block of its size class and the next.
    assert ngram_join.dealt_members(entries.withColumn("room", F.lit(230))).count() <= 2 * n * (n // block + 1)


def test_one_of_each(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    kept = one_of_each(spark.read.parquet(str(tmp_path / "d"))).collect()
    want = {c for _, n, c in brute_components(rows) if n}
    assert Counter(r["doc_id"] for r in kept if WORD.search(r["text"] or "")) == Counter(want)
    assert sum(not WORD.search(t or "") for _, t in rows) == sum(not WORD.search(r["text"] or "") for r in kept)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# ---------------------------------------------------------------- decontamination
def brute_hits(rows, items, size=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = []
    for item, t in items:
        w = find(t)
        windows += [(item, w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    out = []
    for doc, t in rows:
        w, hit, names = find(t), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    names.add(item)
        names.discard(None)
        out.append((doc, len(w), len(hit), ",".join(sorted(map(str, names))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize(("shingle", "bits"), [(3, 1 << 27), (1, 64), (5, 64), (13, 1 << 20)])
def test_decontaminate(spark, docs, rows, shingle, bits):
    """Any shingle and any bitmap find the same; a small bitmap passes most places, and the joins settle them."""
    items = [(1, " ".join(prose(99, 50))[:120]), (2, "One, two!"), (10, " ".join(prose(201, 20))), (3, None), (4, "?!"), (None, " ".join(prose(200, 15)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench, shingle=shingle, most_bits=bits).select("doc_id", "hits.n_words", "hits.n_hit", F.array_join("hits.items", ","), "hits.contaminated").collect()
    assert sum(r["n_hit"] for r in got) > 20
    same(got, brute_hits(rows, items))


def test_decontaminate_without_broadcasts(spark, docs, rows, monkeypatch):
    """Beyond the bounds joins are shuffled, and a shingle's places dealt to parts: the rows are the same."""
    monkeypatch.setattr("limpid.llm.decontaminate.FEW_WINDOWS", 0)
    monkeypatch.setattr("limpid.llm.decontaminate.FEW_BYTES", -1)
    items = [(1, " ".join(prose(99, 50))[:120]), (2, "One, two!"), (10, " ".join(prose(201, 20))), (None, " ".join(prose(200, 15)))]
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "hits.n_words", "hits.n_hit", F.array_join("hits.items", ","), "hits.contaminated").collect()
    same(got, brute_hits(rows, items))


def test_words_of_many_texts_are_hashed_together():
    """Looking each word up in a dict, text by text, was most of both readings; hashes must not depend on where a word lies."""
    from limpid.llm.decontaminate import Bitmap, Words, hashed_together, words_of

    draw = np.random.default_rng(8)
    pool = [b"a", b"A", b"ab", b"abcdefgh", b"abcdefghi", "ñandú".encode(), "a　b\x85".encode(), b"x" * 63, b"x" * 64, b"x" * 65, b"x" * 64 + b"y", b"z" * 300, b"a\x01b", b"\x00"]
    texts = [b"", b"...", *(b"".join(pool[i] + b" ,"[: draw.integers(0, 3)] for i in draw.integers(0, len(pool), 12)) for _ in range(200)), b""]
    words, known = Words(texts), {}
    for i, text in enumerate(texts):
        begin, end = words.bounds[i : i + 2].tolist()
        want = words_of(text)
        assert end - begin == len(want) and (not want or words.between(begin, end) == want)
        for word, h in zip(want, words.hashes[begin:end].tolist(), strict=True):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    everything = Bitmap(np.full(4096, 255, np.uint8))
    of, at, _ = words.shingles(3, everything)
    assert list(zip(of.tolist(), at.tolist(), strict=True)) == [(i, int(words.bounds[i]) + k) for i, t in enumerate(texts) for k in range(len(words_of(t)) - 2)]
    assert [t for part in hashed_together(iter(texts)) for t in part] == texts and not Words([]).hashes.size


# ---------------------------------------------------------------- media
def test_media_round_trip(docs, rows):
    got = media_features(docs).select("doc_id", "media.*").collect()
    want = []
    for doc, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        want.append((doc, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p) + 44))
    same([r[:6] for r in got], want)
    assert all(r["feature"].startswith("audio/wav;corrected=true") for r in got)


def _png():
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")


def test_sniffing_confirms_rejects_and_carves(spark):
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    broken = bytearray(_png())
    broken[20] ^= 1
    import gzip

    packed = gzip.compress(b"hello" * 50)
    assert [x[0] for x in sniff(b"junk" + _png() + b"BM" + gif + packed + bytes(broken), media._automaton())[1]] == ["image/png", "image/gif", "application/gzip"]
    df = spark.createDataFrame([(1, bytearray(_png() + gif), "image/gif"), (2, None, None), (3, bytearray(b"BMBMBM"), "image/bmp")], "i int, m binary, d string")
    got = {r["i"]: r["sniffed"] for r in sniff_media(df, "m", "d").collect()}
    assert got[1]["media_type"] == "image/png" and got[1]["corrected"] and [e["type"] for e in got[1]["embedded"]] == ["image/gif"] and bytes(got[1]["embedded"][0]["data"]) == gif
    assert got[2]["media_type"] is None and got[3]["media_type"] is None and got[3]["candidates"] == 3


# ---------------------------------------------------------------- sharding
def test_sharding(spark, docs, rows):
    out = sharding.assign_shards(docs, "doc_id", F.octet_length("text"), 2000, bits_a_round=2).select("doc_id", "text", "shard.*").collect()
    assert len(out) == len(rows)
    by, size = defaultdict(set), Counter()
    for r in out:
        by[r["prefix"]].add(r["doc_id"])
        size[r["prefix"]] += len((r["text"] or "").encode())
        digest = hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
        assert f"{int(digest, 16):0128b}".startswith(r["prefix"]) and r["depth"] == len(r["prefix"])
    assert all(size[p] <= 2000 or len(by[p]) == 1 for p in by)
    assert all(r["bytes"] == size[r["prefix"]] for r in out)
    parents = {p[:-1] for p in by if p}
    total = lambda q: sum(s for p, s in size.items() if p.startswith(q))
    assert all(total(p) > 2000 for p in parents)


def test_shards_are_written(spark, docs, tmp_path):
    out = sharding.assign_shards(docs, "doc_id", F.octet_length("text"), 20_000)
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# ---------------------------------------------------------------- quality
def mixed(x):
    """The finaliser of the 64-bit hash of n-grams, in whole numbers."""
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD % 2**64
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 % 2**64
    return x ^ x >> 33


def brute_buckets(text):
    words = [xxhash.xxh3_64_intdigest(w.encode()) for w in WORD.findall(ascii_lower(text or ""))]
    grams = words + [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(words, words[1:], strict=False)]
    return Counter(mixed(g) % 10_000 for g in grams)


def brute_gumbel(key, seed):
    """Noise from XXH64 of the seed and the id; a null id adds nothing to the hash."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42)
    h = h if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=h)
    return -math.log(-math.log(((h >> 11) + 0.5) / 2**53))


def test_resampling_weights_and_selection(spark, docs, rows):
    """Against buckets, models, weights, noise and choice of the k largest that share no code with the operator."""
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i == 4)) for i in range(20)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels, share=0.5).collect()
    target = {i for i in range(0, 20, 2) if i != 4}
    found = [brute_buckets(t) for _, t in rows]
    raw, wanted = Counter(), Counter()
    for f, (doc, _) in zip(found, rows, strict=True):
        raw.update(f)
        if doc in target:
            wanted.update(f)
    total = lambda c: sum(c.values()) + 10_000
    ratio = {g: math.log((wanted[g] + 1) / total(wanted)) - math.log((raw[g] + 1) / total(raw)) for g in raw}
    weights = [sum(n * ratio[g] for g, n in f.items()) for f in found]
    keys = [w + brute_gumbel(d, 17) for w, (d, _) in zip(weights, rows, strict=True)]
    last = round(sorted(keys)[-round(0.5 * len(rows))], 5)
    want = sorted((str(d), round(w, 5), round(k, 5), round(k, 5) >= last) for (d, _), w, k in zip(rows, weights, keys, strict=True))
    close = sorted((str(r["doc_id"]), round(r["log_weight"], 5), round(r["sample_key"], 5), r["selected"]) for r in got)
    for x, y in zip(close, want, strict=True):
        assert x[0] == y[0] and abs(x[1] - y[1]) < 1e-4 and abs(x[2] - y[2]) < 1e-4 and x[3] == y[3]


def test_kth_largest(spark):
    values = [5, 1, 9, 9, -3, 7, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [quality.kth_largest(df, "v", k, ways=4) for k in range(1, 8)] == sorted(values, reverse=True)
    assert quality.kth_largest(df.where("v > 10000000000000"), "v", 1) is None


# ---------------------------------------------------------------- language
def test_languages_are_told(spark):
    draw = np.random.default_rng(3)
    parts = {"aa": ["ka", "ko", "tu"], "bb": ["shi", "ran", "el"], "cc": ["ö", "ßt", "ung"]}
    made = [(int(i), " ".join("".join(draw.choice(parts[k], 3)) for _ in range(int(draw.integers(5, 40)))), k) for k in parts for i in draw.integers(0, 10**6, 40)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    got = predict_language(docs, model).select("lang", "language.lang", "language.score").collect()
    assert all(r[0] == r[1] and 0 <= r[2] <= 1 for r in got)


def test_language_of_awkward_texts(docs):
    model = fit(docs)
    got = {(r["doc_id"], r["text"]): r["language"] for r in predict_language(docs, model).collect()}
    for (_, text), told in got.items():
        assert (told["lang"] == "und") == (text is None or not any(map(str.isalpha, text)))
    assert {r["language"]["lang"] for r in predict_language(docs, None).collect()} == {"und"}


def test_scores_are_those_of_kernel_ridge_regression(spark):
    """Against n-gram sets of strings, their kernel matrix and the normal equations written out."""
    draw = random.Random(8)
    letters = {"aa": "abcde ", "bb": "defgh ", "cc": "hijab "}
    known = [(k, "".join(draw.choices(marks, k=draw.randint(20, 80)))) for k, marks in letters.items() for _ in range(12)]
    model = fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(known)], "doc_id long, text string, lang string"), ridge=0.05)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}
    alike = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    sets = [grams(t) for _, t in known]
    k = np.array([[alike(a, b) for b in sets] for a in sets])
    labels = np.array([sorted(letters).index(x) for x, _ in known])
    y = np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    w = np.diag([1 / np.mean(labels == x) / 3 for x in labels])
    alpha = np.linalg.solve(k.T @ w @ k + 0.05 * len(known) * k / 100 + 1e-6 * np.eye(len(known)), k.T @ w @ y)
    unseen = ["".join(draw.choices("".join(letters.values()), k=60)) for _ in range(30)]
    want = np.array([[alike(grams(t), s) for s in sets] for t in unseen]) @ alpha
    assert np.abs(model.scores(unseen) - want).max() < 0.02


def test_held_out_languages_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    unseen = docs.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    right = predict_language(unseen, model).agg(F.avg((F.col("language.lang") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.98


LANGUAGES = {"aa": ["ka", "ko", "tu"], "bb": ["shi", "ran", "el"], "cc": ["ö", "ßt", "ung"]}


def made_up(lang, n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(LANGUAGES[lang], k=3)) for _ in range(n))


def test_language_of_long_and_noisy_texts(spark):
    known = [(i, made_up(k, 30, f"{k}{i}"), k) for k in LANGUAGES for i in range(40)]
    model = fit(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    for lang in LANGUAGES:
        run = made_up(lang, 3000, 1) + " " + noise(60_000)
        strewn = " ".join(f"{made_up(lang, 8, i)} {noise(8)}" for i in range(10_000))
        scores = model.scores([run, strewn])
        assert [model.languages[i] for i in scores.argmax(axis=1)] == [lang, lang]
        # What is told apart in a text stays told apart when it goes on in the same way.
        short, long = model.scores([strewn[:20_000], strewn])
        assert np.abs(short - long).max() < 0.05


def test_languages_of_many_copies_are_learned(spark):
    texts = [(k, made_up(k, 30, 7)) for k in LANGUAGES]
    copies = spark.createDataFrame(texts, "lang string, text string").crossJoin(spark.range(5000).withColumnRenamed("id", "doc_id"))
    model = fit(copies)
    assert model.languages == sorted(LANGUAGES)
    assert [model.languages[i] for i in model.scores([made_up(k, 30, 8) for k, _ in texts]).argmax(axis=1)] == [k for k, _ in texts]


# ---------------------------------------------------------------- personal data
def test_base_spans():
    text = "x a.b@c.de 1.2.3.4.5.6.7.8 999.1.1.1. 4111-1111 1111 1111, +12 345 678 9 é z@q"
    found = [(k, text[s:e]) for k, s, e in pii.base_spans(text)]
    assert found == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111-1111 1111 1111"), ("phone", "+12 345 678 9")]
    assert pii.base_spans("") == []


def test_base_spans_are_the_patterns_matches():
    import random

    # The contract's patterns, as they stand.
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
    draw = random.Random(4)
    for marks in ("a1@._ ", "12.+ ", "0123456789 -", "+1 ().-", "b@.é\n9"):
        for _ in range(2000):
            text = "".join(draw.choice(marks) for _ in range(draw.randint(0, 50)))
            want = [("email", *m.span()) for m in email.finditer(text)]
            want += [("ip", *m.span()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
            want += [("card", *m.span()) for m in card.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
            want += [("phone", *m.span()) for m in phone.finditer(text) if 8 <= len(digits(m[0])) <= 15]
            assert pii.base_spans(text) == want, text


def test_personal_data_in_very_long_texts():
    """Runs without an end are read once, and a long stretch of entities is segmented in pieces, alike."""
    weights = np.random.default_rng(1).normal(size=(5, len(pii.FEATURES)))
    for text in ("a" * 2_000_000 + " x@", "1" * 500_000 + ".", "+1" * 300_000):
        pii.base_spans(text)
    many = "ask u1@m.example.com or 10.0.0.1 (at) 4111 1111 1111 1111 x +12 345 678 9 " * 300
    base, spans = pii.all_spans(many, weights)
    assert len(base) == 300 * 4 and set(base) <= set(spans)
    tokens = pii.regions_of(many)[0]
    whole = pii.best_segments(many, tokens, weights, len(tokens))
    assert all(pii.best_segments(many, tokens, weights, n) == whole for n in (1, 7, 2000))


def test_personal_data_is_found_and_base_stays(docs, rows):
    got = {(r["doc_id"], r["text"]): r["found"] for r in pii.find_personal_data(docs).collect()}
    for (_, text), f in got.items():
        base = pii.base_spans(text or "")
        assert f["base_sha256"] == sha(pii.digest(base))
        assert set(pii.digest(base).split(",")) - {""} <= set(f["spans"].split(","))
        assert [f[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
    assert sum(f["n_email"] for f in got.values()) == 1


def test_field_learns_forms_that_the_rules_miss():
    import random

    draw = random.Random(1)
    samples = []
    for i in range(60):
        mail = f"write to u{i}.x@mail{i}.example.com today"
        card = "paid with 4111111111111111 then"
        secret = f"key token = {draw.getrandbits(64):x} end"
        for text in (mail, card, secret):
            spans = pii.base_spans(text)
            samples += [(text, spans)] + ([pii.rewritten(text, spans, draw)] if spans else [])
    weights = pii.train(samples)
    text = "please ask bob (at) site (dot) com now"
    assert ("email", 11, 34) in pii.all_spans(text, weights)[1]
    assert pii.all_spans("Version 2.0 of 1999 and 12 apples", weights)[1] == []


def test_likelihood_gradient():
    region = pii.Region("to a@b.cc and 4111111111111111 x", [m.span() for m in pii.TOKEN.finditer("to a@b.cc and 4111111111111111 x")])
    truth = {(1, 1, 0), (3, 1, 2)}
    w = np.random.default_rng(0).normal(size=(5, len(pii.FEATURES))) * 0.1
    grad, value = pii._gradient(region, truth, w)
    for at in ((0, 0), (2, 3), (4, 0), (4, 1)):
        step = np.zeros_like(w)
        step[at] = 1e-5
        assert abs((pii._gradient(region, truth, w + step)[1] - value) / 1e-5 - grad[at]) < 1e-3


# ---------------------------------------------------------------- packing
def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file("word_bpe_49k.json"))
    got = sorted(pack_documents(docs, window=64, shard_tokens=3000).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    want = Counter()
    for doc, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[(doc, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(d for (d, _, _), n in want.items() for _ in range(n))
    filled = Counter()
    for r in got:
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 64
    total = sum(n * k for (_, n, _), k in want.items())
    assert sum(filled.values()) == total and len(filled) * 64 < total * 1.05 + 5 * 64
    single = {d: t for d, t in rows if sum(x == d for x, _ in rows) == 1}
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for doc, t in single.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_neighbours_are_lexical():
    idf = np.ones(50)
    index = packing.Index([np.array([1, 2, 3]), np.array([7, 8]), np.array([1, 2, 9]), np.array([7, 9])], idf)
    assert next(iter(index.neighbours(0, np.array([False, True, True, True])))) == 2
    assert next(iter(index.neighbours(1, np.array([True, False, True, True])))) == 3


def test_all_terms_of_a_seed_count():
    # Thirty ids that no other item has are rarer than the ids that tell the neighbour.
    idf = np.r_[np.ones(20), np.full(80, 9.0)]
    index = packing.Index([np.r_[1:9, 30:60], np.array([17, 18]), np.array([19]), np.array([1, 2, 3, 4])], idf)
    assert next(iter(index.neighbours(0, np.array([False, True, True, True])))) == 3


def test_neighbours_are_those_of_brute_force():
    draw = np.random.default_rng(6)
    items = [draw.zipf(1.3, int(draw.integers(1, 200))) % 300 for _ in range(150)]
    holders = np.bincount(np.concatenate([np.unique(x) for x in items]), minlength=300)
    idf = np.log(1 + (len(items) - holders + 0.5) / (holders + 0.5))
    mean = np.mean([len(x) for x in items])
    index, left = packing.Index(items, idf), np.ones(len(items), bool)
    for seed in draw.permutation(len(items)):
        left[seed] = False
        want = np.zeros(len(items))
        for i, x in enumerate(items):
            for t in np.intersect1d(items[seed], x):
                tf = np.count_nonzero(x == t)
                want[i] += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean))
        got = list(dict.fromkeys(index.neighbours(int(seed), left)))  # the first are given twice
        assert sorted(got) == np.flatnonzero(left).tolist()
        assert np.all(np.diff(want[got]) < 1e-9)


# ---------------------------------------------------------------- for all
def _each(docs, spark):
    bench = spark.createDataFrame([(1, "some words of a benchmark item")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    yield "media", media_features(docs)
    yield "substrings", dedup_substrings(docs)
    yield "shards", sharding.assign_shards(docs, "doc_id", F.octet_length("text"), 1000)
    yield "lines", dedup_lines(docs)
    yield "quality", quality.resample(docs, labels)
    yield "join", near_duplicates(docs)
    yield "language", predict_language(docs, fit(docs))
    yield "hits", decontaminate(docs, bench)
    yield "pii", pii.find_personal_data(docs)
    yield "packing", pack_documents(docs)


def test_empty_tables(spark):
    for name, out in _each(empty(spark), spark):
        assert out.count() == 0, name


#: Names that the operators use for themselves, anywhere in their plans, in either case.
INNER = """again around at band before beside blocks bucket copies count cut depth digest doc dropped edge end ends extra fine found h1 h2 head high hits id ids items item k1 k2 keep_bitmap kept key keys
    language leaf line lines links list lists log_weight low media met most n n_bytes n_dropped n_hit n_lines name node order other own own_digest own_doc own_key own_size own_t1 own_t2 p place places
    prefix rank_key read room root row rows sample_key seen set_key shard shingle shingles size sketch sniffed span spans start starts stat t1 t1_found t1_hit t2 t2_found t2_hit text_key token total window
    windows word __bits __doc __dropped __ends __found __hits0 __id __key __n_hit __read __row __size __sniffed __starts __text_key _t1 _doc _read""".split()  # noqa: SIM905
#: The one column of its own that each operator adds; a column of that name is replaced.
ADDED = {"media": "media", "substrings": "cut", "shards": "shard", "lines": "lines", "language": "language", "hits": "hits", "pii": "found"}


def test_clashing_columns(spark, docs):
    """Columns with all the operators' inner names come back with their values, and results are those of the table without them."""
    crowd = {name.upper() if i % 3 == 0 else name: F.concat(F.lit(f"{name}="), F.coalesce(F.xxhash64("text").cast("string"), F.lit("none"))) for i, name in enumerate(INNER)}
    crowded = docs.withColumns(crowd)
    plain = dict(_each(docs, spark))
    for name, out in _each(crowded, spark):
        if name not in ADDED:
            assert out.columns == plain[name].columns, name
            if name != "packing":
                same(out.collect(), plain[name].collect())
            continue
        added = ADDED[name]
        assert sorted(out.columns) == sorted([c for c in crowded.columns if c.lower() != added] + [added]), name
        values = [c for c in out.columns if c != added]
        same(out.select(values).collect(), crowded.select(values).collect())
        result = lambda df: df.select("doc_id", "text", F.to_json(F.struct(added))).collect()  # noqa: B023, E731
        same(result(out), result(plain[name]))


def test_empty_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).where("hits.n_hit > 0").count() == 0


def test_ids_are_the_tokenizers():
    """Words looked up apart from the marks after them, over odd letters, marks and blanks."""
    import random

    import pyarrow as pa

    words, draw = packing.word_ids("word_bpe_49k.json"), random.Random(0)
    pool = ["a", "B", "é", "é", "x́", "H̱", "≠", "İ", "ß", "ﬁ", "1", "²", "Ⅳ", "'s", "'", "’", ",", "—", "<|endoftext|>", "<|STARTOFTEXT|>", " ", "　", "\x85", "\x1c", "\t", "中", "ก็", "!!", "_", "ΑΣ", "ǅ", "‍", "😀", ".", "-", "\n"]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    for text, got in zip(texts, words.ids(pa.array(texts)), strict=True):
        assert got.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_new_words_are_looked_up_in_few_texts(monkeypatch):
    """A call of the tokenizer for each new word, and an index of all known words for each batch, were most of the work."""
    import pyarrow as pa

    words = packing.WordIds("word_bpe_49k.json")
    texts = [" ".join(f"{a}{b}ière{c}," for c in ("x", "ñu", "ОК")) for a in "abcdefgh" for b in "ijklmnop"] + ["", "it's 12 x y"]
    one_by_one = words._looked_up
    seen = []
    monkeypatch.setattr(words, "_looked_up", lambda new: seen.extend(new) or one_by_one(new))
    for _ in range(2):
        for text, got in zip(texts, words.ids(pa.array(texts)), strict=True):
            assert got.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == [",", "12", "it's"]
    # A tokenizer whose ids bear no mark at a word's end: one by one, to the same ids.
    plain = packing.WordIds("word_bpe_49k.json")
    plain.last[:] = False
    assert [x.tolist() for x in plain.ids(pa.array(texts))] == [x.tolist() for x in words.ids(pa.array(texts))]


def test_keys_of_documents_on_end():
    draw = np.random.default_rng(3)
    docs = [draw.integers(1, 9, n).astype("<u2") for n in (1, 2, 3, 40, 1, 300)]
    lengths = np.array([len(x) for x in docs])
    ids = np.concatenate(docs)
    of, unique, counts = packing.counted(ids, lengths)
    got = packing.shard_keys(ids, lengths, of, unique, counts)
    for d, (x, key) in enumerate(zip(docs, got.tolist(), strict=True)):
        want, n = np.unique(x, return_counts=True)
        assert unique[of == d].tolist() == want.tolist() and counts[of == d].tolist() == n.tolist()
        common = [int(t) for t, _ in sorted(zip(want, n, strict=True), key=lambda p: (-p[1], p[0]))]
        runs = [(int(a) << 32) + (int(b) << 16) + int(c) for a, b, c in zip(x, x[1:], x[2:], strict=False)] or x.tolist()
        least = min(((r + 1) * 0x9E3779B97F4A7C15 % 2**64) >> 33 for r in runs)
        assert key == common[0] << 47 | common[min(1, len(common) - 1)] << 31 | least
