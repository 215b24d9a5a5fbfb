"""The pipeline's stages against brute force, each on its own input."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from limpid.llm.common import stored
from tests.llm.corpus import documents, prose
from tests.llm.test_operators import WORD, brute_components, brute_hits, brute_lines, sha


def test_stages(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(prose(99, 50))), (2, " ".join(prose(200, 30)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stored(stage(spark, docs, str(tmp_path)))
        if name == "packing":
            assert sum(r["length"] for r in docs.collect()) >= len(before)
            continue
        assert docs.columns == columns
        after = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "language_id":
            assert all(any(map(str.isalpha, t)) for _, t in after)
            assert len(after) == sum(t is not None and any(map(str.isalpha, t)) for _, t in before)
        elif name == "line_dedup":
            assert sorted(sha(t) for _, t in after) == sorted(h for *_, h in brute_lines(before))
        elif name == "near_duplicates":
            want = {c for _, n, c in brute_components(before) if n}
            assert sorted(map(str, (d for d, t in after if WORD.search(t or "")))) == sorted(map(str, want))
        elif name == "decontaminate":
            want = [d for d, _, _, _, bad in brute_hits(before, items) if not bad]
            assert sorted(map(str, (d for d, _ in after))) == sorted(map(str, want)) and len(after) < len(before)


def test_run(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 10


def test_language_stage_keeps_what_has_a_letter(spark, tmp_path):
    draw = random.Random(2)
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=50_000)), "Ж", "12 a", "ʰ", *(" ".join(prose(i, 40)) for i in range(30))]
    # Six languages with the same words, so that no score stands out.
    rows = [(i, t, f"l{i % 6}") for i, t in enumerate(texts)] + [(100, "7 8 !", "l0"), (101, "", "l1"), (102, None, "l2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for given in (docs, docs.withColumn("lang", F.lit(None).cast("string")), docs.limit(0)):
        kept = corpus_pipeline.known_language(spark, given, str(tmp_path))
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in given.collect() if r["doc_id"] < 100)
