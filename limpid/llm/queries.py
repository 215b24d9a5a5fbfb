"""The registered queries of this subpackage, and the SQL that some are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.llm.common import read
from limpid.llm.decontaminate import decontaminate
from limpid.llm.language_id import fit, held_out, predict_language
from limpid.llm.line_dedup import dedup_lines
from limpid.llm.media import media_features
from limpid.llm.minhash import sketch_duplicates
from limpid.llm.ngram_join import near_duplicates
from limpid.llm.packing import pack_documents
from limpid.llm.pii import find_personal_data
from limpid.llm.quality import resample
from limpid.llm.sharding import assign_shards
from limpid.llm.substring_dedup import dedup_substrings
from limpid.llm.target_resampling import resample_to_target
from limpid.llm.whitening import fit_whitening, whiten


#: Bytes of a shard of op3_sharding.
SHARD_BYTES = 8 << 20


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_features(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "media.*")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = assign_shards(docs, "doc_id", F.col("n_bytes"), SHARD_BYTES)
    return out.select("doc_id", "n_bytes", F.col("shard.prefix").alias("shard_prefix"), F.col("shard.depth").cast("long").alias("shard_depth"), F.col("shard.bytes").alias("shard_bytes"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.concat_ws(",", "hits.items")
    return out.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "hits.contaminated")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "found.n_email", "found.n_ip", "found.n_card", "found.n_phone", "found.base_sha256", "found.spans")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample_to_target(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(vectors, "embedding", components=4)
    n, explained, error = (model.n, model.explained.tolist(), model.identity_error) if model else (0, [], 0.0)
    each = whiten(vectors, model, "embedding").select("vec_id", "white.deviation", F.posexplode("white.whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(e) for e in explained]).cast("array<double>"), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {"op1_media": op1_media, "op2_substring_dedup": op2_substring_dedup, "op3_sharding": op3_sharding, "op4_line_dedup": op4_line_dedup, "op5_quality": op5_quality, "op6_ngram_join": op6_ngram_join, "op7_language_id": op7_language_id, "op8_decontaminate": op8_decontaminate, "op9_pii": op9_pii, "op10_packing": op10_packing, "op11_target_resampling": op11_target_resampling, "op12_minhash": op12_minhash, "op13_whitening": op13_whitening}

ORACLE = {
    "op2_substring_dedup": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
          SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM dw WHERE len(w) >= 35)),
        again AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE win IN (SELECT win FROM again)),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw),
        kept AS (SELECT words.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
                        sha256(coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL), '')) AS s
                 FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
        SELECT dw.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(s, sha256('')) AS kept_sha256
        FROM dw LEFT JOIN kept ON dw.doc_id = kept.doc_id""",
    "op3_sharding": f"""
        WITH RECURSIVE rows AS (
          SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                 array_to_string([lpad(to_binary(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), i, 8) AS BIGINT)), 32, '0')
                                  for i in [1, 9, 17, 25]], '') AS bits
          FROM documents),
        buckets AS (
          SELECT d, left(bits, d) AS prefix, sum(n_bytes) AS size, count(DISTINCT bits) AS n
          FROM rows, (SELECT unnest(range(0, 129)) AS d) GROUP BY ALL),
        leaf AS (
          SELECT bits, min(d) AS d FROM rows JOIN buckets ON left(rows.bits, d) = prefix
          WHERE size <= {SHARD_BYTES} OR n = 1 OR d = 128 GROUP BY bits)
        SELECT doc_id, n_bytes, prefix AS shard_prefix, CAST(leaf.d AS BIGINT) AS shard_depth, CAST(size AS BIGINT) AS shard_bytes
        FROM rows JOIN leaf USING (bits) JOIN buckets ON buckets.d = leaf.d AND prefix = left(bits, leaf.d)""",
    "op4_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
        keyed AS (
          SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM lines),
        common AS (
          SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
          GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
               CAST(count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id""",
    "op6_ngram_join": r"""
        WITH RECURSIVE dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (
          SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b
          FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
          JOIN sizes sa ON sa.doc_id = a.doc_id JOIN sizes sb ON sb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id
          HAVING 100 * count(*) >= 80 * (any_value(sa.n) + any_value(sb.n) - count(*))),
        reach AS (
          SELECT doc_id AS a, doc_id AS b FROM documents
          UNION
          SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT dw.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id
        FROM dw LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)""",
    "op8_decontaminate": r"""
        WITH dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        iw AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
          SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
          FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
                FROM iw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT k FROM windows),
        grams AS (
          SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
        found AS (SELECT doc_id, item_id, grams.k, i FROM grams JOIN windows ON grams.win = windows.win AND grams.k = windows.k),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_target_resampling": r"""
        WITH crc AS (
          SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
                   lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
        words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r, t
          FROM (SELECT doc_id, text, false AS t FROM documents UNION ALL SELECT NULL, text, true FROM benchmark)),
        grams AS (
          SELECT r, t, unnest(w) AS g FROM words
          UNION ALL
          SELECT r, t, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
        counted AS (SELECT g, count(*) FILTER (NOT t) AS s, count(*) FILTER (t) AS t FROM grams GROUP BY g),
        placed AS (
          SELECT g, s, t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                   list_transform(range(octet_length(encode(g))), lambda i: CAST('0x' || substr(hex(encode(g)), 2 * i + 1, 2) AS BIGINT))),
                   lambda c, b: xor(c >> 8, step[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
          FROM counted, crc),
        totals AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM placed),
        gains AS (
          SELECT bucket, CAST(floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * (any_value(s_all) + 10000)
                                              / ((CAST(sum(s) AS DOUBLE) + 1) * (any_value(t_all) + 10000)))) AS BIGINT) AS gain
          FROM placed, totals GROUP BY bucket),
        means AS (
          SELECT r, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
          FROM grams JOIN placed USING (g) JOIN gains USING (bucket) WHERE NOT grams.t GROUP BY r),
        scored AS (
          SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                                   / 4294967296::DOUBLE))) AS BIGINT) AS score
          FROM words LEFT JOIN means USING (r) WHERE NOT t),
        ordered AS (
          SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
                 count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= floor(25 * n / 100) THEN place END AS rank
        FROM ordered""",
    "op12_minhash": r"""
        WITH RECURSIVE dw AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (
          SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        held AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY hash(g), g) AS p FROM grams JOIN sizes USING (doc_id)),
        likely AS (
          SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
          FROM held a JOIN held b ON a.g = b.g AND a.doc_id < b.doc_id
          WHERE a.p <= a.n - ceil(a.n * 4 / 5) + 1 AND b.p <= b.n - ceil(b.n * 4 / 5) + 1 AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        linked AS (
          SELECT likely.a, likely.b
          FROM likely JOIN grams x ON x.doc_id = likely.a JOIN grams y ON y.doc_id = likely.b AND x.g = y.g
          JOIN sizes sa ON sa.doc_id = likely.a JOIN sizes sb ON sb.doc_id = likely.b
          GROUP BY likely.a, likely.b
          HAVING 100 * count(*) >= 80 * (any_value(sa.n) + any_value(sb.n) - count(*))),
        links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
        reach AS (
          SELECT doc_id AS a, doc_id AS b FROM documents
          UNION
          SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT dw.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id, dw.doc_id = m AS kept
        FROM dw LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)""",
}
