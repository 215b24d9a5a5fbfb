"""Queries that profile, split and sample columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions import kinds, numbers, text
from limpid.operators import outliers as out
from limpid.operators import profile, sampling
from limpid.operators.ranks import numbered
from limpid.plans.demo import PARTS, STAR, made, table

EVENT_COLUMNS = ["user_id", "event_type", "value"]
NUMERIC = [("part", "p_retailprice"), ("orders", "o_totalprice"), ("events", "value")]


def load_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in STAR]
    first, *rest = counted
    for x in rest:
        first = first.unionByName(x)
    return first


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, PARTS)


def _part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(_parts(spark, sf_dir), "p_partkey", TEXTS)


TEXTS = ["size_text", "flag_text", "brand_text", "list_text"]


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_counts(spark, sf_dir)


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_stats(_parts(spark, sf_dir), TEXTS)


def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = profile.repetition(_part_counts(spark, sf_dir))
    return x.select("column", F.round("repeated_values", 6).alias("repeated_values"), F.round("repeated_rows", 6).alias("repeated_rows"))


def topk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(_part_counts(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [profile.numeric_stats(table(spark, sf_dir, t), [c]) for t, c in NUMERIC]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return x.select("column", *[F.round(c, 4).alias(c) for c in ("low", "high", "span", "mean", "median", "std")])


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice")
    return x.select(F.col("bin").cast("long").alias("bin"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n", F.col("height_pct").cast("long").alias("height_pct"))


def outliers_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.outliers(table(spark, sf_dir, "events"), "event_id", "value")


def outlier_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return out.outlier_context(docs, "doc_id", "n_chars")


def regex_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("v"))
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("v"))
    return brands.unionByName(names).groupBy(text.signature(F.col("v")).alias("pattern")).agg(F.count("*").alias("n"))


def shape_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shapes(table(spark, sf_dir, "part"), "p_partkey", "p_brand")


def noise_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.noise_patterns(_parts(spark, sf_dir), "p_partkey", "size_text")


def type_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("v")
    cells = profile.unpivoted(_parts(spark, sf_dir), "p_partkey", TEXTS).where("value is not null").select("column", F.col("value").alias("v")).distinct()
    return cells.select("column", "v", kinds.is_boolean(c).alias("boolean"), kinds.is_integer(c).alias("integer"), kinds.is_float(c).alias("float"), kinds.is_delimited(c).alias("delimited"))


def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.semantic_types(_part_counts(spark, sf_dir), TEXTS)


def kind_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.kind_votes(_part_counts(spark, sf_dir)).where("column = 'size_text'").select("kind", F.col("n").cast("long").alias("n"), "first_rid")


def numeric_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.numeric_parts(_parts(spark, sf_dir), "size_text").select("p_partkey", "size_text", "is_clean")


def dirty_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.dirty_top(_parts(spark, sf_dir), "p_partkey", "size_text", 20)


def datetime_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.col("o_orderpriority")).alias("d"))
    return sampling.datetime_parts(orders, "d").select("o_orderkey", "d", "is_clean")


def text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sampling.text_parts(table(spark, sf_dir, "documents"), "text")
    return x.select("doc_id", "is_short")


def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "orders"), "o_orderkey", 500, sampling.seed_of(42, "orders")).select("o_orderkey", "o_custkey")


def clean_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.clean_review(_parts(spark, sf_dir), "p_partkey", "brand_text", sampling.seed_of(42, "brand_text"))


def labelled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = _parts(spark, sf_dir).where("brand_text = 'unknown' or brand_text <> trim(brand_text) or brand_text = lower(brand_text)")
    return sampling.capped_cells(spoilt.select("p_partkey", "brand_text"), "p_partkey", 100, sampling.seed_of(42, "labels"))


def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sampling.distinct_values(table(spark, sf_dir, "part"), "p_partkey", "p_type")
    return numbered(x, "first_rid", "place").select(F.col("place").cast("long").alias("place"), "value", "n")


def text_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sampling.text_halves(sampling.distinct_values(table(spark, sf_dir, "part"), "p_partkey", "p_type"))
    return x.select("value", F.col("half").cast("long").alias("half"))


def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.page(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", 150)


def number_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _parts(spark, sf_dir).select("size_text").distinct()
    return x.select("size_text", numbers.to_number(F.col("size_text")).alias("plain"), numbers.loose_number(F.col("size_text")).alias("loose"))


_P = f"WITH parts AS ({PARTS})"
_CELLS = " UNION ALL ".join(f"SELECT p_partkey AS rid, '{c}' AS \"column\", {c} AS value FROM parts" for c in TEXTS)
_COUNTS = f'{_P}, cells AS ({_CELLS}), counts AS (SELECT "column", value, count(*) AS n, min(rid) AS first_rid FROM cells WHERE value IS NOT NULL GROUP BY 1, 2)'
_NUM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_LOOSE = f"CASE WHEN regexp_matches(replace({{0}}, ',', ''), '{_NUM}') THEN TRY_CAST(replace({{0}}, ',', '') AS DOUBLE) END"
_SCALE = """x AS (SELECT {id} AS rid, CAST({c} AS DOUBLE) AS x, * FROM {t}), m AS (SELECT median(x) AS med FROM x), d AS (SELECT median(abs(x - med)) AS mad FROM x, m),
    o AS (SELECT x.* FROM x, m, d WHERE mad <> 0 AND abs(0.6745 * (x - med) / mad) > 5.0)"""

# A text's shape: characters by class, runs of a class as islands of equal row-number differences.
_SHAPES = r"""
    chars AS (SELECT v, i, CASE WHEN regexp_matches(c, '[0-9]') THEN '\d' WHEN regexp_matches(c, '[A-Z]') THEN '[A-Z]' WHEN regexp_matches(c, '[a-z]') THEN '[a-z]'
                               WHEN regexp_matches(c, '\s') THEN '\s' WHEN regexp_matches(c, '[()\[\]{}?*+\-|^$\\.&~#]') THEN '\' || c ELSE c END AS k
              FROM (SELECT DISTINCT v, unnest(string_split(v, '')) AS c, generate_subscripts(string_split(v, ''), 1) AS i FROM texts)),
    islands AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY i) - row_number() OVER (PARTITION BY v, k ORDER BY i) AS g FROM chars),
    runs AS (SELECT v, k, g, min(i) AS a, count(*) AS n FROM islands GROUP BY v, k, g),
    shapes AS (SELECT v, '^' || string_agg(k || CASE WHEN n > 1 THEN '{' || n || '}' ELSE '' END, '' ORDER BY a) || '$' AS pattern FROM runs GROUP BY v)"""

QUERIES = {
    f.__name__: f
    for f in (
        load_counts, value_counts, column_profile, repetition, topk_values, numeric_stats, histogram, outliers_mad, outlier_context, regex_signature, shape_rows,
        noise_mask, type_flags, semantic_types, kind_votes, numeric_split, dirty_top, datetime_split, text_split, sample_exact, clean_review, labelled_cells, distinct_first_seen, text_halves, page_slice, number_readers,
    )
}
ORACLE = {
    "load_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in STAR),
    "value_counts": f'{_COUNTS} SELECT "column", value, n, first_rid FROM counts',
    "column_profile": f"""{_P} """ + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count({c}) AS present, count(DISTINCT {c}) AS "distinct",
            round((count(*) - count({c})) / count(*) * 100, 4) AS missing_pct, round(count(DISTINCT {c}) / count({c}) * 100, 4) AS unique_pct,
            round((count(DISTINCT {c}) + (count({c}) < count(*))::INT) / count(*), 6) AS uniqueness FROM parts""" for c in TEXTS),
    "repetition": f"""{_COUNTS} SELECT "column", round(count(*) FILTER (n > 1) / count(*), 6) AS repeated_values,
        round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS repeated_rows FROM counts GROUP BY 1""",
    "topk_values": f"""{_COUNTS} SELECT "column", rank, value, n, round(n / present * 100, 1) AS pct FROM (
        SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first_rid) AS rank, sum(n) OVER (PARTITION BY "column") AS present FROM counts) WHERE rank <= 5""",
    "numeric_stats": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(min({c}), 4) AS low, round(max({c}), 4) AS high, round(max({c}) - min({c}), 4) AS span, round(avg({c}), 4) AS mean,
            round(median({c}), 4) AS median, round(stddev_pop({c}), 4) AS std FROM {t}""" for t, c in NUMERIC),
    "histogram": """
        WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, (max(o_totalprice) - min(o_totalprice)) / 16 AS w FROM orders),
        c AS (SELECT CAST(least(16, greatest(1, ceil((o_totalprice - a) / w))) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1),
        f AS (SELECT i AS bin, a + (i - 1) * w AS low, a + i * w AS high, coalesce(n, 0) AS n FROM e, (SELECT unnest(range(1, 17)) AS i) LEFT JOIN c ON c.bin = i)
        SELECT bin, round(low, 6) AS low, round(high, 6) AS high, n, CAST(greatest(8, floor(n / max(n) OVER () * 100)) AS BIGINT) AS height_pct FROM f""",
    "outliers_mad": f"WITH {_SCALE.format(id='event_id', c='value', t='events')} SELECT x AS value, count(*) AS n, min(rid) AS first_rid FROM o GROUP BY 1",
    "outlier_context": f"""WITH {_SCALE.format(id='doc_id', c='n_chars', t='documents')}
        SELECT x AS outlier, doc_id, lang, source, n_chars, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY rid) AS k FROM o) WHERE k <= 2""",
    "regex_signature": f"""WITH texts AS (SELECT p_brand AS v FROM part UNION ALL SELECT c_name FROM customer), {_SHAPES}
        SELECT pattern, count(*) AS n FROM texts JOIN shapes USING (v) GROUP BY pattern""",
    "shape_rows": f"""WITH first AS (SELECT p_partkey, p_brand AS v FROM part ORDER BY p_partkey LIMIT 3000), texts AS (SELECT v FROM first), {_SHAPES}
        SELECT pattern, count(*) AS n, round(count(*) / (SELECT count(*) FROM first) * 100, 1) AS pct FROM first JOIN shapes USING (v) GROUP BY pattern
        HAVING count(*) >= 0.2 * (SELECT count(*) FROM first) ORDER BY n DESC, min(p_partkey) LIMIT 3""",
    "noise_mask": f"""{_P}, m AS (SELECT p_partkey, size_text, regexp_replace(trim(size_text), '[0-9]+(\\.[0-9]+)?', '{{N}}', 'g') AS mask FROM parts
        WHERE size_text IS NOT NULL AND NOT regexp_full_match(trim(size_text), '[0-9]+(\\.[0-9]+)?'))
        SELECT mask, arg_min(size_text, p_partkey) AS value, min(p_partkey) AS first_rid FROM m GROUP BY mask""",
    "type_flags": f"""{_P}, cells AS ({_CELLS}), v AS (SELECT DISTINCT "column", value AS v, {_LOOSE.format('value')} AS x FROM cells WHERE value IS NOT NULL)
        SELECT "column", v, lower(v) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n') AS boolean, coalesce(x = floor(x), false) AS integer,
               coalesce(x <> floor(x), false) AS float,
               len([d for d in [',', ';', '|', '/'] if contains(v, d) AND NOT list_contains([trim(p) for p in string_split(v, d)], '')]) > 0 AS delimited
        FROM v""",
    "kind_votes": f"""{_P}, v AS (SELECT p_partkey AS rid, size_text AS v, {_LOOSE.format('size_text')} AS x FROM parts WHERE size_text IS NOT NULL),
        k AS (SELECT rid, CASE WHEN x = floor(x) THEN 'integer' WHEN x IS NOT NULL THEN 'float' WHEN regexp_matches(v, '^[$]|kg$') THEN 'dirty_integer'
              WHEN v = 'N/A' THEN 'delimited_string' END AS kind FROM v)
        SELECT kind, count(*) AS n, min(rid) AS first_rid FROM k GROUP BY 1""",
    "semantic_types": f"""{_COUNTS}, k AS (SELECT "column", n, first_rid, CASE WHEN lower(value) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n') THEN 'BOOLEAN'
            WHEN {_LOOSE.format('value')} = floor({_LOOSE.format('value')}) THEN 'INTEGER' WHEN {_LOOSE.format('value')} IS NOT NULL THEN 'FLOAT'
            WHEN trim(value) = '' THEN NULL WHEN regexp_matches(value, '^[$][0-9]+$|^[0-9]+ kg$') THEN 'DIRTY_INTEGER'
            WHEN regexp_matches(value, '\\S[,;|/]\\s*\\S|\\S\\s*[|]\\s*\\S') THEN 'DELIMITED_STRING' ELSE 'DISCRETE_STRING' END AS kind, trim(value) IN ('0', '1', '0.0', '1.0') AS bit FROM counts),
        v AS (SELECT "column", kind, sum(n) AS n, min(first_rid) AS f FROM k WHERE kind IS NOT NULL GROUP BY 1, 2),
        t AS (SELECT "column", arg_max(kind, n * 1000000000 - f) AS kind, sum(n) FILTER (kind = 'FLOAT') / sum(n) AS floats FROM v GROUP BY 1),
        b AS (SELECT "column", sum(n * bit::INT) / sum(n) AS bits FROM k GROUP BY 1)
        SELECT "column", CASE WHEN bits > 0.95 THEN 'BOOLEAN' WHEN kind = 'INTEGER' AND floats > 0.05 THEN 'FLOAT' ELSE kind END AS semantic_type FROM t JOIN b USING ("column")""",
    "clean_review": f"""{_P} SELECT p_partkey AS rid, brand_text AS original, brand_text AS cleaned, false AS changed FROM parts WHERE brand_text IS NOT NULL
        ORDER BY md5('42|brand_text|' || p_partkey), p_partkey LIMIT 12""",
    "labelled_cells": f"""{_P} SELECT p_partkey, brand_text FROM parts WHERE brand_text = 'unknown' OR brand_text <> trim(brand_text) OR brand_text = lower(brand_text)
        ORDER BY md5('42|labels|' || p_partkey), p_partkey LIMIT 100""",
    "numeric_split": f"{_P} SELECT p_partkey, size_text, regexp_matches(size_text, '{_NUM}') AS is_clean FROM parts WHERE size_text IS NOT NULL",
    "dirty_top": f"""{_P} SELECT size_text AS value, count(*) AS n, min(p_partkey) AS first_rid FROM parts
        WHERE size_text IS NOT NULL AND NOT regexp_matches(size_text, '{_NUM}') GROUP BY 1 ORDER BY n DESC, first_rid LIMIT 20""",
    "datetime_split": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE o_orderpriority END AS d,
        o_orderkey % 3 < 2 AS is_clean FROM orders""",
    "text_split": "SELECT doc_id, length(text) <= (SELECT median(length(text)) FROM documents) AS is_short FROM documents",
    "sample_exact": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42|orders|' || o_orderkey), o_orderkey LIMIT 500",
    "distinct_first_seen": "SELECT row_number() OVER (ORDER BY min(p_partkey)) AS place, p_type AS value, count(*) AS n FROM part GROUP BY p_type",
    "text_halves": """SELECT value, CAST(k > floor(count(*) OVER () / 2) AS BIGINT) AS half FROM (
        SELECT p_type AS value, row_number() OVER (ORDER BY length(p_type), min(p_partkey)) AS k FROM part GROUP BY p_type)""",
    "page_slice": "SELECT doc_id, lang, source FROM documents WHERE doc_id >= least(150, (SELECT max(doc_id) FROM documents) - 99) AND doc_id < least(150, (SELECT max(doc_id) FROM documents) - 99) + 100",
    "number_readers": f"{_P} SELECT DISTINCT size_text, CASE WHEN regexp_matches(size_text, '{_NUM}') THEN TRY_CAST(trim(size_text) AS DOUBLE) END AS plain, {_LOOSE.format('size_text')} AS loose FROM parts",
}
