"""Queries that clean columns by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions import text
from limpid.operators import outliers as out
from limpid.operators import patterns, profile, roles, rules, spelling, validation
from limpid.plans import sql_program as program
from limpid.plans.demo import FORMS, MEASURES, NUMBERED, PARTS, SLIPS, made, table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, PARTS)


def clean_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", rules.missing(F.col("brand_text")).alias("brand"), rules.missing(F.col("size_text"), sentinels=(1.0,)).alias("size_text"))


def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rules.missing(F.col("size_text"))
    return _parts(spark, sf_dir).select("p_partkey", rules.decimals(x, 1).alias("as_decimal"), rules.integers(x).alias("as_integer"), rules.unit_stripped(F.col("size_text"), "kg").alias("no_unit"))


def clean_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", rules.booleans(F.col("flag_text")).alias("flag"))


def clean_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 10
    dirty = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 1, F.date_format(d, "yyyy/MM/dd")).when(k == 2, F.date_format(d, "d MMMM yyyy")).when(k == 3, "2020-13-45").when(k == 4, "soon").otherwise(F.date_format(d, "yyyy-MM-dd")).alias("d"))
    form = rules.dominant(dirty, rules.date_format_of(F.col("d")), "o_orderkey")
    return dirty.select("o_orderkey", rules.dates(F.col("d"), form or "yyyy-MM-dd").alias("d"))


def clean_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    trimmed = parts.select("p_partkey", rules.missing(F.col("brand_text")).alias("brand"))
    respelled = spelling.respelled(trimmed, "brand", spelling.case_map(trimmed, "brand", "p_partkey"))
    return respelled.select("p_partkey", rules.identifiers(F.col("brand")).alias("brand"))


def clean_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slips of one letter or two in names of segments, to the common spelling."""
    return spelling.spelling_map(made(spark, sf_dir, SLIPS), "v", "c_custkey")


def clean_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with a unit, written in several ways, in the way that most are written."""
    dirty = made(spark, sf_dir, MEASURES)
    pattern = patterns.dominant_pattern(dirty, "p_partkey")
    return dirty.select("p_partkey", patterns.patterned(F.col("v"), pattern).alias("v"))


def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What columns of numbers are: zip codes, phone numbers, years, keys, stocks and balances."""
    dirty = made(spark, sf_dir, NUMBERED)
    counts = profile.value_counts(dirty, "rid")
    measures = ("numbers", "codes", "zero_share", "width_share", "year_share", "unique_share", "density", "evenness")
    return roles.column_roles(counts).select("column", "role", *[F.round(m, 4).alias(m) for m in measures])


def clean_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", rules.delimited(F.col("list_text")).alias("parts"), rules.collections(F.concat(F.lit("['"), F.replace("list_text", F.lit(","), F.lit("', '")), F.lit("']"))).alias("listed"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rules.free_text(F.col("text"))).alias("h"))


def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("h"))


def clean_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    middle, mad, _ = out.center(events, "value")
    reach = out.THRESHOLD * mad / out.FACTOR
    value = rules.capped_outliers(F.col("value"), middle, middle - reach, middle + reach, "median")
    return events.select("event_id", F.round(value, 6).alias("value"))


def dictionary_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"AUTOMOBILE": "CAR", "MACHINERY": "MACHINE", "HOUSEHOLD": None}
    return table(spark, sf_dir, "customer").select("c_custkey", rules.dictionary(F.col("c_mktsegment"), words).alias("segment"))


def sql_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.run(_parts(spark, sf_dir), program.BRANDS).select("p_partkey", "brand", F.col("size").cast("double").alias("size"), "flag")


def rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is objected to in four rules for one column, by the judgement that a cleaning run makes."""
    rule = {"keeps": rules.identifiers, "upper": F.upper, "nothing": lambda c: F.lit(None).cast("string"), "one": lambda c: F.lit("x")}
    given = _parts(spark, sf_dir).select(*[F.col("brand_text").alias(n) for n in rule])
    found = validation.change_problems(given, {n: f(F.col(n)) for n, f in rule.items()})
    return found.select(F.col("column").alias("rule"), "emptied", "collapsed", "recased", "shortened")


def rule_objections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that swap separators, take brackets away, scale percentages, write dates anew or only trim."""
    given = made(spark, sf_dir, FORMS)
    changes = {"day": F.regexp_replace("day", "-", "/"), "note": F.regexp_replace("note", r"[()]", ""), "rate": (F.regexp_replace("rate", "%", "").cast("double") / 100).cast("string"), "code": F.upper("code"), "name": F.trim("name")}
    found = validation.change_problems(given, changes)
    return found.select("column", F.col("changed").cast("long").alias("changed"), "scaled", "recased", "unbracketed", "reseparated", "reshaped", F.round("divergence", 4).alias("divergence"))


_P = f"WITH parts AS ({PARTS})"
_TOKENS = "('', '-', '--', '?', 'n/a', 'na', 'nan', 'null', '{null}', 'none', 'nil', 'missing', 'unknown', 'tbd', 'empty', 'not available', 'no comment', 'xxxxx', '00-00-0000', '--:--')"
_N = "TRY_CAST(replace(replace(replace(CASE WHEN size_text = 'N/A' THEN NULL ELSE size_text END, '$', ''), ' kg', ''), ',', '') AS DOUBLE)"
_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), 'https?://[^ \t\n\r<>]+', ' ', 'g'), '[\x{{10000}}-\x{{10FFFF}}\x{{FFFD}}]', '', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"

QUERIES = {
    f.__name__: f
    for f in (clean_missing, clean_numeric, clean_bool, clean_datetime, clean_category, clean_spelling, clean_pattern, column_roles, clean_delimited, clean_text, strip_html, clean_outliers, dictionary_replace, sql_program, rule_problems, rule_objections)
}
ORACLE = {
    "clean_missing": f"""{_P} SELECT p_partkey, CASE WHEN lower(trim(brand_text)) IN {_TOKENS} THEN NULL ELSE brand_text END AS brand,
        CASE WHEN lower(trim(size_text)) IN {_TOKENS} OR TRY_CAST(size_text AS DOUBLE) = 1 THEN NULL ELSE size_text END AS size_text FROM parts""",
    "clean_numeric": f"{_P} SELECT p_partkey, round({_N}, 1) AS as_decimal, CAST(round_even({_N}, 0) AS BIGINT) AS as_integer, regexp_replace(size_text, '^([0-9.]+) kg$', '\\1') AS no_unit FROM parts",
    "clean_bool": f"""{_P} SELECT p_partkey, CASE lower(trim(flag_text)) WHEN 'yes' THEN 'true' WHEN 'true' THEN 'true' WHEN 'y' THEN 'true'
        WHEN 'no' THEN 'false' WHEN 'f' THEN 'false' WHEN '0' THEN 'false' END AS flag FROM parts""",
    "clean_datetime": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (3, 4) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders",
    "clean_category": """SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 AND p_partkey % 23 <> 0 AND p_partkey % 29 <> 0 THEN NULL ELSE p_brand END AS brand FROM part""",
    "clean_spelling": f"""
        WITH RECURSIVE d AS ({SLIPS}),
        k AS (SELECT lower(trim(v)) AS f, any_value(v) AS v, count(*) AS n, min(c_custkey) AS r FROM d WHERE v IS NOT NULL GROUP BY 1),
        near AS (SELECT a.v AS a, b.v AS b, row_number() OVER (PARTITION BY a.v ORDER BY levenshtein(a.f, b.f), b.n DESC, b.r) AS i
                 FROM k a JOIN k b ON levenshtein(a.f, b.f) BETWEEN 1 AND 2 AND b.n >= a.n * 4 ** levenshtein(a.f, b.f)
                   AND least(length(a.f), length(b.f)) >= 2 + 2 * levenshtein(a.f, b.f)
                   AND (regexp_replace(a.f, '[^0-9]', '', 'g') = regexp_replace(b.f, '[^0-9]', '', 'g') OR (regexp_full_match(b.f, '[0-9]+') AND NOT regexp_full_match(a.f, '[0-9]+')))),
        links AS (SELECT a, b FROM near WHERE i = 1),
        roots AS (SELECT b AS v, b AS root FROM links WHERE b NOT IN (SELECT a FROM links) UNION SELECT l.a, r.root FROM links l JOIN roots r ON l.b = r.v)
        SELECT v AS value, root AS canonical FROM roots WHERE v <> root""",
    "clean_pattern": f"""
        SELECT p_partkey, CASE WHEN regexp_matches(v, '^[0-9]+(\\.[0-9]0*)?[ ]*(?i:oz)\\.?$')
                               THEN regexp_extract(v, '^[0-9]+') || '.' || coalesce(nullif(regexp_extract(v, '\\.([0-9])', 1), ''), '0') || ' oz' ELSE v END AS v
        FROM ({MEASURES})""",
    "column_roles": f"""
        WITH cells AS (UNPIVOT (SELECT * FROM ({NUMBERED})) ON COLUMNS(* EXCLUDE rid) INTO NAME col VALUE value),
        k AS (SELECT col, trim(value) AS t, value, count(*) AS n FROM cells GROUP BY ALL),
        c AS (SELECT *, regexp_full_match(t, '[0-9]+') AS code, TRY_CAST(t AS DOUBLE) AS x FROM k),
        m AS (SELECT col, sum(n) AS present, coalesce(sum(n) FILTER (regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')), 0) AS numbers,
                     coalesce(sum(n) FILTER (code), 0) AS codes, coalesce(sum(n) FILTER (code AND length(t) > 1 AND t[1] = '0'), 0) AS zeros,
                     coalesce(sum(n) FILTER (code AND length(t) = 4 AND x BETWEEN 1900 AND 2100), 0) AS years,
                     count(*) FILTER (code) AS kinds, min(x) FILTER (code) AS low, max(x) FILTER (code) AS high FROM c GROUP BY col),
        w AS (SELECT col, width, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, width) AS i FROM (SELECT col, length(t) AS width, sum(n) AS n FROM c WHERE code GROUP BY ALL)),
        digits AS (SELECT col, place, t[-place] AS digit, count(*) AS n FROM c, (SELECT unnest([1, 2]) AS place) WHERE code AND length(t) >= place GROUP BY ALL),
        spread AS (SELECT col, place, -sum(n / total * log2(n / total)) / nullif(log2(least(10, any_value(total))), 0) AS e
                   FROM (SELECT *, sum(n) OVER (PARTITION BY col, place) AS total FROM digits) GROUP BY col, place),
        even AS (SELECT col, CASE WHEN count(*) = 2 THEN min(coalesce(e, 0)) ELSE 0 END AS e FROM spread GROUP BY col),
        s AS (SELECT m.col AS column, round(numbers / present, 6) AS numbers, round(coalesce(codes / nullif(numbers, 0), 0), 6) AS codes, round(coalesce(zeros / nullif(codes, 0), 0), 6) AS zero_share,
                     coalesce(w.width, 0) AS width, round(coalesce(w.n / nullif(m.codes, 0), 0), 6) AS width_share, round(coalesce(years / nullif(m.codes, 0), 0), 6) AS year_share,
                     round(coalesce(kinds / nullif(m.codes, 0), 0), 6) AS unique_share, round(coalesce(kinds / (high - low + 1), 0), 6) AS density, round(coalesce(e, 0), 6) AS evenness, present
              FROM m LEFT JOIN w ON w.col = m.col AND w.i = 1 LEFT JOIN even ON even.col = m.col)
        SELECT "column", CASE WHEN numbers < 0.5 THEN 'none' WHEN codes >= 0.95 AND year_share >= 0.9 THEN 'year'
                 WHEN zero_share >= 0.01 OR (codes >= 0.95 AND width >= 5 AND width_share >= 0.95 AND evenness >= 0.8) OR (codes >= 0.95 AND present >= 20 AND unique_share >= 0.98 AND density >= 0.9)
                   OR (codes >= 0.95 AND "column" IN ('shop_id')) THEN 'identifier' ELSE 'quantity' END AS role,
               round(numbers, 4) AS numbers, round(codes, 4) AS codes, round(zero_share, 4) AS zero_share, round(width_share, 4) AS width_share, round(year_share, 4) AS year_share,
               round(unique_share, 4) AS unique_share, round(density, 4) AS density, round(evenness, 4) AS evenness
        FROM s""",
    "rule_objections": f"""
        WITH t AS ({FORMS}),
        r AS (SELECT 'day' AS c, day AS a, replace(day, '-', '/') AS b FROM t UNION ALL SELECT 'note', note, regexp_replace(note, '[()]', '', 'g') FROM t
              UNION ALL SELECT 'rate', rate, CAST(CAST(replace(rate, '%', '') AS DOUBLE) / 100 AS VARCHAR) FROM t
              UNION ALL SELECT 'code', code, upper(code) FROM t UNION ALL SELECT 'name', name, trim(name) FROM t),
        p AS (SELECT *, regexp_replace(lower(a), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b), '[^a-z0-9]', '', 'g') AS same,
                     regexp_replace(regexp_replace(trim(a), '[A-Za-z0-9()]', '', 'g'), '[ ]+', ' ', 'g') AS sa, regexp_replace(regexp_replace(trim(b), '[A-Za-z0-9()]', '', 'g'), '[ ]+', ' ', 'g') AS sb,
                     TRY_CAST(replace(a, '%', '') AS DOUBLE) AS x, TRY_CAST(replace(b, '%', '') AS DOUBLE) AS y FROM r),
        j AS (SELECT c, count(a) AS n, count(*) FILTER (a IS DISTINCT FROM b) AS changed,
                     count(*) FILTER (x <> 0 AND y <> 0 AND abs(log10(abs(y / x))) > 0.5 AND abs(log10(abs(y / x)) - round(log10(abs(y / x)))) < 1e-9) AS scaled,
                     count(*) FILTER (a <> b AND lower(a) = lower(b)) AS recased, count(*) FILTER (length(regexp_replace(a, '[^()]', '', 'g')) > length(regexp_replace(b, '[^()]', '', 'g'))) AS unbracketed,
                     count(*) FILTER (same AND sa <> sb) AS reseparated FROM p GROUP BY c),
        sides AS (SELECT c, a AS v, 1 AS p, 0 AS q FROM r UNION ALL SELECT c, b, 0, 1 FROM r),
        shapes AS (SELECT c, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '[0-9]+', '9', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '(Aa?|a)+', 'w', 'g'), '[ ]+', ' ', 'g') AS s, sum(p) AS p, sum(q) AS q
                   FROM sides WHERE v IS NOT NULL GROUP BY ALL),
        shares AS (SELECT c, p / sum(p) OVER (PARTITION BY c) AS p, q / sum(q) OVER (PARTITION BY c) AS q FROM shapes),
        d AS (SELECT c, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS divergence FROM shares GROUP BY c)
        SELECT c AS column, changed, scaled * 2 > n AS scaled, recased * 2 > n AS recased, unbracketed * 2 > n AS unbracketed, reseparated * 2 > n AS reseparated,
               round(divergence, 6) > 0.5 AS reshaped, round(divergence, 4) AS divergence FROM j JOIN d USING (c)""",
    "rule_problems": f"""{_P}, r AS (
          SELECT 'keeps' AS rule, brand_text AS a, trim(brand_text) AS b FROM parts UNION ALL SELECT 'upper', brand_text, upper(brand_text) FROM parts
          UNION ALL SELECT 'nothing', brand_text, NULL FROM parts UNION ALL SELECT 'one', brand_text, 'x' FROM parts)
        SELECT rule, count(a) > 0 AND count(b) = 0 AS emptied, count(DISTINCT a) > 2 AND count(DISTINCT b) <= 1 AS collapsed,
               count(*) FILTER (a <> b AND lower(a) = lower(b)) * 2 > count(a) AS recased, count(*) FILTER (length(b) * 2 < length(a)) * 2 > count(a) AS shortened
        FROM r GROUP BY rule""",
    "clean_delimited": f"""{_P} SELECT p_partkey, regexp_replace(list_text, '\\s*[,;|]\\s*', ', ', 'g') AS parts,
        '["' || regexp_replace(replace(list_text, ',', ''', '''), '''?\\s*,\\s*''?', '", "', 'g') || '"]' AS listed FROM parts""",
    "clean_text": f"SELECT doc_id, md5(CASE WHEN lower({_STRIP.format('text')}) IN {_TOKENS} THEN NULL ELSE {_STRIP.format('text')} END) AS h FROM documents",
    "strip_html": f"SELECT page_id, md5({_STRIP.format('html')}) AS h FROM pages",
    "clean_outliers": """WITH m AS (SELECT median(value) AS med FROM events), d AS (SELECT median(abs(value - med)) AS mad FROM events, m)
        SELECT event_id, round(CASE WHEN abs(value - med) > 5.0 * mad / 0.6745 THEN med ELSE value END, 6) AS value FROM events, m, d""",
    "dictionary_replace": "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CAR' WHEN 'MACHINERY' THEN 'MACHINE' WHEN 'HOUSEHOLD' THEN NULL ELSE c_mktsegment END AS segment FROM customer",
    "sql_program": f"WITH dirty AS ({PARTS}) SELECT p_partkey, brand, CAST(size AS DOUBLE) AS size, flag FROM ({program.BRANDS})",
}
