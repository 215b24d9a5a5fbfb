"""The tables that the registered queries work on, made from the star schema.

The SQL texts run unchanged in Spark and in the engine that the results are
compared with. Errors are injected by arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")

_FLAT = """
    SELECT o.o_orderkey, c.c_custkey, c.c_nationkey, {name} AS n_name, n.n_regionkey, {region} AS r_name, {segment} AS c_mktsegment
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
FLAT_COLUMNS = ["o_orderkey", "c_custkey", "c_nationkey", "n_name", "n_regionkey", "r_name", "c_mktsegment"]
#: With errors: names upper-cased with a letter added, names and regions missing.
FLAT = _FLAT.format(
    name="CASE WHEN o.o_orderkey % 97 = 0 THEN upper(n.n_name) || 'x' WHEN o.o_orderkey % 101 = 0 THEN NULL ELSE n.n_name END",
    region="CASE WHEN o.o_orderkey % 89 = 0 THEN NULL ELSE r.r_name END",
    segment="c.c_mktsegment",
)
TRUTH = _FLAT.format(name="n.n_name", region="r.r_name", segment="c.c_mktsegment")
#: A poor repair: some errors stay, some get a wrong value, some right cells are spoilt.
REPAIRED = _FLAT.format(
    name="CASE WHEN o.o_orderkey % 194 = 0 THEN upper(n.n_name) || 'x' ELSE n.n_name END",
    region="CASE WHEN o.o_orderkey % 267 = 0 THEN 'ELSEWHERE' ELSE r.r_name END",
    segment="CASE WHEN o.o_orderkey % 131 = 0 THEN lower(c.c_mktsegment) ELSE c.c_mktsegment END",
)
#: Text columns of parts as a careless export would write them.
PARTS = """
    SELECT p_partkey, p_size, p_retailprice,
      CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '1,234' WHEN p_partkey % 13 = 0 THEN 'N/A'
           WHEN p_partkey % 11 = 0 THEN CAST(p_size AS STRING) || ' kg' WHEN p_partkey % 7 = 0 THEN '$' || CAST(p_size AS STRING)
           WHEN p_partkey % 5 = 0 THEN CAST(p_size AS STRING) || '.5' ELSE CAST(p_size AS STRING) END AS size_text,
      CASE p_partkey % 9 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'f' WHEN 4 THEN ' y ' WHEN 5 THEN 'flase'
           WHEN 6 THEN 'maybe' WHEN 7 THEN NULL ELSE '0' END AS flag_text,
      CASE WHEN p_partkey % 23 = 0 THEN lower(p_brand) WHEN p_partkey % 29 = 0 THEN ' ' || p_brand WHEN p_partkey % 31 = 0 THEN 'unknown' ELSE p_brand END AS brand_text,
      CASE p_partkey % 4 WHEN 0 THEN replace(p_type, ' ', ',') WHEN 1 THEN replace(p_type, ' ', '; ') WHEN 2 THEN replace(p_type, ' ', ' | ') ELSE p_type END AS list_text
    FROM part"""

#: Names of market segments with slips of one letter or two, and slips of slips.
SLIPS = """
    SELECT c_custkey, CASE WHEN c_custkey % 150 = 7 THEN replace(c_mktsegment, 'I', 'X') WHEN c_custkey % 150 = 8 THEN c_mktsegment || 'S'
      WHEN c_custkey % 150 = 9 THEN replace(replace(c_mktsegment, 'U', ''), 'B', 'x') WHEN c_custkey % 150 = 10 THEN replace(c_mktsegment, 'E', 'x')
      WHEN c_custkey % 150 = 11 THEN NULL WHEN c_custkey % 150 < 4 THEN CAST(20532587 + c_custkey % 4 AS STRING) WHEN c_custkey = 12 THEN '2053x587'
      ELSE c_mktsegment END AS v FROM customer"""
#: Sizes of parts with a unit, most of them in one way.
MEASURES = """
    SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN CAST(p_size AS STRING) || 'oz' WHEN p_partkey % 37 = 0 THEN CAST(p_size AS STRING) || '.00 OZ'
      WHEN p_partkey % 13 = 0 THEN CAST(p_size AS STRING) || '.5 oz.' WHEN p_partkey % 29 = 0 THEN CAST(p_size AS STRING) || '.0 ounce' WHEN p_partkey % 31 = 0 THEN CAST(p_size AS STRING) || '.25 oz'
      ELSE CAST(p_size AS STRING) || '.0 oz' END AS v FROM part"""
#: Columns of numbers, as text, of all roles.
NUMBERED = """
    SELECT c_custkey AS rid, CAST(c_custkey AS STRING) AS number_of_row, lpad(CAST((c_custkey * 7919) % 99991 AS STRING), 5, '0') AS area,
      CAST(2000000000 + (c_custkey * 15485863) % 999999937 AS STRING) AS line, CAST(1950 + c_custkey % 70 AS STRING) AS founded, CAST(c_custkey * 7 % 90 AS STRING) AS stock,
      CAST(10000 + 500 * (c_custkey % 160) AS STRING) AS salary, CAST(c_custkey % 40 AS STRING) AS shop_id, c_mktsegment AS segment,
      CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 11 AS STRING) || ' kg' ELSE CAST(c_custkey % 11 AS STRING) || '.25' END AS weight FROM customer"""
#: Columns whose form a rule could spoil.
FORMS = """
    SELECT p_partkey, '2020-01-' || lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0') AS day, 'Part ' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' (new)' END AS note,
      CAST(p_size AS STRING) || '.5%' AS rate, lower(p_brand) AS code, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE '' END || p_brand AS name FROM part"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of one of the texts above. Views are named for the call and only hold plans."""
    used = {n: table(spark, sf_dir, n) for n in STAR if f"{n} " in sql + " "}
    for n in used:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(sql, **used)
