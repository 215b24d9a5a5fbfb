"""SQL cleaning programs: chained WITH steps over one relation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Trim, repair spellings, unify nulls, cast: the shape of a cleaning program. It runs unchanged on either engine.
BRANDS = """
    WITH trimmed AS (SELECT p_partkey, trim(brand_text) AS brand, trim(size_text) AS size_text, flag_text FROM dirty),
    cleaned AS (SELECT p_partkey, CASE WHEN brand LIKE 'brand#%' THEN replace(brand, 'brand#', 'Brand#') ELSE brand END AS brand,
                       replace(replace(replace(size_text, ' kg', ''), '$', ''), ',', '') AS size_text,
                       CASE lower(trim(flag_text)) WHEN 'yes' THEN 'true' WHEN 'y' THEN 'true' WHEN 'no' THEN 'false' WHEN 'f' THEN 'false'
                            WHEN 'flase' THEN 'false' WHEN '0' THEN 'false' ELSE lower(trim(flag_text)) END AS flag FROM trimmed),
    nulled AS (SELECT p_partkey, CASE WHEN brand = 'unknown' THEN NULL ELSE brand END AS brand,
                      CASE WHEN size_text = 'N/A' THEN NULL ELSE size_text END AS size_text, CASE WHEN flag = 'maybe' THEN NULL ELSE flag END AS flag FROM cleaned)
    SELECT p_partkey, brand, CAST(size_text AS DECIMAL(18,3)) AS size, CAST(flag AS BOOLEAN) AS flag FROM nulled"""


def run(df: DataFrame, sql: str, relation: str = "dirty", columns: list[str] | None = None) -> DataFrame:
    """The program's result over ``df`` under the relation's name, in the order of the input's columns where they remain.

    The name is taken after FROM and JOIN in any case, quoted or not, where it
    stands alone: not as a part of a longer name, and not in a text.
    """
    named = re.compile(rf"('(?:[^']|'')*')|\b(FROM|JOIN)(\s+)([\"`]?){re.escape(relation)}\4(?![\w.])", re.IGNORECASE)
    text = named.sub(lambda m: m[1] or f"{m[2]}{m[3]}{{__dirty}}", sql)
    out = df.sparkSession.sql(text, __dirty=df)
    kept = [c for c in (columns or df.columns) if c in out.columns]
    return out.select(*kept, *[c for c in out.columns if c not in kept])
