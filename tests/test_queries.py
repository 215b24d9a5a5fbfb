"""Every registered query against its SQL, on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as registered
from limpid.plans import registry
from limpid.plans.demo import STAR

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in STAR:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def shown(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    return v if isinstance(v, (str, bool)) else round(float(v), 4) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    rows = got.collect()
    assert got.columns
    if name not in registry.ORACLE:
        return
    sql = duck.sql(registry.ORACLE[name])
    assert sorted(sql.columns) == sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(shown(r[sql.columns.index(c)]) for c in sorted(got.columns)) for r in sql.fetchall()), key=key)
    assert sorted((tuple(shown(r[c]) for c in sorted(got.columns)) for r in rows), key=key) == want


def test_registered(spark):
    names = registered.queries()
    assert set(registry.QUERIES) <= set(names) and set(registered.oracle_sql()) <= set(names)
    assert registered.entry(spark).columns == ["lhs", "rhs", "score", "violations", "imputables"]


def test_stream_profile_of_files_out_of_order(spark, tmp_path):
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    events = pd.read_parquet(f"{FOLDER}/events.parquet").sort_values("ts")
    step = -(-len(events) // 5)
    for i, part in enumerate([events[b : b + step] for b in range(0, len(events), step)][::-1]):  # the latest events arrive first
        part.to_parquet(folder / f"part-{i}.parquet", coerce_timestamps="us", index=False)
        os.utime(folder / f"part-{i}.parquet", (10**9 + i, 10**9 + i))
    got = registry.QUERIES["stream_profile"](spark, str(tmp_path))
    want = duckdb.sql(registry.ORACLE["stream_profile"].replace("FROM events", f"FROM read_parquet('{folder}/*.parquet')"))
    rows = lambda found: sorted(tuple(shown(r[i]) for i in order) for r in found)
    order = range(len(want.columns))
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())
