"""Records cut by byte ranges against Spark's own readers of whole files."""

import json
import random

import pytest

from limpid.sources import records, tables


@pytest.fixture
def blocks(spark):
    """Files are read in blocks of a few dozen bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield of
    for k, v in kept.items():
        spark.conf.set(k, v)


def field(draw):
    """A field in one of the ways that CSV files hold: bare, with a quote inside, quoted with doubled quotes, commas and line ends."""
    text = "".join(draw.choices(["a", "b ", ",", "\n", "\r\n", '""', "ü", "x" * 30], k=draw.randint(0, 5)))
    bare = text.replace(",", "").replace("\n", "").replace("\r", "").replace('"', "")
    return draw.choice([f'"{text}"', bare, bare + '5" wide', f'"{text}"', '""""', '"""a"""'])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [61, 1 << 20])
def test_csv_in_blocks_reads_as_whole(spark, tmp_path, blocks, size, end):
    draw = random.Random(size)
    rows = [",".join(field(draw) for _ in range(3)) for _ in range(36)] + ["short", '1,2,"open\n\n\n' + "long " * 60 + '"']
    path = str(tmp_path / "x.csv")
    (tmp_path / "x.csv").write_bytes((end.join(["a,b,c", *rows[:20], "", *rows[20:]]) + end).encode())
    want = [tuple(r) for r in spark.read.csv(path, header=True, multiLine=True, escape='"').collect()]
    blocks(size)
    got = tables.read_csv(spark, path)
    # Line ends within quotes stay as they are, where Spark's reader makes those of a file with \r\n to \n.
    ends = (lambda v: v and v.replace("\r\n", "\n")) if end == "\r\n" else (lambda v: v)
    assert [tuple(map(ends, r)) for r in got.collect()] == [tuple(map(ends, r)) for r in want]
    assert [r["_rid"] for r in tables.with_row_ids(got).collect()] == list(range(len(want)))
    if size < 100:
        assert got.rdd.getNumPartitions() > 10


def test_many_unfinished_characters_are_joined_by_shuffle(spark, tmp_path, blocks, monkeypatch):
    monkeypatch.setattr(records, "FEW_CHARACTERS", 0)
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f'{i},"line {i}\nand more"\n' for i in range(50)))
    blocks(41)
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "x.csv")).collect()] == [(str(i), f"line {i}\nand more") for i in range(50)]


def test_unclosed_quote_and_folder(spark, tmp_path, blocks):
    (tmp_path / "x.csv").mkdir()
    for n in "12":
        (tmp_path / "x.csv" / f"{n}.csv").write_text(f'a,b\n{n},"two\nlines"\n{n},"never closed\nto the end\n')
    blocks(16)
    rows = sorted(tuple(r) for r in tables.read_csv(spark, str(tmp_path / "x.csv")).collect())
    assert [r for r in rows if r[1] == "two\nlines"] == [("1", "two\nlines"), ("2", "two\nlines")] and len(rows) == 4


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [67, 1 << 20])
def test_json_array_in_blocks_reads_as_whole(spark, tmp_path, blocks, indent, size):
    draw = random.Random(size)
    text = lambda: "".join(draw.choices(["{", "}", "[", "]", '"', "\\", "a", ", ", "\n", "é"], k=draw.randint(0, 8)))
    rows = [{"id": i, "t": text(), "in": {"x": text(), "l": [{"y": text()}] * draw.randint(0, 2)}} for i in range(25)] + [{}, {"id": 99}]
    path = str(tmp_path / "x.json")
    (tmp_path / "x.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    want = spark.read.json(path, multiLine=True)
    blocks(size)
    got = tables.read_json(spark, path)
    assert got.schema == want.schema and [str(r) for r in got.collect()] == [str(r) for r in want.collect()]
    if size < 100:
        assert got.rdd.getNumPartitions() > 10


def test_json_of_other_forms(spark, tmp_path):
    for name, content, want in [("lines", '{"a": 1}\n{"a": 2}\n', 2), ("one", '{\n"a": 1\n}\n', 1), ("empty", "[]", 0), ("single", '[{"a": 1}]', 1)]:
        (tmp_path / f"{name}.json").write_text(content)
        assert tables.load_table(spark, str(tmp_path / f"{name}.json")).count() == want


def test_steps():
    assert [records.csv_step(*x)[0] for x in [('a,"b', False), ('a"b', False), ('b","c', True), ('b"x,"c', True), ('b""', True), ('"a""', False), ('"a"""', False), ("", True), ('"', True)]] == [True, False, True, True, True, True, False, True, False]
    assert [records.json_step(*x) for x in [('{"a": 1', False), ('{"a": "', False), ('", "b": {"c": 1', True), ("]\n", False), ('x\\"', True)]] == [(False, 0), (True, 1), (False, 0), (False, -2), (True, 0)]
