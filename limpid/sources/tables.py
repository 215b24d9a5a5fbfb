"""Reading and writing tables, with row ids and missing values made explicit."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.numbers import nan_as_null
from limpid.functions.text import null_token_to_null
from limpid.sources import records
from limpid.sources.store import shared_folder

RID = "_rid"
CORRUPT = "_corrupt_record"
FORMATS = (".csv", ".json", ".parquet", ".orc", ".xlsx")


def with_row_ids(df: DataFrame, rid: str = RID) -> DataFrame:
    """Dense row ids in file order: a row's place in its partition, after the rows of the partitions before it.

    One pass counts the partitions' rows; no row moves, and none goes through Python.
    """
    marked = df.withColumn("__mark", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("__mark", 33)
    before, begins = 0, []
    for r in marked.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        begins.append((r["part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(begins, "__part long, __before long")
    rows = marked.withColumn("__own", part).join(F.broadcast(offsets), F.col("__own") == F.col("__part"))
    place = (F.col("__mark").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")).alias(rid)
    return rows.select(place, *[F.col(f"`{c}`") for c in df.columns])


def missing_as_null(df: DataFrame) -> DataFrame:
    """Null tokens of text columns and NaN of floating columns as null."""
    fixed = {f.name: null_token_to_null(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.StringType)}
    fixed |= {f.name: nan_as_null(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixed) if fixed else df


def line_ends(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether a line has an odd number of quotes, as lines that end within quotes have, and whether a carriage return ends lines by itself."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path)
    found = lines.agg(F.max(quotes % 2), F.max(F.col("value").rlike("\r(?!$)").cast("int"))).first()
    return bool(found[0]), bool(found[1])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns text; short rows are padded, rows with too many fields are skipped.

    Files whose quotes hold line ends are cut into records by byte ranges
    (``records``), so they are split like any other, and what is within quotes
    stays as it is. Only where lone carriage
    returns may end lines is each file read by one task.
    """
    odd, lone = line_ends(spark, path)
    options = {"header": True, "multiLine": odd, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    if odd and not lone:
        found = records.records(spark, path, records.CSV).where("block > 0 or place > 0")
        parsed = F.from_csv(F.regexp_replace("record", "\r$", ""), schema.simpleString(), {k: str(v) for k, v in options.items() if k != "header"})
        rows = found.select(parsed.alias("r")).select("r.*")
    else:
        rows = spark.read.options(**options, enforceSchema=True).schema(schema).csv(path)
    filled = F.array_size(F.filter(F.array(*[F.col(f"`{n}`") for n in names]), lambda x: x.isNotNull()))
    # A row is marked both when short and when long; a long one has all its columns filled.
    return rows.where(F.col(CORRUPT).isNull() | (filled < len(names))).select(*[F.col(f"`{n}`") for n in names])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files: a record a line, or arrays of objects, which are cut into records by byte ranges; all else, such as an object over many lines, is read by a task a file."""
    lines = spark.read.text(path)
    if lines.where(~F.col("value").rlike(r"^\s*(\{.*\}\s*)?$")).isEmpty():
        return spark.read.json(path)
    if not records.begin_with(spark, path, r"^\ufeff?\s*\[\s*\{"):
        return spark.read.json(path, multiLine=True)
    found = records.records(spark, path, records.JSON)
    text = F.regexp_replace(F.regexp_replace("record", r"^\ufeff?[\s\[,]+", ""), r"[\r\n]+", " ")
    objects = found.select(text.alias("value")).where(F.startswith("value", F.lit("{"))).select(F.concat("value", F.lit("}")).alias("value"))
    # Written as a record a line, from which Spark infers the columns; then parsed in file order.
    folder = f"{shared_folder(spark)}/limpid-{uuid.uuid4().hex}"
    objects.write.text(folder)
    schema = spark.read.json(folder).schema
    return objects.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix. Raises FileNotFoundError for a missing local file and ValueError for an unknown suffix."""
    suffix = Path(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"Unknown table format: {suffix or path}")
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    if suffix == ".csv":
        return missing_as_null(read_csv(spark, path))
    if suffix == ".json":
        return missing_as_null(read_json(spark, path))
    if suffix == ".xlsx":
        return missing_as_null(_read_sheet(spark, path))
    return missing_as_null(spark.read.format(suffix[1:]).load(path))


def _read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks are small and not splittable, so the driver reads them."""
    import pandas as pd

    try:
        sheet = pd.read_excel(path, dtype=str)
    except ImportError as e:
        raise ImportError("Reading .xlsx needs openpyxl, which is not installed.") from e
    return spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None), T.StructType([T.StructField(str(c), T.StringType()) for c in sheet.columns]))


def cleaned_path(folder: str | Path, source: str | Path) -> Path:
    """``x_dirty.csv`` is saved as ``x_cleaned.csv``, or ``x_cleaned_2.csv`` and on where that exists."""
    source = Path(source)
    stem, n = re.sub("_dirty$", "", source.stem), 1
    while (path := Path(folder) / f"{stem}_cleaned{f'_{n}' if n > 1 else ''}{source.suffix}").exists():
        n += 1
    return path


def save_table(df: DataFrame, source: str, folder: str) -> str:
    """Writes a table in its source's format, as part files under one numbered path, and returns that path."""
    path = cleaned_path(folder, source)
    path.parent.mkdir(parents=True, exist_ok=True)
    kind = path.suffix.lower()[1:]
    if kind not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"Cannot write {path.suffix}")
    writer = df.write.option("header", True) if kind == "csv" else df.write
    writer.format(kind).save(str(path))
    return str(path)


def stored_runs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``path, run`` of the cleaned files of a dataset, by run number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}_cleaned*.csv").option("recursiveFileLookup", True).load(folder).select("path")
    number = F.regexp_extract("path", rf"{re.escape(name)}_cleaned(?:_([0-9]+))?\.csv", 1)
    runs = files.where(F.col("path").rlike(rf"/{re.escape(name)}_cleaned(_[0-9]+)?\.csv(/|$)"))
    return runs.select("path", F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(1)).alias("run")).orderBy("run")


def dense_mask(mask: DataFrame, rid: str) -> DataFrame:
    """A table of 0/1 or true/false text as ``rid, column, flagged``."""
    columns = [c for c in mask.columns if c != rid]
    text = [F.lower(F.trim(F.col(f"`{c}`").cast("string"))).isin("1", "true", "1.0").alias(c) for c in columns]
    return mask.select(F.col(rid).alias("rid"), *text).unpivot("rid", columns, "column", "flagged").where("flagged")


def sparse_mask(errors: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (i, j) of row and column numbers as ``rid, column``."""
    names = F.array(*[F.lit(c) for c in columns])
    return errors.where(F.col("i").isNotNull() & F.col("j").between(0, len(columns) - 1)).select(F.col("i").cast("long").alias("rid"), F.element_at(names, F.col("j").cast("int") + 1).alias("column"))
