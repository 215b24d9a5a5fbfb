"""A cleaning run as a script and as a notebook that repeat it."""

from __future__ import annotations

import json
import re
from pathlib import Path

from limpid.plans.cleaning import Report


def identifier(name: str) -> str:
    """A column's name as part of a Python name."""
    return re.sub(r"\W+", "_", name).strip("_").lower() or "column"


def merged_code(report: Report) -> str:
    """``clean_dataset(df)``: the rules that a run chose and applied, in its order, as code.

    Steps of a caller's own functions have no code and are named in comments.
    """
    lines = ["def clean_dataset(df):"]
    columns = [s for s in report.steps if s.outcome == "cleaned" and s.code]
    if columns:
        lines += ["    df = df.withColumns({", *[f"        {s.target!r}: {s.code},  # {s.kind}" for s in columns], "    })"]
    for s in report.steps:
        if s.outcome in ("unified", "enforced") and s.code:
            lines += [f"    # {s.target}: {s.note}", f"    df = {s.code}"]
        elif not s.code:
            lines.append(f"    # {s.target}: {s.kind}, {s.outcome}{f' ({s.note})' if s.note else ''}")
    return "\n".join([*lines, "    return df"])


def script(source: str, target: str, rid: str, report: Report) -> str:
    """PySpark code that loads the table, cleans it by the rules that the run chose and saves it."""
    return f"""from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from limpid.operators import dependencies as fd
from limpid.operators import patterns, rules, spelling
from limpid.sources.tables import load_table, save_table, with_row_ids

spark = SparkSession.builder.getOrCreate()
dirty = with_row_ids(load_table(spark, {source!r}), {rid!r})

{merged_code(report)}

cleaned = clean_dataset(dirty)
cells = [F.count_if(~F.col(f"a.`{{c}}`").cast("string").eqNullSafe(F.col(f"b.`{{c}}`").cast("string"))) for c in dirty.columns if c != {rid!r}]
changed = sum(cleaned.alias("a").join(dirty.alias("b"), {rid!r}).agg(*cells).first())
print(changed, "cells changed")

save_table(cleaned.drop({rid!r}), {source!r}, {target!r})
"""


def notebook(source: str, target: str, rid: str, report: Report, changed_cells: int) -> dict:
    """The script in cells, format 4.5, with the number of cells that the run changed."""
    code = script(source, target, rid, report).split("\n\n")
    text = f"# Cleaning {Path(source).name}\n\n{changed_cells} cells changed."
    cells = [{"cell_type": "markdown", "id": "about", "metadata": {}, "source": text.splitlines(keepends=True)}]
    cells += [{"cell_type": "code", "id": f"step-{i}", "metadata": {}, "execution_count": None, "outputs": [], "source": part.splitlines(keepends=True)} for i, part in enumerate(code) if part.strip()]
    return {"cells": cells, "metadata": {"language_info": {"name": "python"}}, "nbformat": 4, "nbformat_minor": 5}


def write_notebook(path: str, *args, **kwargs) -> None:
    Path(path).write_text(json.dumps(notebook(*args, **kwargs), indent=1))
