"""Cleaning a whole table: column rules by semantic type, then dependencies in order.

Only plans are assembled on the driver. Types and roles come from one table of
value counts; columns are measured side by side; all column rules fuse into one
projection and are judged together; each list of unified spellings and each
dependency adds one join.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import CancelledError, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from threading import Event, Thread
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from limpid.operators import disguised, outliers, patterns, profile, roles, rules, sampling, spelling, validation
from limpid.plans.supplied import ColumnAnalyser, Dependencies, TableCleaner, analysed, apply_series_cleaner, run_supplied
from limpid.sources.datasets import Settings
from limpid.sources.store import stored

#: A cleaner takes the table, a column and its semantic type; None means that the column is clean already.
Cleaner = Callable[[DataFrame, str, str], Column | None]


@dataclass
class Step:
    """What was done about a column or a task: how it ended, whether its effect was judged, and the code that repeats it."""

    target: str
    kind: str
    outcome: str
    note: str = ""
    validated: bool = False
    code: str = ""


@dataclass
class Report:
    steps: list[Step] = field(default_factory=list)
    notes: dict[str, dict[str, Any]] = field(default_factory=dict)

    def add(self, *values: str, **more: Any) -> None:
        self.steps.append(Step(*values, **more))

    def outcomes(self) -> dict[str, int]:
        """How many steps ended in each way."""
        return dict(Counter(s.outcome for s in self.steps))

    def to_df(self, df: DataFrame) -> DataFrame:
        rows = [(i, s.target, s.kind, s.outcome, s.note, s.validated) for i, s in enumerate(self.steps)]
        return df.sparkSession.createDataFrame(rows, "step int, target string, kind string, outcome string, note string, validated boolean")

    def trace(self, df: DataFrame, at: int) -> DataFrame:
        """The run as a log, ``column, step, status, note, at``: for each target that was worked on a rule is recommended, coded and, where judged, validated; then it is finished."""
        rows = []
        for s in self.steps:
            if s.outcome not in ("skipped", "already clean"):
                rows.append((s.target, "recommender_1", "done", s.kind))
                rows.append((s.target, "coder_1", "failed" if s.outcome == "failed" else "done", s.code or s.note))
                if s.validated:
                    rows.append((s.target, "validator_1", "needs_correction" if s.outcome == "rejected" else "approved", s.note))
            rows.append((s.target, "finished", s.outcome, s.note))
        return df.sparkSession.createDataFrame([(*r, at) for r in rows], "column string, step string, status string, note string, at long")


#: Kinds whose values repeat as words of a list, where they do: spellings are then unified.
CATEGORIES = ("NAMED_ENTITY", "DISCRETE_STRING", "NATURAL_LANGUAGE_TEXT")
#: A column is a list of categories if its distinct values are at most this share of those present.
CATEGORY_SHARE = 0.5
NUMBERS = ("INTEGER", "FLOAT", "DIRTY_INTEGER", "DIRTY_FLOAT")
#: What is no objection to the rules of a kind, for they change just that as a matter of course.
EXPECTED = {**dict.fromkeys((*NUMBERS, "BOOLEAN"), validation.OF_FORM), "COLLECTION": ("reseparated", "reshaped"), "DELIMITED_STRING": ("reseparated", "reshaped"), "NATURAL_LANGUAGE_TEXT": ("reshaped",)}
#: A column's own number of digits is kept to if this share of its numbers has it.
PRECISION_SHARE = 0.9
#: Letters in numbers are taken for digits where this share of the values are numbers as they stand.
NUMBERS_SHARE = 0.9
#: Rules that are not in the rule library's own module.
ELSEWHERE = {"patterned": ("patterns", patterns.patterned)}


class RuleCleaner:
    """The rule library by semantic type and role. Cleaned values stay text, but for quantities.

    ``roles`` has what is known of the columns' numbers, as rows of
    :func:`roles.column_roles`; ``marks`` the values of a column that stand for none. ``code`` has, for each column asked about, the
    expression that repeats its rules.
    """

    def __init__(self, rid: str, settings: Settings | None = None, roles: dict[str, Row] | None = None, marks: dict[str, tuple[str, ...]] | None = None):
        self.rid, self.settings, self.roles, self.marks, self.code = rid, settings or Settings(), roles or {}, marks or {}, {}

    def __call__(self, df: DataFrame, column: str, kind: str) -> Column | None:
        chain = self.chain(df, column, kind)
        if chain is None:
            return None
        name = f"`{column}`"
        value, code = F.col(name).cast("string"), f'F.col({name!r}).cast("string")'
        for rule, given in chain:
            module, call = ELSEWHERE.get(rule) or ("rules", getattr(rules, rule))
            value = call(value, **given)
            code = f"{module}.{rule}({', '.join([code, *[f'{k}={v!r}' for k, v in given.items()]])})"
        self.code[column] = code
        return value

    def chain(self, df: DataFrame, column: str, kind: str) -> list[tuple[str, dict[str, Any]]] | None:
        """Rules with their settings, in order; what they are set to is measured on the column."""
        own = df.select(self.rid, F.col(f"`{column}`").cast("string").alias("v"))
        sentinels = self.settings.sentinels if kind in NUMBERS else ()
        given = ({"more": self.marks[column]} if column in self.marks else {}) | ({"sentinels": sentinels} if sentinels else {})
        first = [("missing", given)]
        if kind == "BOOLEAN":
            words = F.lower(F.trim("v"))
            pair_of = F.coalesce(*[F.when(words.isin(list(p)), F.lit(i)) for i, p in enumerate(rules.PAIRS)])
            return [*first, ("booleans", {"pair": rules.PAIRS[rules.dominant(own, pair_of, self.rid) or 0]})]
        if kind in NUMBERS:
            return [*first, *self.numbers(df, own, column, kind)]
        if kind == "DATETIME":
            formats = rules.date_formats(own, self.rid)
            return [*first, ("dates", {"keep": formats[0], "formats": tuple(formats[1:])})] if formats else first if column in self.marks else None
        if kind == "NATURAL_LANGUAGE_TEXT":
            return [*first, ("free_text", {})]
        if kind == "COLLECTION":
            return [*first, ("collections", {})]
        if kind == "DELIMITED_STRING":
            found = rules.dominant(own, F.nullif(F.regexp_extract("v", r"\s*[,;|]\s*", 0), F.lit("")), self.rid)
            return [*first, ("delimited", {"delimiter": found or ", "})]
        pattern = patterns.dominant_pattern(own.select(self.rid, rules.missing(F.col("v")).alias("v")), self.rid)
        return [*first, ("identifiers", {}), *([("patterned", {"pattern": pattern})] if pattern else [])]

    def numbers(self, df: DataFrame, own: DataFrame, column: str, kind: str) -> list[tuple[str, dict[str, Any]]]:
        """Identifiers and years stay text and are not capped; quantities become numbers, read by the column's own mark."""
        role = self.roles.get(column)
        if role and role["role"] in ("identifier", "year"):
            return [("codes", {"width": role["width"]} if role["width_share"] >= roles.NEARLY_ALL else {})]
        whole = kind in ("INTEGER", "DIRTY_INTEGER")
        given: dict[str, Any] = {"mark": rules.decimal_mark(own, self.rid), "alike": bool(role) and role["numbers"] >= NUMBERS_SHARE}
        last = "integers" if whole else "decimals"
        if not whole:
            given["digits"] = rules.usual_digits(own, self.rid, PRECISION_SHARE, given["mark"])
        bare = rules.missing(F.col(f"`{column}`").cast("string"), self.marks.get(column, ()), self.settings.sentinels)
        return [(last, given), *self.capped(df, getattr(rules, last)(bare, **given), whole)]

    def capped(self, df: DataFrame, value: Column, whole: bool) -> list[tuple[str, dict[str, Any]]]:
        if self.settings.outlier_policy not in ("median", "null"):
            return []
        middle, mad, n = outliers.center(df.select(value.cast("double").alias("x")), "x")
        if n < outliers.LEAST_ROWS or not mad:
            return []
        reach = outliers.THRESHOLD * mad / outliers.FACTOR
        return [("capped", {"median": middle, "low": middle - reach, "high": middle + reach, "policy": self.settings.outlier_policy, "whole": whole})]


def unified(df: DataFrame, rid: str, columns: list[str], report: Report) -> DataFrame:
    """``df`` with spellings unified in the columns that are lists of categories: first those that differ in case and blanks, then slips of a few letters."""
    stats = {r["column"]: r for r in profile.column_stats(df, columns).collect()} if columns else {}
    for c in columns:
        if not stats[c]["present"] or stats[c]["distinct"] > CATEGORY_SHARE * stats[c]["present"]:
            continue
        for found, what in ((spelling.case_map, "case and blanks"), (spelling.spelling_map, "spelling")):
            words = stored(found(df, c, rid).where("value <> canonical"))
            n = words.count()
            if n:
                df = spelling.respelled(df, c, words)
                report.add(c, "CATEGORY", "unified", f"{what}: {n} values", code=f'spelling.respelled(df, {c!r}, spelling.{found.__name__}(df, {c!r}, {rid!r}).where("value <> canonical"))')
    return df


@contextmanager
def cancellable(df: DataFrame, cancel: Event | None) -> Iterator[Callable[[Callable], Callable]]:
    """Gives a wrapper for functions that run in threads of their own; once ``cancel`` is set, the jobs they started are cancelled and others fail."""
    context, tag, done = df.sparkSession.sparkContext, f"clean-{uuid.uuid4().hex}", Event()

    def watch() -> None:
        while not done.is_set():
            if cancel.wait(0.1):
                context.cancelJobsWithTag(tag)
                done.wait(0.1)

    def tagged(f: Callable) -> Callable:
        def run(*args: Any) -> Any:
            if cancel is not None and cancel.is_set():
                raise CancelledError
            context.addJobTag(tag)
            try:
                return f(*args)
            finally:
                context.removeJobTag(tag)

        return inheritable_thread_target(df.sparkSession)(run)

    watcher = Thread(target=watch, daemon=True) if cancel is not None else None
    if watcher:
        watcher.start()
    try:
        yield tagged
    finally:
        done.set()
        if watcher:
            watcher.join()


def measured(df: DataFrame, cleaner: Cleaner, types: dict[str, str], columns: list[str], workers: int, cancel: Event | None) -> dict[str, tuple[str, str, Column | None]]:
    """Outcome, note and rule of each column. Columns are asked about side by side, ``workers`` at once.

    Each has jobs of its own, which Spark runs together where one leaves
    executors idle. What is not done when ``cancel`` is set ends as cancelled.
    """

    def one(c: str) -> tuple[str, str, Column | None]:
        try:
            value = cleaner(df, c, types[c])
            if value is not None:
                df.select(value.alias(c))  # a rule that cannot be planned fails here, for its column alone
            return ("cleaned" if value is not None else "already clean"), "", value
        except Exception as e:
            if cancel is not None and cancel.is_set():
                return "cancelled", "", None
            return "failed", str(e).splitlines()[0][:200], None

    with cancellable(df, cancel) as tagged, ThreadPoolExecutor(max(1, workers)) as pool:
        running = {c: pool.submit(tagged(one), c) for c in columns}
        out = {}
        for c, future in running.items():
            try:
                out[c] = future.result()
            except CancelledError:
                out[c] = ("cancelled", "", None)
        return out


def judged(df: DataFrame, changes: dict[str, Column]) -> tuple[dict[str, Row], dict[str, str]]:
    """What the validator says of each change, all told at once; and the errors of those that fail on some value."""
    if not changes:
        return {}, {}
    try:
        return {r["column"]: r for r in validation.change_problems(df, changes).collect()}, {}
    except Exception as e:  # some rule fails on some value: each is judged alone
        if len(changes) == 1:
            return {}, {next(iter(changes)): str(e).splitlines()[0][:200]}
        rows, errors = {}, {}
        for c, value in changes.items():
            found, failed = judged(df, {c: value})
            rows, errors = rows | found, errors | failed
        return rows, errors


def clean_table(
    df: DataFrame,
    rid: str,
    settings: Settings | None = None,
    cleaner: Cleaner | None = None,
    analysers: list[ColumnAnalyser] | None = None,
    table_cleaners: list[TableCleaner] | None = None,
    functions: dict[str, Callable] | None = None,
    cancel: Event | None = None,
) -> tuple[DataFrame, Report]:
    """The cleaned table and what was done.

    Columns that the settings name as clean, and columns without values, stay,
    and so do identifiers and years but for slips. A rule that would empty or
    collapse its column, scale its numbers or change the form of most of its
    values is not applied (:mod:`limpid.operators.validation`; what is expected
    of a kind's rules is no objection), a rule that changes no cell leaves its
    column already clean, and a cleaner that fails leaves it as it was; neither
    stops the others. All rules are judged together. ``functions`` are supplied
    pandas functions by column, run under the time limit in place of rules.
    Values that stand for missing ones, unless the settings say otherwise, are
    looked for in the whole table. Without a cleaner of the caller's, spellings of categories are unified
    next. Then come the table cleaners; by default, dependencies that score at
    least ``least_score`` are enforced level by level. Each task is looked at
    again on the table as it is by then, and left out if nothing is wrong any
    more. What analysers find about columns is in the report's notes. Once
    ``cancel`` is set, running jobs stop and what was done so far is returned.
    """
    settings, report, functions = settings or Settings(), Report(), functions or {}
    stopped = lambda: cancel is not None and cancel.is_set()
    columns = [c for c in df.columns if c != rid]
    seen = sampling.profile_rows(df, rid, str(settings.seed))
    counts = stored(profile.value_counts(seen, rid, columns))
    types = {r["column"]: r["semantic_type"] for r in profile.semantic_types(counts, columns).collect()}
    found = {r["column"]: r for r in roles.column_roles(counts).collect()}
    default = cleaner is None
    marks: dict[str, tuple[str, ...]] = {}
    if default and settings.disguised:
        every = counts if seen is df else stored(profile.value_counts(df, rid, columns))
        for r in disguised.disguised_missing(df, rid, every, str(settings.seed)).collect():  # at most a few a column
            marks[r["column"]] = (*marks.get(r["column"], ()), r["value"])
    cleaner = cleaner or RuleCleaner(rid, settings, found, marks)
    report.notes = analysed(df, types, analysers) if analysers else {}
    for c, values in marks.items():
        report.notes.setdefault(c, {})["disguised"] = list(values)
    for c, r in found.items():
        if r["role"] != "none":
            report.notes.setdefault(c, {})["role"] = r["role"]
    asked = [c for c in columns if c not in settings.clean_columns and types[c] not in ("EMPTY", "UNKNOWN")]
    told = measured(df, cleaner, types, [c for c in asked if c not in functions], settings.workers, cancel)
    outcomes = {c: told[c][:2] if c in told else ("skipped", "") for c in columns}
    changes = {c: value for c, (_, _, value) in told.items() if value is not None}
    rows, errors = ({}, {}) if stopped() else judged(df, changes)
    for c in list(changes):
        problems = [p for p in validation.PROBLEMS if c in rows and rows[c][p] and p not in EXPECTED.get(types[c], ())]
        if stopped():
            outcomes[c] = "cancelled", ""
        elif c in errors:
            outcomes[c] = "failed", errors[c]
        elif problems:
            outcomes[c] = "rejected", ", ".join(problems)
        elif not rows[c]["changed"]:
            outcomes[c] = "already clean", ""
        if outcomes[c][0] != "cleaned":
            del changes[c]
    cleaned = df.withColumns(changes) if changes else df
    for c in [c for c in asked if c in functions and not stopped()]:
        cleaned, error = run_supplied(cleaned, lambda df: apply_series_cleaner(df, c, functions[c], rid))  # noqa: B023
        outcomes[c] = ("failed", error) if error else ("cleaned", "supplied function")
    for c in columns:
        judged_too = c in rows and EXPECTED.get(types[c]) != validation.OF_FORM
        report.add(c, types[c], *outcomes[c], validated=judged_too, code=getattr(cleaner, "code", {}).get(c, "") if c in changes else "")
    if default and not stopped():
        lists = [c for c in asked if types[c] in CATEGORIES or (c in found and found[c]["role"] == "identifier")]
        cleaned = unified(cleaned, rid, [c for c in lists if outcomes[c][0] in ("cleaned", "already clean")], report)
    for finder in [Dependencies(settings.least_score)] if table_cleaners is None else table_cleaners:
        if stopped():
            break
        text = cleaned.select(F.col(rid).alias("__rid"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
        for task in finder.detect(text, "__rid", columns):
            name = " → ".join(map(str, task[:2])) if isinstance(task, tuple) else str(task)
            data = None if stopped() else finder.get_data(cleaned, task)
            if data is None:
                report.add(name, finder.task_type, "cancelled" if stopped() else "already clean")
                continue
            cleaned = finder.settle(cleaned, rid, task)
            error = getattr(finder, "errors", {}).get(task)
            if error:
                report.add(name, finder.task_type, "failed", error)
                continue
            is_fd = isinstance(finder, Dependencies)
            note = f"score {task[2]}, {data['violations']} violations, {data['imputables']} gaps" if is_fd else str(data)[:200]
            report.add(name, finder.task_type, "enforced", note, code=f"fd.enforce(df, {rid!r}, {task[0]!r}, {task[1]!r})" if is_fd else "")
    return cleaned, report
