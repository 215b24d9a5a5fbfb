"""Functions and analysers that a caller supplies: what they look like, and how long they may run."""

from __future__ import annotations

import signal
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.operators import dependencies as fd
from limpid.sources.store import stored

#: Seconds that a supplied function may take for its table.
TIME_LIMIT = 30.0
#: Seconds after which a function that did not stop by itself is stopped with its jobs.
GRACE = 10.0


class ColumnAnalyser(Protocol):
    """Looks at one column of a known semantic type; what it finds goes into the column's notes."""

    def analyse(self, df: DataFrame, column: str, kind: str) -> dict[str, Any]: ...


class TableCleaner(Protocol):
    """Finds tasks that concern two columns or more, and settles them one by one."""

    task_type: str

    def detect(self, df: DataFrame, rid: str, columns: list[str]) -> list[Any]:
        """Tasks in the order in which they are to be settled."""

    def get_data(self, df: DataFrame, task: Any) -> Row | None:
        """A task looked at again on a table that has been cleaned in part; None where nothing is left to do."""

    def settle(self, df: DataFrame, rid: str, task: Any) -> DataFrame: ...


class Dependencies:
    """Dependencies between two columns, enforced level by level."""

    task_type = "DEPENDENCY"

    def __init__(self, least_score: float = fd.LEAST_SCORE):
        self.least_score = least_score

    def detect(self, df: DataFrame, rid: str, columns: list[str]) -> list[tuple[str, str, float]]:
        found = [(r["lhs"], r["rhs"], r["score"]) for r in fd.detect(df, rid, columns, self.least_score).collect()]
        return [task for level in fd.enforcement_order(found) for task in level]

    def get_data(self, df: DataFrame, task: tuple[str, str, float]) -> Row | None:
        left = fd.issues(df, [task[:2]]).first()
        return left if left["violations"] or left["imputables"] else None

    def settle(self, df: DataFrame, rid: str, task: tuple[str, str, float]) -> DataFrame:
        return fd.enforce(df, rid, task[0], task[1])


def analysed(df: DataFrame, kinds: dict[str, str], analysers: list[ColumnAnalyser]) -> dict[str, dict[str, Any]]:
    """What the analysers found, by column; of two with one name the later stays, and one that fails adds its error alone."""
    notes: dict[str, dict[str, Any]] = {c: {} for c in kinds}
    for c, kind in kinds.items():
        for a in analysers:
            try:
                notes[c] |= a.analyse(df, c, kind) or {}
            except Exception as e:
                notes[c].setdefault("errors", []).append(last_line(e))
    return notes


def last_line(e: BaseException) -> str:
    """The last line of an error that a Python worker raised, which names it; Java frames below it are left out."""
    lines = [line.strip() for line in str(e).splitlines() if line.strip()]
    lines = [line for line in lines if not line.startswith(("at ", "... ", "Caused by", "JVM stacktrace"))]
    return lines[-1] if lines else type(e).__name__


class Late(BaseException):
    """Raised inside a supplied function whose time is up; no Exception, so that the function's own handlers let it pass."""


@dataclass(frozen=True)
class Deadline:
    """When supplied functions have to be done, by the clock that machines of a cluster share."""

    at: float
    seconds: float

    @property
    def note(self) -> str:
        return f"Stopped after {self.seconds:g} seconds."


_deadline: ContextVar[Deadline | None] = ContextVar("deadline", default=None)


def stopping(f: Callable) -> Callable:
    """``f``, stopped from inside at the deadline that holds where this is called; as it is where none does.

    The worker that runs it raises :class:`Late` in it by an interval timer, again every
    second, and ends its task as after any error. So no process is killed, and
    Spark's pool of workers stays whole. What begins too late fails at once.
    """
    deadline = _deadline.get()
    if deadline is None:
        return f

    def run(*args: Any) -> Any:
        def late(*_: Any) -> None:
            raise Late(deadline.note)

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, max(deadline.at - time.time(), 1e-3), 1.0)
        try:
            return f(*args)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    return run


def drained(spark: SparkSession, tries: int = 20) -> None:
    """Runs small Python jobs until one succeeds: a worker that was killed can come back from Spark's pool once."""
    for left in reversed(range(tries)):
        try:
            spark.range(spark.sparkContext.defaultParallelism).mapInArrow(lambda batches: batches, "id long").count()
            return
        except Exception:
            if not left:
                raise


@contextmanager
def time_limit(df: DataFrame, seconds: float = TIME_LIMIT, grace: float = GRACE) -> Iterator[None]:
    """Supplied functions that are applied inside stop after so many seconds, which raises TimeoutError.

    What does not come back to Python by then (native code) is stopped after
    ``grace`` more seconds by cancelling this thread's jobs, the last resort:
    then the killed workers are taken out of Spark's pool before this returns.
    """
    context, tag, late = df.sparkSession.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event()
    deadline = Deadline(time.time() + seconds, seconds)

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds + grace, stop)
    context.addJobTag(tag)
    held = _deadline.set(deadline)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set() or deadline.note in str(e):
            raise TimeoutError(deadline.note) from e
        raise
    finally:
        timer.cancel()
        _deadline.reset(held)
        context.removeJobTag(tag)
        if late.is_set():
            drained(df.sparkSession)


def run_supplied(df: DataFrame, clean: Callable[[DataFrame], DataFrame], seconds: float = TIME_LIMIT) -> tuple[DataFrame, str | None]:
    """``clean(df)``, run to its end and stored, and None; or ``df`` as it was and the error's last line.

    ``clean`` is a plan such as ``lambda df: apply_series_cleaner(df, "a", f, "rid")``;
    it runs in Spark's Python workers, which are no sandbox.
    """
    try:
        with time_limit(df, seconds):
            return stored(clean(df)), None
    except Exception as e:
        return df, last_line(e)


def apply_series_cleaner(df: DataFrame, column: str, clean: Callable, rid: str) -> DataFrame:
    """A supplied pandas function on one column, batch by batch.

    The function must look at each value alone: batches are whatever Spark
    deals out. It has to keep the number of values.
    """
    clean = stopping(clean)

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        out = clean(values)
        if not isinstance(out, pd.Series) or len(out) != len(values):
            raise TypeError("A column cleaner has to return a series as long as its input.")
        return out.astype(object).where(out.notna(), None).map(lambda v: v if v is None else str(v))

    return df.withColumn(column, run(F.col(f"`{column}`").cast("string")))


def apply_pair_cleaner(df: DataFrame, lhs: str, rhs: str, clean: Callable) -> DataFrame:
    """A supplied pandas function on two columns, batch by batch; it has to keep the left one as it is and the number of rows."""
    clean = stopping(clean)

    @F.pandas_udf(T.StringType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        given = pd.DataFrame({lhs: left, rhs: right})
        out = clean(given.copy())
        if not isinstance(out, pd.DataFrame) or len(out) != len(given) or not out[lhs].reset_index(drop=True).equals(given[lhs].reset_index(drop=True)):
            raise TypeError("A cleaner of two columns has to return a table as long as its input, with the left column as it was.")
        return out[rhs].astype(object).where(out[rhs].notna(), None).map(lambda v: v if v is None else str(v))

    text = [F.col(f"`{c}`").cast("string") for c in (lhs, rhs)]
    return df.withColumn(rhs, run(*text))


class PairFunctions:
    """Supplied pandas functions on two columns as table cleaners, each under the time limit.

    A function that fails, or takes too long, leaves the table as it was; ``errors`` says why.
    """

    task_type = "SUPPLIED"

    def __init__(self, functions: dict[tuple[str, str], Callable], seconds: float = TIME_LIMIT):
        self.functions, self.seconds, self.errors = functions, seconds, {}

    def detect(self, df: DataFrame, rid: str, columns: list[str]) -> list[tuple[str, str]]:
        return [pair for pair in self.functions if set(pair) <= set(columns)]

    def get_data(self, df: DataFrame, task: tuple[str, str]) -> Row | None:
        return df.where(F.col(f"`{task[0]}`").isNotNull() | F.col(f"`{task[1]}`").isNotNull()).select(*[f"`{c}`" for c in task]).first()

    def settle(self, df: DataFrame, rid: str, task: tuple[str, str]) -> DataFrame:
        out, error = run_supplied(df, lambda df: apply_pair_cleaner(df, *task, self.functions[task]), self.seconds)
        if error:
            self.errors[task] = error
        return out
