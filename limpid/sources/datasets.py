"""Known datasets, settings, and how their files are named."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Dataset:
    """A benchmark table with its ground truth; ``numeric`` columns are compared as numbers."""

    name: str
    numeric: tuple[str, ...] | None = None

    def paths(self, folder: str) -> tuple[Path, Path]:
        base = Path(folder) / self.name
        return base / f"{self.name}_dirty.csv", base / f"{self.name}_gt.csv"


# The numeric columns of the public benchmarks.
DATASETS = {
    d.name: d
    for d in (
        Dataset("beers", ("id", "ounces", "abv", "ibu", "brewery_id")),
        Dataset("hospital", ("ProviderNumber", "ZipCode", "PhoneNumber", "Score", "Sample")),
        Dataset("movies", ("Year", "Duration", "RatingValue", "RatingCount")),
        Dataset("rayyan", ("id", "article_jvolumn", "article_jissue")),
        Dataset("tax"),
        Dataset("adult"),
        Dataset("restaurants"),
    )
}


def resolve(name_or_path: str, folder: str = "data") -> tuple[Path, Path | None]:
    """(dirty, ground truth or None): a file wins over a dataset's name."""
    path = Path(name_or_path)
    if path.exists():
        truth = path.with_name(path.name.replace("_dirty", "_gt"))
        return path, truth if truth != path and truth.exists() else None
    if name_or_path in DATASETS:
        return DATASETS[name_or_path].paths(folder)
    raise FileNotFoundError(name_or_path)


def dirty_next_to(truth: str | Path) -> Path:
    """``x_gt.csv`` has its dirty table beside it as ``x_dirty.csv``."""
    truth = Path(truth)
    return truth.with_name(truth.name.replace("_gt", "_dirty"))


def numeric_columns(truth: str | Path) -> tuple[str, ...] | None:
    """Declared numeric columns of the dataset that a file belongs to; None: try every column."""
    known = DATASETS.get(Path(truth).stem.removesuffix("_gt"))
    return known.numeric if known else None


def stored_results(path: str | Path) -> dict:
    """The results of a run as ``--results`` wrote them."""
    return json.loads(Path(path).read_text())


def stored_runtime(path: str | Path, name: str) -> float:
    """Seconds of a dataset in a file of runtimes; -1.0 where the file cannot be read or does not name it."""
    try:
        return float(json.loads(Path(path).read_text()).get(name, -1.0))
    except (OSError, ValueError, TypeError, AttributeError):
        return -1.0


@dataclass(frozen=True)
class Settings:
    """What a cleaning run can be told. Unknown keys are ignored and bad values fall back."""

    seed: int = 42
    least_score: float = 0.925
    outlier_policy: str = "keep"
    clean_columns: tuple[str, ...] = ()
    sentinels: tuple[float, ...] = ()
    workers: int = 8
    disguised: bool = True
    sample_sizes: dict[str, int] = field(default_factory=lambda: {"clean": 20, "dirty": 500, "unique": 500, "random": 20, "short": 30, "long": 10})

    @classmethod
    def load(cls, path: str | None) -> Settings:
        """From a JSON file; a missing or unreadable one gives the defaults."""
        try:
            given = json.loads(Path(path).read_text()) if path else {}
        except (OSError, ValueError):
            given = {}
        return cls().merged(given if isinstance(given, dict) else {})

    def merged(self, given: dict) -> Settings:
        kept = {}
        for f in fields(self):
            now, new = getattr(self, f.name), given.get(f.name)
            if isinstance(now, dict) and isinstance(new, dict):
                kept[f.name] = now | {k: v for k, v in new.items() if k in now and isinstance(v, int) and not isinstance(v, bool) and v > 0}
            elif isinstance(now, tuple) and isinstance(new, list):
                kept[f.name] = tuple(float(x) for x in new if isinstance(x, (int, float)) and not isinstance(x, bool)) if f.name == "sentinels" else tuple(map(str, new))
            elif new is not None and isinstance(new, type(now)) and isinstance(new, bool) == isinstance(now, bool):
                kept[f.name] = new
        return replace(self, **kept)

    def with_sample_size(self, n: int) -> Settings:
        """One size for all samples but those of free text."""
        return replace(self, sample_sizes={k: v if k in ("short", "long") else n for k, v in self.sample_sizes.items()})
