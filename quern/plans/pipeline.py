"""Local pipelines: select tables, run their stages in order, verify, clean up."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quern.contracts import TableContract
from quern.operators.verify import require_passed
from quern.sources.sinks import write_table


class SelectionError(KeyError):
    """A unit that no family has."""


def expand_selection(families: Mapping[str, Sequence[str]], wanted: Iterable[str]) -> list[str]:
    """Units to process, in declared order and once.

    ``all`` is every unit, a family name its units, and a unit its whole family,
    because the units of a family form one table.
    """
    wanted = list(wanted)
    chosen: set[str] = set()
    for name in wanted:
        if name == "all":
            chosen.update(families)
        elif name in families:
            chosen.add(name)
        else:
            owners = [f for f, units in families.items() if name in units]
            if not owners:
                raise SelectionError(name)
            chosen.update(owners)
    return [u for f, units in families.items() if f in chosen for u in units]


@dataclass(frozen=True)
class Stage:
    """Builds one table; ``reports`` are (check, count, status) frames over what was written."""

    name: str
    contract: TableContract
    build: Callable[[SparkSession], DataFrame]
    reports: Sequence[Callable[[SparkSession, DataFrame], DataFrame]] = ()


@dataclass
class Pipeline:
    spark: SparkSession
    root: str
    stages: Sequence[Stage]
    rows: dict[str, int] = field(default_factory=dict)

    def path(self, stage: Stage) -> str:
        return f"{self.root.rstrip('/')}/{stage.name}"

    def run(self, only: Iterable[str] = ("all",)) -> dict[str, int]:
        """Process, validate and verify the selected stages; a failed check stops the run."""
        names = expand_selection({s.name: (s.name,) for s in self.stages}, only)
        for stage in self.stages:
            if stage.name in names:
                self.rows[stage.name] = write_table(stage.build(self.spark), self.path(stage), stage.contract)
                self.verify(stage)
        return self.rows

    def verify(self, stage: Stage) -> None:
        written = self.spark.read.parquet(self.path(stage))
        for report in stage.reports:
            require_passed(report(self.spark, written))


def cleanup_plan(root: str | Path, owned: Iterable[str]) -> list[Path]:
    """Existing owned paths under a local root that may be deleted.

    A path outside the root, or one that is or passes through a symbolic link, raises.
    """
    root = Path(root).resolve()
    plan = []
    for name in owned:
        path = root / name
        for part in (path, *path.parents):
            if part == root:
                break
            if part.is_symlink():
                raise ValueError(f"{part} is a symbolic link")
        if root not in path.resolve().parents:
            raise ValueError(f"{name} is not inside {root}")
        if path.exists():
            plan.append(path)
    return plan


def clean(root: str | Path, owned: Iterable[str], dry_run: bool = True) -> list[Path]:
    """Delete owned paths (or only name them)."""
    import shutil

    plan = cleanup_plan(root, owned)
    if not dry_run:
        for path in plan:
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    return plan
