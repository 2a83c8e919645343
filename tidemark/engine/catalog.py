"""Registered tables: kind, key and column projection; the guard against file access in builders."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

KINDS = ("static", "schedule", "event", "snapshot")


@dataclass(frozen=True)
class TableSpec:
    """A table's kind decides how it may be read as of a cutoff; ``key`` identifies a row."""

    name: str
    kind: str
    key: tuple[str, ...]
    available_at: str = "available_at"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")


DOMAIN_TABLES = [
    TableSpec("team_dim", "static", ("team_key",)),
    TableSpec("player_dim", "static", ("player_key",)),
    TableSpec("gameweek", "schedule", ("season", "gw")),
    TableSpec("fixture", "event", ("fixture_key",)),
    TableSpec("player_match", "event", ("player_key", "fixture_key")),
    TableSpec("ban_event", "event", ("ban_key",)),
    TableSpec("player_snapshot", "snapshot", ("snapshot_at", "source", "player_key")),
]


@dataclass
class Catalog:
    """Tables of a directory (or given frames), read lazily; Catalyst prunes columns and row groups."""

    spark: SparkSession
    directory: str | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)
    specs: dict[str, TableSpec] = field(default_factory=lambda: {s.name: s for s in DOMAIN_TABLES})
    _blocked: str | None = None

    def register(self, spec: TableSpec, frame: DataFrame | None = None) -> None:
        self.specs[spec.name] = spec
        if frame is not None:
            self.frames[spec.name] = frame

    def load(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if self._blocked:
            raise RuntimeError(f"files must not be read here: {self._blocked}")
        if self.directory is None:
            raise KeyError(name)
        self.frames[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self.frames[name]

    @contextlib.contextmanager
    def files_blocked(self, reason: str) -> Iterator[None]:
        """While active, opening a table that wasn't opened before raises."""
        before, self._blocked = self._blocked, reason
        try:
            yield
        finally:
            self._blocked = before
