"""A streaming source of changes in a source tree, by comparing listings."""

from __future__ import annotations

import datetime
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .debounce import EVENTS


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self._root = options["path"]

    def _listing(self) -> dict[str, list[float]]:
        out = {}
        for folder, dirs, names in os.walk(self._root):
            dirs[:] = [d for d in dirs if d != ".git" and not os.path.islink(os.path.join(folder, d))]
            for n in names:
                full = os.path.join(folder, n)
                if os.path.islink(full):
                    continue
                try:
                    at = os.stat(full)
                except OSError:
                    continue
                out[os.path.relpath(full, self._root)] = [at.st_mtime, at.st_size]
        return out

    def initialOffset(self) -> dict:
        return {"files": self._listing()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        old, new = start["files"], self._listing()
        changed = sorted(p for p in old.keys() | new.keys() if old.get(p) != new.get(p))
        now = datetime.datetime.now(datetime.timezone.utc)
        return iter([(p, False, now) for p in changed]), {"files": new}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        old, new = start["files"], end["files"]
        now = datetime.datetime.now(datetime.timezone.utc)
        return iter([(p, False, now) for p in sorted(old.keys() | new.keys()) if old.get(p) != new.get(p)])


class TreeChanges(DataSource):
    """``spark.readStream.format("tree_changes")``; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeChanges)
