"""Source trees and change logs as Spark data sources.

Spark's own file sources leave out names that begin with a dot or an underscore, so trees are read by
a Python data source: folders are opened level by level, ignored ones pruned before they are entered, until
there are enough for all tasks; each then walks the tree below one. A change log is read by ranges of its
commits. Roots are folders that the executors can open too (one machine, or a shared mount).
"""

from __future__ import annotations

import hashlib
import math
import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import config
from ..functions import globs, paths, text

FILES = "root string, path string, size long, mtime double, content binary, sha256 string"
CHANGES = "sha string, ts double, path string, subject string"


#: Folders from which on no further level is opened before tasks are dealt, and commits of a range.
WIDE, RANGE = 256, 500


class _Part(InputPartition):
    """Folders or files to walk, or ids of commits."""

    def __init__(self, entries: list[str]):
        self.entries = entries


def _dealt(entries: list[str], size: int) -> list[_Part]:
    return [_Part(entries[i : i + size]) for i in range(0, len(entries), size)]


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._root, self._rules = options["path"], globs.parse_rules(options.get("ignore", "").split("\n"))

    def partitions(self) -> list[InputPartition]:
        folders, found = [""], []
        while folders and len(folders) < WIDE:
            below = []
            for rel in folders:
                try:
                    with os.scandir(os.path.join(self._root, rel)) as entries:
                        for e in entries:
                            own = f"{rel}/{e.name}" if rel else e.name
                            if not e.is_dir(follow_symlinks=False):
                                found.append(own)
                            elif not globs.decide(own + "/", self._rules):
                                below.append(own)
                except OSError:
                    continue
            folders = below
        return [*_dealt(sorted(folders), 1), *_dealt(sorted(found), max(1, -(-len(found) // WIDE)))] or [_Part([])]

    def _walk(self, rel: str) -> Iterator[str]:
        full = os.path.join(self._root, rel)
        if os.path.islink(full):
            return
        if not os.path.isdir(full):
            if os.path.isfile(full) and not globs.decide(rel, self._rules):
                yield rel
            return
        if globs.decide(rel + "/", self._rules):
            return
        try:
            names = sorted(os.listdir(full))
        except PermissionError:
            return
        for n in names:
            yield from self._walk(f"{rel}/{n}")

    def read(self, partition: _Part) -> Iterator[tuple]:
        for rel in (x for e in partition.entries for x in self._walk(e)):
            full = os.path.join(self._root, rel)
            try:
                content = Path(full).read_bytes()
                mtime = os.stat(full).st_mtime
            except OSError:
                continue  # unreadable: as good as binary
            yield self._root, rel, len(content), mtime, content, hashlib.sha256(content).hexdigest()


class RepoFiles(DataSource):
    """``spark.read.format("repo_files")``; options ``path`` and ``ignore`` (lines of patterns)."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


class _LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._root, self._since, self._limit = options["path"], options.get("since"), int(options.get("limit", config.COMMITS))

    def _git(self, *args: str, told: str = "") -> str:
        found = subprocess.run(["git", "-C", self._root, *args], input=told.encode(), capture_output=True)
        return "" if found.returncode else found.stdout.decode("utf-8", "replace")

    def partitions(self) -> list[InputPartition]:
        """Ranges of commits, newest first."""
        ids = self._git("rev-list", f"--since=@{self._since}" if self._since else f"-n{self._limit}", "--date-order", "HEAD").split()
        return _dealt(ids, RANGE) or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.entries:
            return
        # against the first parent only; a root commit against nothing
        how = ["log", "--no-walk=unsorted", "--stdin", "--no-renames", "--diff-merges=first-parent", "--root", "--name-only", "-z", "--format=%x01%H%x02%ct%x02%s%x02"]
        for commit in self._git(*how, told="\n".join(partition.entries)).split("\x01")[1:]:
            sha, ts, subject, names = commit.split("\x02", 3)
            changed = [n.strip("\n") for n in names.split("\0") if n.strip("\n")]
            for n in changed or [None]:
                yield sha, float(ts), n, subject.strip()


class CommitLog(DataSource):
    """``spark.read.format("commit_log")``: a row for each commit and file; options ``path``, and
    ``since`` (whole seconds), from when on all are read, or ``limit``, the newest."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepoFiles)
    spark.dataSource.register(CommitLog)


def ignore_layers(root: str | Path, extra: tuple[str, ...] = ()) -> list[str]:
    """Patterns in order: built in, the tree's ignore files, the run's own."""
    lines = list(config.ALWAYS_IGNORE)
    for name in (".gitignore", ".ctxignore"):
        try:
            lines += (Path(root) / name).read_text(encoding="utf-8", errors="replace").splitlines()
        except OSError:
            continue
    return [*lines, *extra]


def files(spark: SparkSession, roots: list[str], extra_ignore: tuple[str, ...] = (), output_file: str | None = None) -> DataFrame:
    """Text files of all roots that no rule ignores, with name, suffix, language and text; symbolic
    links, binary files and the run's own output are left out. A tree below another counts once for
    each root."""
    register(spark)
    out = None
    for root in roots:
        rows = spark.read.format("repo_files").option("path", str(root)).option("ignore", "\n".join(ignore_layers(root, extra_ignore))).load()
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], FILES)
    p = F.col("path")
    out = out.where(~text.is_binary(F.col("content")))
    if output_file:
        out = out.where(F.concat_ws("/", "root", "path") != str(Path(roots[0], output_file) if not os.path.isabs(output_file) else output_file)) if roots else out
    return out.select("root", "path", paths.name(p).alias("name"), paths.suffix(p).alias("ext"), paths.language(p).alias("language"), "size", "mtime", "sha256", text.decoded(F.col("content")).alias("text"))


def commits(spark: SparkSession, root: str, limit: int = config.COMMITS, since: float | None = None) -> DataFrame:
    """The newest ``limit`` commits, or all that are no older than ``since``."""
    register(spark)
    log = spark.read.format("commit_log").option("path", str(root)).option("limit", limit)
    return (log if since is None else log.option("since", math.ceil(since))).load()


def change_stats(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (path, commit_count, last_modified_ts) of the known files (path, mtime): from the log, or,
    where there is none at all, no commits and the file's own time."""
    own = changes.where("path is not null").groupBy("path").agg(F.count("*").alias("commit_count"), F.max("ts").alias("last_modified_ts"))
    if changes.isEmpty():
        return known.select("path", F.lit(0).cast("long").alias("commit_count"), F.col("mtime").alias("last_modified_ts"))
    return known.select("path").join(own, "path")


def recent_changes(changes: DataFrame, cutoff: float, files_shown: int = config.RECENT_FILES) -> str:
    """All commits since ``cutoff``, newest first, and the files that they touched. Only what is shown
    comes to the driver."""
    recent = changes.where(F.col("ts") >= cutoff)
    heads = recent.groupBy("sha").agg(F.max("ts").alias("ts"), F.first("subject").alias("subject")).orderBy(F.desc("ts"), "sha")
    line = F.format_string("- `%s` (%s) %s", F.left("sha", F.lit(8)), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"), "subject")
    shown = [r["l"] for r in heads.select(line.alias("l")).collect()]
    if not shown:
        return ""
    touched = recent.where("path is not null").select("path").distinct()
    names, n = [r["path"] for r in touched.orderBy("path").limit(files_shown).collect()], touched.count()
    more = [f"- ... and {n - files_shown} more"] if n > files_shown else []
    return "\n".join(["### Commits", "", *shown, "", "### Files", "", *(f"- `{p}`" for p in names), *more, ""])
