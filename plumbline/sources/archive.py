"""A history of files as a table: every committed revision of the paths asked for, read where Spark's tasks run.

``spark.read.format("revisions").option("repository", folder).option("path", "data/book.json")`` gives one row per revision and
path: revision, committed (timestamp), day, subject, path and content. The list of revisions is read once, when the query is
planned; conditions on day, committed, revision and path are used there, so revisions that can't match are never opened, and
each task opens its share of the others. The folder must be one that every executor sees.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import subprocess
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "revision string, committed timestamp, day date, subject string, path string, content string"
#: Revisions that a task opens, if no option says otherwise.
PER_TASK = 16


def _run(repository: str, *arguments: str) -> bytes:
    return subprocess.run(["git", "-C", repository, *arguments], check=True, capture_output=True).stdout


class Share(InputPartition):
    """Some revisions: (revision, committed, subject, paths)."""

    def __init__(self, revisions: list[tuple[str, dt.datetime, str, list[str]]]):
        super().__init__(revisions[0][0] if revisions else None)
        self.revisions = revisions


_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


class RevisionsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repository = options["repository"]
        self.patterns = [p.strip() for p in options["path"].split(",")]
        self.reference = options.get("reference", "HEAD")
        self.per_task = int(options.get("revisionspertask", PER_TASK))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on what is known without opening a revision; Spark keeps the rest."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("day",), ("committed",), ("revision",), ("path",), ("subject",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _passes(self, known: dict[str, object]) -> bool:
        def holds(name: str, kind: type, value: object) -> bool:
            if isinstance(value, dt.datetime) and value.tzinfo is None:
                value = value.replace(tzinfo=dt.timezone.utc)
            return name not in known or _TESTS[kind](known[name], value)

        return all(holds(*t) for t in self.tests)

    def listed(self) -> list[tuple[str, dt.datetime, str, list[str]]]:
        """Revisions that touch the paths and can match, newest first, with the paths that they hold then."""
        plain = [p for p in self.patterns if not set(p) & set("*?[")]
        arguments = ["log", "--first-parent", "--format=%H%x1f%ct%x1f%s", self.reference]
        if self.limit is not None:
            arguments.append(f"--max-count={self.limit}")
        pathspecs = plain if len(plain) == len(self.patterns) else [f":(glob){p}" for p in self.patterns]
        out = []
        for line in _run(self.repository, *arguments, "--", *pathspecs).decode("utf-8", "replace").splitlines():
            revision, seconds, subject = line.split("\x1f", 2)
            at = dt.datetime.fromtimestamp(int(seconds), dt.timezone.utc)
            if not self._passes({"revision": revision, "committed": at, "day": at.date(), "subject": subject}):
                continue
            held = _run(self.repository, "ls-tree", "-r", "-z", "--name-only", revision).decode("utf-8", "replace").split("\0") if len(plain) < len(self.patterns) else plain
            paths = [p for p in held if p and any(p == x or fnmatch.fnmatchcase(p, x) for x in self.patterns) and self._passes({"path": p})]
            if paths:
                out.append((revision, at, subject, paths))
        return out

    def partitions(self) -> Sequence[Share]:
        found = self.listed()
        return [Share(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)]

    def read(self, partition: Share) -> Iterator[tuple]:
        for revision, at, subject, paths in partition.revisions:
            for path in paths:
                shown = subprocess.run(["git", "-C", self.repository, "show", f"{revision}:{path}"], capture_output=True)
                if shown.returncode == 0:  # a revision that removed the path has no row
                    yield revision, at, at.date(), subject, path, shown.stdout.decode("utf-8", "replace")


class Revisions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "revisions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RevisionsReader:
        return RevisionsReader(self.options)


def revisions(spark: SparkSession, repository: str, path: str, limit: int | None = None, per_task: int = PER_TASK) -> DataFrame:
    """Revisions of paths (comma-separated, with * and ?), newest first by ``committed``. [SRC14, SRC15, SRC16]

    One revision is ``.where(revision = ...)``, refreshes only are ``.where(subject.startswith(...))``.
    """
    spark.dataSource.register(Revisions)
    # Conditions reach the reader only where the session lets Python sources have them.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("revisions").option("repository", repository).option("path", path).option("revisionsPerTask", per_task)
    return (reader.option("limit", limit) if limit is not None else reader).load()


def documents_of(snapshots: DataFrame, schema: str) -> DataFrame:
    """The contents read as JSON of the schema, their fields beside revision, committed and day; unreadable contents give nulls. [SRC15]"""
    parsed = snapshots.withColumn("_doc", F.from_json("content", schema))
    return parsed.select("revision", "committed", "day", "subject", "path", "_doc.*")
