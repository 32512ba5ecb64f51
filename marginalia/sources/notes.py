"""Folders of Markdown files as a Spark data source `notes`, and what writes them back.

The built-in text source can't open names with a colon and skips those that begin with an
underscore; this one takes every file whose name ends in .md.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, SimpleDataSourceStreamReader, StringStartsWith

SCHEMA = "path string, name string, content string, modified timestamp, created timestamp, size_bytes long"
#: Files that one task reads.
FILES_PER_TASK = 2000


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(root: str, hidden: bool = False, prefix: str = "") -> list[str]:
    """Relative paths of the Markdown files under root, sorted by their parts; whole folders that a prefix rules out aren't entered."""
    out = []
    for folder, folders, files in os.walk(root):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if at == "." else at + "/"
        fits = lambda p: p.startswith(prefix) or prefix.startswith(p)
        folders[:] = sorted(f for f in folders if (hidden or not f.startswith(".")) and fits(at + f + "/"))
        out += [at + f for f in files if f.endswith(".md") and (hidden or not f.startswith(".")) and (at + f).startswith(prefix)]
    return sorted(out, key=lambda p: p.split("/"))


def reachable(root: str, path: str, hidden: bool) -> bool:
    """Whether a listing of root has this path: a Markdown file below it, by its plain name, and not hidden unless asked for."""
    parts = path.split("/")
    if not path.endswith(".md") or any(p in ("", ".", "..") for p in parts) or (not hidden and any(p.startswith(".") for p in parts)):
        return False
    folder = Path(root)
    # Listing doesn't follow links to folders.
    return os.path.isfile(folder / path) and not any((folder / "/".join(parts[:i])).is_symlink() for i in range(1, len(parts)))


def head_of(path: Path) -> str:
    """A file's text up to the end of its frontmatter; all of it if that doesn't end."""
    with path.open(encoding="utf-8", newline="") as f:
        out = f.readline()
        if out.rstrip("\r\n") != "---":
            return out
        for line in f:
            out += line
            if line.rstrip("\r\n") == "---" and out.count("\n") > 2:
                break
    return out


def row(root: str, path: str, head: bool) -> tuple:
    file = Path(root, path)
    at = file.stat()
    utc = lambda t: datetime.fromtimestamp(t, timezone.utc)
    born = getattr(at, "st_birthtime", None)
    content = head_of(file) if head else file.read_bytes().decode("utf-8", errors="replace")
    return path, file.stem, content, utc(at.st_mtime), utc(born) if born else None, at.st_size


class NotesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.head = options["path"], options.get("columns") == "frontmatter"
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.exact: str | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A path, or the beginning of paths, decides what is listed; Spark applies every filter again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.exact = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefix = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.exact is not None:
            paths = [self.exact] if reachable(self.root, self.exact, self.hidden) else []
        else:
            paths = listed(self.root, self.hidden, self.prefix)
        return [Files(paths[i : i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                yield row(self.root, path, self.head)
            except OSError:
                continue  # gone since it was listed


class NotesStream(SimpleDataSourceStreamReader):
    """Notes that were changed after those seen so far; the offset is the latest modification time and the paths that have it."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def initialOffset(self) -> dict:
        return {"mtime": "0", "paths": ""}

    def _changed(self, start: dict, end: dict | None) -> list[tuple[int, str]]:
        seen = set(start["paths"].split("\0"))
        found = []
        for path in listed(self.root):
            try:
                at = os.stat(os.path.join(self.root, path)).st_mtime_ns
            except OSError:
                continue
            low = int(start["mtime"])
            if (at > low or (at == low and path not in seen)) and (end is None or at <= int(end["mtime"])):
                found.append((at, path))
        return found

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._changed(start, None)
        if not found:
            return iter(()), start
        last = max(at for at, _ in found)
        paths = sorted(p for at, p in found if at == last)
        if str(last) == start["mtime"]:
            paths = sorted({*paths, *start["paths"].split("\0")})
        return iter([row(self.root, p, False) for _, p in found]), {"mtime": str(last), "paths": "\0".join(paths)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([row(self.root, p, False) for _, p in self._changed(start, end)])


class NotesSource(DataSource):
    """Options: path, the folder; hidden, to take names that begin with a dot; columns=frontmatter, to read no further than the frontmatter."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NotesReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return NotesStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known; its reader takes filters, which Spark refuses unless told otherwise."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NotesSource)


def read(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The notes under a folder that every executor sees."""
    register(spark)
    return spark.read.format("notes").options(**options).load(root)


def write(notes: DataFrame, root: str) -> int:
    """Writes (path, content) as files under root, each by a rename, and returns how many; a null content deletes the file.

    Writing the same notes again changes nothing, so that a task may be repeated.
    """

    def put(rows: Iterator) -> Iterator[int]:
        for r in rows:
            file = Path(root, r.path).resolve()
            if not file.is_relative_to(Path(root).resolve()):
                raise ValueError(f"{r.path} is outside of the folder")
            if r.content is None:
                file.unlink(missing_ok=True)
            else:
                file.parent.mkdir(parents=True, exist_ok=True)
                part = file.with_name(f".{file.name}.{os.getpid()}.part")
                part.write_bytes(r.content.encode())
                part.replace(file)
            yield 1

    def batches(it):
        import pyarrow as pa

        for batch in it:
            n = sum(put(_rows(batch)))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return notes.select("path", "content").mapInArrow(batches, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _rows(batch):
    from types import SimpleNamespace

    for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        yield SimpleNamespace(path=path, content=content)


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object on each line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def pretty(df: DataFrame, key: str = "path") -> DataFrame:
    """(key, json): each row as indented JSON."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("json"))
