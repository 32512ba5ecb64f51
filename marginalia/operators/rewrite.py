"""Edits of notes as rewrites of their content; none of them writes a file (see sources.notes)."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown, tasks, yamlcore
from . import extract, notes as parts

#: Characters of contents that are held before they go on as one batch.
CHARACTERS_A_BATCH = 1_000_000


class Fault(ValueError):
    """Why one note could not be changed."""


def rewritten(notes: DataFrame, change: Callable[[str], str]) -> DataFrame:
    """`notes` with changed content and a column `error`: where it isn't null the content is the old one. A null content stays."""
    schema = T._parse_datatype_string("path string, content string, error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "content", "error"])
        for batch in batches:
            paths, out, errors, held = [], [], [], 0
            for path, content in extract.each(batch):
                error = None
                try:
                    content = None if content is None else change(content)
                except ValueError as fault:
                    error = str(fault)
                paths.append(path)
                out.append(content)
                errors.append(error)
                held += len(content or "")
                if held >= CHARACTERS_A_BATCH:
                    yield made(paths, out, errors)
                    paths, out, errors, held = [], [], [], 0
            yield made(paths, out, errors)

    return notes.select("path", "content").mapInArrow(run, schema)


def fields_of(text: str) -> dict | None:
    raw = markdown.split_frontmatter(text)[0]
    if raw is None:
        return None
    value = yamlcore.load(raw)
    return value if isinstance(value, dict) else {} if value is None else None


def with_fields(text: str, fields: dict) -> str:
    return f"---\n{yamlcore.dump(fields) if fields else '{}' + chr(10)}---\n{markdown.split_frontmatter(text)[1]}"


def _lines(text: str, change: Callable[[list[str]], list[str]]) -> str:
    out = "\n".join(change(markdown.lines_of(text)))
    return out + "\n" if text.endswith("\n") else out


def _spliced(line: str, start: int, end: int, put: str) -> str:
    data = line.encode()
    return (data[:start] + put.encode() + data[end:]).decode()


def set_field(text: str, key: str, value: object) -> str:
    fields = fields_of(text) or {}
    fields[key] = value
    return with_fields(text, fields)


def append_field(text: str, key: str, value: object) -> str:
    """The value at the end of the key's list, which it begins if need be; the key moves to the end."""
    fields = fields_of(text) or {}
    old = fields.pop(key, None) if key in fields else []
    fields[key] = [*(old if isinstance(old, list) else [old]), value]
    return with_fields(text, fields)


def remove_field(text: str, key: str) -> str:
    fields = fields_of(text)
    if fields is None:
        return text
    fields.pop(key, None)
    return with_fields(text, fields)


def rename_field(text: str, old: str, new: str) -> str:
    fields = fields_of(text)
    if not fields or old not in fields:
        return text
    fields[new] = fields.pop(old)
    return with_fields(text, fields)


def _inline(text: str, key: str | None, index: int | None) -> tuple:
    found = markdown.inline_properties(text)
    if index is not None:
        if index >= len(found):
            raise Fault(f"Inline property index {index} out of range (note has {len(found)})")
        return found[index]
    if key is None:
        raise Fault("A key or an index is needed")
    own = [p for p in found if p[0] == key]
    if len(own) != 1:
        raise Fault(f"{'Multiple inline properties' if own else 'No inline property'} with key {key!r}")
    return own[0]


def put_inline(text: str, key: str, value: str, index: int | None = None) -> str:
    _, _, line, start, end = _inline(text, key, index)
    return _lines(text, lambda x: [*x[: line - 1], _spliced(x[line - 1], start, end, f"[{key}::{value}]"), *x[line:]])


def drop_inline(text: str, key: str | None = None, index: int | None = None) -> str:
    _, _, line, start, end = _inline(text, key, index)
    return _lines(text, lambda x: [*x[: line - 1], _spliced(x[line - 1], start, end, ""), *x[line:]])


def rename_inline(text: str, old: str, new: str) -> str:
    own = sorted((p for p in markdown.inline_properties(text) if p[0] == old), key=lambda p: (-p[2], -p[3]))

    def change(lines: list[str]) -> list[str]:
        for _, value, line, start, end in own:
            lines[line - 1] = _spliced(lines[line - 1], start, end, f"[{new}::{value}]")
        return lines

    return _lines(text, change) if own else text


def set_property(notes: DataFrame, key: str, value: object, scope: str = "auto", index: int | None = None) -> DataFrame:
    """scope: frontmatter, inline, or auto, where the key is already, in the frontmatter if nowhere; in both is an error, and so is the scope both."""

    def change(text: str) -> str:
        if scope == "both":
            raise Fault("The scope 'both' can't be set")
        where = scope
        if scope == "auto":
            front = key in (fields_of(text) or {})
            inline = any(p[0] == key for p in markdown.inline_properties(text))
            if front and inline:
                raise Fault(f"Property {key!r} is in the frontmatter and inline; a scope is needed")
            where = "inline" if inline else "frontmatter"
        return put_inline(text, key, yamlcore.as_text(value), index) if where == "inline" else set_field(text, key, value)

    return rewritten(notes, change)


def remove_property(notes: DataFrame, key: str, scope: str = "auto", index: int | None = None) -> DataFrame:
    def change(text: str) -> str:
        if scope == "frontmatter":
            return remove_field(text, key)
        if scope == "inline":
            return drop_inline(text, key, index)
        text = remove_field(text, key)
        own = [i for i, p in enumerate(markdown.inline_properties(text)) if p[0] == key]
        for i in reversed(own):
            text = drop_inline(text, index=i)
        return text

    return rewritten(notes, change)


def rename_property(notes: DataFrame, old: str, new: str, scope: str = "auto") -> DataFrame:
    def change(text: str) -> str:
        if scope != "inline":
            text = rename_field(text, old, new)
        return rename_inline(text, old, new) if scope != "frontmatter" else text

    return rewritten(notes, change)


def modify_frontmatter(notes: DataFrame, key: str, value: object, append: bool = False) -> DataFrame:
    return rewritten(notes, lambda text: (append_field if append else set_field)(text, key, value))


def heal_frontmatter(notes: DataFrame) -> DataFrame:
    """Repeated keys of the frontmatter removed at every level, the last one staying."""

    class Last(yamlcore.Loader):
        pass

    def mapping(loader, node):
        return {loader.construct_object(k, deep=True): loader.construct_object(v, deep=True) for k, v in node.value}

    Last.add_constructor("tag:yaml.org,2002:map", mapping)

    def change(text: str) -> str:
        import yaml

        raw = markdown.split_frontmatter(text)[0]
        if raw is None:
            return text
        try:
            yamlcore.load(raw)
            return text
        except ValueError:
            try:
                value = yaml.load(raw, Loader=Last)  # noqa: S506 - a subclass of SafeLoader
            except yaml.YAMLError as error:
                raise Fault(str(error)) from None
            return with_fields(text, value) if isinstance(value, dict) else text

    return rewritten(notes, change)


def init_metadata(notes: DataFrame, force: bool = False, namespace: str = "marginalia") -> DataFrame:
    """A random id and the time under the namespace in each note's frontmatter; notes that have one keep it unless forced."""

    def change(text: str) -> str:
        if namespace in (fields_of(text) or {}) and not force:
            return text
        made = {"id": str(uuid.uuid4()), "created": datetime.datetime.now(datetime.timezone.utc).isoformat()}
        return set_field(text, namespace, made)

    return rewritten(notes, change)


# Native rewrites: new contents as columns.


def remove_frontmatter() -> Column:
    return parts.body()


def with_body(new: Column) -> Column:
    return F.when(parts.has_frontmatter(), F.concat(F.lit("---\n"), parts.frontmatter_raw(), F.lit("\n---\n"), new)).otherwise(new)


def append(text: Column) -> Column:
    return F.concat("content", text)


def prepend(text: Column) -> Column:
    return with_body(F.concat(text, parts.body()))


def replace(old: str, new: str, first: bool = False) -> Column:
    """All occurrences of a text, or the first one only."""
    if not first:
        return F.replace(F.col("content"), F.lit(old), F.lit(new))
    at = F.locate(old, F.col("content"))
    return F.when((at > 0) & F.lit(bool(old)), F.concat(F.substring("content", F.lit(1), at - 1), F.lit(new), F.substring("content", at + len(old), F.length("content")))).otherwise(F.col("content"))


_TASK = r"\A(\s*(?:[-*+]|\d+\.) \[).\](.*)\z"


def set_task_symbol(notes: DataFrame, line: int, symbol: str) -> DataFrame:
    """The symbol in the box of the task on that line; `error` says why not."""
    cut = F.split(F.col("content"), "\n")
    trailing = F.col("content").endswith("\n")
    count = F.when(trailing | (F.col("content") == ""), F.size(cut) - 1).otherwise(F.size(cut))
    target = F.regexp_replace(F.get(cut, F.lit(line - 1)), r"\r\z", "")
    error = F.when(F.lit(line < 1), "Line numbers begin with 1").when(F.lit(line) > count, F.concat(F.lit(f"Line {line} is out of range (note has "), count.cast("string"), F.lit(" lines)"))).when(~target.rlike("(?U)(?s)" + _TASK), F.lit(f"Line {line} is not a task"))
    plain = F.transform(cut, lambda x, i: F.when(i == line - 1, F.regexp_replace(F.regexp_replace(x, r"\r\z", ""), "(?U)(?s)" + _TASK, "$1" + symbol.replace("\\", "\\\\").replace("$", "\\$") + "]$2")).otherwise(F.regexp_replace(x, r"\r\z", "")))
    return notes.select("path", F.when(error.isNull(), F.array_join(plain, "\n")).otherwise(F.col("content")).alias("content"), error.alias("error"))


def toggle_tasks() -> Column:
    """Every open box checked and every checked one opened."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?m)^(\s*(?:[-*+]|\d+\.) )\[ \]", "$1[\u0001]"), r"(?m)^(\s*(?:[-*+]|\d+\.) )\[[xX]\]", "$1[ ]"), "\\[\u0001\\]", "[x]")


def replace_lines(first: int, last: int, new: str) -> Column:
    """Lines first to last, counted from 1, replaced by a text."""
    cut = F.split(F.col("content"), "\n")
    kept = F.concat(F.slice(cut, 1, first - 1), F.array(F.lit(new)), F.slice(cut, last + 1, F.greatest(F.size(cut) - last, F.lit(0))))
    return F.when(F.size(cut) >= last, F.array_join(kept, "\n")).otherwise(F.col("content"))


ILLEGAL = r'[<>:"|?*\\\p{Cntrl}]'


def invalid_path(path: Column) -> Column:
    """Why a path can't name a note; null if it can."""
    return F.when(path.isNull() | (F.trim(path) == ""), "empty path").when(path.rlike(ILLEGAL), "illegal character").cast("string")


def create_notes(notes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes with new ones (path, content) added, and those refused: (path, error)."""
    judged = new.select(parts.normalized(F.col("path")).alias("path"), "content").withColumn("error", invalid_path(F.col("path")))
    there = notes.select("path", F.lit(True).alias("__there"))
    judged = judged.join(there, "path", "left").withColumn("error", F.coalesce("error", F.when(F.col("__there"), "note exists")))
    return notes.unionByName(judged.where("error is null").select("path", "content")), judged.where("error is not null").select("path", "error")


def delete_notes(notes: DataFrame, paths: DataFrame) -> DataFrame:
    return notes.join(paths.select("path"), "path", "left_anti")


def rename_notes(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Paths changed by (path, new_path), nothing else; links to them stay as they are."""
    return notes.join(moves.select("path", "new_path"), "path", "left").select(F.coalesce("new_path", "path").alias("path"), "content")


def rename_with_links(notes: DataFrame, edges: DataFrame, moves: DataFrame) -> DataFrame:
    """As rename_notes, and the targets of links that resolve to a moved note follow it; aliases, headings and blocks stay.

    edges: with resolved_path.  A target with a slash becomes the new path without .md,
    another the new name.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.md\z", "")
    turn = edges.where("line > 0").join(moves.select(F.col("path").alias("resolved_path"), "new_path"), "resolved_path")
    goal = F.when(F.contains("target", F.lit("/")), F.regexp_replace("new_path", r"\.md\z", "")).otherwise(stem(F.col("new_path")))
    todo = turn.groupBy(F.col("from").alias("path")).agg(F.collect_list(F.struct("line", "start_col", "target", goal.alias("goal"))).alias("edits"))
    schema = T._parse_datatype_string("path string, content string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "content"])
        for batch in batches:
            paths, out, held = [], [], 0
            for path, content, edits in extract.each(batch):
                if content is not None and edits:
                    cut = [x.encode() for x in content.split("\n")]
                    for e in sorted(edits, key=lambda e: (e["line"], -e["start_col"])):
                        line, old = cut[e["line"] - 1], e["target"].encode()
                        at = line.index(old, e["start_col"])
                        cut[e["line"] - 1] = line[:at] + e["goal"].encode() + line[at + len(old) :]
                    content = b"\n".join(cut).decode()
                paths.append(path)
                out.append(content)
                held += len(content or "")
                if held >= CHARACTERS_A_BATCH:
                    yield made(paths, out)
                    paths, out, held = [], [], 0
            yield made(paths, out)

    joined = notes.join(todo, "path", "left").select("path", "content", "edits")
    return rename_notes(joined.mapInArrow(run, schema), moves)


def without_links_to(notes: DataFrame, targets: list[str]) -> DataFrame:
    """Links to any of the names replaced by the text they show."""
    names = {t.lower() for t in targets}

    def change(text: str) -> str:
        code = markdown.code_ranges(text)

        def shown(m: re.Match) -> str:
            target = m[2].strip()
            return (m[5] or target) if target.lower() in names and not markdown.in_code(m.start(), code) else m[0]

        return markdown.LINK.sub(shown, text)

    return rewritten(notes, change)


def format_tasks(task_rows: DataFrame, config: tasks.TaskConfig = tasks.COMMON) -> Column:
    """Each task's line as it is written: marker, symbol, description, then the fields in their order."""
    steps = [F.concat_ws(" ", "marker", "symbol", "description")]
    for f in config.ordered():
        value = F.col("metadata")[f.name]
        steps.append(F.when(value.isNotNull(), F.lit(f.emoji) if f.kind in ("flag", "enum") else F.concat(F.lit(f.emoji + " "), value)))
    return F.concat_ws(" ", *steps)


def relative_date(text: Column, today: Column) -> Column:
    """today, tomorrow, yesterday, a signed number of d, w or m (30 days), or an ISO date; null for anything else."""
    low = F.lower(text)
    number = F.regexp_extract(low, r"\A([+-]\d+)[dwm]\z", 1).try_cast("int")
    unit = F.when(low.endswith("d"), 1).when(low.endswith("w"), 7).otherwise(30)
    iso = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)
    return F.when(low == "today", today.cast("string")).when(low == "tomorrow", F.date_add(today, 1).cast("string")).when(low == "yesterday", F.date_add(today, -1).cast("string")).when(number.isNotNull(), F.date_add(today, number * unit).cast("string")).otherwise(iso)
