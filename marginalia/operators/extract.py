"""Relations extracted from notes(path, content), each by one pass without a shuffle.

A relation's rows come out of Arrow batches, because they need byte offsets of matches,
state over lines, or YAML.  Notes with a null content have no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown, tasks, yamlcore
from . import notes as parts

LINK = "target string, alias string, heading string, block_id string, embed boolean, line int, start_col int, end_col int"
TASK = "line int, raw string, marker string, symbol string, description string, indent int, parent_line int, metadata map<string,string>, links array<struct<to:string,alias:string>>, tags array<string>, block_id string"
NODE = "node_id int, parent_id int, depth int, ordinal int, node_type string, line int, marker string, symbol string, text string, metadata map<string,string>, block_id string"
EDGE = f"{LINK}, context string"

#: Rows that are held as tuples, and notes that are read for them, before they go on as one batch.
ROWS_A_BATCH = 2_000
NOTES_A_BATCH = 1_000
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.MapType):
        return pa.map_(_arrow(kind.keyType), _arrow(kind.valueType))
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    return _ARROW[kind.simpleString()]


def each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, one at a time."""
    return (tuple(cell.as_py() for cell in row) for row in zip(*batch.columns))


def relation(notes: DataFrame, parse: Callable[[str], list[tuple]], schema: str, order: bool = False) -> DataFrame:
    """Rows of parse(content) beside their path; `ord` numbers them within the note if asked for.

    One text at a time is a string of Python's, which takes up to four times its bytes in Arrow.
    """
    full = T._parse_datatype_string(f"path string, {'ord int, ' if order else ''}{schema}")
    kinds = [(f.name, _arrow(f.dataType)) for f in full]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(_cells(c, k), k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])

        for batch in batches:
            out: list[tuple] = []
            for n, (path, content) in enumerate(each(batch), 1):
                if content is not None:
                    found = parse(content)
                    out += [(path, i, *r) for i, r in enumerate(found)] if order else [(path, *r) for r in found]
                if len(out) >= ROWS_A_BATCH or n % NOTES_A_BATCH == 0:
                    yield made(out)
                    out = []
            yield made(out)

    return notes.select("path", "content").mapInArrow(run, full)


def _cells(column: tuple, kind: pa.DataType) -> list:
    if pa.types.is_map(kind):
        return [list(c.items()) for c in column]
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        names = [f.name for f in kind.value_type]
        return [[dict(zip(names, x)) for x in c] for c in column]
    return list(column)


def links(notes: DataFrame) -> DataFrame:
    """Wikilinks and embeds outside code, of the whole content."""
    return relation(notes, markdown.links, LINK, order=True)


def embeds(notes: DataFrame) -> DataFrame:
    return links(notes).where("embed")


def plain_links(notes: DataFrame) -> DataFrame:
    return links(notes).where("NOT embed")


def tags(notes: DataFrame) -> DataFrame:
    return relation(notes, markdown.tags, "name string, line int, start_col int, end_col int", order=True)


def headings(notes: DataFrame) -> DataFrame:
    return relation(notes, markdown.headings, "text string, level int, line int, slug string")


def blocks(notes: DataFrame) -> DataFrame:
    return relation(notes, markdown.block_ids, "id string, line int, block_type string")


def inline_properties(notes: DataFrame) -> DataFrame:
    return relation(notes, markdown.inline_properties, "key string, value string, line int, start_col int, end_col int", order=True).withColumnRenamed("ord", "index")


def code_ranges(notes: DataFrame) -> DataFrame:
    """Code with byte offsets in the content: (start, end, start_line, end_line, is_fenced)."""

    def parse(text: str) -> list[tuple]:
        found = markdown.code_ranges(text)
        place = (lambda i: i) if text.isascii() else (lambda i: len(text[:i].encode()))
        return [(place(c.start), place(c.end), c.first, c.last, c.fenced) for c in found]

    return relation(notes, parse, "start int, end int, start_line int, end_line int, is_fenced boolean")


def task_rows(notes: DataFrame, config: tasks.TaskConfig = tasks.COMMON) -> DataFrame:
    return relation(notes, lambda text: tasks.tasks(text, config), TASK)


def task_nodes(notes: DataFrame, config: tasks.TaskConfig = tasks.COMMON) -> DataFrame:
    return relation(notes, lambda text: tasks.tree(text, config), NODE)


def formatted_trees(notes: DataFrame, indent: str = "    ", config: tasks.TaskConfig = tasks.COMMON) -> DataFrame:
    """(path, tree): each note's task tree as text; notes without tasks have none."""

    def parse(text: str) -> list[tuple]:
        nodes = tasks.tree(text, config)
        return [(tasks.format_tree(nodes, indent, config),)] if nodes else []

    return relation(notes, parse, "tree string")


def frontmatter(notes: DataFrame) -> DataFrame:
    """(path, status, fm_json, fm_text, fm_strings, fm_error): status is absent, empty, ok or malformed.

    fm_json is the YAML as JSON, fm_text each key's value as search compares it, fm_strings
    every string with its key path and, in a list, its index.  Only the notes' heads reach Python.
    """

    def parse(text: str) -> list[tuple]:
        raw = markdown.split_frontmatter(text)[0]
        if raw is None:
            return [("absent", None, {}, [], None)]
        try:
            value = yamlcore.load(raw)
        except ValueError as error:
            return [("malformed", None, {}, [], str(error))]
        if value is None:
            return [("empty", None, {}, [], None)]
        texts = {k: yamlcore.as_text(v) for k, v in value.items() if isinstance(k, str)} if isinstance(value, dict) else {}
        return [("ok", yamlcore.as_json(value), texts, yamlcore.strings(value), None)]

    return relation(notes.select("path", parts.head().alias("content")), parse, "status string, fm_json string, fm_text map<string,string>, fm_strings array<struct<key:string,idx:int,text:string>>, fm_error string")


def edges_of(text: str) -> list[tuple]:
    """Links of the content with where they stand, then those of the frontmatter's strings, on line 0."""
    found = markdown.links(text)
    lines = markdown.lines_of(text) if found else []
    out = [(*x, markdown.link_context(lines, x[5], x[6])) for x in found]
    raw = markdown.split_frontmatter(text)[0]
    if raw is not None and "[[" in raw:
        try:
            value = yamlcore.load(raw)
        except ValueError:
            return out
        for key, index, string in yamlcore.strings(value):
            context = "body" if not key and index is None else f"frontmatter:{key}" if index is None else f"frontmatter:{key}[{index}]"
            out += [(*x[:5], 0, *x[6:], context) for x in markdown.links(string)]
    return out


def edges(notes: DataFrame) -> DataFrame:
    """Outgoing links, in order, with their context and the key by which they are looked up."""
    key = F.regexp_replace(F.lower("target"), r"\.md\z", "")
    return relation(notes, edges_of, EDGE, order=True).withColumnRenamed("path", "from").withColumn("target_key", key)


def lines(notes: DataFrame) -> DataFrame:
    """(path, line, text) of every line; native, no Python."""
    cut = F.split(F.col("content"), "\n")
    cut = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).otherwise(cut)
    return notes.select("path", F.posexplode(cut).alias("i", "raw")).select("path", (F.col("i") + 1).alias("line"), F.regexp_replace("raw", r"\r\z", "").alias("text"))
