"""The extractors as table functions for SQL: SELECT ... FROM notes, LATERAL note_links(content)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import markdown, tasks

_LINK = "target string, alias string, heading string, block_id string, embed boolean, line int, start_col int, end_col int"
FUNCTIONS = {
    "note_links": (markdown.links, _LINK),
    "note_tags": (markdown.tags, "name string, line int, start_col int, end_col int"),
    "note_headings": (markdown.headings, "text string, level int, line int, slug string"),
    "note_blocks": (markdown.block_ids, "id string, line int, block_type string"),
    "note_properties": (markdown.inline_properties, "key string, value string, line int, start_col int, end_col int"),
    "note_tasks": (lambda text: [r[:7] for r in tasks.tasks(text, tasks.COMMON)], "line int, raw string, marker string, symbol string, description string, indent int, parent_line int"),
}


def register(spark: SparkSession) -> None:
    for name, (parse, schema) in FUNCTIONS.items():

        class Rows:
            _parse = staticmethod(parse)

            def eval(self, content: str):
                if content is not None:
                    yield from self._parse(content)

        spark.udtf.register(name, udtf(Rows, returnType=schema))
