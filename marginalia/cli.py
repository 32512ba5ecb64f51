"""Commands over a folder of notes: python -m marginalia.cli --vault FOLDER COMMAND [ARGUMENTS]."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import yamlcore
from .operators import extract, graph, health, notes as parts, properties, rewrite
from .plans import search
from .plans.query import QueryError
from .session import session
from .sources import notes as source


class NotFound(LookupError):
    pass


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()]


class Vault:
    """The notes of a folder and the commands over them; each command gives what is printed as JSON."""

    def __init__(self, root: str):
        self.root, self.spark = root, session(master="local[*]")
        self.notes = source.read(self.spark, root)

    def note(self, name: str) -> DataFrame:
        found = graph.resolve_note(self.notes, extract.frontmatter(self.notes), self.spark.createDataFrame([(name,)], "query string")).first()
        if found is None or found.status == "not_found":
            raise NotFound(f"Note not found: {name}")
        if found.status == "ambiguous":
            raise NotFound(f"{len(found.matches)} notes match {name}: {', '.join(found.matches)}")
        return self.notes.where(F.col("path") == found.path)

    def edges(self) -> DataFrame:
        return graph.outgoing(self.notes)

    def change(self, name: str, change: Callable[[DataFrame], DataFrame]) -> list[dict]:
        changed = change(self.note(name)).collect()
        for r in changed:
            if "error" in r and r["error"]:
                raise ValueError(r["error"])
        return [{"written": source.write(self.spark.createDataFrame([(r["path"], r["content"]) for r in changed], "path string, content string"), self.root)}]

    def content(self, name: str, column) -> list[dict]:
        return self.change(name, lambda n: n.select("path", column.alias("content")))


def value_of(text: str) -> object:
    return yamlcore.load(text)


COMMANDS: dict[str, tuple[str, Callable]] = {
    "list": ("", lambda v: rows(parts.list_notes(v.notes).select("path"))),
    "glob": ("pattern", lambda v, p: rows(parts.list_matching(v.notes, p).select("path"))),
    "exists": ("path", lambda v, p: [{"exists": parts.note_exists(v.notes, p)}]),
    "resolve": ("note", lambda v, n: rows(graph.resolve_note(v.notes, extract.frontmatter(v.notes), v.spark.createDataFrame([(n,)], "query string")))),
    "content": ("note", lambda v, n: rows(v.note(n).select("path", "content"))),
    "body": ("note", lambda v, n: rows(v.note(n).select("path", parts.body().alias("body")))),
    "frontmatter": ("note", lambda v, n: rows(extract.frontmatter(v.note(n)).select("path", "status", "fm_json", "fm_error"))),
    "inspect": ("note", lambda v, n: [{"frontmatter": rows(extract.frontmatter(v.note(n)).select("status", "fm_json")), "properties": rows(extract.inline_properties(v.note(n))), "headings": rows(extract.headings(v.note(n))), "tasks": rows(extract.task_rows(v.note(n))), "links": rows(extract.links(v.note(n))), "tags": rows(extract.tags(v.note(n))), "blocks": rows(extract.blocks(v.note(n))), "stats": rows(parts.stats(v.note(n)))}]),
    "properties": ("note", lambda v, n: rows(properties.merged(v.note(n)))),
    "property": ("note key", lambda v, n, k: rows(properties.one(v.note(n), k))),
    "inline-properties": ("note", lambda v, n: rows(extract.inline_properties(v.note(n)))),
    "search": ("query", lambda v, q: rows(search.search(v.notes, q))),
    "all-frontmatter": ("", lambda v: rows(properties.all_frontmatter(extract.frontmatter(v.notes)))),
    "validate": ("", lambda v: rows(properties.invalid(extract.frontmatter(v.notes)))),
    "links": ("note", lambda v, n: rows(extract.links(v.note(n)))),
    "tags": ("note", lambda v, n: rows(extract.tags(v.note(n)))),
    "headings": ("note", lambda v, n: rows(extract.headings(v.note(n)))),
    "block-ids": ("note", lambda v, n: rows(extract.blocks(v.note(n)))),
    "tasks": ("note", lambda v, n: rows(extract.task_rows(v.note(n)))),
    "task-trees": ("note", lambda v, n: rows(extract.task_nodes(v.note(n)))),
    "incoming-links": ("note", lambda v, n: rows(graph.incoming(v.edges(), v.notes).join(v.note(n).select("path"), "path", "left_semi"))),
    "outgoing-links": ("note", lambda v, n: rows(v.edges().join(v.note(n).select(F.col("path").alias("from")), "from", "left_semi"))),
    "info": ("", lambda v: rows(health.info(v.notes, v.edges(), extract.tags(v.notes), extract.task_rows(v.notes)))),
    "lint": ("", lambda v: rows(health.lint(v.notes, extract.frontmatter(v.notes), v.edges(), extract.headings(v.notes), extract.blocks(v.notes)))),
    "create": ("path content", lambda v, p, c: _create(v, p, c)),
    "delete": ("note", lambda v, n: v.content(n, F.lit(None).cast("string"))),
    "rename": ("note new_path", lambda v, n, p: _rename(v, n, p)),
    "set-content": ("note body", lambda v, n, b: v.content(n, rewrite.with_body(F.lit(b)))),
    "set-raw-content": ("note content", lambda v, n, c: v.content(n, F.lit(c))),
    "append": ("note text", lambda v, n, t: v.content(n, rewrite.append(F.lit(t)))),
    "prepend": ("note text", lambda v, n, t: v.content(n, rewrite.prepend(F.lit(t)))),
    "replace": ("note old new", lambda v, n, a, b: v.content(n, rewrite.replace(a, b))),
    "modify-frontmatter": ("note key value", lambda v, n, k, x: v.change(n, lambda d: rewrite.modify_frontmatter(d, k, value_of(x)))),
    "append-frontmatter": ("note key value", lambda v, n, k, x: v.change(n, lambda d: rewrite.modify_frontmatter(d, k, value_of(x), append=True))),
    "remove-frontmatter": ("note", lambda v, n: v.content(n, rewrite.remove_frontmatter())),
    "set-property": ("note key value", lambda v, n, k, x: v.change(n, lambda d: rewrite.set_property(d, k, value_of(x)))),
    "remove-property": ("note key", lambda v, n, k: v.change(n, lambda d: rewrite.remove_property(d, k))),
    "rename-property": ("note old new", lambda v, n, a, b: v.change(n, lambda d: rewrite.rename_property(d, a, b))),
    "set-task-symbol": ("note line symbol", lambda v, n, i, s: v.change(n, lambda d: rewrite.set_task_symbol(d, int(i), s))),
    "init-metadata": ("note", lambda v, n: v.change(n, rewrite.init_metadata)),
    "metadata": ("note", lambda v, n: rows(properties.metadata(extract.frontmatter(v.note(n))))),
    "find-by-id": ("id", lambda v, i: rows(properties.find_by_id(extract.frontmatter(v.notes), i))),
}


def _create(v: Vault, path: str, content: str) -> list[dict]:
    made, refused = rewrite.create_notes(v.notes.select("path", "content"), v.spark.createDataFrame([(path, content)], "path string, content string"))
    wrong = refused.first()
    if wrong is not None:
        raise ValueError(f"{wrong.path}: {wrong.error}")
    full = path if path.endswith(".md") else path + ".md"
    return [{"written": source.write(made.where(F.col("path") == full.strip()), v.root)}]


def _rename(v: Vault, note: str, path: str) -> list[dict]:
    old = v.note(note).select("path", "content").first()
    full = path if path.endswith(".md") else path + ".md"
    return [{"written": source.write(v.spark.createDataFrame([(full, old.content), (old.path, None)], "path string, content string"), v.root)}]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    parser.add_argument("--vault", required=True, help="folder of notes")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (wanted, _) in COMMANDS.items():
        own = commands.add_parser(name)
        for part in wanted.split():
            own.add_argument(part, help="'-' reads it from standard input" if part in ("content", "body", "text") else None)
    given = parser.parse_args(argv)
    wanted, run = COMMANDS[given.command]
    values = [sys.stdin.read() if (x := getattr(given, p)) == "-" else x for p in wanted.split()]
    try:
        print(json.dumps(run(Vault(given.vault), *values), indent=2, ensure_ascii=False))
    except (NotFound, ValueError, QueryError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
