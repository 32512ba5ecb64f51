"""The test tables' documents as a collection of notes, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_S = "CAST({} AS STRING)"


def _text(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _n(expression: str) -> str:
    return _S.format(expression)


PATH = _text("source", "'/'", "lang", "'/Doc '", _n("doc_id"), "'.md'")

_YAML = _text(
    "'---', chr(10), 'title: \"Doc '", _n("doc_id"), "'\"', chr(10), 'rating: '", _n("doc_id % 5"), "chr(10), 'status: '",
    "CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'done' ELSE 'paused' END", "chr(10), 'tags:', chr(10), '  - '", "lang", "chr(10), '  - s/'", "source",
    "chr(10), 'aliases:', chr(10), '  - alias-'", "CASE WHEN doc_id % 50 = 3 THEN 'dup' ELSE " + _n("doc_id") + " END",
    "chr(10), 'related: \"[[Doc '", _n("(doc_id * 3) % m"), "']]\"', chr(10)",
    "CASE WHEN doc_id % 4 = 0 THEN " + _text("'marginalia:', chr(10), '  id: id-'", _n("doc_id"), "chr(10), '  created: \"2024-01-01T00:00:00Z\"', chr(10)") + " ELSE '' END",
    "CASE WHEN doc_id % 97 = 5 THEN 'status: again' || chr(10) ELSE '' END",
    "'---', chr(10)",
)

_LINKS = _text(
    "'## Links ^links-'", _n("doc_id"), "chr(10), 'See [[Doc '", _n("(doc_id * 7 + 1) % m"), "'|first]] and ![[img'", _n("doc_id % 9"), "'.png|400x300]] then [[Doc '", _n("(doc_id * 5 + 2) % m"), "'#Tasks]] end.', chr(10)",
    "CASE WHEN doc_id % 11 = 0 THEN " + _text("'Broken [[Missing '", _n("doc_id"), "']] here.', chr(10)") + " ELSE '' END",
    "CASE WHEN doc_id % 6 = 1 THEN " + _text("'Block [[Doc '", _n("(doc_id + 6) % m"), "'#^task-'", _n("(doc_id + 6) % m"), "']].', chr(10)") + " ELSE '' END",
    "'[owner::'", "source", "'] [score:: '", _n("doc_id % 17"), "'] #lang/'", "lang", "' #'", "source", "chr(10), '`[[code '", _n("doc_id"), "']] #nocode`', chr(10), '```', chr(10), '[[fenced]] #fenced', chr(10), '# no heading', chr(10), '```', chr(10)",
)

_TASKS = _text(
    "'## Tasks', chr(10), '- [ ] Review '", _n("doc_id"), "' #todo 📅 2024-0'", _n("1 + doc_id % 9"), "'-1'", _n("doc_id % 10"), "CASE WHEN doc_id % 2 = 0 THEN ' 🔺' ELSE '' END", "' ^task-'", _n("doc_id"),
    "chr(10), '    - [x] Sub '", _n("doc_id"), "' [[Doc '", _n("(doc_id + 1) % m"), "']]', chr(10), '        - note under sub', chr(10), '* [>] Other '", _n("doc_id"), "' 🆔 id'", _n("doc_id"), "chr(10)",
)

CONTENT = _text("CASE WHEN doc_id % 13 = 0 THEN '' ELSE " + _YAML + " END", "'# Doc '", _n("doc_id"), "chr(10)", "text", "chr(10)", _LINKS, _TASKS)


def _front(title: str, rating: int, status: str, alias: str, related: str) -> str:
    return f'---\ntitle: "{title}"\nrating: {rating}\nstatus: {status}\ntags:\n  - lone\naliases:\n  - {alias}\nrelated: "[[{related}]]"\n---\n'


#: Notes with what the documents' own lack: links by path and by alias, links to nothing, one block id twice, no body, no note that links there.
PLANTED = {
    "x/Lonely.md": _front("L", 4, "open", "Doc 2", "x/Hub") + "# Lonely\n![[Gone note]]\nto [[x/Hub#Nowhere]] and [[Hub#^nope]]\n[[x/Hub]] [[x/Hub.md|by path]] [[HUB-ALIAS]] [[Hub.md]]\n[[x/Away]]\n",
    "x/Hub.md": _front("H", 1, "done", "Hub-alias", "Doc 1") + "# Hub\none part ^same\ntwo parts ^same\n## Part\n## Part\n",
    "x/Empty.md": _front("E", 2, "open", "empty-alias", "Hub"),
}
_QUOTED = ", ".join(f"({-i}, '{path}', '{content.replace(chr(10), '~')}')" for i, (path, content) in enumerate(PLANTED.items(), 1))
#: Begins every oracle: notes(doc_id, path, content).
SQL = f"""WITH m AS (SELECT max(doc_id) + 1 AS m FROM documents
), notes AS (SELECT doc_id, {PATH} AS path, {CONTENT} AS content FROM documents CROSS JOIN m
  UNION ALL SELECT id, path, replace(body, '~', chr(10)) FROM (VALUES {_QUOTED}) AS planted(id, path, body))
"""


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes(path, content) of all documents, and those of PLANTED; links among them need the greatest doc_id, which is read first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = (docs.selectExpr("max(doc_id) + 1 AS m").first()[0]) or 1
    made = docs.selectExpr("doc_id", "lang", "source", "text", f"CAST({m} AS BIGINT) AS m").selectExpr(f"{PATH} AS path", f"{CONTENT} AS content")
    # As SQL, of which no Python worker is asked.
    return made.unionByName(spark.sql(f"SELECT path, replace(body, '~', chr(10)) AS content FROM VALUES {_QUOTED} AS planted(id, path, body)"))
