"""Search over notes: native columns where a query needs only paths and lines, else one pass over Arrow batches behind a native prefilter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown, yamlcore
from ..operators import extract, notes as parts
from .query import And, Matcher, Not, Or, Property, Query, Scope, Tag, Text, parse

MATCHES = "array<struct<field:string,line:int,text:string>>"
_FLOAT = re.compile(r"[+-]?(?:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", re.I | re.A)
_EPSILON = 2.220446049250313e-16


def valid_regex(pattern: str) -> str | None:
    """The pattern as Java and Python read it; None if it is invalid or has look-around or back-references, which a linear-time engine refuses."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=", pattern):
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def _ascii_lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def matches_text(text: str, matcher: Matcher, cased: bool) -> bool:
    if matcher.kind == "contains":
        return matcher.value in text if cased else matcher.value.lower() in text.lower()
    if matcher.kind == "exact":
        return text == matcher.value if cased else _ascii_lower(text) == _ascii_lower(matcher.value)
    if valid_regex(matcher.value) is None:
        raise ValueError(f"Invalid regex: {matcher.value}")
    return re.search(matcher.value, text, 0 if cased else re.I) is not None


def compare(actual: str, expected: str, op: str) -> bool:
    """Numbers if both are, else strings; equality ignores ASCII case, order is that of bytes."""
    if _FLOAT.fullmatch(actual) and _FLOAT.fullmatch(expected):
        a, b = float(actual), float(expected)
        return {"=": abs(a - b) < _EPSILON, "!=": abs(a - b) >= _EPSILON, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    same = _ascii_lower(actual) == _ascii_lower(expected)
    a8, b8 = actual.encode(), expected.encode()
    return {"=": same, "!=": not same, "<": a8 < b8, ">": a8 > b8, "<=": a8 <= b8, ">=": a8 >= b8}[op]


def evaluate(path: str, content: str, query: Query) -> list[tuple[str, int | None, str | None]]:
    """Matches (field, line, text) of one note; raises ValueError where the query can't be evaluated."""
    if isinstance(query, And):
        out = []
        for child in query.children:
            found = evaluate(path, content, child)
            if not found:
                return []
            out += found
        return out
    if isinstance(query, Or):
        return next((found for child in query.children if (found := evaluate(path, content, child))), [])
    if isinstance(query, Not):
        return [] if evaluate(path, content, query.child) else [("not", None, None)]
    if isinstance(query, Text) and query.field != "content":
        last = path.rsplit("/", 1)[-1]
        text = path if query.field == "path" else last.rsplit(".", 1)[0] or last
        return [(query.field, None, text)] if matches_text(text, query.matcher, True) else []
    if isinstance(query, Tag):
        wanted = query.value.lower().lstrip("#")
        for name, line, _, _ in _tags(content):
            if name.lstrip("#").lower() == wanted:
                return [("tag", line, name)]
        raw = markdown.split_frontmatter(content)[0]
        if raw is None or _literal(wanted) and raw.isascii() and "\\" not in raw and wanted not in raw.lower():
            return []
        listed = _fields(content).get("tags")
        own = [t for t in listed if isinstance(t, str) and t.lstrip("#").lower() == wanted] if isinstance(listed, list) else []
        return [("tag", 1, own[0])] if own else []
    if isinstance(query, Property):
        fields = _fields(content)
        values = [(yamlcore.as_text(fields[query.key]), 1)] if query.key in fields else []
        values += [(value, line) for key, value, line, _, _ in markdown.inline_properties(content) if key == query.key]
        for value, line in values:
            if query.op == "exists" or compare(value, query.value or "", query.op):
                return [(f"property:{query.key}", line, value)]
        return []
    _, body, begin = markdown.split_frontmatter(content)
    lines = markdown.lines_of(body)
    if isinstance(query, Text):
        return [("content", begin + i, line) for i, line in enumerate(lines) if matches_text(line, query.matcher, False)]
    if query.field == "line":
        for i, line in enumerate(lines):
            if found := evaluate(path, line, query.query):
                return [(f"line:{field}", begin + i, text) for field, _, text in found]
        return []
    cuts = [h[2] - begin for h in markdown.headings(content) if h[2] >= begin]
    edges = sorted({0, *cuts}) + [len(lines)] if cuts else [0, len(lines)]
    for low, high in zip(edges[:-1], edges[1:]):
        if found := evaluate(path, "\n".join(lines[low:high]), query.query):
            return [(f"section:{field}", None if line is None else line + begin + low - 1, text) for field, line, text in found]
    return []


def _literal(tag: str) -> bool:
    """Whether YAML without escapes has the tag only as it stands; others may be folded or have doubled quotes."""
    return tag.isascii() and not re.search(r"[\s'\"]", tag)


# Of the last note, for queries that ask for several tags or properties of one.
_tags = lru_cache(maxsize=1)(markdown.tags)


@lru_cache(maxsize=1)
def _fields(content: str) -> dict:
    raw = markdown.split_frontmatter(content)[0]
    try:
        value = yamlcore.load(raw) if raw is not None else None
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _native(query: Query) -> bool:
    if isinstance(query, (And, Or)):
        return all(map(_native, query.children))
    if isinstance(query, Not):
        return _native(query.child)
    return isinstance(query, Text)


def _matched(text: Column, matcher: Matcher, cased: bool) -> Column | None:
    """Whether a text matches; None where the regex is invalid, which must not reach the plan."""
    if matcher.kind == "contains":
        return F.contains(text, F.lit(matcher.value)) if cased else F.contains(F.lower(text), F.lit(matcher.value.lower()))
    if matcher.kind == "exact":
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        return text == matcher.value if cased else F.translate(text, upper, lower) == _ascii_lower(matcher.value)
    if valid_regex(matcher.value) is None:
        return None
    return text.rlike(("(?dU)" if cased else "(?diuU)") + matcher.value.replace("(?P<", "(?<"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once.

    Spark copies a column into every place that names it, and a filter that moves below a
    projection takes such copies of copies along; a lambda's argument is never copied.
    """
    return F.transform(F.array(value), use)[0]


def compiled(query: Query, path: Column, lines: Column) -> Column:
    """The matches of a native query: null for an evaluation error, empty for no match; lines: those of the body, as content matches."""
    none = F.array().cast(MATCHES)
    if isinstance(query, (And, Or)) and len(query.children) == 1:
        return compiled(query.children[0], path, lines)
    if isinstance(query, And):
        last = compiled(query.children[-1], path, lines)

        def both(a: Column) -> Column:
            joined = let(last, lambda b: F.when(b.isNull(), None).when(F.size(b) == 0, none).otherwise(F.concat(a, b)))
            return F.when(a.isNull(), None).when(F.size(a) == 0, none).otherwise(joined)

        return let(compiled(And(query.children[:-1]), path, lines), both)
    if isinstance(query, Or):
        rest = compiled(Or(query.children[1:]), path, lines)
        return let(compiled(query.children[0], path, lines), lambda a: F.when(a.isNull(), None).when(F.size(a) > 0, a).otherwise(rest))
    if isinstance(query, Not):
        found = F.array(F.struct(F.lit("not").alias("field"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text")))
        return let(compiled(query.child, path, lines), lambda a: F.when(a.isNull(), None).when(F.size(a) == 0, found).otherwise(none))
    if query.field != "content":
        text = path if query.field == "path" else parts.name_of(path)
        hit = _matched(text, query.matcher, True)
        if hit is None:
            return F.lit(None).cast(MATCHES)
        return F.when(hit, F.array(F.struct(F.lit(query.field).alias("field"), F.lit(None).cast("int").alias("line"), text.alias("text")))).otherwise(none)
    if _matched(path, query.matcher, False) is None:
        return F.when(F.size(lines) > 0, F.lit(None).cast(MATCHES)).otherwise(none)
    return F.filter(lines, lambda r: _matched(r["text"], query.matcher, False))


def body_lines(content: Column) -> Column:
    """The lines of the body as content matches: (field, line, text)."""

    def rows(head: Column, text: Column) -> Column:
        line = lambda x, i: F.struct(F.lit("content").alias("field"), (parts.begin_of(head) + i).cast("int").alias("line"), F.regexp_replace(x, r"\r\z", "").alias("text"))
        whole = lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
        return F.transform(let(F.split(parts.body_of(head, text), "\n"), whole), line)

    return let(content, lambda text: let(parts.head_of(text), lambda head: rows(head, text)))


def prefilter(query: Query) -> Column | None:
    """A condition that every note with a match satisfies, of paths and contents only, for the scan; None if there is none to tell."""
    if isinstance(query, And):
        found = [p for p in map(prefilter, query.children) if p is not None]
        out = None
        for p in found:
            out = p if out is None else out & p
        return out
    if isinstance(query, Or):
        found = [prefilter(c) for c in query.children]
        if any(p is None for p in found):
            return None
        out = found[0]
        for p in found[1:]:
            out = out | p
        return out
    if isinstance(query, Scope):
        return prefilter(query.query)
    if isinstance(query, Text):
        if query.field != "content":
            return _matched(F.col("path") if query.field == "path" else parts.name(), query.matcher, True)
        if query.matcher.kind == "contains":
            return F.contains(F.lower("content"), F.lit(query.matcher.value.lower()))
    if isinstance(query, Tag) and _literal(wanted := query.value.lower().lstrip("#")):
        return F.contains(F.lower("content"), F.lit(wanted)) | F.contains("content", F.lit("\\"))
    if isinstance(query, Property) and query.key.isascii():
        return F.contains(F.col("content"), F.lit(query.key))
    return None


def search(notes: DataFrame, query: Query | str, limit: int | None = None) -> DataFrame:
    """Notes that match, (path, matches), sorted by the parts of their paths; `limit` keeps the first ones.

    A note for which the query can't be evaluated, by an invalid regex that is reached,
    doesn't match.  Notes with a null content don't either.
    """
    query = parse(query) if isinstance(query, str) else query
    rows = notes.select("path", "content").where("content is not null")
    first = prefilter(query)
    if first is not None:
        rows = rows.where(first)
    if _native(query):
        matched = let(body_lines(F.col("content")), lambda lines: compiled(query, F.col("path"), lines))
        found = rows.select("path", F.coalesce(matched, F.array().cast(MATCHES)).alias("matches"))
    else:
        schema = T._parse_datatype_string(f"path string, matches {MATCHES}")
        kind = pa.list_(pa.struct([("field", pa.string()), ("line", pa.int32()), ("text", pa.string())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = lambda paths, out: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, kind)], ["path", "matches"])
            for batch in batches:
                paths, out, held = [], [], 0
                for path, content in extract.each(batch):
                    try:
                        found = evaluate(path, content, query)
                    except ValueError:
                        continue
                    if found:
                        paths.append(path)
                        out.append([{"field": f, "line": n, "text": t} for f, n, t in found])
                        held += len(found)
                    if held >= extract.ROWS_A_BATCH:
                        yield made(paths, out)
                        paths, out, held = [], [], 0
                yield made(paths, out)

        found = rows.mapInArrow(run, schema)
    # Sorting samples what it sorts first; behind a shuffle the notes are searched only once.
    found = found.where(F.size("matches") > 0).repartition("path").orderBy(F.split("path", "/"))
    return found.limit(limit) if limit is not None else found


def matches(results: DataFrame) -> DataFrame:
    """One row for each match: (path, ord, field, line, text)."""
    return results.select("path", F.posexplode("matches").alias("ord", "m")).select("path", "ord", "m.field", "m.line", "m.text")


def summary(results: DataFrame) -> DataFrame:
    """Results as lines of text: the path, the number of matches, and the fields that matched."""
    fields = F.array_join(F.array_distinct(F.transform("matches", lambda m: m["field"])), ", ")
    return results.select("path", F.concat("path", F.lit(" ("), F.size("matches").cast("string"), F.lit(" matches: "), fields, F.lit(")")).alias("summary"))


def find_names(notes: DataFrame, text: str, mode: str = "subsequence", content: bool = False, limit: int = 1) -> DataFrame:
    """Notes by name, (path, score): subsequence, fuzzy (least edit distance first), exact or regex; with `content`, exact and regex look at the content."""
    name = F.lower(parts.name())
    low = text.lower()
    score = F.lit(0)
    if mode == "subsequence":
        hit = name.rlike("(?s)" + ".*".join(re.escape(c) for c in low))
        score = F.length(name) - len(low)
    elif mode == "fuzzy":
        hit, score = F.lit(True), F.levenshtein(name, F.lit(low))
    else:
        where = F.lower("content") if content else name
        if mode == "regex" and valid_regex(text) is None:
            raise ValueError(f"Invalid regex: {text}")
        hit = (F.contains(where, F.lit(low)) if content else where == low) if mode == "exact" else F.col("content" if content else "path").rlike("(?diuU)" + text)
    return notes.where(hit).select("path", score.cast("int").alias("score")).orderBy("score", F.split("path", "/")).limit(limit)
