"""The search language: words, quotes, /regexes/, fields, AND by juxtaposition, OR, a leading -, parentheses."""

from __future__ import annotations

import json
from dataclasses import dataclass

FIELDS = ("path", "filename", "tag", "content", "section", "line", "property")
OPERATORS = ("!=", "<=", ">=", "<", ">", "=")
_OP_NAMES = {"=": "eq", "!=": "not_eq", "<": "lt", ">": "gt", "<=": "lte", ">=": "gte", "exists": "exists"}


class QueryError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Matcher:
    """kind: contains, exact or regex."""

    kind: str
    value: str


@dataclass(frozen=True)
class Text:
    """field: path, filename or content."""

    field: str
    matcher: Matcher


@dataclass(frozen=True)
class Tag:
    value: str


@dataclass(frozen=True)
class Scope:
    """field: section or line."""

    field: str
    query: Query


@dataclass(frozen=True)
class Property:
    """op: exists or one of OPERATORS."""

    key: str
    op: str = "exists"
    value: str | None = None


@dataclass(frozen=True)
class And:
    children: tuple[Query, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Query, ...]


@dataclass(frozen=True)
class Not:
    child: Query


Query = Text | Tag | Scope | Property | And | Or | Not


def tokens(text: str) -> list[tuple[str, str]]:
    """Pairs of a kind (word, quoted, regex, field, op, or, not, open, close) and its text; other characters are passed over."""
    out, i = [], 0
    part = lambda c: c.isalnum() or c in "_-./"
    while i < len(text):
        c = text[i]
        if c in "()":
            out.append(("open" if c == "(" else "close", c))
            i += 1
        elif c == "-" and i + 1 < len(text) and not text[i + 1].isspace():
            out.append(("not", c))
            i += 1
        elif c in '"/':
            got, i = "", i + 1
            while i < len(text) and text[i] != c:
                if text[i] == "\\" and i + 1 < len(text):
                    got += text[i] if c == "/" else ""
                    i += 1
                got += text[i]
                i += 1
            out.append(("quoted" if c == '"' else "regex", got))
            i += 1
        elif (op := next((o for o in OPERATORS if text.startswith(o, i)), None)) is not None:
            out.append(("op", op))
            i += len(op)
        elif part(c):
            begin = i
            while i < len(text) and part(text[i]):
                i += 1
            word = text[begin:i]
            if word == "OR":
                out.append(("or", word))
            elif text[i : i + 1] == ":" and word.lower() in FIELDS:
                out.append(("field", word.lower()))
                i += 1
            else:
                out.append(("word", word))
        else:
            i += 1
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def kind(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self, *kinds: str, what: str) -> tuple[str, str]:
        if self.kind() not in kinds:
            found = repr(self.tokens[self.at][1]) if self.at < len(self.tokens) else "the end"
            raise QueryError(f"Expected {what}, found {found}")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Query:
        found = [self.both()]
        while self.kind() == "or":
            self.at += 1
            found.append(self.both())
        return found[0] if len(found) == 1 else Or(tuple(found))

    def both(self) -> Query:
        found = [self.unary()]
        while self.kind() not in (None, "or", "close"):
            found.append(self.unary())
        return found[0] if len(found) == 1 else And(tuple(found))

    def unary(self) -> Query:
        if self.kind() == "not":
            self.at += 1
            return Not(self.atom())
        return self.atom()

    def matcher(self) -> Matcher:
        kind, value = self.take("word", "quoted", "regex", what="a word, a quoted string or a regex")
        return Matcher({"word": "contains", "quoted": "exact", "regex": "regex"}[kind], value)

    def group(self) -> Query:
        self.at += 1
        inner = self.either()
        self.take("close", what="')'")
        return inner

    def atom(self) -> Query:
        if self.kind() == "open":
            return self.group()
        if self.kind() != "field":
            return Text("content", self.matcher())
        field = self.take("field", what="a field")[1]
        if field in ("path", "filename", "content"):
            return Text(field, self.matcher())
        if field in ("section", "line"):
            return Scope(field, self.group() if self.kind() == "open" else Text("content", self.matcher()))
        if field == "tag":
            if self.kind() != "open":
                return Tag(self.take("word", "quoted", what="a tag")[1])
            self.at += 1
            found = [Tag(self.take("word", "quoted", what="a tag")[1])]
            while self.kind() == "or":
                self.at += 1
                found.append(Tag(self.take("word", "quoted", what="a tag")[1]))
            self.take("close", what="')'")
            return found[0] if len(found) == 1 else Or(tuple(found))
        key = self.take("word", "quoted", what="a property")[1]
        if self.kind() != "op":
            return Property(key)
        return Property(key, self.take("op", what="an operator")[1], self.take("word", "quoted", what="a value")[1])


def parse(text: str) -> Query:
    reader = _Reader(text.strip())
    if not reader.tokens:
        raise QueryError("Empty search query")
    out = reader.either()
    if reader.kind() is not None:
        raise QueryError(f"Unexpected {reader.tokens[reader.at][1]!r}")
    return out


def to_json(query: Query) -> dict:
    """The structured form: {"type": "and" | "or" | "not" | "field", ...}, a field's parts beside its type."""
    if isinstance(query, (And, Or)):
        return {"type": type(query).__name__.lower(), "children": [to_json(c) for c in query.children]}
    if isinstance(query, Not):
        return {"type": "not", "child": to_json(query.child)}
    if isinstance(query, Text):
        return {"type": "field", "field": query.field, "matcher": {"type": query.matcher.kind, "pattern" if query.matcher.kind == "regex" else "value": query.matcher.value}}
    if isinstance(query, Tag):
        return {"type": "field", "field": "tag", "value": query.value}
    if isinstance(query, Scope):
        return {"type": "field", "field": query.field, "query": to_json(query.query)}
    return {"type": "field", "field": "property", "key": query.key, "op": _OP_NAMES[query.op], "value": query.value}


def from_json(value: dict | str) -> Query:
    """Reads to_json's form, and the one in which a field's parts are nested under "field"."""
    value = json.loads(value) if isinstance(value, str) else value
    try:
        kind = value["type"]
        if kind in ("and", "or"):
            return (And if kind == "and" else Or)(tuple(from_json(c) for c in value["children"]))
        if kind == "not":
            return Not(from_json(value["child"]))
        part = value["field"] if isinstance(value["field"], dict) else value
        field = part["field"]
        if field in ("path", "filename", "content"):
            m = part["matcher"]
            return Text(field, Matcher(m["type"], m["pattern"] if m["type"] == "regex" else m["value"]))
        if field == "tag":
            return Tag(part["value"])
        if field in ("section", "line"):
            return Scope(field, from_json(part["query"]))
        back = {v: k for k, v in _OP_NAMES.items()}
        return Property(part["key"], back[part.get("op", "exists")], part.get("value"))
    except (KeyError, TypeError) as error:
        raise QueryError(f"Malformed query: {error!r}") from None
