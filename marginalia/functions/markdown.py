"""Parsers of one note's text: code, links, tags, headings, block ids, properties.

They run inside Arrow batches (operators.extract), because Spark's regular expressions
give no offsets and cannot carry state over lines.  Lines count from 1; columns are byte
offsets within their line.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

FENCE = re.compile(r"^(`{3,}|~{3,})", re.M)
DOUBLE_TICK = re.compile(r"``(?:[^`]|`[^`])*``")
SINGLE_TICK = re.compile(r"`[^`\n]+`")
LINK = re.compile(r"(!?)\[\[([^\]|#]+)(?:#\^([a-zA-Z0-9_-]+))?(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]")
TAG = re.compile(r"(?:^|[^\w&])#([a-zA-Z_][\w/-]*)")
TAG_AT = re.compile(r"#([a-zA-Z_][\w/-]*)")
HEADING = re.compile(r"(#{1,6})\s+([^\n]+?)(?:\s+\^[a-zA-Z0-9_-]+)?\s*\Z")
BLOCK = re.compile(r"\s+\^([a-zA-Z0-9_-]+)\s*\Z")
INLINE = re.compile(r"\[\s*([\w-]+)\s*::\s*([^\]]*(?:\]\][^\]]*)*)\s*\]")
MEDIA_EMBED = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".mp3", ".wav", ".ogg", ".mp4", ".webm", ".pdf")


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a line feed at the very end begins no further line."""
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


class Places:
    """Turns character offsets into line numbers and byte columns."""

    def __init__(self, text: str):
        self.text = text
        self.plain = text.isascii()
        self.begins = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.begins, at)

    def column(self, line: int, at: int) -> int:
        begin = self.begins[line - 1]
        return at - begin if self.plain else len(self.text[begin:at].encode())

    def span(self, start: int, end: int) -> tuple[int, int, int]:
        line = self.line(start)
        return line, self.column(line, start), self.column(line, end)


@dataclass(frozen=True)
class Code:
    start: int
    end: int
    first: int
    last: int
    fenced: bool


def code_ranges(text: str, places: Places | None = None) -> list[Code]:
    """Fenced blocks and inline code, by start.

    A fence closes at a later line that begins with as many of its characters and has
    nothing else; the line right under the opening one is never taken for the closing one,
    and a fence that never closes is no code.
    """
    if "`" not in text and "~~~" not in text:
        return []
    places = places or Places(text)
    found: list[Code] = []
    at = 0
    while at < len(text):
        opening = FENCE.search(text, at)
        if opening is None:
            break
        start, mark = opening.start(), opening[1]
        stop = text.find("\n", start)
        below = len(text) if stop < 0 else stop + 1
        seek, closed = below, False
        while (stop := text.find("\n", seek)) >= 0:
            seek = stop + 1
            if text.startswith(mark, seek):
                end = text.find("\n", seek)
                end = len(text) if end < 0 else end
                rest = text[seek:end].strip()
                if len(rest) >= len(mark) and not rest.strip(mark[0]):
                    found.append(Code(start, end, places.line(start), places.line(end), True))
                    at, closed = end, True
                    break
        if not closed:
            at = below
    fences = list(found)
    for m in DOUBLE_TICK.finditer(text):
        if not any(f.start <= m.start() and m.end() <= f.end for f in fences):
            found.append(Code(m.start(), m.end(), places.line(m.start()), places.line(m.end()), False))
    for m in SINGLE_TICK.finditer(text):
        if not any(f.start <= m.start() < f.end or f.start < m.end() <= f.end for f in found):
            found.append(Code(m.start(), m.end(), places.line(m.start()), places.line(m.end()), False))
    return sorted(found, key=lambda c: c.start)


def in_code(at: int, ranges: list[Code]) -> bool:
    return any(c.start <= at < c.end for c in ranges)


def in_fence(line: int, ranges: list[Code]) -> bool:
    return any(c.fenced and c.first <= line <= c.last for c in ranges)


def found_links(text: str) -> Iterator[re.Match]:
    """LINK.finditer(text), by its brackets: the optional ! before them makes the regex try every character."""
    at = text.find("[[")
    while at >= 0:
        m = LINK.match(text, at - 1 if at and text[at - 1] == "!" else at)
        if m:
            yield m
        at = text.find("[[", m.end() if m else at + 1)


def found_tags(text: str) -> Iterator[re.Match]:
    """TAG at each # that TAG.finditer(text) would find, as (?:)#(tag)."""
    at, end = text.find("#"), 0
    while at >= 0:
        before = text[at - 1] if at else " "
        m = TAG_AT.match(text, at) if not at or at > end and not (before.isalnum() or before in "_&") else None
        if m:
            yield m
            end = m.end()
        at = text.find("#", end if m else at + 1)


def links(text: str) -> list[tuple]:
    """(target, alias, heading, block_id, embed, line, start_col, end_col) of wikilinks and embeds outside code."""
    if "[[" not in text:
        return []
    places = Places(text)
    code = code_ranges(text, places)
    return [(m[2].strip(), m[5], m[4], m[3], bool(m[1]), *places.span(m.start(), m.end())) for m in found_links(text) if not in_code(m.start(), code)]


def tags(text: str) -> list[tuple]:
    """(name with its #, line, start_col, end_col) of tags outside code and links."""
    if "#" not in text:
        return []
    places = Places(text)
    code = code_ranges(text, places)
    out = []
    opened = closed = seen = 0
    final = text.rfind("]]")
    for m in found_tags(text):
        start, end = m.start(1) - 1, m.end(1)
        after = text[end : end + 1]
        if (after and (after.isalnum() or after in "_/")) or in_code(start, code):
            continue
        # The last brackets before this tag, found from the last tag on: 0 for none, else one more than where they stand.
        opened, closed = (max(was, text.rfind(mark, max(0, seen - 1), start) + 1) for mark, was in (("[[", opened), ("]]", closed)))
        seen = start
        if opened > closed and final >= start:
            continue
        out.append((f"#{m[1]}", *places.span(start, end)))
    return out


def slug(text: str) -> str:
    """A heading's anchor: letters and digits (ASCII ones in lower case), single hyphens for space, inner - and _."""
    out: list[str] = []
    hyphen = False
    for c in text if text.isascii() else unicodedata.normalize("NFC", text):
        if c.isalnum():
            out.append(c.lower() if c.isascii() else c)
            hyphen = False
        elif (c in "-_" or c.isspace()) and out and not hyphen:
            out.append(c if c == "_" else "-")
            hyphen = c != "_"
    return "".join(out).rstrip("-")


def headings(text: str) -> list[tuple]:
    """(text, level, line, slug) of headings outside fences; a slug's n-th use has -(n-1) added."""
    code = code_ranges(text)
    seen: dict[str, int] = {}
    out = []
    for n, line in enumerate(lines_of(text), 1):
        if line.startswith("#") and not in_fence(n, code) and (m := HEADING.match(line)):
            title = m[2].strip()
            base = slug(title)
            seen[base] = count = seen.get(base, 0) + 1
            out.append((title, len(m[1]), n, base if count == 1 else f"{base}-{count - 1}"))
    return out


def block_type(line: str) -> str:
    body = line.lstrip()
    digits = len(body) - len(body.lstrip("0123456789"))
    if body.startswith("#"):
        return "heading"
    if body.startswith(("- ", "* ", "+ ")) or (digits and body[digits:].startswith(". ")):
        return "list-item"
    if body.startswith(">"):
        return "blockquote"
    if body.startswith("|") and body.endswith("|"):
        return "table"
    return "code-block" if body.startswith(("```", "~~~")) else "paragraph"


def block_ids(text: str) -> list[tuple]:
    """(id, line, block_type) of ^ids at the ends of lines outside fences."""
    if "^" not in text:
        return []
    code = code_ranges(text)
    return [(m[1], n, block_type(line)) for n, line in enumerate(lines_of(text), 1) if "^" in line and not in_fence(n, code) and (m := BLOCK.search(line))]


def inline_properties(text: str) -> list[tuple]:
    """(key, value, line, start_col, end_col) of [key::value] outside code."""
    if "::" not in text:
        return []
    places = Places(text)
    code = code_ranges(text, places)
    return [(m[1], m[2].strip(), *places.span(m.start(), m.end())) for m in INLINE.finditer(text) if not in_code(m.start(), code)]


def link_context(lines: list[str], line: int, column: int) -> str:
    """Where a link stands: task, inline:key, or body."""
    if not 0 < line <= len(lines):
        return "body"
    text = lines[line - 1]
    if text.lstrip().startswith(("- [ ]", "- [x]", "- [X]", "- [>]", "- [-]", "- [/]")):
        return "task"
    before = text.encode()[:column].decode(errors="ignore")
    opened = before.rfind("[")
    if opened >= 0:
        between = before[opened:]
        if "::" in between and "]" not in between:
            return "inline:" + between[1 : between.index("::")]
    return "body"


def split_frontmatter(text: str) -> tuple[str | None, str, int]:
    """YAML text or None, the body, and the line on which the body begins."""
    begin = 4 if text.startswith("---\n") else 5 if text.startswith("---\r\n") else 0
    if not begin:
        return None, text, 1
    end = text.find("\n---\n", begin)
    if end < 0:
        end = text.find("\n---\r\n", begin)
    if end < 0 and text.endswith("\n---") and len(text) - 4 >= begin:
        end = len(text) - 4
    if end < 0:
        return None, text, 1
    rest = text[end + 4 :]
    body = rest[1:] if rest.startswith("\n") else rest[2:] if rest.startswith("\r\n") else rest
    return text[begin:end], body, text.count("\n", 0, end + 4) + 2
