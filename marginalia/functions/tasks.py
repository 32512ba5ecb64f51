"""Tasks of one note: checkbox lines with emoji metadata, their parents and trees, and how they are written."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from . import markdown

TASK = re.compile(r"(\s*)([-*+]|\d+\.) \[([^\n])\] (.*)\Z")
ITEM = re.compile(r"(\s*)([-*+]|\d+\.) (.*)\Z")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
PLAIN_TAG = re.compile(r"#[a-zA-Z_][a-zA-Z0-9_/-]*")


@dataclass(frozen=True)
class Field:
    """An emoji and what follows it; kind: date, string, text, number, or flag and enum, which have a constant value."""

    emoji: str
    name: str
    kind: str
    order: int = 0
    value: str = ""


@dataclass(frozen=True)
class TaskConfig:
    fields: tuple[Field, ...] = field(default=())

    def ordered(self) -> list[Field]:
        return sorted(self.fields, key=lambda f: f.order)

    def emojis(self) -> list[str]:
        return [f.emoji for f in self.fields]


COMMON = TaskConfig(
    (
        Field("📅", "due", "date", 1),
        Field("⏳", "scheduled", "date", 2),
        Field("🛫", "start", "date", 3),
        Field("✅", "done", "date", 4),
        Field("🆔", "id", "string", 5),
        Field("⏱", "estimate", "number", 6),
        Field("🔺", "priority", "enum", 7, "highest"),
        Field("🔼", "priority", "enum", 8, "medium"),
        Field("📌", "pinned", "flag", 9, "true"),
        Field("💬", "note", "text", 10),
    )
)


def indent_of(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return lead.count("\t") + lead.count(" ") // 4


def without_block_id(text: str) -> tuple[str, str | None]:
    m = markdown.BLOCK.search(text)
    return (text[: m.start()].rstrip(), m[1]) if m else (text, None)


def metadata(text: str, config: TaskConfig) -> tuple[str, dict[str, str]]:
    """The description that is left, white space collapsed, and the fields; each takes its text away before the next is sought."""
    out: dict[str, str] = {}
    emojis = config.emojis()
    for f in config.ordered():
        at = text.find(f.emoji)
        if at < 0:
            continue
        begin = at + len(f.emoji)
        after = text[begin:]
        trimmed = after.lstrip()
        skipped = begin + len(after) - len(trimmed)
        if f.kind in ("flag", "enum"):
            out[f.name], text = f.value, text[:at] + after
        elif f.kind in ("date", "number"):
            # The first one anywhere behind the emoji; what stands between goes with it.
            m = (DATE if f.kind == "date" else NUMBER).search(trimmed)
            if m:
                out[f.name], text = m[0], text[:at] + text[skipped + m.end() :]
        else:
            if f.kind == "string":
                end = next((i for i, c in enumerate(trimmed) if c.isspace()), len(trimmed))
            else:
                end = min((p for p in (trimmed.find(e) for e in emojis) if p >= 0), default=len(trimmed))
            value = trimmed[:end].strip()
            if value:
                out[f.name], text = value, text[:at] + text[skipped + end :]
    return " ".join(text.split()), out


def task_of(line: str, config: TaskConfig) -> tuple | None:
    """(marker, symbol, description, indent, metadata, links, tags, block_id) of a checkbox line."""
    m = TASK.match(line)
    if not m:
        return None
    rest, block = without_block_id(m[4])
    description, fields = metadata(rest, config)
    found = [(x[0], x[1]) for x in markdown.links(description) if not x[4]]
    return m[2], f"[{m[3]}]", description, indent_of(m[1]), fields, found, PLAIN_TAG.findall(description), block


def tasks(text: str, config: TaskConfig) -> list[tuple]:
    """(line, raw, marker, symbol, description, indent, parent_line, metadata, links, tags, block_id); a parent is the nearest task above with less indent that no line between has closed."""
    if "[" not in text:
        return []
    code = markdown.code_ranges(text)
    open_: list[tuple[int, int]] = []
    out = []
    for n, line in enumerate(markdown.lines_of(text), 1):
        # Without an open task, only lines with a box change anything.
        if not open_ and "[" not in line or markdown.in_fence(n, code):
            continue
        found = task_of(line, config)
        depth = found[3] if found else indent_of(line)
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        if found:
            marker, symbol, description, indent, *rest = found
            out.append((n, line, marker, symbol, description, indent, open_[-1][1] if open_ else None, *rest))
            open_.append((depth, n))
    return out


def tree(text: str, config: TaskConfig) -> list[tuple]:
    """Nodes (node, parent, depth, ordinal, kind, line, marker, symbol, text, metadata, block_id) of tasks and of the list items under them, in order; node numbers count from 0, ordinals among siblings."""
    code = markdown.code_ranges(text)
    open_: list[tuple[int, int, int]] = []
    children: dict[int | None, int] = {}
    out: list[tuple] = []
    for n, line in enumerate(markdown.lines_of(text), 1):
        if markdown.in_fence(n, code):
            continue
        found = task_of(line, config)
        item = None if found else ITEM.match(line)
        depth = found[3] if found else indent_of(item[1]) if item else indent_of(line)
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        if not found and (not item or not open_):
            continue
        parent, level = (open_[-1][1], open_[-1][2] + 1) if open_ else (None, 0)
        if found:
            row = ("task", n, found[0], found[1], found[2], found[4], found[7])
        else:
            content, block = without_block_id(item[3])
            row = ("text", n, item[2], None, content, {}, block)
        children[parent] = ordinal = children.get(parent, -1) + 1
        out.append((len(out), parent, level, ordinal, *row))
        open_.append((depth, len(out) - 1, level))
    return out


def hierarchy(rows: list[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    """Pairs (line, parent line) as the flat hierarchy has them: a task whose parent is itself a child becomes a root."""
    roots: set[int] = set()
    out = []
    for line, parent in rows:
        if parent in roots:
            out.append((line, parent))
        else:
            roots.add(line)
            out.append((line, None))
    return out


def format_task(description: str, symbol: str = "[ ]", marker: str = "-", fields: dict[str, str] | None = None, config: TaskConfig = COMMON) -> str:
    parts = [f"{marker} {symbol} {description}"]
    for f in config.ordered():
        if fields and f.name in fields:
            parts.append(f.emoji if f.kind in ("flag", "enum") else f"{f.emoji} {fields[f.name]}")
    return " ".join(parts)


def format_tree(nodes: list[tuple], indent: str = "    ", config: TaskConfig = COMMON) -> str:
    lines = []
    for _, _, depth, _, kind, _, marker, symbol, text, fields, _ in nodes:
        lines.append(indent * depth + (format_task(text, symbol, marker, fields, config) if kind == "task" else f"{marker} {text}"))
    return "\n".join(lines)


def relative_date(text: str, today: date) -> str | None:
    """today, tomorrow, yesterday, a signed number of d, w or m (30 days), or an ISO date, as an ISO date."""
    low = text.lower()
    named = {"today": 0, "tomorrow": 1, "yesterday": -1}
    if low in named:
        return (today + timedelta(days=named[low])).isoformat()
    m = re.fullmatch(r"([+-])([+-]?\d+)([dwm])", low, re.A)
    if m:
        days = int(m[2]) * {"d": 1, "w": 7, "m": 30}[m[3]]
        return (today + timedelta(days=-days if m[1] == "-" else days)).isoformat()
    try:
        date.fromisoformat(text)
    except ValueError:
        return None
    return text if DATE.fullmatch(text) else None
