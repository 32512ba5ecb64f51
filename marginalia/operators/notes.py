"""Native columns and filters over notes(path, content): the parts of a note, listing, globs, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def name(path: str = "path") -> Column:
    return name_of(F.col(path))


def folder(path: str = "path") -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(path), r"[^/]*\z", ""), r"/\z", "")


def head(content: str = "content") -> Column:
    return head_of(F.col(content))


def head_of(content: Column) -> Column:
    """The frontmatter with both its rules and the line end behind it; empty if there is none.

    It closes at the first line `---` that ends in a line feed alone, else at the first that
    ends in both, else at one that ends the note; never at the line under the opening one.
    """
    found = [F.regexp_extract(content, r"(?s)\A---\r?\n.*?\n---" + end, 0) for end in (r"\n", r"\r\n", r"\z")]
    return F.when(~content.startswith("---"), "").when(found[0] != "", found[0]).when(found[1] != "", found[1]).otherwise(found[2])


def raw_of(head: Column) -> Column:
    return F.when(head != "", F.regexp_extract(head, r"(?s)\A---\r?\n(.*)\n---(?:\r?\n)?\z", 1))


def body_of(head: Column, content: Column) -> Column:
    return F.substring(content, F.length(head) + 1, F.length(content))


def begin_of(head: Column) -> Column:
    feeds = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.when(head == "", 1).otherwise(feeds + F.when(head.endswith("\n"), 1).otherwise(2))


def frontmatter_raw(content: str = "content") -> Column:
    return raw_of(head(content))


def has_frontmatter(content: str = "content") -> Column:
    return head(content) != ""


def body(content: str = "content") -> Column:
    return body_of(head(content), F.col(content))


def body_start_line(content: str = "content") -> Column:
    return begin_of(head(content))


def parted(notes: DataFrame) -> DataFrame:
    """`notes` with __head, __body and __begin, each computed once."""
    out = notes.withColumn("__head", head())
    return out.withColumn("__body", body_of(F.col("__head"), F.col("content"))).withColumn("__begin", begin_of(F.col("__head")))


def normalized(path: Column) -> Column:
    """A note's path with its extension: trimmed, .md added if missing."""
    path = F.trim(path)
    return F.when(path.endswith(".md"), path).otherwise(F.concat(path, F.lit(".md")))


def list_notes(notes: DataFrame, hidden: bool = False) -> DataFrame:
    """Markdown notes, without those under a name that begins with a dot, sorted by the parts of their paths."""
    out = notes.where(F.col("path").endswith(".md"))
    if not hidden:
        out = out.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")))
    return out.orderBy(F.split("path", "/"))


def glob_regex(pattern: str, flavour: str = "glob") -> str:
    """An anchored regular expression: ** crosses folders, * and ? don't, [..] and [!..] are classes; 'picomatch' also has {a,b} and hides dot names from wildcards."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out += "(?:[^/]+/)*" if flavour == "glob" else "(?:(?!\\.)[^/]+/)*"
            i += 3
            continue
        if pattern.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            start = i == 0 or pattern[i - 1] == "/"
            out += ("(?!\\.)" if flavour == "picomatch" and start else "") + "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside.startswith(("!", "^")) else inside) + "]"
            i = end
        elif c == "{" and flavour == "picomatch" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out += "(?:" + "|".join(glob_regex(p, flavour)[2:-2] for p in pattern[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += "\\" + c if c in "\\.^$|()+{}[]" else c
        i += 1
    return f"\\A{out}\\z"


def list_matching(notes: DataFrame, pattern: str, flavour: str = "glob") -> DataFrame:
    """Notes whose whole path matches the glob; hidden ones too, but for the picomatch flavour."""
    return notes.where(F.col("path").endswith(".md") & F.col("path").rlike(glob_regex(pattern, flavour))).orderBy(F.split("path", "/"))


def load_note(notes: DataFrame, path: str | Column) -> DataFrame:
    """The note of that path, if there is one, or of the path that a column gives; the filter reaches the scan."""
    return notes.where(F.col("path") == normalized(F.lit(path) if isinstance(path, str) else path))


def note_exists(notes: DataFrame, path: str) -> bool:
    return not load_note(notes, path).limit(1).isEmpty()


def accessors(notes: DataFrame) -> DataFrame:
    raw = raw_of(F.col("__head"))
    return parted(notes).select("path", name().alias("name"), folder().alias("folder"), (F.col("__head") != "").alias("has_frontmatter"), raw.alias("frontmatter_raw"), F.col("__body").alias("body"), F.col("__begin").alias("body_start_line"))


def stats(notes: DataFrame) -> DataFrame:
    """Lines, words and bytes of each note."""
    content = F.col("content")
    feeds = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    lines = feeds + F.when((content == "") | content.endswith("\n"), 0).otherwise(1)
    words = F.size(F.filter(F.split(content, r"(?U)\s+"), lambda w: w != ""))
    return notes.select("path", lines.cast("long").alias("lines"), words.cast("long").alias("words"), F.octet_length(content).cast("long").alias("size_bytes"))
