import datetime

import pytest

from marginalia.functions import markdown as M
from marginalia.functions import tasks as T
from marginalia.functions import yamlcore as Y

CONFIG = T.TaskConfig((T.Field("📅", "due", "date", 1), T.Field("🆔", "id", "string", 2), T.Field("⏱", "estimate", "number", 3), T.Field("🔺", "priority", "enum", 4, "high"), T.Field("🔼", "priority", "enum", 5, "medium"), T.Field("💬", "note", "text", 6), T.Field("📌", "pinned", "flag", 7, "true")))


def test_links_have_byte_columns_and_every_part():
    text = "é [[A|b]] ![[pic.png|400x300]]\n[[N#Head]] [[N#^blk]] [[N#H#^b]] `[[code]]`"
    assert M.links(text) == [
        ("A", "b", None, None, False, 1, 3, 10), ("pic.png", "400x300", None, None, True, 1, 11, 31),
        ("N", None, "Head", None, False, 2, 0, 10), ("N", None, None, "blk", False, 2, 11, 21), ("N", None, "H#^b", None, False, 2, 22, 32),
    ]


def test_fences():
    text = "a\n```\nx\n```\nb ``c ` d`` `e`"
    assert [(c.first, c.last, c.fenced) for c in M.code_ranges(text)] == [(2, 4, True), (5, 5, False)]
    # The line under an opening fence never closes it, one that never closes is no code, nor is an indented one.
    assert [(c.first, c.last) for c in M.code_ranges("```\n```\nx\n```\n") if c.fenced] == [(1, 4)]
    assert not any(c.fenced for c in M.code_ranges("~~~\nx\n")) and not any(c.fenced for c in M.code_ranges("  ~~~\nx\n  ~~~\n"))
    assert M.links("~~~~\n[[a]]\n~~~\n[[b]]\n~~~~\n[[c]]")[0][0] == "c"


def test_tags():
    assert [t[0] for t in M.tags("#a x#b &#c (#d/e) #1 #_f #é #g-h, [[N#i]] `#j` #k/#l")] == ["#a", "#d/e", "#_f", "#g-h", "#k/"]
    assert M.tags("é #x")[0] == ("#x", 1, 3, 5)


@pytest.mark.parametrize("text, slug", [("Hello World", "hello-world"), ("A  --  b", "a-b"), ("C++ & Rust!", "c-rust"), ("Été Über", "Été-Über".replace("É", "É")), ("a_b__c", "a_b__c"), ("- x -", "x"), ("e\u0301", "é")])
def test_slugs(text, slug):
    assert M.slug(text) == slug


def test_headings_blocks_and_types():
    text = "# A ^id-1\n## A\n#no\n```\n# x\ny\n```\n### A #\n- item ^b\n> q ^c\n| a | ^d\n1. n ^e\nplain ^f\nmid ^g text"
    assert M.headings(text) == [("A", 1, 1, "a"), ("A", 2, 2, "a-1"), ("A #", 3, 8, "a-2")]
    assert M.block_ids(text) == [("id-1", 1, "heading"), ("b", 9, "list-item"), ("c", 10, "blockquote"), ("d", 11, "paragraph"), ("e", 12, "list-item"), ("f", 13, "paragraph")]


def test_inline_properties_and_contexts():
    text = "[ key :: v w ] [a::[[N]]] `[x::y]`\n- [x] t [[T]]\n* [ ] u [[U]]\n[k::see [[V]]]"
    assert [p[:2] for p in M.inline_properties(text)] == [("key", "v w"), ("a", "[[N]]"), ("k", "see [[V]]")]
    lines = M.lines_of(text)
    assert [M.link_context(lines, x[5], x[6]) for x in M.links(text)] == ["inline:a", "task", "body", "inline:k"]


def test_frontmatter_splits():
    assert M.split_frontmatter("---\na: 1\n---\nb") == ("a: 1", "b", 4)
    assert M.split_frontmatter("---\r\na: 1\r\n---\r\nb") == ("a: 1\r", "b", 4)
    assert M.split_frontmatter("---\na: 1\n---") == ("a: 1", "", 4)
    for plain in ("---\n---\n", "--- \na\n---\n", "a\n---\n", "---\na: 1\n", "---"):
        assert M.split_frontmatter(plain) == (None, plain, 1)
    assert M.split_frontmatter("---\n---\nx\n---\ny") == ("---\nx", "y", 5)
    assert M.lines_of("a\r\nb\n\n") == ["a", "b", ""] and M.lines_of("") == []


def test_yaml_by_the_core_schema():
    value = Y.load("a: 2024-01-15\nb: yes\nc: 010\nd: 4.0\ne: null\nf: 12:30:00\ng: [1, x]\nh: true\ni: 1e3")
    assert value == {"a": "2024-01-15", "b": "yes", "c": 10, "d": 4.0, "e": None, "f": "12:30:00", "g": [1, "x"], "h": True, "i": 1000.0}
    assert [Y.as_text(value[k]) for k in "acdegh"] == ["2024-01-15", "10", "4", "null", "- 1\n- x", "true"]
    with pytest.raises(ValueError, match="duplicate"):
        Y.load("a: 1\na: 2")
    assert Y.strings({"a": "x", "b": ["y", {"c": "z"}], "d": {"e": "w"}}) == [("a", None, "x"), ("b", 0, "y"), ("b[1].c", None, "z"), ("d.e", None, "w")]


def test_task_metadata():
    rest = lambda text: T.task_of(f"- [ ] {text}", CONFIG)[2:5:2]
    assert rest("Buy 📅 2024-01-02 🔺 now") == ("Buy now", {"due": "2024-01-02", "priority": "high"})
    assert rest("x 📅 by 2024-01-02 y 2024-02-03") == ("x y 2024-02-03", {"due": "2024-01-02"})
    assert rest("a 🔺 🔼") == ("a", {"priority": "medium"})
    assert rest("n ⏱ about -1.5 h 🆔 q1 💬 some text 📌") == ("n h", {"id": "q1", "estimate": "-1.5", "note": "some text", "pinned": "true"})
    assert T.task_of("- [x] see [[N|m]] #t ^b", CONFIG) == ("-", "[x]", "see [[N|m]] #t", 0, {}, [("N", "m")], ["#t"], "b")
    assert T.task_of("-[ ] no", CONFIG) is None and T.task_of("12. [>] yes", CONFIG)[0] == "12."


def test_task_parents_and_trees():
    text = "- [ ] a\n    - [ ] b\n        - [ ] c\n    text\n    - item\n- [ ] d\n\n    - [ ] e\n- loose\n\t- [ ] f"
    rows = [(t[0], t[6]) for t in T.tasks(text, CONFIG)]
    assert rows == [(1, None), (2, 1), (3, 2), (6, None), (8, None), (10, None)]
    assert T.hierarchy(rows) == [(1, None), (2, 1), (3, None), (6, None), (8, None), (10, None)]
    nodes = [(n[5], n[1], n[2], n[3], n[4]) for n in T.tree(text, CONFIG)]
    assert nodes == [(1, None, 0, 0, "task"), (2, 0, 1, 0, "task"), (3, 1, 2, 0, "task"), (5, 0, 1, 1, "text"), (6, None, 0, 1, "task"), (8, None, 0, 2, "task"), (10, None, 0, 3, "task")]
    assert T.format_tree(T.tree("- [ ] a 📅 2024-01-02\n    * b", CONFIG), "  ", CONFIG) == "- [ ] a 📅 2024-01-02\n  * b"


def test_relative_dates():
    today = datetime.date(2024, 3, 1)
    known = {"Today": "2024-03-01", "tomorrow": "2024-03-02", "yesterday": "2024-02-29", "+3d": "2024-03-04", "-1w": "2024-02-23", "+2m": "2024-04-30", "2024-12-31": "2024-12-31", "2024-13-01": None, "+d": None, "soon": None, "+3y": None}
    assert {k: T.relative_date(k, today) for k in known} == known


def test_links_and_tags_are_those_of_their_expressions():
    import random

    rng = random.Random(5)
    parts = ["[[", "]]", "!", "#", "a", "b/c", "-", "_", "&", " ", "\n", "|", "^", "é", "1", "[", "]", "📅", "²"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 16)))
        assert [(m.span(), m.groups()) for m in M.LINK.finditer(text)] == [(m.span(), m.groups()) for m in M.found_links(text)], text
        assert [(m.start(1) - 1, m[1]) for m in M.TAG.finditer(text)] == [(m.start(), m[1]) for m in M.found_tags(text)], text


def test_plain_yaml_is_read_by_libyaml_and_alike(monkeypatch):
    import random

    import yaml

    def old(text):
        try:
            return repr(yaml.load(text, Loader=Y.Loader))
        except (yaml.YAMLError, ValueError, RecursionError) as error:
            return " ".join(str(error).split())

    def new(text):
        try:
            return repr(Y.load(text))
        except ValueError as error:
            return str(error)

    rng = random.Random(6)
    bits = ["a", "b c", "k:", ": ", "- ", "\n", "\n  ", "\n- ", "\n  - ", ' "x"', '"', "'", " '[[D]]'", "1", "0x1F", "0o7", "1.5", ".inf", "TRUE", "null", "é", "---", "...", "'it''s'", "#", "\t", "\\", "{", "\nk: v", "\nk:\n", "²"]
    for text in ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(2000)]:
        assert new(text) == old(text), text
    monkeypatch.setattr(yaml, "load", None)
    assert Y.load('title: "D 1"\nrating: 3\nup: -1.5\nok: true\nno: null\ntags:\n  - de\n  - s/x\nm:\n  id: id-1\n') == {"title": "D 1", "rating": 3, "up": -1.5, "ok": True, "no": None, "tags": ["de", "s/x"], "m": {"id": "id-1"}}


def test_lines_without_a_box_cost_nothing_before_a_task(monkeypatch):
    asked, old = [], T.task_of
    monkeypatch.setattr(T, "task_of", lambda line, config: asked.append(line) or old(line, config))
    found = T.tasks("plain\n" * 500 + "- [ ] a\n    text\n    - [x] b\n- c\n    - [ ] d\n", CONFIG)
    assert [(r[0], r[6]) for r in found] == [(501, None), (503, 501), (505, None)] and len(asked) == 5
