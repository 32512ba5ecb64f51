import pytest

from marginalia.plans import search as S
from marginalia.plans.query import And, Matcher, Not, Or, Property, QueryError, Scope, Tag, Text, from_json, parse, to_json

NOTE = "---\nrating: 4.0\ntags:\n  - Draft\nlist:\n  - a\nwhen: 2024-05-01\n---\n# One\nAlpha beta #Work/x\n## Two\ngamma [score:: 7] alpha\n"


def word(w):
    return Text("content", Matcher("contains", w))


def test_parse():
    assert parse("a b OR c") == Or((And((word("a"), word("b"))), word("c")))
    assert parse('-tag:x (path:p OR filename:"F 1")') == And((Not(Tag("x")), Or((Text("path", Matcher("contains", "p")), Text("filename", Matcher("exact", "F 1"))))))
    assert parse("tag:(a OR b)") == Or((Tag("a"), Tag("b"))) and parse("tag:#x") == Tag("x")
    assert parse("section:(a line:b)") == Scope("section", And((word("a"), Scope("line", word("b")))))
    assert parse(r"/a\/b/") == Text("content", Matcher("regex", r"a\/b"))
    assert parse("property:k>=3") == Property("k", ">=", "3") and parse('property:"a b"') == Property("a b")
    assert parse("foo:bar") == And((word("foo"), word("bar")))


@pytest.mark.parametrize("text", ["", "  ", "(a", "a)", "OR a", "--a", "property:x=-5", "tag:(a b)", "tag:", "path:(a)"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text", ["a OR -b", "tag:(x OR y)", 'section:(path:/r/ "q")', "property:k!=v property:z"])
def test_json_both_ways(text):
    assert from_json(to_json(parse(text))) == parse(text)
    assert from_json({"type": "field", "field": {"field": "tag", "value": "x"}}) == Tag("x")


CASES = {
    "alpha": [("content", 10, "Alpha beta #Work/x"), ("content", 12, "gamma [score:: 7] alpha")],
    '"ALPHA beta #work/X"': [("content", 10, "Alpha beta #Work/x")],
    "alpha nothing": [],
    "nothing OR gamma": [("content", 12, "gamma [score:: 7] alpha")],
    "-nothing": [("not", None, None)],
    "path:dir": [("path", None, "dir/My Note.md")],
    "path:DIR": [],
    "filename:Note": [("filename", None, "My Note")],
    "tag:work/X": [("tag", 10, "#Work/x")],
    "tag:work": [],
    "tag:draft": [("tag", 1, "Draft")],
    "section:(gamma alpha)": [("section:content", 12, "gamma [score:: 7] alpha")] * 2,
    "section:(beta gamma)": [],
    "section:-beta": [],
    "line:(gamma alpha)": [("line:content", 12, "gamma [score:: 7] alpha")] * 2,
    "line:(alpha path:dir)": [("line:content", 10, "Alpha beta #Work/x"), ("line:path", 10, "dir/My Note.md")],
    "property:rating=4": [("property:rating", 1, "4")],
    "property:rating<10": [("property:rating", 1, "4")],
    "property:score>=7": [("property:score", 12, "7")],
    "property:list=a": [],
    "property:when<2024-06-01": [("property:when", 1, "2024-05-01")],
    "property:gone!=x": [],
    "/be+ta/": [("content", 10, "Alpha beta #Work/x")],
    "/(/": None,
    "-/(/": None,
    "alpha OR /(/": [("content", 10, "Alpha beta #Work/x"), ("content", 12, "gamma [score:: 7] alpha")],
}


@pytest.mark.parametrize("text", [t for t in CASES if t != "section:-beta"])
def test_evaluate(text):
    if CASES[text] is None:
        with pytest.raises(ValueError):
            S.evaluate("dir/My Note.md", NOTE, parse(text))
    else:
        assert S.evaluate("dir/My Note.md", NOTE, parse(text)) == CASES[text]


def test_native_search_equals_the_evaluator(spark):
    rows = [("dir/My Note.md", NOTE), ("dir/b.md", "plain alpha\r\n\r\nend"), ("a b.md", ""), ("a/c.md", "---\nx: 1\n---\n"), ("z.md", None)]
    notes = spark.createDataFrame(rows, "path string, content string")
    for text in ("alpha", '"plain ALPHA"', "/^PLAIN/", "-alpha", "path:dir alpha", "alpha OR filename:c", "-(path:dir OR alpha)", "/(/", "-/(/", "alpha OR /(/"):
        want = {}
        for path, content in rows[:-1]:
            try:
                found = S.evaluate(path, content, parse(text))
            except ValueError:
                found = []
            if found:
                want[path] = found
        got = S.search(notes, text).collect()
        assert {r.path: [tuple(m) for m in r.matches] for r in got} == want, text
    order = [r.path for r in S.search(notes, "-nothing").collect()]
    assert order == ["a/c.md", "a b.md", "dir/My Note.md", "dir/b.md"]


def test_names(spark):
    notes = spark.createDataFrame([("Project Plan.md", ""), ("plan.md", ""), ("x/Plane.md", "")], "path string, content string")
    assert [r.path for r in S.find_names(notes, "plan", limit=3).collect()] == ["plan.md", "x/Plane.md", "Project Plan.md"]
    assert [r.path for r in S.find_names(notes, "plam", "fuzzy").collect()] == ["plan.md"]


def test_notes_are_searched_once_though_sorted(spark):
    notes = spark.range(40).selectExpr("concat(id, '.md') AS path", "'#x' AS content").repartition(4)
    for query in ("tag:x", "-gone"):
        plan = S.search(notes, query)._jdf.queryExecution().executedPlan().toString()
        assert plan.index("rangepartitioning") < plan.index("hashpartitioning(path")
    assert [r.path for r in S.search(notes, "tag:x").collect()] == sorted(f"{i}.md" for i in range(40))


def test_a_tag_is_looked_for_in_yaml_only_where_it_may_be(spark, monkeypatch):
    escaped = '---\ntags:\n  - "dr\\x61ft"\n---\n'
    folded = "---\ntags:\n  - 'it''s'\n---\n"
    assert S.evaluate("a.md", escaped, Tag("draft")) == [("tag", 1, "draft")] and S.evaluate("a.md", folded, Tag("it's")) == [("tag", 1, "it's")]
    notes = spark.createDataFrame([("n.md", NOTE), ("e.md", escaped), ("f.md", folded), ("t.md", "#DRAFT"), ("z.md", "none")], "path string, content string")
    assert [r.path for r in S.search(notes, "tag:draft").collect()] == ["e.md", "n.md", "t.md"]
    assert [r.path for r in S.search(notes, Tag("it's")).collect()] == ["f.md"]
    S._fields.cache_clear()
    monkeypatch.setattr(S.yamlcore, "load", None)
    assert S.evaluate("n.md", NOTE, parse("tag:(lang/de OR lang/fr)")) == []
