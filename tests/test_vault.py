import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marginalia import queries as Q
from marginalia.functions import sql
from marginalia.operators import extract, graph, health, notes as parts, properties, rewrite
from marginalia.sources import notes as source
from marginalia.streaming import index

SCHEMA = "path string, content string"


def contents(df):
    return {r.path: r.content for r in df.collect()}


def test_parts_and_edges_of_texts(spark):
    rows = [("a.md", "---\nx: 1\n---\nbody"), ("d/b.c.md", "---\r\nx: 1\r\n---\r\nbody\r\n"), ("e.md", "---\n---\n"), ("f.md", ""), ("g.md", None), ("h.md", "---\nx: 1\n---")]
    notes = spark.createDataFrame(rows, SCHEMA)
    from marginalia.functions.markdown import split_frontmatter

    for r in parts.accessors(notes).collect():
        content = dict(rows)[r.path]
        if content is not None:
            assert (r.frontmatter_raw, r.body, r.body_start_line) == split_frontmatter(content)
    assert [r.name for r in parts.accessors(notes).orderBy("path").collect()][1] == "b.c"
    for relation in (extract.links, extract.tags, extract.task_rows, extract.frontmatter, extract.edges, extract.code_ranges):
        assert relation(notes).where(F.col(relation(notes).columns[0]) == "g.md").count() == 0


def test_resolution_and_incoming_links(spark):
    rows = [
        ("a/N.md", "---\naliases: [Ali]\n---\n[[b/N]] [[n.md]] [[Ali]] [[gone]] ![[x.png]]"),
        ("b/N.md", "---\naliases: Bob\nup: '[[a/N]]'\nlist: ['[[N]]']\n---\n- [ ] [[Bob]]"),
        ("c.md", "[[B/N]] [[N#h]]"),
    ]
    notes = spark.createDataFrame(rows, SCHEMA)
    edges = graph.outgoing(notes)
    got = [(r["from"], r.target, r.context, r.resolved_path) for r in edges.orderBy("from", "ord").collect()]
    assert got == [
        ("a/N.md", "b/N", "body", "b/N.md"), ("a/N.md", "n.md", "body", "b/N.md"), ("a/N.md", "Ali", "body", "a/N.md"), ("a/N.md", "gone", "body", None), ("a/N.md", "x.png", "body", None),
        ("b/N.md", "a/N", "body", "a/N.md"), ("b/N.md", "N", "body", "b/N.md"), ("b/N.md", "Bob", "task", "b/N.md"), ("b/N.md", "a/N", "frontmatter:up", "a/N.md"), ("b/N.md", "N", "frontmatter:list[0]", "b/N.md"),
        ("c.md", "B/N", "body", None), ("c.md", "N", "body", "b/N.md"),
    ]
    incoming = {(r["path"], r["from"], r.target) for r in graph.incoming(edges, notes).collect()}
    assert ("b/N.md", "c.md", "B/N") in incoming and ("a/N.md", "c.md", "N") in incoming and not any(t in ("Ali", "Bob") for _, _, t in incoming)
    assert {r.path for r in graph.orphans(notes, edges).collect()} == {"c.md"}
    assert [r.target for r in graph.broken_links(edges).orderBy("target").collect()] == ["B/N", "gone"]
    asked = graph.resolve_note(notes, extract.frontmatter(notes), spark.createDataFrame([("n",), ("ali",), ("a/N",), ("bob",), ("zz",)], "query string"))
    assert {r.query: (r.status, r.path) for r in asked.collect()} == {"n": ("ambiguous", None), "ali": ("found", "a/N.md"), "a/N": ("found", "a/N.md"), "bob": ("not_found", None), "zz": ("not_found", None)}


def test_rewrites(spark):
    text = "---\na: 1\nk: x\n---\nhi [k2::v] [k2::w] é [p::1]\n- [ ] t\n"
    notes = spark.createDataFrame([("n.md", text)], SCHEMA)
    one = lambda df: df.first()
    assert one(rewrite.set_property(notes, "a", [1, "b"])).content.startswith("---\na:\n")
    assert one(rewrite.set_property(notes, "k2", "z")).error.startswith("Multiple") and one(rewrite.set_property(notes, "k2", "z")).content == text
    assert "é [p::9]" in one(rewrite.set_property(notes, "p", 9)).content
    assert one(rewrite.remove_property(notes, "k2")).content == "---\na: 1\nk: x\n---\nhi   é [p::1]\n- [ ] t\n"
    assert "[q::v] [q::w]" in one(rewrite.rename_property(notes, "k2", "q")).content
    assert one(rewrite.rename_property(notes, "a", "z")).content.startswith("---\nk: x\nz: 1\n---\n")
    assert "k:\n- x\n- y\n" in one(rewrite.modify_frontmatter(notes, "k", "y", append=True)).content
    assert one(rewrite.set_property(notes, "x", 1, "both")).error
    assert one(rewrite.set_task_symbol(notes, 6, "x")).content.endswith("- [x] t\n")
    assert "not a task" in one(rewrite.set_task_symbol(notes, 5, "x")).error and "out of range" in one(rewrite.set_task_symbol(notes, 7, "x")).error
    made, refused = rewrite.create_notes(notes, spark.createDataFrame([("new", "t"), ("n", "t"), ("a?b", "t")], SCHEMA))
    assert set(contents(made)) == {"n.md", "new.md"} and {r.error for r in refused.collect()} == {"note exists", "illegal character"}
    healed = rewrite.heal_frontmatter(spark.createDataFrame([("d.md", "---\na: 1\na: 2\n---\nb")], SCHEMA)).first()
    assert healed.content == "---\na: 2\n---\nb"
    marked = rewrite.init_metadata(notes)
    assert properties.metadata(extract.frontmatter(marked)).count() == 1
    linked = spark.createDataFrame([("x.md", "é [[Old|a]] [[dir/Old#h]] `[[Old]]`"), ("dir/Old.md", "[[x]]")], SCHEMA)
    moved = rewrite.rename_with_links(linked, graph.outgoing(linked), spark.createDataFrame([("dir/Old.md", "far/New.md")], "path string, new_path string"))
    assert contents(moved) == {"x.md": "é [[New|a]] [[far/New#h]] `[[Old]]`", "far/New.md": "[[x]]"}
    assert contents(rewrite.without_links_to(linked, ["old"]))["x.md"] == "é a [[dir/Old#h]] `[[Old]]`"


def test_globs():
    import re

    assert re.search(parts.glob_regex("a/*.md").replace(r"\z", r"\Z"), "a/b.md") and not re.search(parts.glob_regex("a/*.md").replace(r"\z", r"\Z"), "a/b/c.md")
    assert re.search(parts.glob_regex("**/[a-c]?.md").replace(r"\z", r"\Z"), "x/y/b1.md")


def test_files_are_read_written_and_followed(spark, tmp_path):
    root = tmp_path / "vault"
    for name, text in {"a.md": "# A\n[[b]]", "s/2026: x.md": "#t", ".hidden/h.md": "no", "_u.md": "---\nk: 1\n---\nbody\nmore", "n.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    notes = source.read(spark, str(root))
    assert [r.path for r in parts.list_notes(notes).collect()] == ["_u.md", "a.md", "s/2026: x.md"]
    assert contents(source.read(spark, str(root), columns="frontmatter"))["_u.md"] == "---\nk: 1\n---\n"
    assert parts.note_exists(notes, "a") and not parts.note_exists(notes, "zz")
    assert source.write(spark.createDataFrame([("new/c.md", "c"), ("a.md", None)], SCHEMA), str(root)) == 2
    assert sorted(contents(source.read(spark, str(root)))) == ["_u.md", "new/c.md", "s/2026: x.md"]
    table, state = str(tmp_path / "index"), str(tmp_path / "state")
    index.follow(spark, str(root), table, state).awaitTermination()
    assert {r.name for r in index.current(spark, table, "tags").collect()} == {"#t"}
    assert index.status(spark, table, source.read(spark, str(root))).first()[:] == (3, 0, 0)


def test_table_functions(spark):
    sql.register(spark)
    spark.createDataFrame([("a.md", "[[X]] #t")], SCHEMA).createOrReplaceTempView("some_notes")
    assert spark.sql("SELECT path, l.target FROM some_notes, LATERAL note_links(content) l").collect()[0].target == "X"


def test_lint_fixes(spark):
    notes = spark.createDataFrame([("a.md", "x ^b\ny ^b\n"), ("b.md", "---\nk: 1\n---\n")], SCHEMA)
    assert contents(health.with_unique_block_ids(notes, extract.blocks(notes)))["a.md"] == "x ^b\ny ^b-1\n"
    assert contents(health.with_frontmatter_added(notes, extract.frontmatter(notes)))["a.md"].startswith("---\n{}\n---\n")


SOME = ["a8_note_accessors", "b6_links", "b10_tags", "b27_tasks", "b32_task_parents", "c12_and", "c7_section", "d3_resolve", "d8_incoming", "e1_merged_props", "f3_with_body", "h9_section", "h13_lint_broken_block_refs"]


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_their_sql(spark, name):
    root = "/root/testdata/sf0.001"
    got = Q.queries()[name](spark, root).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{root}/documents.parquet')")
    want = con.execute(Q.oracle_sql()[name]).fetchdf()
    cells = lambda d: sorted(tuple("" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in d[sorted(got.columns)].itertuples(index=False))
    assert cells(got) == cells(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_pushed_path_is_one_that_a_listing_has(spark, tmp_path):
    root = tmp_path / "vault"
    for name in ("a.md", ".h/x.md", "sub/.y.md", "sub/b.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (tmp_path / "out.md").write_text("secret")
    (root / "away").symlink_to(tmp_path)
    notes = source.read(spark, str(root))
    for path, there in (("a.md", 1), ("sub/b.md", 1), (".h/x.md", 0), ("sub/.y.md", 0), ("../out.md", 0), ("sub/../a.md", 0), ("./a.md", 0), (str(tmp_path / "out.md"), 0), ("away/out.md", 0), ("gone.md", 0)):
        assert notes.where(F.col("path") == path).count() == there, path
    assert source.read(spark, str(root), hidden="true").where("path = '.h/x.md'").count() == 1


def test_resolution_plans_without_jobs_or_loops(spark, tmp_path):
    notes = spark.createDataFrame([("a/One.md", "---\naliases: [uno]\n---\n[[Two]] [[uno]] [[a/One]]"), ("Two.md", "[[One]]")], "path string, content string")
    front = extract.frontmatter(notes)
    asked = spark.createDataFrame([("a/One",), ("Two.md",), ("UNO",), ("none",)], "query string")
    found = graph.resolve_note(notes, front, asked)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r.query, r.status, r.path) for r in found.collect()} == {("a/One", "found", "a/One.md"), ("Two.md", "found", "Two.md"), ("UNO", "found", "a/One.md"), ("none", "not_found", None)}
    graph.save(notes, f"{tmp_path}/graph")
    kept = graph.load(spark, f"{tmp_path}/graph")
    assert sorted((r["from"], r.resolved_path) for r in kept.collect()) == [("Two.md", "a/One.md"), ("a/One.md", "Two.md"), ("a/One.md", "a/One.md"), ("a/One.md", "a/One.md")]


def test_a_note_is_loaded_from_any_folder_of_its_source(spark, tmp_path):
    rows = [(7, "text", "de", "src7"), (7, "other", "en", "src7"), (7, "more", "en", "src70"), (8, "text", "en", "src7")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.queries()["a3_load_note"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(tuple(r) for r in got) == sorted(con.execute(Q.oracle_sql()["a3_load_note"]).fetchall()) and len(got) == 2


def test_texts_of_a_batch_are_strings_one_at_a_time(spark):
    # 3000 notes of 30,000 characters, 90 MB in Arrow and four times that as strings, in one batch.
    notes = spark.range(0, 3000, 1, 1).select(F.concat("id", F.lit(".md")).alias("path"), F.concat(F.lit("📅 "), F.repeat(F.lit("abc "), 7500)).alias("content"))
    # By value: the workers don't have this module.
    read = eval("lambda text: [(int(open('/proc/self/statm').read().split()[1]) * 4096 // 2**20,)]")
    used = extract.relation(notes, read, "mb int").agg(F.max("mb") - F.min("mb")).first()[0]
    assert used < 100
    got = rewrite.rewritten(notes, lambda text: text[:2] + str(read(text)[0][0]))
    assert got.where("error is null").count() == 3000 and got.agg(F.max(F.substring("content", 3, 9).cast("int"))).first()[0] < 600


def test_frontmatter_of_heads_is_that_of_contents(spark):
    from marginalia.functions.markdown import split_frontmatter

    texts = ["---\na: 1\n---\nb", "---\r\na: 1\r\n---\r\nb", "---\na: 1\n---\r\nb\n---\n", "---\n---\n", "---\n\n---\n", "---\na: 1\n---", "---\na: 1\n--- \nb", "--- \na: 1\n---\n", "x\n---\na: 1\n---\n", "---\na: 1\na: 2\n---\n[[x]]", "---\n- x\n---\n", ""]
    notes = spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)], SCHEMA)
    for r in extract.frontmatter(notes).collect():
        raw = split_frontmatter(texts[int(r.path[:-3])])[0]
        assert (raw is None) == (r.status == "absent"), r
    assert "regexp_extract" in extract.frontmatter(notes)._jdf.queryExecution().optimizedPlan().toString()


def test_info_makes_edges_once_and_counts_right(spark):
    rows = [("a.md", "[[b]] [[gone]] [[a]] ![[x.png]] #t"), ("b.md", "---\nup: '[[nope]]'\n---\n- [ ] t #t #u"), ("c.md", ""), ("d.md", None)]
    notes = spark.createDataFrame(rows, SCHEMA)
    info = health.info(notes, graph.outgoing(notes), extract.tags(notes), extract.task_rows(notes))
    assert info.first().asDict() == {"note_count": 4, "total_size": sum(len(c or "") for _, c in rows), "link_count": 6, "broken_link_count": 3, "tag_count": 2, "task_count": 1, "orphan_count": 3}
    assert info._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 4
    none = notes.where("false")
    assert health.info(none, graph.outgoing(none), extract.tags(none), extract.task_rows(none)).first()[:] == (0,) * 7


def test_the_vault_asks_for_no_python(spark):
    plan = Q.Vault(spark, "/root/testdata/sf0.001").notes._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
    assert "ExistingRDD" not in Q.queries()["d10_resolve_note"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
