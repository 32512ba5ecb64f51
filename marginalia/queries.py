"""Queries of the notes engine over the whole vault view, and SQL that parses the same contents on its own."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vaultview
from .operators import extract, graph, health, notes as parts, properties, rewrite
from .plans import search


class Vault:
    """The vault view and its relations, each planned when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def notes(self) -> DataFrame:
        return vaultview.vault(self.spark, self.sf_dir)

    @cached_property
    def links(self) -> DataFrame:
        return extract.links(self.notes)

    @cached_property
    def tags(self) -> DataFrame:
        return extract.tags(self.notes)

    @cached_property
    def headings(self) -> DataFrame:
        return extract.headings(self.notes)

    @cached_property
    def blocks(self) -> DataFrame:
        return extract.blocks(self.notes)

    @cached_property
    def inline(self) -> DataFrame:
        return extract.inline_properties(self.notes)

    @cached_property
    def tasks(self) -> DataFrame:
        return extract.task_rows(self.notes)

    @cached_property
    def frontmatter(self) -> DataFrame:
        return extract.frontmatter(self.notes)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.resolved(extract.edges(self.notes), self.notes, self.frontmatter)


# Relations of the oracles, by regular expressions over lines.
_LINES = r"""
, ln0 AS (SELECT doc_id, path, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS txt FROM (SELECT doc_id, path, string_split(content, chr(10)) AS p FROM notes))
, ln1 AS (SELECT *, sum(CASE WHEN starts_with(txt, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS f FROM ln0)
, ln AS (SELECT doc_id, path, line, txt FROM ln1 WHERE f % 2 = 0 AND NOT starts_with(txt, '```'))
, fm AS (SELECT doc_id, path, regexp_extract(content, '^---\n((?s:.*?))\n---\n', 1) AS yaml, starts_with(content, '---' || chr(10)) AS has FROM notes)
, ok AS (SELECT doc_id, path, yaml FROM fm WHERE has AND len(regexp_extract_all(yaml, '(?m)^status:')) = 1)
"""
_LINKS = _LINES + r"""
, lk0 AS (SELECT doc_id, path, line, txt, unnest(regexp_extract_all(regexp_replace(txt, '`[^`]+`', '', 'g'), '!?\[\[[^\]|#]+(?:#\^[a-zA-Z0-9_-]+)?(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]')) AS x FROM ln)
, lk AS (SELECT doc_id, path, line, strlen(substr(txt, 1, strpos(txt, x) - 1)) AS start_col, strlen(substr(txt, 1, strpos(txt, x) - 1)) + strlen(x) AS end_col, txt,
    starts_with(x, '!') AS embed, trim(regexp_extract(x, '\[\[([^\]|#]+)', 1)) AS target, nullif(regexp_extract(x, '#\^([a-zA-Z0-9_-]+)', 1), '') AS block_id,
    nullif(regexp_extract(x, '#([^\]|^][^\]|]*)', 1), '') AS heading, nullif(regexp_extract(x, '\|([^\]]+)\]\]', 1), '') AS alias FROM lk0)
"""
_EDGES = _LINKS + r"""
, re AS (SELECT doc_id, path, regexp_extract(yaml, '(?m)^related: "(.*)"$', 1) AS x FROM ok)
, eg0 AS (
  SELECT doc_id, path AS frm, 0 AS part, line, start_col, end_col, embed, target, block_id, heading, alias,
    CASE WHEN regexp_matches(txt, '^\s*- \[[ xX>/-]\]') THEN 'task' ELSE 'body' END AS context FROM lk
  UNION ALL SELECT doc_id, path, 1, 0, 0, strlen(x), false, regexp_extract(x, '\[\[([^\]|#]+)', 1), NULL, NULL, NULL, 'frontmatter:related' FROM re)
, st AS (SELECT lower(regexp_extract(path, '([^/]+)\.md$', 1)) AS stem, path AS to_path FROM notes)
, al AS (SELECT alias, arg_max(path, string_split(path, '/')) AS al_path FROM (SELECT path, lower(regexp_extract(yaml, 'aliases:\n  - (.*)\n', 1)) AS alias FROM ok) GROUP BY alias)
, eg AS (SELECT eg0.*, coalesce(ex.path, st.to_path, al_path) AS to_path, regexp_replace(lower(target), '\.md$', '') AS target_key, row_number() OVER (PARTITION BY frm ORDER BY part, line, start_col) - 1 AS ord
    FROM eg0 LEFT JOIN notes ex ON contains(target, '/') AND ex.path = regexp_replace(target, '\.md$', '') || '.md' LEFT JOIN st ON stem = regexp_replace(lower(target), '\.md$', '') LEFT JOIN al ON al.alias = lower(target))
"""
_MEDIA = r"regexp_matches(lower(target), '\.(png|jpe?g|gif|webp|svg|bmp|mp3|wav|ogg|m4a|flac|mp4|webm|mov|avi|pdf)$')"
_TAGS = _LINES + r"""
, tg0 AS (SELECT doc_id, path, line, txt, unnest(regexp_extract_all(regexp_replace(regexp_replace(txt, '`[^`]+`', '', 'g'), '\[\[[^\]]*\]\]', '', 'g'), '(?:^|[^\p{L}\p{N}_&])#([a-zA-Z_][\p{L}\p{N}_/-]*)', 1)) AS t FROM ln)
, tg AS (SELECT doc_id, path, line, '#' || t AS name, strlen(substr(txt, 1, strpos(txt, '#' || t) - 1)) AS start_col FROM tg0)
"""
_HEADINGS = _LINES + r"""
, hd AS (SELECT doc_id, path, line, length(regexp_extract(txt, '^(#{1,6})\s', 1)) AS level, regexp_extract(txt, '^#{1,6}\s+(.+?)(?:\s+\^[a-zA-Z0-9_-]+)?\s*$', 1) AS text
    FROM ln WHERE regexp_matches(txt, '^#{1,6}\s+.+$'))
"""
_TASKS = _LINES + r"""
, tk0 AS (SELECT doc_id, path, line, txt, regexp_extract(txt, '^(\s*)', 1) AS lead, regexp_extract(txt, '^\s*([-*+]|\d+\.) \[', 1) AS marker,
    '[' || regexp_extract(txt, '^\s*(?:[-*+]|\d+\.) \[(.)\]', 1) || ']' AS symbol, regexp_extract(txt, '^\s*(?:[-*+]|\d+\.) \[.\] (.*)$', 1) AS rest FROM ln
    WHERE regexp_matches(txt, '^\s*([-*+]|\d+\.) \[.\] .*$'))
, tk AS (SELECT doc_id, path, line, marker, symbol, length(lead) // 4 AS indent, nullif(regexp_extract(rest, '\s\^([a-zA-Z0-9_-]+)\s*$', 1), '') AS block_id,
    nullif(regexp_extract(rest, '📅\s*(\d{4}-\d{2}-\d{2})', 1), '') AS due, CASE WHEN contains(rest, '🔺') THEN 'highest' END AS priority, nullif(regexp_extract(rest, '🆔\s*(\S+)', 1), '') AS tid,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '\s\^[a-zA-Z0-9_-]+\s*$', ''), '📅\s*\d{4}-\d{2}-\d{2}', ''), '🆔\s*\S+', ''), '\s*🔺\s*', ' ')) AS description FROM tk0)
"""
_BODY = _LINES + r"""
, bd AS (SELECT doc_id, path, CASE WHEN has THEN regexp_replace(content, '^---\n(?s:.*?)\n---\n', '') ELSE content END AS body, CASE WHEN has THEN len(string_split(yaml, chr(10))) + 3 ELSE 1 END AS begins FROM notes JOIN fm USING (doc_id, path))
, bl AS (SELECT doc_id, path, unnest(range(0, len(p))) + begins AS line, unnest(p) AS txt FROM (SELECT doc_id, path, begins, string_split(rtrim(body, chr(10)), chr(10)) AS p FROM bd))
"""
_PROPS = _LINES + r"""
, ip0 AS (SELECT doc_id, path, line, txt, unnest(regexp_extract_all(txt, '\[\s*[A-Za-z0-9_-]+\s*::\s*[^\]]*\]')) AS x FROM ln)
, ip AS (SELECT doc_id, path, line, strlen(substr(txt, 1, strpos(txt, x) - 1)) AS start_col, strlen(substr(txt, 1, strpos(txt, x) - 1)) + strlen(x) AS end_col,
    trim(regexp_extract(x, '\[([^:]*)::', 1)) AS key, trim(regexp_extract(x, '::([^\]]*)\]', 1)) AS value FROM ip0)
"""

FOUND: dict[str, tuple[Callable[[Vault], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, relations: str = ""):
    def keep(make: Callable[[Vault], DataFrame]):
        FOUND[name] = (make, None if sql is None else vaultview.SQL + relations + sql)
        return make

    return keep


def wide(df: DataFrame) -> DataFrame:
    """Integers as 64-bit ones."""
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "tinyint", "smallint") else F.col(f"`{c}`") for c, t in df.dtypes])


def hits(text: str) -> Callable[[Vault], DataFrame]:
    return lambda v: search.matches(search.search(v.notes, text)).select("path", "field", "line", "text")


# Scans and parts of notes.
query("a1_list_notes", "SELECT path FROM notes")(lambda v: parts.list_notes(v.notes).select("path"))
query("a2_list_glob", r"SELECT path FROM notes WHERE regexp_matches(path, '^src1[^/]*/en/Doc [^/]*5\.md$')")(lambda v: parts.list_matching(v.notes, "src1*/en/Doc *5.md").select("path"))
query("a3_load_note", "SELECT path, content FROM notes WHERE path LIKE 'src7/%/Doc 7.md'")(lambda v: parts.load_note(v.notes.where("path LIKE 'src7/%/%'"), F.concat(parts.folder(), F.lit("/Doc 7"))).select("path", "content"))
query("a8_note_accessors", "SELECT notes.path, regexp_extract(notes.path, '([^/]+)[.]md$', 1) AS name, regexp_extract(notes.path, '^(.*)/[^/]*$', 1) AS folder, has AS has_frontmatter, CASE WHEN has THEN yaml END AS frontmatter_raw, body, begins AS body_start_line FROM notes JOIN fm USING (doc_id, path) JOIN bd USING (doc_id, path)", _BODY)(lambda v: parts.accessors(v.notes))
query("a10_note_stats", "SELECT path, CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT) AS lines, CAST(len(list_filter(regexp_split_to_array(content, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')) AS BIGINT) AS words, strlen(content) AS size_bytes FROM notes")(lambda v: parts.stats(v.notes))
query("a7_all_frontmatter_where", "SELECT path FROM ok WHERE regexp_matches(yaml, '(?m)^status: open$')", _LINES)(lambda v: properties.all_frontmatter(v.frontmatter, "rating", ("status", "open")).select("path"))
query("a9_validate", "SELECT path FROM fm WHERE has AND len(regexp_extract_all(yaml, '(?m)^status:')) > 1", _LINES)(lambda v: properties.invalid(v.frontmatter).select("path"))
query("a9b_frontmatter_status", "SELECT path, CASE WHEN NOT has THEN 'absent' WHEN len(regexp_extract_all(yaml, '(?m)^status:')) > 1 THEN 'malformed' ELSE 'ok' END AS status FROM fm", _LINES)(lambda v: v.frontmatter.select("path", "status"))

# Extraction.
query("b1_split_frontmatter", "SELECT path, CASE WHEN has THEN yaml END AS yaml, body, begins FROM bd JOIN fm USING (doc_id, path)", _BODY)(lambda v: parts.accessors(v.notes).select("path", F.col("frontmatter_raw").alias("yaml"), "body", F.col("body_start_line").alias("begins")))
query("b4_code_ranges", "SELECT path, min(line) AS start_line, max(line) AS end_line, true AS is_fenced FROM (SELECT *, sum(CASE WHEN starts_with(txt, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS g FROM ln0) WHERE g % 2 = 1 OR starts_with(txt, '```') GROUP BY path UNION ALL SELECT path, line, line, false FROM (SELECT path, line, unnest(regexp_extract_all(txt, '`[^`]+`')) FROM ln)", _LINES)(lambda v: extract.code_ranges(v.notes).select("path", "start_line", "end_line", "is_fenced"))
query("b6_links", "SELECT path, row_number() OVER (PARTITION BY path ORDER BY line, start_col) - 1 AS ord, target, alias, heading, block_id, embed, line, start_col, end_col FROM lk", _LINKS)(lambda v: v.links)
query("b7_embeds", "SELECT path, target, alias, line FROM lk WHERE embed", _LINKS)(lambda v: extract.embeds(v.notes).select("path", "target", "alias", "line"))
query("b8_media_types", f"SELECT CASE WHEN {_MEDIA} THEN 'image' ELSE 'none' END AS media, count(*) AS n FROM lk GROUP BY 1", _LINKS)(lambda v: v.links.groupBy(F.coalesce(graph.media_type(F.col("target")), F.lit("none")).alias("media")).agg(F.count("*").alias("n")))
query("b9_format_wikilink", "SELECT path, line, start_col, CASE WHEN embed THEN '!' ELSE '' END || '[[' || target || coalesce('#' || heading, '') || coalesce('#^' || block_id, '') || coalesce('|' || alias, '') || ']]' AS link, coalesce(alias, target) AS display FROM lk", _LINKS)(lambda v: v.links.select("path", "line", "start_col", graph.wikilink(*(F.col(c) for c in ("target", "alias", "heading", "block_id", "embed"))).alias("link"), F.coalesce("alias", "target").alias("display")))
query("b10_tags", "SELECT path, name, line, start_col FROM tg", _TAGS)(lambda v: v.tags.select("path", "name", "line", "start_col"))
query("b12_unique_tags", "SELECT DISTINCT path, name FROM tg", _TAGS)(lambda v: health.unique_tags(v.tags).select("path", "name"))
query("b13_tag_roots", "SELECT path, '#' || split_part(substr(name, 2), '/', 1) AS root, string_agg(name, ',' ORDER BY line, start_col) AS tags FROM tg GROUP BY 1, 2", _TAGS)(lambda v: health.tag_roots(v.tags).select("path", "root", F.array_join("tags", ",").alias("tags")))
query("b14_tag_ancestors", "SELECT DISTINCT name, CASE WHEN contains(name, '/') THEN regexp_extract(name, '^([^/]*)/', 1) ELSE '' END AS above FROM tg", _TAGS)(lambda v: v.tags.select("name").distinct().select("name", F.array_join(health.tag_ancestors(F.col("name")), ",").alias("above")))
query("b15_headings_slugs", "SELECT path, text, level, line, slug || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY line) AS n FROM (SELECT *, regexp_replace(lower(text), ' ', '-', 'g') AS slug FROM hd))", _HEADINGS)(lambda v: v.headings)
query("b18_heading_by_text", "SELECT path, min(line) AS line FROM hd WHERE lower(text) = 'tasks' GROUP BY path", _HEADINGS)(lambda v: v.headings.where(F.lower("text") == "tasks").groupBy("path").agg(F.min("line").alias("line")))
query("b19_heading_levels", "SELECT level, count(*) AS n FROM hd WHERE level BETWEEN 1 AND 2 GROUP BY level", _HEADINGS)(lambda v: v.headings.where("level BETWEEN 1 AND 2").groupBy("level").agg(F.count("*").alias("n")))
query("b20_heading_tree", "SELECT a.path, a.text, a.line, max(b.line) AS parent_line FROM hd a LEFT JOIN hd b ON a.path = b.path AND b.line < a.line AND b.level < a.level GROUP BY ALL", _HEADINGS)(lambda v: health.heading_parents(v.headings).select("path", "text", "line", "parent_line"))
query("b21_block_ids", r"SELECT path, regexp_extract(txt, '\s\^([a-zA-Z0-9_-]+)\s*$', 1) AS id, line, CASE WHEN starts_with(txt, '#') THEN 'heading' WHEN starts_with(ltrim(txt), '- ') THEN 'list-item' ELSE 'paragraph' END AS block_type FROM ln WHERE regexp_matches(txt, '\s\^[a-zA-Z0-9_-]+\s*$')", _LINES)(lambda v: v.blocks)
query("b24_inline_props", "SELECT path, row_number() OVER (PARTITION BY path ORDER BY line, start_col) - 1 AS index, key, value, line, start_col, end_col FROM ip", _PROPS)(lambda v: v.inline)
query("b25_props_collected", "SELECT path, key, string_agg(value, ',' ORDER BY line, start_col) AS vals FROM ip GROUP BY 1, 2", _PROPS)(lambda v: properties.collected_inline(v.inline).select("path", "key", F.array_join("values", ",").alias("vals")))
query("b27_tasks", "SELECT path, line, marker, symbol, indent, description, block_id FROM tk", _TASKS)(lambda v: v.tasks.select("path", "line", "marker", "symbol", "indent", "description", "block_id"))
query("b30_task_metadata", "SELECT path, line, due, priority, tid FROM tk", _TASKS)(lambda v: v.tasks.select("path", "line", F.col("metadata")["due"].alias("due"), F.col("metadata")["priority"].alias("priority"), F.col("metadata")["id"].alias("tid")))
query("b32_task_parents", "SELECT a.path, a.line, max(b.line) AS parent_line FROM tk a LEFT JOIN tk b ON a.path = b.path AND b.line < a.line AND b.indent < a.indent AND NOT EXISTS (SELECT 1 FROM tk c WHERE c.path = a.path AND c.line > b.line AND c.line < a.line AND c.indent <= b.indent) GROUP BY ALL", _TASKS)(lambda v: v.tasks.select("path", "line", "parent_line"))
query("b33_task_tree_nodes", r"SELECT path, line, (length(regexp_extract(txt, '^(\s*)', 1)) // 4) AS depth, CASE WHEN regexp_matches(txt, '^\s*[-*+] \[.\] ') THEN 'task' ELSE 'text' END AS node_type FROM ln WHERE regexp_matches(txt, '^\s*[-*+] ') AND (regexp_matches(txt, '^\s*[-*+] \[.\] ') OR starts_with(txt, ' ')) AND line > (SELECT max(h.line) FROM ln h WHERE h.path = ln.path AND h.txt = '## Tasks')", _LINES)(lambda v: extract.task_nodes(v.notes).select("path", "line", "depth", "node_type"))
query("b34_format_task", "SELECT path, line, marker || ' ' || symbol || ' ' || description || coalesce(' 📅 ' || due, '') || coalesce(' 🆔 ' || tid, '') || CASE WHEN priority = 'highest' THEN ' 🔺 🔼' ELSE '' END AS text FROM tk", _TASKS)(lambda v: v.tasks.select("path", "line", rewrite.format_tasks(v.tasks).alias("text")))
query("b34_format_tree", r"SELECT path, string_agg(repeat('    ', indent) || text, chr(10) ORDER BY line) AS tree FROM (SELECT path, line, indent, marker || ' ' || symbol || ' ' || description || coalesce(' 📅 ' || due, '') || coalesce(' 🆔 ' || tid, '') || CASE WHEN priority = 'highest' THEN ' 🔺 🔼' ELSE '' END AS text FROM tk UNION ALL SELECT path, line, length(regexp_extract(txt, '^(\s*)', 1)) // 4, ltrim(txt) FROM ln WHERE txt = '        - note under sub') GROUP BY path", _TASKS)(lambda v: extract.formatted_trees(v.notes))
query("b35_relative_dates", "SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN DATE '2024-03-15' WHEN 1 THEN DATE '2024-03-16' WHEN 2 THEN DATE '2024-03-15' - CAST(7 * (doc_id % 9) AS INTEGER) WHEN 3 THEN DATE '2024-03-15' + CAST(30 * (doc_id % 9) AS INTEGER) END AS STRING) AS day FROM documents")(
    lambda v: v.spark.read.parquet(f"{v.sf_dir}/documents.parquet").select("doc_id", rewrite.relative_date(F.expr("CASE doc_id % 5 WHEN 0 THEN 'Today' WHEN 1 THEN 'tomorrow' WHEN 2 THEN concat('-', doc_id % 9, 'w') WHEN 3 THEN concat('+', doc_id % 9, 'm') ELSE 'soon' END"), F.lit("2024-03-15").cast("date")).alias("day"))
)

# Search.
_AND = "SELECT path, 'path' AS field, NULL AS line, path AS text FROM notes WHERE contains(path, 'src1') AND path IN (SELECT path FROM bl WHERE contains(lower(txt), 'the')) UNION ALL SELECT path, 'content', line, txt FROM bl WHERE contains(path, 'src1') AND contains(lower(txt), 'the')"
query("c12_and", _AND, _BODY)(hits("path:src1 the"))
query("c3_path", "SELECT path, 'path' AS field, CAST(NULL AS BIGINT) AS line, path AS text FROM notes WHERE contains(path, 'src1/')")(hits("path:src1/"))
query("c3_filename", "SELECT path, 'filename' AS field, CAST(NULL AS BIGINT) AS line, regexp_extract(path, '([^/]+)[.]md$', 1) AS text FROM notes WHERE path LIKE '%/Doc 12.md'")(hits('filename:"Doc 12"'))
query("c4_exact_line", "SELECT path, 'content' AS field, line, txt AS text FROM bl WHERE lower(txt) = '## tasks'", _BODY)(hits('"## tasks"'))
query("c4_regex", r"SELECT path, 'content' AS field, line, txt AS text FROM bl WHERE regexp_matches(txt, '(?i)^broken \[\[missing \d+\]\]')", _BODY)(hits(r"/^broken \[\[missing \d+\]\]/"))
query("c5_tag", "SELECT path, 'tag' AS field, min(line) AS line, '#todo' AS text FROM tg WHERE lower(name) = '#todo' GROUP BY path", _TAGS)(hits("tag:TODO"))
query("c6_content", "SELECT path, 'content' AS field, line, txt AS text FROM bl WHERE contains(lower(txt), 'review')", _BODY)(hits("content:review"))
query("c7_section", "SELECT path, 'section:content' AS field, line, txt AS text FROM bl JOIN (SELECT path, min(line) AS first FROM bl WHERE txt = '## Tasks' GROUP BY path) USING (path) WHERE line >= first AND contains(lower(txt), 'review')", _BODY)(hits("section:(review)"))
query("c8_line", "SELECT path, 'line:content' AS field, min(line) AS line, arg_min(txt, line) AS text FROM bl WHERE contains(lower(txt), 'review') AND contains(lower(txt), 'todo') GROUP BY path UNION ALL SELECT path, 'line:content', min(line), arg_min(txt, line) FROM bl WHERE contains(lower(txt), 'review') AND contains(lower(txt), 'todo') GROUP BY path", _BODY)(hits("line:(review todo)"))
query("c9_prop_exists", "SELECT path, 'property:score' AS field, line, value AS text FROM ip WHERE key = 'score'", _PROPS)(hits("property:score"))
query("c10_prop_numeric", "SELECT path, 'property:rating' AS field, 1 AS line, regexp_extract(yaml, '(?m)^rating: (.*)$', 1) AS text FROM ok WHERE CAST(regexp_extract(yaml, '(?m)^rating: (.*)$', 1) AS INT) >= 3", _LINES)(hits("property:rating>=3"))
query("c10_prop_not_equal", "SELECT path, 'property:status' AS field, 1 AS line, regexp_extract(yaml, '(?m)^status: (.*)$', 1) AS text FROM ok WHERE regexp_extract(yaml, '(?m)^status: (.*)$', 1) <> 'done'", _LINES)(hits("property:status!=DONE"))
query("c13_or", "SELECT path, 'path' AS field, NULL AS line, path AS text FROM notes WHERE contains(path, 'src2/') UNION ALL SELECT path, 'content', line, txt FROM bl WHERE NOT contains(path, 'src2/') AND contains(lower(txt), 'broken')", _BODY)(hits("path:src2/ OR broken"))
query("c14_not", "SELECT path, 'not' AS field, NULL AS line, NULL AS text FROM notes WHERE path NOT IN (SELECT path FROM bl WHERE contains(lower(txt), 'broken'))", _BODY)(hits("-broken"))
query("c15_tag_group", "SELECT path, 'tag' AS field, min(line) AS line, name AS text FROM tg WHERE name IN ('#lang/de', '#lang/fr') GROUP BY path, name", _TAGS)(hits("tag:(lang/de OR lang/fr)"))
query("c18_limit", "SELECT path, path || ' (' || count(*) || ' matches: content)' AS summary FROM bl WHERE contains(lower(txt), 'broken') GROUP BY path ORDER BY string_split(path, '/') LIMIT 20", _BODY)(lambda v: search.summary(search.search(v.notes, "broken", 20)))

# The link graph.
query("d1_aliases", r"SELECT path, lower(regexp_extract(yaml, 'aliases:\n  - (.*)\n', 1)) AS alias FROM ok", _LINES)(lambda v: graph.aliases(v.frontmatter))
query("d3_resolve", "SELECT frm AS source, target, line, to_path AS resolved_path FROM eg", _EDGES)(lambda v: v.edges.select(F.col("from").alias("source"), "target", "line", "resolved_path"))
query("d4_outgoing", "SELECT frm AS source, ord, target, target_key, context, line, start_col, embed FROM eg", _EDGES)(lambda v: extract.edges(v.notes).select(F.col("from").alias("source"), "ord", "target", "target_key", "context", "line", "start_col", "embed"))
query("d6_context_hist", "SELECT split_part(context, ':', 1) AS context, count(*) AS links FROM eg GROUP BY 1", _EDGES)(lambda v: graph.context_counts(v.edges))
query("d8_incoming", "SELECT DISTINCT st.to_path AS path, frm AS source, line, start_col FROM eg JOIN st ON target_key IN (stem, regexp_replace(lower(st.to_path), '[.]md$', ''))", _EDGES)(lambda v: graph.incoming(v.edges, v.notes).select("path", F.col("from").alias("source"), "line", "start_col"))
query("d10_resolve_note", "SELECT query, CASE WHEN query = 'Doc 2' THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN query <> 'Doc 2' THEN path END AS path, CASE WHEN query <> 'Doc 2' THEN 'name' END AS match_type FROM (SELECT regexp_extract(path, '([^/]+)[.]md$', 1) AS query, path FROM notes) UNION ALL SELECT 'Gone', 'not_found', NULL, NULL UNION ALL SELECT 'x/Hub', 'found', 'x/Hub.md', 'path' UNION ALL SELECT 'hub-ALIAS', 'found', 'x/Hub.md', 'alias'")(
    lambda v: graph.resolve_note(v.notes, v.frontmatter, v.notes.select(parts.name().alias("query")).unionByName(v.spark.sql("SELECT * FROM VALUES ('Gone'), ('x/Hub'), ('hub-ALIAS') AS asked(query)"))).select("query", "status", "path", "match_type")
)
query("d13_backlinks", "SELECT DISTINCT st.to_path AS path, frm AS source, line FROM eg JOIN st ON target_key IN (stem, regexp_replace(lower(st.to_path), '[.]md$', '')) WHERE NOT starts_with(context, 'frontmatter')", _EDGES)(lambda v: graph.backlinks(v.edges, v.notes, False).select("path", F.col("from").alias("source"), "line"))
query("d14_in_degree", "SELECT to_path AS path, count(*) AS links, count(DISTINCT frm) AS sources FROM eg WHERE to_path IS NOT NULL AND NOT embed GROUP BY 1", _EDGES)(lambda v: graph.in_degree(v.edges))
query("d14_out_degree_top5", "SELECT frm AS path, count(*) AS links FROM eg WHERE to_path IS NOT NULL AND NOT embed GROUP BY 1 ORDER BY links DESC, string_split(frm, '/') LIMIT 5", _EDGES)(lambda v: graph.out_degree(v.edges).orderBy(F.desc("links"), F.split("path", "/")).limit(5))
query("d14_orphans", "SELECT path FROM notes WHERE path NOT IN (SELECT to_path FROM eg WHERE to_path IS NOT NULL AND to_path <> frm)", _EDGES)(lambda v: graph.orphans(v.notes, v.edges))

# Properties and identity.
_FRONT = " UNION ALL ".join([
    *(f"SELECT path, '{k}', regexp_extract(yaml, '(?m)^{k}: \"?([^\"\\n]*)\"?$', 1) FROM ok" for k in ("title", "rating", "status", "related")),
    *(f"SELECT path, '{k}', rtrim(regexp_replace(regexp_extract(yaml, '{k}:\\n((?:  - .*\\n)+)', 1), '(?m)^  ', '', 'g'), chr(10)) FROM ok" for k in ("tags", "aliases")),
    r"SELECT path, 'marginalia', 'id: ' || regexp_extract(yaml, '\n  id: (.*)\n', 1) || chr(10) || 'created: ' || regexp_extract(yaml, '\n  created: .(.*).$', 1) FROM ok WHERE contains(yaml, 'marginalia:')",
])
query("e1_merged_props", f"SELECT path, key, string_agg(value, ',' ORDER BY line, start_col) AS vals FROM ip GROUP BY 1, 2 UNION ALL {_FRONT}", _PROPS)(lambda v: properties.merged(v.notes, v.frontmatter, v.inline).select("path", "key", F.array_join("values", ",").alias("vals")))
query("e2_property", "SELECT path, value FROM ip WHERE key = 'owner'", _PROPS)(lambda v: properties.one(v.notes, "owner").select("path", F.col("values")[0].alias("value")))
query("e6_set_inline", r"SELECT path, regexp_replace(content, '\[score:: \d+\]', '[score::0]') AS content FROM notes")(lambda v: rewrite.set_property(v.notes, "score", 0, "inline").select("path", "content"))
query("e4_rename_inline", r"SELECT path, regexp_replace(content, '\[owner::', '[holder::') AS content FROM notes")(lambda v: rewrite.rename_property(v.notes, "owner", "holder", "inline").select("path", "content"))
_EDITED = (
    r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(fm.yaml, '(?m)^title: "(.*)"$', 'title: \1'), '(?m)^  - ', '- ', 'g'),"""
    r""" '(?m)^related: "(.*)"$', 'related: ' || chr(39) || '\1' || chr(39)), '(?m)^  created: "(.*)"$', '  created: \1')"""
)
query("e5_set_frontmatter", f"SELECT path, CASE WHEN NOT has THEN '---' || chr(10) || 'reviewed: true' || chr(10) || '---' || chr(10) || content WHEN path NOT IN (SELECT path FROM ok) THEN content ELSE '---' || chr(10) || {_EDITED} || chr(10) || 'reviewed: true' || chr(10) || '---' || chr(10) || body END AS content, has AND path NOT IN (SELECT path FROM ok) AS failed FROM notes JOIN fm USING (doc_id, path) JOIN bd USING (doc_id, path)", _BODY)(
    lambda v: rewrite.set_property(v.notes, "reviewed", True).select("path", "content", F.col("error").isNotNull().alias("failed"))
)
query("g2_metadata", r"SELECT path, regexp_extract(yaml, '\n  id: (.*)\n', 1) AS id, regexp_extract(yaml, '\n  created: .(.*).$', 1) AS created FROM ok WHERE contains(yaml, 'marginalia:')", _LINES)(lambda v: properties.metadata(v.frontmatter))
query("g3_find_by_id", "SELECT path FROM ok WHERE contains(yaml, '  id: id-16' || chr(10))", _LINES)(lambda v: properties.find_by_id(v.frontmatter, "id-16"))

# Rewrites.
query("f3_with_body", "SELECT path, CASE WHEN has THEN '---' || chr(10) || yaml || chr(10) || '---' || chr(10) ELSE '' END || 'new' AS content FROM fm", _LINES)(lambda v: v.notes.select("path", rewrite.with_body(F.lit("new")).alias("content")))
query("f4_replace_first", "SELECT path, CASE WHEN strpos(content, 'Doc') > 0 THEN substr(content, 1, strpos(content, 'Doc') - 1) || 'Note' || substr(content, strpos(content, 'Doc') + 3) ELSE content END AS content FROM notes")(lambda v: v.notes.select("path", rewrite.replace("Doc", "Note", True).alias("content")))
query("f5_toggle_tasks", "SELECT path, replace(replace(replace(content, '- [ ] Review', '- [@] Review'), '    - [x] Sub', '    - [ ] Sub'), '- [@] Review', '- [x] Review') AS content FROM notes")(lambda v: v.notes.select("path", rewrite.toggle_tasks().alias("content")))
query("f6_remove_frontmatter", "SELECT path, body AS content FROM bd", _BODY)(lambda v: v.notes.select("path", rewrite.remove_frontmatter().alias("content")))

# Reports.
query("h1_list_filters", "SELECT ok.path FROM ok WHERE regexp_matches(yaml, '(?m)^status: done$') AND path IN (SELECT path FROM tg WHERE name = '#lang/en')", _TAGS)(lambda v: health.listing(v.notes, tags=v.tags, with_tags=("lang/en",), frontmatter=v.frontmatter, where=("status", "done")).select("path"))
query("h3_tag_prefix", "SELECT DISTINCT path FROM tg WHERE starts_with(name, '#lang/')", _TAGS)(lambda v: health.tagged(v.notes, v.tags, every=("lang",)).select("path"))
query("h6_embeds", f"SELECT frm AS source, line, target, CASE WHEN {_MEDIA} THEN 'image' ELSE 'note' END AS media_type, CASE WHEN {_MEDIA} THEN 400 END AS width, CASE WHEN {_MEDIA} THEN 300 END AS height FROM eg WHERE embed", _EDGES)(lambda v: graph.embeds(v.edges).select(F.col("from").alias("source"), "line", "target", "media_type", "width", "height"))
query("h7_tag_counts_nested", "SELECT name, count(*) AS n, count(DISTINCT path) AS notes FROM (SELECT path, name FROM tg UNION ALL SELECT path, regexp_extract(name, '^([^/]*)/', 1) FROM tg WHERE contains(name, '/')) GROUP BY name", _TAGS)(lambda v: health.tag_counts(v.tags, nested=True))
query("h8_block_refs", "SELECT to_path AS path, block_id, frm AS source, line FROM eg WHERE block_id IS NOT NULL AND to_path IS NOT NULL", _EDGES)(lambda v: graph.block_refs(v.edges).select(F.col("resolved_path").alias("path"), "block_id", F.col("from").alias("source"), "line"))
query("h9_section", "SELECT path, string_agg(txt, chr(10) ORDER BY line) AS section FROM ln0 JOIN (SELECT path, min(line) AS first FROM ln WHERE txt = '## Tasks' GROUP BY path) USING (path) JOIN (SELECT path, max(line) AS last FROM ln0 GROUP BY path) USING (path) WHERE line >= first AND line < last GROUP BY path", _LINES)(lambda v: health.sections(v.notes, v.headings, slug="tasks").select("path", "section"))
query("h10_task_filters", "SELECT path, line FROM tk WHERE symbol = '[ ]' AND due < '2024-05-01' AND priority = 'highest' AND block_id IS NOT NULL", _TASKS)(lambda v: health.tasks_where(v.tasks, symbol=" ", dates=(("due", "before", "2024-05-01"),), priority="highest", has_block=True).select("path", "line"))
query("h12_info", f"SELECT (SELECT count(*) FROM notes) AS note_count, CAST((SELECT sum(strlen(content)) FROM notes) AS BIGINT) AS total_size, (SELECT count(*) FROM eg) AS link_count, (SELECT count(*) FROM eg WHERE to_path IS NULL AND NOT {_MEDIA}) AS broken_link_count, (SELECT count(DISTINCT name) FROM tg) AS tag_count, (SELECT count(*) FROM ln WHERE regexp_matches(txt, '^\\s*([-*+]|\\d+\\.) \\[.\\] .*$')) AS task_count, (SELECT count(*) FROM notes WHERE path NOT IN (SELECT to_path FROM eg WHERE to_path IS NOT NULL AND to_path <> frm)) AS orphan_count", _EDGES + _TAGS.removeprefix(_LINES))(lambda v: health.info(v.notes, v.edges, v.tags, v.tasks))
query("h12_by_folder", "SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS notes FROM notes GROUP BY 1")(lambda v: health.by_folder(v.notes))
query("h12_top_linked", "SELECT to_path AS path, count(*) AS links, count(DISTINCT frm) AS sources FROM eg WHERE to_path IS NOT NULL AND NOT embed GROUP BY 1 ORDER BY links DESC, string_split(to_path, '/') LIMIT 10", _EDGES)(lambda v: health.top_linked(v.edges))


def _lint(rule: str, sql: str, relations: str) -> None:
    query("h13_lint_" + rule.replace("-", "_"), sql, relations)(lambda v: health.lint(v.notes, v.frontmatter, v.edges, v.headings, v.blocks, only=(rule,)).select("rule", "path", "line", "detail"))


_lint("broken-links", f"SELECT 'broken-links' AS rule, frm AS path, line, target AS detail FROM eg WHERE to_path IS NULL AND NOT embed AND NOT {_MEDIA}", _EDGES)
_lint("broken-embeds", f"SELECT 'broken-embeds' AS rule, frm AS path, line, target AS detail FROM eg WHERE to_path IS NULL AND embed AND NOT {_MEDIA}", _EDGES)
_lint("broken-heading-links", "SELECT 'broken-heading-links' AS rule, frm AS path, line, target || '#' || heading AS detail FROM eg WHERE heading IS NOT NULL AND to_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hd WHERE hd.path = to_path AND lower(hd.text) = lower(eg.heading))", _EDGES + _HEADINGS.removeprefix(_LINES))
_lint("broken-block-refs", r"SELECT 'broken-block-refs' AS rule, frm AS path, line, target || '#^' || block_id AS detail FROM eg WHERE block_id IS NOT NULL AND to_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ln WHERE ln.path = to_path AND ends_with(ln.txt, ' ^' || eg.block_id))", _EDGES)
_lint("orphans", "SELECT 'orphans' AS rule, path, CAST(NULL AS BIGINT) AS line, 'no note links here' AS detail FROM notes WHERE path NOT IN (SELECT to_path FROM eg WHERE to_path IS NOT NULL AND to_path <> frm)", _EDGES)
_lint("duplicate-aliases", r"SELECT 'duplicate-aliases' AS rule, path, CAST(NULL AS BIGINT) AS line, alias AS detail FROM (SELECT path, lower(regexp_extract(yaml, 'aliases:\n  - (.*)\n', 1)) AS alias, count(*) OVER (PARTITION BY lower(regexp_extract(yaml, 'aliases:\n  - (.*)\n', 1))) AS n FROM ok) WHERE n > 1", _LINES)
_lint("duplicate-block-ids", r"SELECT 'duplicate-block-ids' AS rule, path, line, id AS detail FROM (SELECT path, line, regexp_extract(txt, '\s\^([a-zA-Z0-9_-]+)\s*$', 1) AS id, count(*) OVER (PARTITION BY path, regexp_extract(txt, '\s\^([a-zA-Z0-9_-]+)\s*$', 1)) AS n FROM ln WHERE regexp_matches(txt, '\s\^[a-zA-Z0-9_-]+\s*$')) WHERE n > 1", _LINES)
_lint("empty-notes", "SELECT 'empty-notes' AS rule, path, CAST(NULL AS BIGINT) AS line, 'no body' AS detail FROM bd WHERE trim(body) = ''", _BODY)
_lint("missing-frontmatter", "SELECT 'missing-frontmatter' AS rule, path, CAST(NULL AS BIGINT) AS line, 'no frontmatter' AS detail FROM fm WHERE NOT has", _LINES)
_lint("invalid-frontmatter", "SELECT 'invalid-frontmatter' AS rule, path, 1 AS line, 'frontmatter doesn''t parse' AS detail FROM fm WHERE has AND len(regexp_extract_all(yaml, '(?m)^status:')) > 1", _LINES)
_lint("unresolved-aliases", r"SELECT 'unresolved-aliases' AS rule, path, CAST(NULL AS BIGINT) AS line, lower(regexp_extract(yaml, 'aliases:\n  - (.*)\n', 1)) AS detail FROM ok WHERE lower(regexp_extract(yaml, 'aliases:\n  - (.*)\n', 1)) IN (SELECT lower(regexp_extract(path, '([^/]+)[.]md$', 1)) FROM notes)", _LINES)
query("h15_broken_links", f"SELECT frm AS source, target, line FROM eg WHERE to_path IS NULL AND NOT {_MEDIA}", _EDGES)(lambda v: graph.broken_links(v.edges).select(F.col("from").alias("source"), "target", "line"))
query("h16_replace_regex", r"SELECT path, regexp_replace(content, 'Doc (\d+)', 'Note \1', 'g') AS content FROM notes")(lambda v: v.notes.select("path", F.regexp_replace("content", r"Doc (\d+)", "Note $1").alias("content")))
query("h17_rename_with_links", r"SELECT CASE WHEN path LIKE '%/Doc 10.md' THEN 'archive/Old 10.md' ELSE path END AS path, regexp_replace(content, '\[\[Doc 10([\]|#])', '[[Old 10\1', 'g') AS content FROM notes")(
    lambda v: rewrite.rename_with_links(v.notes, v.edges, v.notes.where("path LIKE '%/Doc 10.md'").select("path", F.lit("archive/Old 10.md").alias("new_path")))
)
query("h19_cypher", "SELECT 'node' AS kind, 'CREATE (:Note {path: ''' || path || ''', name: ''' || regexp_extract(path, '([^/]+)[.]md$', 1) || '''})' AS statement FROM notes UNION ALL SELECT 'edge', 'MATCH (a:Note {path: ''' || frm || '''}), (b:Note {path: ''' || to_path || '''}) CREATE (a)-[:LINKS_TO {context: ''' || context || '''}]->(b)' FROM eg WHERE to_path IS NOT NULL", _EDGES)(lambda v: graph.cypher(v.notes, v.edges))
query("h19_json_ld", "SELECT path, '{\"@type\":\"Note\",\"@id\":\"' || path || '\",\"name\":\"' || regexp_extract(path, '([^/]+)[.]md$', 1) || '\",\"links\":[' || coalesce(links, '') || ']}' AS json FROM notes LEFT JOIN (SELECT frm AS path, string_agg('\"' || to_path || '\"', ',' ORDER BY to_path) AS links FROM (SELECT DISTINCT frm, to_path FROM eg WHERE to_path IS NOT NULL) GROUP BY frm) USING (path)", _EDGES)(lambda v: graph.json_ld(v.notes, v.edges))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, make=make: wide(make(Vault(spark, sf_dir)))) for name, (make, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
