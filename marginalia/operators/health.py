"""Reports over a whole collection: lists, tags, sections, tasks, statistics, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, notes as parts

RULES = (
    "broken-links", "broken-embeds", "broken-heading-links", "broken-block-refs", "orphans", "duplicate-aliases",
    "duplicate-block-ids", "empty-notes", "missing-frontmatter", "invalid-frontmatter", "unresolved-aliases",
)


def bare(tag: Column) -> Column:
    return F.regexp_replace(tag, r"\A#+", "")


def unique_tags(tags: DataFrame) -> DataFrame:
    """(path, name, ord): each note's tags once, where they first stand."""
    return tags.groupBy("path", "name").agg(F.min("ord").alias("ord"))


def tag_roots(tags: DataFrame) -> DataFrame:
    """(path, root, tags): a note's tags by their first part, in order."""
    root = F.concat(F.lit("#"), F.split_part(bare(F.col("name")), F.lit("/"), F.lit(1)))
    return tags.groupBy("path", root.alias("root")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda t: t["name"]).alias("tags"))


def tag_ancestors(name: Column) -> Column:
    """The tags above a nested one, outermost first."""
    cut = F.split(bare(name), "/")
    return F.when(F.size(cut) > 1, F.transform(F.sequence(F.lit(1), F.size(cut) - 1), lambda n: F.concat(F.lit("#"), F.array_join(F.slice(cut, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))


def tag_parent(name: Column) -> Column:
    """The tag right above, or null."""
    return F.when(F.contains(name, F.lit("/")), F.regexp_replace(name, r"/[^/]*\z", ""))


def tag_counts(tags: DataFrame, nested: bool = False) -> DataFrame:
    """(name, n, notes): uses of each tag and notes that have it; nested ones count for those above them too."""
    if nested:
        tags = tags.withColumn("name", F.explode(F.concat(tag_ancestors(F.col("name")), F.array("name"))))
    return tags.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("path").alias("notes"))


def tagged(notes: DataFrame, tags: DataFrame, every: tuple[str, ...] = (), some: tuple[str, ...] = (), none: tuple[str, ...] = ()) -> DataFrame:
    """Notes that have all of `every`, any of `some` and none of `none`; a tag has those nested below it, and #x/* only these."""

    def hit(wanted: str) -> Column:
        wanted = wanted.lstrip("#")
        own = lambda t: F.lower(bare(t))
        if wanted.endswith("/*"):
            return F.exists("tags", lambda t: own(t).startswith(wanted[:-1].lower()))
        return F.exists("tags", lambda t: (own(t) == wanted.lower()) | own(t).startswith(wanted.lower() + "/"))

    have = tags.groupBy("path").agg(F.collect_set("name").alias("tags"))
    out = notes.join(have, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    for t in every:
        out = out.where(hit(t))
    if some:
        any_ = hit(some[0])
        for t in some[1:]:
            any_ = any_ | hit(t)
        out = out.where(any_)
    for t in none:
        out = out.where(~hit(t))
    return out.drop("tags")


def listing(
    notes: DataFrame,
    glob: str | None = None,
    tags: DataFrame | None = None,
    with_tags: tuple[str, ...] = (),
    frontmatter: DataFrame | None = None,
    where: tuple[str, str] | None = None,
    edges: DataFrame | None = None,
    has_links: bool = False,
    has_backlinks: bool = False,
    orphans: bool = False,
    sort: str = "path",
    reverse: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Notes by glob, tags, a frontmatter value and links; sort: path, name, modified or created, by columns of `notes`."""
    out = notes if glob is None else notes.where(F.col("path").rlike(parts.glob_regex(glob)))
    if with_tags:
        out = tagged(out, tags, every=with_tags)
    if where is not None:
        fits = frontmatter.where("status = 'ok'").where(F.col("fm_text")[where[0]] == where[1]).select("path")
        out = out.join(fits, "path", "left_semi")
    if has_links:
        out = out.join(edges.where("NOT embed").select(F.col("from").alias("path")).distinct(), "path", "left_semi")
    if has_backlinks:
        out = out.join(edges.where("resolved_path is not null and resolved_path != `from`").select(F.col("resolved_path").alias("path")).distinct(), "path", "left_semi")
    if orphans:
        out = out.join(graph.orphans(notes, edges), "path", "left_semi")
    key = F.split("path", "/") if sort == "path" else parts.name() if sort == "name" else F.col(sort)
    out = out.orderBy(key.desc() if reverse else key, F.split("path", "/"))
    return out if limit is None else out.limit(limit)


def section_ranges(notes: DataFrame, headings: DataFrame) -> DataFrame:
    """(path, slug, text, level, first, last): a heading's lines up to the next heading of its level or above."""
    size = parts.stats(notes).select("path", F.col("lines").alias("n"))
    # The next heading at most as deep, found among later ones of the note: collected once for each note.
    all_ = headings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "level", "text", "slug"))).alias("h"))
    rows = all_.join(size, "path").select("path", "n", "h", F.posexplode("h").alias("i", "x"))
    later = F.filter(F.slice("h", F.col("i") + 2, F.size("h")), lambda y: y["level"] <= F.col("x.level"))
    return rows.select("path", "x.slug", "x.text", "x.level", F.col("x.line").alias("first"), F.coalesce(F.get(later, F.lit(0))["line"] - 1, F.col("n").cast("int")).alias("last"))


def sections(notes: DataFrame, headings: DataFrame, slug: str | None = None, text: str | None = None, content_only: bool = False) -> DataFrame:
    """(path, slug, first, last, section): the text of the first section of each note with that slug, or that title in any case."""
    ranges = section_ranges(notes, headings)
    ranges = ranges.where(F.col("slug") == slug) if slug is not None else ranges.where(F.lower("text") == text.lower()) if text is not None else ranges
    if slug is not None or text is not None:
        ranges = ranges.groupBy("path").agg(F.min_by(F.struct("slug", "first", "last"), "first").alias("r")).select("path", "r.*")
    begin = F.col("first") + (1 if content_only else 0)
    cut = F.slice(F.split("content", "\n"), begin, F.greatest(F.col("last") - begin + 1, F.lit(0)))
    return notes.join(ranges, "path").select("path", "slug", "first", "last", F.array_join(cut, "\n").alias("section"))


def heading_parents(headings: DataFrame) -> DataFrame:
    """`headings` with parent_line: the nearest earlier heading of a lesser level."""
    all_ = headings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "level", "text", "slug"))).alias("h"))
    rows = all_.select("path", "h", F.posexplode("h").alias("i", "x"))
    above = F.filter(F.slice("h", F.lit(1), F.col("i")), lambda y: y["level"] < F.col("x.level"))
    return rows.select("path", "x.text", "x.level", "x.line", "x.slug", F.when(F.size(above) > 0, F.element_at(above, -1)["line"]).alias("parent_line"))


def tasks_where(
    tasks: DataFrame,
    symbol: str | None = None,
    dates: tuple[tuple[str, str, str], ...] = (),
    has: tuple[str, ...] = (),
    priority: str | None = None,
    contains: str | None = None,
    links_to: str | None = None,
    tag: str | None = None,
    has_block: bool | None = None,
    block: str | None = None,
    exact_links: bool = False,
) -> DataFrame:
    """Tasks by symbol, dates as (field, 'before' | 'after' | 'on' | 'until' | 'since', ISO date), fields, text, link, tag, and block id."""
    if symbol is not None:
        tasks = tasks.where(F.col("symbol") == f"[{symbol}]")
    for name, how, day in dates:
        value = F.col("metadata")[name]
        tasks = tasks.where({"before": value < day, "after": value > day, "on": value == day, "until": value <= day, "since": value >= day}[how])
    for name in has:
        tasks = tasks.where(F.map_contains_key("metadata", name))
    if priority is not None:
        tasks = tasks.where(F.col("metadata")["priority"] == priority)
    if contains is not None:
        tasks = tasks.where(F.contains(F.lower("description"), F.lit(contains.lower())))
    if links_to is not None:
        if exact_links:
            tasks = tasks.where(F.exists("links", lambda x: x["to"] == links_to))
        else:
            goal = links_to.lower().removesuffix(".md")
            tasks = tasks.where(F.exists("links", lambda x: F.regexp_replace(F.lower(x["to"]), r"\.md\z", "") == goal))
    if tag is not None:
        tasks = tasks.where(F.exists("tags", lambda t: F.lower(bare(t)) == tag.lstrip("#").lower()))
    if has_block is not None:
        tasks = tasks.where(F.col("block_id").isNotNull() if has_block else F.col("block_id").isNull())
    return tasks if block is None else tasks.where(F.col("block_id") == block)


def info(notes: DataFrame, edges: DataFrame, tags: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row of counts of the whole collection."""
    # Notes beside the links that resolve to them, so that edges, the dearest relation, are made once.
    own = notes.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.octet_length("content").cast("long")).alias("size"))
    media = graph.media_type(F.col("target"))
    to = edges.groupBy(F.col("resolved_path").alias("to")).agg(F.count("*").alias("links"), F.count_if(F.col("resolved_path").isNull() & media.isNull()).alias("broken"), F.max(F.col("resolved_path") != F.col("from")).alias("linked"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    counts = own.join(to, F.col("path") == F.col("to"), "full").agg(
        total("n", "note_count"), total("size", "total_size"), total("links", "link_count"), total("broken", "broken_link_count"), total(F.when(~F.coalesce("linked", F.lit(False)), F.col("n")), "orphan_count")
    )
    found = counts.crossJoin(tags.agg(F.countDistinct("name").alias("tag_count"))).crossJoin(tasks.agg(F.count("*").alias("task_count")))
    return found.select("note_count", "total_size", "link_count", "broken_link_count", "tag_count", "task_count", "orphan_count")


def by_folder(notes: DataFrame) -> DataFrame:
    return notes.groupBy(parts.folder().alias("folder")).agg(F.count("*").alias("notes"))


def top_linked(edges: DataFrame, k: int = 10) -> DataFrame:
    return graph.in_degree(edges).orderBy(F.desc("links"), F.split("path", "/")).limit(k)


def _issue(rows: DataFrame, rule: str, path: str, line: Column | None, what: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(path).alias("path"), (line if line is not None else F.lit(None)).cast("int").alias("line"), what.alias("detail"))


def lint(notes: DataFrame, frontmatter: DataFrame, edges: DataFrame, headings: DataFrame, blocks: DataFrame, only: tuple[str, ...] = RULES, ignore: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """What is wrong: (rule, path, line, detail), by the rules of RULES."""
    media = graph.media_type(F.col("target")).isNotNull()
    rules = [r for r in only if r not in ignore]
    found: list[DataFrame] = []
    if "broken-links" in rules:
        found.append(_issue(graph.broken_links(edges).where("NOT embed"), "broken-links", "from", F.col("line"), F.col("target")))
    if "broken-embeds" in rules:
        found.append(_issue(edges.where(F.col("resolved_path").isNull() & F.col("embed") & ~media), "broken-embeds", "from", F.col("line"), F.col("target")))
    if "broken-heading-links" in rules:
        known = headings.select(F.col("path").alias("resolved_path"), F.lower("text").alias("h")).unionByName(headings.select(F.col("path").alias("resolved_path"), F.col("slug").alias("h"))).distinct()
        asked = edges.where("heading is not null and resolved_path is not null").withColumn("h", F.lower("heading"))
        found.append(_issue(asked.join(known, ["resolved_path", "h"], "left_anti"), "broken-heading-links", "from", F.col("line"), F.concat("target", F.lit("#"), "heading")))
    if "broken-block-refs" in rules:
        known = blocks.select(F.col("path").alias("resolved_path"), F.col("id").alias("block_id")).distinct()
        asked = edges.where("block_id is not null and resolved_path is not null")
        found.append(_issue(asked.join(known, ["resolved_path", "block_id"], "left_anti"), "broken-block-refs", "from", F.col("line"), F.concat("target", F.lit("#^"), "block_id")))
    if "orphans" in rules:
        found.append(_issue(graph.orphans(notes, edges), "orphans", "path", None, F.lit("no note links here")))
    if "duplicate-aliases" in rules:
        same = graph.aliases(frontmatter).distinct().withColumn("n", F.count("*").over(Window.partitionBy("alias"))).where("n > 1")
        found.append(_issue(same, "duplicate-aliases", "path", None, F.col("alias")))
    if "duplicate-block-ids" in rules:
        same = blocks.withColumn("n", F.count("*").over(Window.partitionBy("path", "id"))).where("n > 1")
        found.append(_issue(same, "duplicate-block-ids", "path", F.col("line"), F.col("id")))
    if "empty-notes" in rules:
        found.append(_issue(parts.parted(notes).where(~F.col("__body").rlike(r"\S")), "empty-notes", "path", None, F.lit("no body")))
    if "missing-frontmatter" in rules:
        found.append(_issue(frontmatter.where("status = 'absent'"), "missing-frontmatter", "path", None, F.lit("no frontmatter")))
    if "invalid-frontmatter" in rules:
        found.append(_issue(frontmatter.where("status = 'malformed'"), "invalid-frontmatter", "path", F.lit(1), F.lit("frontmatter doesn't parse")))
    if "unresolved-aliases" in rules:
        names = graph.name_index(notes).select(F.col("stem").alias("alias"))
        found.append(_issue(graph.aliases(frontmatter).join(names, "alias", "left_semi"), "unresolved-aliases", "path", None, F.col("alias")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out if glob is None else out.where(F.col("path").rlike(parts.glob_regex(glob)))


def lint_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("rule").agg(F.count("*").alias("issues"))


def annotations(issues: DataFrame) -> DataFrame:
    """Issues as workflow annotations, one line of text each."""
    line = F.when(F.col("line").isNotNull(), F.concat(F.lit(",line="), F.col("line").cast("string"))).otherwise("")
    return issues.select(F.concat(F.lit("::warning file="), "path", line, F.lit("::"), "rule", F.lit(": "), "detail").alias("annotation"))


def with_frontmatter_added(notes: DataFrame, frontmatter: DataFrame) -> DataFrame:
    """A fix: an empty frontmatter for notes that have none."""
    bare_ = frontmatter.where("status = 'absent'").select("path", F.lit(True).alias("__bare"))
    return notes.join(bare_, "path", "left").select("path", F.when(F.col("__bare"), F.concat(F.lit("---\n{}\n---\n"), "content")).otherwise(F.col("content")).alias("content"))


def with_unique_block_ids(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """A fix: the second and later uses of a block id in a note get -1, -2 and so on."""
    nth = F.row_number().over(Window.partitionBy("path", "id").orderBy("line"))
    edits = blocks.withColumn("n", nth).where("n > 1").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("line", F.concat(F.lit("^"), "id", F.lit("-"), (F.col("n") - 1).cast("string"))))).alias("__edits"))
    lines = F.transform(F.split("content", "\n"), lambda x, i: F.when(F.map_contains_key("__edits", i + 1), F.concat(F.regexp_replace(x, r"\^[a-zA-Z0-9_-]+\s*\z", ""), F.col("__edits")[i + 1])).otherwise(x))
    return notes.join(edits, "path", "left").select("path", F.when(F.col("__edits").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("content")).alias("content"))
