"""The link graph: resolution, incoming and outgoing links, ranks, orphans, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import extract
from .notes import name

MEDIA = {
    "image": ("png", "jpg", "jpeg", "gif", "webp", "svg", "bmp"),
    "audio": ("mp3", "wav", "ogg", "m4a", "flac"),
    "video": ("mp4", "webm", "mov", "avi"),
    "pdf": ("pdf",),
}


def order_of(path: str | Column) -> Column:
    """Paths compare by their parts."""
    return F.split(F.col(path) if isinstance(path, str) else path, "/")


def media_type(target: Column) -> Column:
    """image, audio, video or pdf by the extension; null for anything else."""
    extension = F.lower(F.regexp_extract(target, r"\.([^./]+)\z", 1))
    out = F.lit(None).cast("string")
    for kind, known in MEDIA.items():
        out = F.when(extension.isin(*known), kind).otherwise(out)
    return out


def is_media_embed(target: Column) -> Column:
    """The shorter list of embeddable media."""
    return F.lower(target).rlike(r"\.(png|jpe?g|gif|webp|svg|bmp|mp3|wav|ogg|mp4|webm|pdf)\z")


def aliases(frontmatter: DataFrame, scalar: bool = True) -> DataFrame:
    """(alias in lower case, path): of a list, and of a single string if asked for."""
    variant = F.try_parse_json("fm_json")
    listed = F.try_variant_get(variant, "$.aliases", "array<variant>")
    one = F.when(F.schema_of_variant(F.try_variant_get(variant, "$.aliases", "variant")) == "STRING", F.try_variant_get(variant, "$.aliases", "string"))
    items = F.transform(listed, lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")))
    every = F.coalesce(items, F.array(one)) if scalar else F.coalesce(items, F.array().cast("array<string>"))
    rows = frontmatter.where("status = 'ok'").select("path", F.explode(every).alias("alias")).where("alias is not null")
    return rows.select(F.lower("alias").alias("alias"), "path")


def name_index(notes: DataFrame, last: bool = True) -> DataFrame:
    """(stem in lower case, path): of notes with one name the last path, or the first."""
    pick = F.max_by if last else F.min_by
    return notes.groupBy(F.lower(name()).alias("stem")).agg(pick("path", order_of("path")).alias("path"))


def resolved(edges: DataFrame, notes: DataFrame, frontmatter: DataFrame, last: bool = True) -> DataFrame:
    """`edges` with resolved_path: an exact path for targets with a slash, else a note's name, else an alias.

    Three equi-joins with the indexes; whether one is broadcast is left to the sizes that
    adaptive execution sees, so that no job runs while this is planned.
    """
    pick = F.max_by if last else F.min_by
    target = F.split_part("target", F.lit("#"), F.lit(1))
    exact = notes.select(F.col("path").alias("exact"))
    stems = name_index(notes, last).select(F.col("stem").alias("key_s"), F.col("path").alias("by_stem"))
    known = aliases(frontmatter).groupBy(F.col("alias")).agg(pick("path", order_of("path")).alias("by_alias"))
    full = F.when(F.contains(target, F.lit("/")), F.when(target.endswith(".md"), target).otherwise(F.concat(target, F.lit(".md"))))
    stem = F.regexp_replace(F.lower(target), r"\.md\z", "")
    out = edges.withColumn("__f", full).withColumn("__s", stem).withColumn("__a", F.lower(target))
    out = out.join(exact, F.col("__f") == F.col("exact"), "left").join(stems, F.col("__s") == F.col("key_s"), "left")
    out = out.join(known.withColumnRenamed("alias", "key_a"), F.col("__a") == F.col("key_a"), "left")
    return out.select(*edges.columns, F.coalesce("exact", "by_stem", "by_alias").alias("resolved_path"))


def save(notes: DataFrame, path: str, last: bool = True) -> None:
    """Keeps the link graph of a collection as Parquet under `path`: every link with its resolution, extracted once for all reports."""
    resolved(extract.edges(notes), notes, extract.frontmatter(notes), last).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The edges that `save` kept."""
    return spark.read.parquet(path)


def outgoing(notes: DataFrame, frontmatter: DataFrame | None = None) -> DataFrame:
    """All edges with their resolution."""
    return resolved(extract.edges(notes), notes, frontmatter if frontmatter is not None else extract.frontmatter(notes))


def incoming(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Links to each note by the text of their targets: its full path or its name, without .md, in lower case.

    One row for each (path, from, line, start_col); resolution plays no part, so that links
    by alias aren't there.
    """
    strip = lambda c: F.regexp_replace(F.lower(c), r"\.md\z", "")
    keys = notes.select("path", F.posexplode(F.array_distinct(F.array(strip(F.col("path")), F.lower(name())))).alias("key_ord", "key"))
    met = edges.join(keys, F.col("target_key") == F.col("key"))
    first = Window.partitionBy("path", "from", "line", "start_col").orderBy("key_ord", "ord")
    return met.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "key", "key_ord")


def backlinks(edges: DataFrame, notes: DataFrame, with_frontmatter: bool = True) -> DataFrame:
    """Incoming links, one for each source and line; those of the frontmatter only if asked for."""
    out = incoming(edges, notes)
    return (out if with_frontmatter else out.where("NOT startswith(context, 'frontmatter')")).dropDuplicates(["path", "from", "line"])


def resolve_note(notes: DataFrame, frontmatter: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's note: (query, status, path, matches, match_type), status found, not_found or ambiguous.

    An exact path counts first, with or without .md; then all notes of that name or with
    that alias, in any case.
    """
    asked = queries.select("query").distinct().withColumn("__key", F.lower("query"))
    full = F.when(F.col("query").endswith(".md"), F.col("query")).otherwise(F.concat("query", F.lit(".md")))
    tried = asked.select("query", F.explode(F.array_distinct(F.array(full, F.col("query")))).alias("path"))
    exact = tried.join(notes.select("path"), "path").select("query", "path", F.lit("path").alias("match_type"), F.lit(0).alias("rank"))
    named = asked.join(notes.select("path", F.lower(name()).alias("key")), F.col("__key") == F.col("key")).select("query", "path", F.lit("name").alias("match_type"), F.lit(1).alias("rank"))
    known = asked.join(aliases(frontmatter, scalar=False), F.col("__key") == F.col("alias")).select("query", "path", F.lit("alias").alias("match_type"), F.lit(1).alias("rank"))
    every = exact.unionByName(named).unionByName(known).groupBy("query", "path").agg(F.min("rank").alias("rank"), F.min_by("match_type", F.struct("rank", F.col("match_type") != "name")).alias("match_type"))
    best = F.min("rank").over(Window.partitionBy("query"))
    found = every.withColumn("best", best).where("rank = best").groupBy("query").agg(F.sort_array(F.collect_list(F.struct(order_of("path").alias("o"), "path", "match_type"))).alias("m"))
    status = F.when(F.col("m").isNull(), "not_found").when(F.size("m") == 1, "found").otherwise("ambiguous")
    one = F.size("m") == 1
    return asked.join(found, "query", "left").select("query", status.alias("status"), F.when(one, F.col("m")[0]["path"]).alias("path"), F.transform("m", lambda x: x["path"]).alias("matches"), F.when(one, F.col("m")[0]["match_type"]).alias("match_type"))


def in_degree(edges: DataFrame) -> DataFrame:
    """(path, links, sources): resolved links to each note, embeds apart."""
    return edges.where("resolved_path is not null and not embed").groupBy(F.col("resolved_path").alias("path")).agg(F.count("*").alias("links"), F.countDistinct("from").alias("sources"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.where("resolved_path is not null and not embed").groupBy(F.col("from").alias("path")).agg(F.count("*").alias("links"))


def context_counts(edges: DataFrame) -> DataFrame:
    """Links by the kind of place they stand in."""
    return edges.groupBy(F.substring_index("context", ":", 1).alias("context")).agg(F.count("*").alias("links"))


def orphans(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes that no other note's link resolves to."""
    met = edges.where("resolved_path is not null and resolved_path != `from`").select(F.col("resolved_path").alias("path")).distinct()
    return notes.select("path").join(met, "path", "left_anti")


def broken_links(edges: DataFrame) -> DataFrame:
    """Links that resolve to nothing and aren't media."""
    return edges.where(F.col("resolved_path").isNull() & media_type(F.col("target")).isNull())


def block_refs(edges: DataFrame) -> DataFrame:
    """Links to a block of a note that exists."""
    return edges.where("block_id is not null and resolved_path is not null").select("resolved_path", "block_id", "from", "line", "context")


def embeds(edges: DataFrame) -> DataFrame:
    """Embeds with the type of their medium and the size in their alias: (from, line, target, media_type, width, height)."""
    size = F.regexp_extract("alias", r"\A(\d+)(?:x(\d+))?\z", 1)
    high = F.regexp_extract("alias", r"\A(\d+)(?:x(\d+))?\z", 2)
    return edges.where("embed").select("from", "line", "target", F.coalesce(media_type(F.col("target")), F.lit("note")).alias("media_type"), F.when(size != "", size.cast("int")).alias("width"), F.when(high != "", high.cast("int")).alias("height"))


def filtered(edges: DataFrame, context: str | None = None, embeds_only: bool = False, no_embeds: bool = False, media_only: bool = False) -> DataFrame:
    """Edges by the place they stand in (* matches anything) and by what they are."""
    if context is not None:
        edges = edges.where(F.col("context").like(context.replace("%", r"\%").replace("_", r"\_").replace("*", "%")))
    if embeds_only:
        edges = edges.where("embed")
    if no_embeds:
        edges = edges.where("NOT embed")
    return edges.where(media_type(F.col("target")).isNotNull()) if media_only else edges


def wikilink(target: Column, alias: Column, heading: Column, block_id: Column, embed: Column) -> Column:
    """The text of a link: heading before block reference."""
    part = lambda mark, c: F.when(c.isNull(), "").otherwise(F.concat(F.lit(mark), c))
    return F.concat(F.when(embed, "!").otherwise(""), F.lit("[["), target, part("#", heading), part("#^", block_id), part("|", alias), F.lit("]]"))


def cypher(notes: DataFrame, edges: DataFrame, merge: bool = False) -> DataFrame:
    """Statements that build the graph: (kind, statement), notes and resolved links."""
    verb = "MERGE" if merge else "CREATE"
    quote = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    nodes = notes.select(F.lit("node").alias("kind"), F.concat(F.lit(f"{verb} (:Note {{path: "), quote(F.col("path")), F.lit(", name: "), quote(name()), F.lit("})")).alias("statement"))
    joined = edges.where("resolved_path is not null").select(
        F.lit("edge").alias("kind"),
        F.concat(F.lit("MATCH (a:Note {path: "), quote(F.col("from")), F.lit("}), (b:Note {path: "), quote(F.col("resolved_path")), F.lit(f"}}) {verb} (a)-[:LINKS_TO {{context: "), quote(F.col("context")), F.lit("}]->(b)")).alias("statement"),
    )
    return nodes.unionByName(joined)


def json_ld(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, json): each note as a JSON-LD node with the notes it links to."""
    to = edges.where("resolved_path is not null").groupBy(F.col("from").alias("path")).agg(F.array_sort(F.collect_set("resolved_path")).alias("links"))
    rows = notes.select("path", name().alias("name")).join(to, "path", "left")
    body = F.to_json(F.struct(F.lit("Note").alias("@type"), F.col("path").alias("@id"), "name", F.coalesce("links", F.array().cast("array<string>")).alias("links")))
    return rows.select("path", body.alias("json"))
