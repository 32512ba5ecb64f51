"""Properties of notes: frontmatter first, inline ones for keys it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extract


def frontmatter_properties(frontmatter: DataFrame) -> DataFrame:
    """(path, key, value, value_json): every top-level key, its text and its JSON."""
    fields = F.expr("from_json(fm_json, 'map<string,string>')")
    rows = frontmatter.where("status = 'ok'").select("path", fields.alias("json"), F.explode("fm_text").alias("key", "value"))
    return rows.select("path", "key", "value", F.col("json")[F.col("key")].alias("value_json"))


def merged(notes: DataFrame, frontmatter: DataFrame | None = None, inline: DataFrame | None = None) -> DataFrame:
    """(path, key, source, values): a key of the frontmatter hides inline ones; several inline values make a list."""
    front = frontmatter_properties(frontmatter if frontmatter is not None else extract.frontmatter(notes))
    inline = inline if inline is not None else extract.inline_properties(notes)
    # One grouping of both kinds; each is extracted once.
    rows = inline.select("path", "key", F.col("index"), "value", F.lit(False).alias("front"))
    rows = rows.unionByName(front.select("path", "key", F.lit(-1).alias("index"), "value", F.lit(True).alias("front")))
    grouped = rows.groupBy("path", "key").agg(F.array_sort(F.collect_list(F.struct("index", "value", "front"))).alias("all"))
    first = F.col("all")[0]["front"]
    kept = F.when(first, F.slice("all", 1, 1)).otherwise(F.col("all"))
    return grouped.select("path", "key", F.when(first, "frontmatter").otherwise("inline").alias("source"), F.transform(kept, lambda x: x["value"]).alias("values"))


def one(notes: DataFrame, key: str) -> DataFrame:
    """The property `key` of each note that has it."""
    front, inline = extract.frontmatter(notes), extract.inline_properties(notes)
    # Both sides are cut down before they meet.
    return merged(notes, front.where(F.map_contains_key("fm_text", key)), inline.where(F.col("key") == key)).where(F.col("key") == key)


def collected_inline(inline: DataFrame) -> DataFrame:
    """(path, key, values) of inline properties, in order."""
    return inline.groupBy("path", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "value"))), lambda x: x["value"]).alias("values"))


def all_frontmatter(frontmatter: DataFrame, has_key: str | None = None, where: tuple[str, str] | None = None) -> DataFrame:
    """(path, frontmatter): each note's frontmatter as JSON; has_key asks for a key, where for a key with a value (a string's text, other values' JSON)."""
    out = frontmatter.where("status = 'ok'")
    fields = F.from_json("fm_json", "map<string,string>")
    if has_key is not None:
        out = out.where(F.map_contains_key("fm_text", has_key))
    if where is not None:
        out = out.where(fields[where[0]] == where[1])
    return out.select("path", F.col("fm_json").alias("frontmatter"))


def invalid(frontmatter: DataFrame) -> DataFrame:
    """Notes whose frontmatter doesn't parse, with what is wrong."""
    return frontmatter.where("status = 'malformed'").select("path", "fm_error")


def metadata(frontmatter: DataFrame, namespace: str = "marginalia") -> DataFrame:
    """(path, id, created) of notes that have both, as strings, in the mapping of that name or as keys `name-id` and `name-created`."""
    variant = F.try_parse_json("fm_json")

    def string(at: str):
        found = F.try_variant_get(variant, at, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(variant, at, "string"))

    both = F.struct(string(f'$["{namespace}"].id').alias("id"), string(f'$["{namespace}"].created').alias("created"))
    flat = F.struct(string(f'$["{namespace}-id"]').alias("id"), string(f'$["{namespace}-created"]').alias("created"))
    whole = lambda s: F.when(s["id"].isNotNull() & s["created"].isNotNull(), s)
    return frontmatter.where("status = 'ok'").select("path", F.coalesce(whole(both), whole(flat)).alias("m")).where("m is not null").select("path", "m.id", "m.created")


def find_by_id(frontmatter: DataFrame, id_: str, namespace: str = "marginalia") -> DataFrame:
    """The first path, by its parts, whose metadata has the id."""
    return metadata(frontmatter, namespace).where(F.col("id") == id_).orderBy(F.split("path", "/")).limit(1).select("path")
