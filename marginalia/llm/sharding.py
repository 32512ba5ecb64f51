"""Operator 10: shards that each match the mixture of sources, by stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SHARDS, SEED = 64, 2024
#: Rows that rank together, bytes that are sorted together, and rows of the table of cuts that are broadcast.
RANKED_ROWS = 250_000
SLICE_BYTES = 32 << 20
BROADCAST_CUTS = 200_000


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`docs` with `shard` and `position`: a seeded shuffle in which each shard has every source's share.

    Within each source rows are ordered by the MD5 of the seed and doc_id, and rank r of n
    has the fraction (r - 1/2) / n.  All rows sorted by that fraction, then by source, are
    cut into intervals of fractions of equal width: a shard has n / shards rows of each
    source, give or take one.  Position counts from 1 within the shard, in that order.

    Rows of a source with the same doc_id have the same rank, the least; the text decides
    their order.  A null source is a source of its own, a null doc_id counts as empty, and a
    null text is a text like others.  Columns of `docs` named shard or position are
    replaced; all others are kept.  An empty table gives an empty table.

    No task holds a whole source or a whole shard: ranks are counted by ranges of the MD5,
    over ids alone, and give the place of every cut; the full rows then move once, to
    slices of shards of SLICE_BYTES of text, each in a task of its own.  Beyond BROADCAST_CUTS
    cuts they move once more before that, to be joined with them.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "position")]
    k_, s_, p_, cuts_, cut_, slice_, at_ = (scratch.free_name(docs, c) for c in ("k_", "s_", "p_", "cuts_", "cut_", "slice_", "at_"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = docs.select(*names).withColumn(k_, key)
    narrow = keyed.select(F.col("source").alias("s"), F.col(k_).alias("key"))
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    digits = 1
    while total / 16**digits > RANKED_ROWS:
        digits += 1
    part = lambda k: F.substring(k, 1, digits)
    slices = max(1, -(-size // (SLICE_BYTES * shards)))
    narrow = narrow.withColumn("part", part(F.col("key")))
    counts = narrow.groupBy("s", "part").agg(F.count("*").alias("c"))
    by_source = Window.partitionBy("s")
    before = counts.select("s", "part", (F.sum("c").over(by_source.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(by_source).alias("n"))
    same = (F.col("x.s").eqNullSafe(F.col("y.s"))) & (F.col("x.part") == F.col("y.part"))
    rank = F.col("before") + F.rank().over(Window.partitionBy("s", "part").orderBy("key"))
    ranked = narrow.alias("x").join(before.alias("y"), same).select("x.s", "x.part", "key", "before", "n").withColumn("rank", rank)
    ranked = ranked.withColumn("slice", F.expr(f"((2 * rank - 1) * {shards * slices}L) div (2 * n)"))
    cuts = scratch.written(ranked.groupBy("s", "part", "slice").agg(F.min("key").alias("low"), F.min("rank").alias("rank"), F.first("n").alias("n"), F.count("*").alias("c")), "cuts")
    shard = F.expr(f"slice div {slices}")
    filled = cuts.groupBy("slice").agg(F.sum("c").alias("c")).withColumn("shard", shard)
    offsets = filled.select("slice", (F.sum("c").over(Window.partitionBy("shard").orderBy("slice")) - F.col("c")).alias("offset"))
    table = cuts.join(offsets, "slice").groupBy("s", "part").agg(F.sort_array(F.collect_list(F.struct("low", "slice", "rank", "n", "offset"))).alias("cuts"))
    table = scratch.written(table, "places").withColumnsRenamed({"s": s_, "part": p_, "cuts": cuts_})
    held = cuts.count()
    placed = (
        keyed.join(F.broadcast(table) if held <= BROADCAST_CUTS else table, F.col("source").eqNullSafe(F.col(s_)) & (part(F.col(k_)) == F.col(p_)))
        .withColumn(cut_, F.element_at(F.filter(cuts_, lambda c: c["low"] <= F.col(k_)), -1))
        .select(*names, k_, p_, cut_)
        .withColumn(slice_, F.col(cut_)["slice"].cast("int"))
    )
    # One slice is one task.
    moved = placed.repartitionById(shards * slices, slice_)
    first = Window.partitionBy(slice_, "source", p_).orderBy(k_)
    at = (2 * (F.col(cut_)["rank"] + F.rank().over(first) - 1) - 1) / (2.0 * F.col(cut_)["n"])
    order = Window.partitionBy(slice_).orderBy(F.col(at_).asc_nulls_first(), F.col("source").asc_nulls_first(), k_, F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered = moved.withColumn(at_, at).withColumn("position", (F.col(cut_)["offset"] + F.row_number().over(order)).cast("long"))
    return ordered.select(*names, F.expr(f"{slice_} div {slices}").cast("long").alias("shard"), "position")


SQL = f"""
WITH k AS (SELECT *, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY key) AS rk, count(*) OVER (PARTITION BY source) AS n FROM k
), s AS (SELECT *, ((2 * rk - 1) * {SHARDS}) // (2 * n) AS shard FROM r)
SELECT doc_id, text, lang, source, n_chars, CAST(shard AS BIGINT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY (2 * rk - 1) / (2.0 * n), source NULLS FIRST, key, doc_id NULLS FIRST, text NULLS FIRST) AS position
FROM s
"""
