"""Operator 1: exact deduplication of documents as a stateful stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import scratch

#: Digests that share a state entry, on average.
DIGESTS_PER_ENTRY = 8
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
_STATE = "digests array<binary>, ids array<long>, locators array<string>"
_OUT = "doc_id long, digest binary, locator string, first_id long, first_locator string"


def remember(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Gives each row the first row that had its digest, from this batch or any before."""
    digests, ids, locators = state.get if state.exists else ([], [], [])
    known = {bytes(d): (i, at) for d, i, at in zip(digests, ids, locators)}
    old = len(known)
    rows = sorted((r for table in batches for r in zip(table["doc_id"], table["locator"], table["digest"])), key=lambda r: (pd.isna(r[0]), 0 if pd.isna(r[0]) else r[0], r[1]))
    out = []
    for doc_id, locator, digest in rows:
        doc_id = None if pd.isna(doc_id) else int(doc_id)
        first = known.setdefault(bytes(digest), (doc_id, locator))
        out.append((doc_id, digest, locator, *first))
    if len(known) > old:
        state.update((list(known), [v[0] for v in known.values()], [v[1] for v in known.values()]))
    table = pd.DataFrame(out, columns=["doc_id", "digest", "locator", "first_id", "first_locator"])
    yield table.astype({"doc_id": "Int64", "first_id": "Int64"})


def located(df: DataFrame) -> DataFrame:
    """Adds where in the source files a row is: a file and the row's place in it."""
    return df.select("doc_id", "text", F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias("locator"))


def stream_of(spark: SparkSession, path: str, batch_bytes: str | None) -> DataFrame:
    """The Parquet file or folder at `path` as a stream; a single file is its folder, filtered by name."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def prefix_of(spark: SparkSession, path: str, base: str, expected: int | None) -> int:
    """How many hex digits of a digest name its state entry. The first run on a checkpoint decides and writes it there, for entries by another length would not be found again."""
    layout = f"{base}/layout"
    if not exists(spark, f"{layout}/_SUCCESS"):
        expected = expected or spark.read.parquet(path).count()
        prefix = max(1, math.ceil(math.log(max(expected, 1) / DIGESTS_PER_ENTRY + 1, 16)))
        spark.createDataFrame([(prefix,)], "prefix int").coalesce(1).write.mode("overwrite").parquet(layout)
    return spark.read.schema("prefix int").parquet(layout).first()[0]


def decisions(spark: SparkSession, path: str, base: str, expected: int | None = None, digest_bits: int = 256, batch_bytes: str | None = None) -> DataFrame:
    """Reads what is new under `path` and returns all decisions so far: (doc_id, digest, locator, first_id, first_locator).

    State is kept in RocksDB under `base` and never expires: for each digest the id and the
    locator of the first document that had it.  One state entry holds the few digests of
    one prefix, whose length the first run takes from `expected`, the number of documents
    to be met in all, or else from how many there are; later runs keep it, and entries grow
    if there come many more.  batch_bytes bounds a micro-batch.
    """
    prefix = prefix_of(spark, path, base, expected)
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        hashed = F.substring(F.sha2("text", 256), 1, digest_bits // 4)
        rows = located(stream_of(spark, path, batch_bytes)).where("text is not null").withColumn("hex", hashed)
        rows = rows.select("doc_id", "locator", F.encode("hex", "utf-8").alias("digest") if digest_bits % 8 else F.unhex("hex").alias("digest"), F.substring("hex", 1, prefix).alias("prefix"))
        kept = rows.groupBy("prefix").applyInPandasWithState(remember, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
        query = kept.writeStream.format("parquet").option("path", f"{base}/decisions").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(_OUT).parquet(f"{base}/decisions")


_COMPARED = "locator string, first_locator string, same boolean"


def texts_at(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """`asked` (locator and others) with doc_id and text, by a hash join at any size; locators are unique in `texts`."""
    return texts.join(asked.hint("shuffle_hash"), "locator")


def compared(texts: DataFrame, hits: DataFrame, base: str) -> DataFrame:
    """All hits as (locator, first_locator, same): whether their bytes are those of the first. Only those that no earlier run compared are fetched."""
    spark, path = hits.sparkSession, f"{base}/compared"
    known = spark.read.schema(_COMPARED).parquet(path) if exists(spark, path) else None
    pairs = hits.select("locator", "first_locator")
    fresh = pairs if known is None else pairs.join(known.select("locator"), "locator", "left_anti")
    asked = fresh.unionByName(fresh.select(F.col("first_locator").alias("locator"), "first_locator").distinct())
    fetched = texts_at(texts, asked).select("locator", "first_locator", "text")
    # Equal bytes throughout a group means that its least and greatest texts are one text; both are found before anything is shuffled.
    odd = scratch.written(fetched.groupBy("first_locator").agg((F.min("text") != F.max("text")).alias("odd")).where("odd").select("first_locator"), "odd")
    same = fresh.withColumn("same", F.lit(True))
    if odd.head(1):
        fetched = texts_at(texts, asked.join(odd, "first_locator").select("locator", "first_locator"))
        firsts = fetched.where("locator = first_locator").select("first_locator", F.col("text").alias("first_text"))
        other = fetched.where("locator != first_locator").join(firsts, "first_locator").where("text != first_text").select("locator", F.lit(False).alias("equal"))
        same = fresh.join(other, "locator", "left").select("locator", "first_locator", F.coalesce("equal", F.lit(True)).alias("same"))
    same.write.mode("append").parquet(path)
    return spark.read.schema(_COMPARED).parquet(path)


def exact_dedup(spark: SparkSession, path: str, checkpoint: str | None = None, **options) -> DataFrame:
    """Documents under `path` (Parquet) that no earlier document equals byte for byte, as (doc_id, digest, locator).

    Of equal documents the first to arrive stays: among those of one micro-batch the one
    with the least doc_id, then locator, a null doc_id last.  A document whose digest was
    met before counts as a hit only: its bytes are compared with those of the first, both
    fetched by their locators, and where they differ, each different text stays once.
    With a checkpoint, a later call reads and compares only what is new, and the result
    has all that was decided so far.

    Documents with a null text equal nothing and all stay, with a null digest.  An empty
    text is a text like any other.  Repeated rows are equal documents: one stays.  Other
    columns are ignored.  An empty table gives no rows.
    """
    base = checkpoint or scratch.place(spark, "exact")
    spark_docs = located(spark.read.parquet(path))
    met = decisions(spark, path, base, **options)
    first = met.where("locator = first_locator")
    texts = spark_docs.where("text is not null")
    odd = compared(texts, met.where("locator != first_locator"), base).where("NOT same").select("locator", "first_locator")
    apart = texts_at(texts, odd).groupBy("first_locator", "text").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "locator")).alias("stays")) if odd.head(1) else None
    hexed = lambda df: df.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "locator")
    nulls = spark_docs.where("text is null").select("doc_id", F.lit(None).cast("string").alias("digest"), "locator")
    out = hexed(first).unionByName(nulls)
    if apart is not None:
        out = out.unionByName(hexed(apart.select("stays.doc_id", "stays.locator", "first_locator").join(first.select(F.col("locator").alias("first_locator"), "digest"), "first_locator")))
    return out


SQL = "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"
