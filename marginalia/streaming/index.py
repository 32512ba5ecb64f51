"""Indexes of notes kept up to date as files change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import extract, notes as parts

RELATIONS = {"links": extract.links, "tags": extract.tags, "tasks": extract.task_rows, "headings": extract.headings}


def stale(notes: DataFrame, seen: DataFrame) -> DataFrame:
    """Notes that are new or changed after (path, modified) of `seen`."""
    return notes.join(seen.select("path", F.col("modified").alias("__seen")), "path", "left").where("__seen is null or modified > __seen").drop("__seen")


def gone(notes: DataFrame, seen: DataFrame) -> DataFrame:
    return seen.join(notes.select("path"), "path", "left_anti").select("path")


def follow(spark: SparkSession, root: str, index: str, checkpoint: str):
    """Starts a stream that appends each changed note's relations to Parquet tables under `index`, with the batch and the time of the change; ends when nothing is new."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        version = F.lit(number).alias("batch")
        batch.select("path", "modified", "size_bytes", version).write.mode("overwrite").parquet(f"{index}/notes/batch={number}")
        for name, relation in RELATIONS.items():
            relation(batch).write.mode("overwrite").parquet(f"{index}/{name}/batch={number}")
        batch.unpersist()

    stream = spark.readStream.format("notes").load(root)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, index: str, name: str) -> DataFrame:
    """A relation of the index as of each note's last change."""
    seen = spark.read.parquet(f"{index}/notes").select("path", "batch")
    last = seen.groupBy("path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{index}/{name}").join(last, ["path", "batch"], "left_semi").drop("batch")


def status(spark: SparkSession, index: str, notes: DataFrame) -> DataFrame:
    """(indexed, stale, removed): notes in the index, those changed since, and those that are gone."""
    seen = spark.read.parquet(f"{index}/notes").groupBy("path").agg(F.max("modified").alias("modified"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(seen, "indexed").crossJoin(count(stale(notes, seen), "stale")).crossJoin(count(gone(notes, seen), "removed"))


def changes_by_day(changes: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Changes of notes by day and folder, over a stream or a table with `modified`."""
    return changes.withWatermark("modified", lateness).groupBy(F.window("modified", "1 day").alias("day"), parts.folder().alias("folder")).agg(F.count("*").alias("changes")).select(F.col("day.start").alias("day"), "folder", "changes")


def latest(changes: DataFrame) -> DataFrame:
    """The last version of each note of (path, modified, ...)."""
    return changes.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("modified")))).where("__n = 1").drop("__n")
