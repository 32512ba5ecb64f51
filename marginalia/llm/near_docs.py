"""Operator 8: near-duplicate documents by an exact n-gram Jaccard join with adaptive prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .setsim import CLASSES, Rule, candidates, verified

NGRAM = 3
THRESHOLD = 0.5


def linked(known: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many documents the links of each set lead to, and a forest that connects what the pairs connect: (one, links) and (u, v)."""
    if not len(a):
        return
    weight = known[:, 4]
    links = np.bincount(a, weight[b], len(known)) + np.bincount(b, weight[a], len(known))
    root = list(range(len(known)))
    u, v = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            u.append(x)
            v.append(y)
            root[y] = x
    met = np.flatnonzero(links)
    none = pa.nulls(len(met), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(known[met, 0]), pa.array(links[met].astype(np.int64)), none, none], ["one", "links", "u", "v"])
    none = pa.nulls(len(u), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.array(known[u, 1]), pa.array(known[v, 1])], ["one", "links", "u", "v"])


def near_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The near-duplicate class of every document, as (doc_id, class_id, links).

    A document's set is the distinct n-grams of its words, maximal runs of other than ASCII
    white space, case kept; one of fewer than n words has the single n-gram of all its
    words.  Two documents are linked if their sets have a Jaccard similarity of at least the
    threshold.  A class is what links connect, directly or through others; class_id is its
    least doc_id.  links is how many other documents a document is linked to, copies of the
    same set and all links between different sets counted; a group of thousands of copies
    has as many rows, not their square.

    Documents whose text is null or has no word, and those linked to none, are a class of
    their own with no links.  Rows with a null doc_id are left out.  Repeated rows with one
    doc_id and one text are one document; rows with one doc_id and different texts are one
    row too, in one class, with the links of each text added up.  Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    rule = Rule("doc", n, threshold, True)
    found = candidates(docs, rule)
    members = found.records.select("one", "two", "doc_id", "mark").distinct()
    heads = members.groupBy("one", "two").agg(F.min(F.struct("doc_id", "mark")).alias("head"), F.count("*").alias("size"))
    heads = scratch.written(heads.select("one", "two", "head.*", "size"), "heads")
    firsts = heads.groupBy("one").agg(F.min(F.struct("doc_id", "mark", F.col("size").alias("weight"))).alias("first")).select("one", "first.doc_id", "first.mark", F.lit(0).alias("line"), "first.weight")
    met = scratch.written(verified(docs, found, firsts, rule, linked, "one long, links long, u long, v long"), "met")
    named = members.join(heads.withColumnsRenamed({"doc_id": "head", "mark": "__mark"}), ["one", "two"]).select("one", "doc_id", "head", "size")
    named = scratch.written(named.join(met.where("one is not null").groupBy("one").agg(F.sum("links").alias("near")), "one", "left").select("doc_id", "head", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links")), "named")
    found.discard()
    several = named.groupBy("doc_id").agg(F.min("head").alias("v"), F.max("head").alias("last"), F.collect_set("head").alias("heads")).where("v != last")
    edges = met.where("u is not null").select("u", "v").unionByName(several.select(F.explode("heads").alias("u"), "v")).select(F.col("u").alias("doc_a"), F.col("v").alias("doc_b"))
    roots = groups(edges).select(F.col("doc_id").alias("head"), F.col("head").alias("root"))
    placed = named.join(roots, "head", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "head")).alias("class_id"), F.sum("links").alias("links"))
    every = docs.select("doc_id").where("doc_id is not null").distinct()
    return every.join(placed, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of the pairs as rows (doc_id, head): head is the least doc_id that can be reached.

    Alternating large-star and small-star rounds; each is two shuffles of narrow rows, is
    written to the shared folder, and the number of rounds grows with the logarithm of the
    number of documents, not with the length of chains.
    """
    edges = scratch.written(pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).where("u != v").distinct(), "edges")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = total(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        turned = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = turned.groupBy("u").agg(F.min("v").alias("m"))
        small = turned.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        fresh = scratch.written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        scratch.discard(edges)
        now = total(fresh)
        if now == was:
            return fresh.select(F.col("u").alias("doc_id"), F.col("v").alias("head"))
        edges, was = fresh, now


def one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` without the later documents of each near-duplicate class; the least doc_id stays.

    Rows that are linked to none stay, also those with a null text or doc_id.  Of rows that
    repeat a doc_id all stay or go together.  All columns are kept.
    """
    gone = scratch.written(near_classes(docs, n, threshold).where("doc_id != class_id").select("doc_id"), "gone")
    kept = docs.where("doc_id is not null").join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {NGRAM} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(list_slice(w, i, i + {NGRAM - 1}), ' ')) END)) AS s
  FROM d WHERE len(w) > 0
), heads AS (SELECT s, min(doc_id) AS head, count(*) AS size, len(s) AS n FROM sets GROUP BY s
), tokens AS (SELECT head, size, n, unnest(s) AS t FROM heads
), shared AS (
  SELECT a.head AS x, b.head AS y, any_value(b.size) AS size, a.n AS nx, b.n AS ny, count(*) AS k
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.head <> b.head GROUP BY a.head, b.head, a.n, b.n
), near AS (SELECT x, y, size FROM shared WHERE k >= {THRESHOLD} * (nx + ny - k) - 1e-9
), reach AS (
  SELECT x, y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x
), roots AS (SELECT x, least(x, min(y)) AS root FROM reach GROUP BY x
), links AS (SELECT x, sum(size) AS far FROM near GROUP BY x
)
SELECT e.doc_id, coalesce(root, head, e.doc_id) AS class_id, CAST(coalesce(size - 1 + coalesce(far, 0), 0) AS BIGINT) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) e
LEFT JOIN sets USING (doc_id) LEFT JOIN heads USING (s) LEFT JOIN roots ON roots.x = head LEFT JOIN links ON links.x = head
"""
