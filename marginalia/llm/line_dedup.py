"""Operator 2: removal of lines that repeat or nearly repeat an earlier line anywhere in the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, setsim
from .setsim import CLASSES, COPIES, Found, Rule, candidates, further, verified

THRESHOLD = 0.8
#: Tokens that meet in one round of the verification, as a share of the input's.
ROUND_SHARE = 0.5
_BLANK = " \t\n\r\x0b\x0c"


def late(known: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The later line of each pair, once."""
    order = np.empty(len(known), np.int64)
    order[np.lexsort((known[:, 2], known[:, 3], known[:, 1]))] = np.arange(len(known))
    row = known[np.unique(np.where(order[a] < order[b], b, a))]
    yield pa.RecordBatch.from_arrays([pa.array(row[:, 0]), pa.array(row[:, 1]), pa.array(row[:, 2]), pa.array(row[:, 3].astype(np.int32))], ["one", "doc_id", "mark", "line"])


def late_lines(docs: DataFrame, found: Found, firsts: DataFrame, rule: Rule) -> list[DataFrame]:
    """Tables of the lines that candidates show to be late, one of each round.

    The texts of candidates follow their number, which nothing bounds by the input.  A round
    takes so many parts that their texts are a share of the input, and its shuffles go before
    the next one; candidates that are few for their input take one round.
    """
    step, tables = max(1, int(found.tokens * ROUND_SHARE / setsim.TASK_TOKENS)), []
    for low in range(0, found.parts, step):
        parts = min(step, found.parts - low)
        own = found.pairs.where(F.col("part").between(low, low + parts - 1)).select("a", "b", (F.col("part") - low).alias("part"))
        near = verified(docs, replace(found, pairs=own, parts=parts), firsts, rule, late, "one long, doc_id long, mark long, line int")
        tables.append(scratch.written(near, "near"))
    return tables


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Lines to remove, as (doc_id, mark, lines); mark is the hash that tells texts with one doc_id apart.

    A line goes if any earlier line, in the order of doc_id and place, has a similarity of
    at least the threshold with it, whether or not that one goes too.  Of the lines of one
    set all but the first go without being compared; the first goes if the set has an
    earlier one like it.  One such is enough: a few candidates of each set are verified
    first, and all others only of the sets that none of these settles.
    """
    rule = Rule("line", 1, threshold, False)
    found = candidates(docs, rule)
    firsts = found.records.where(F.col("kind") == CLASSES).select("one", "doc_id", "mark", "line", F.lit(0).alias("weight"))
    copies = found.records.where(F.col("kind") == COPIES).select("doc_id", "mark", "line")
    tables = late_lines(docs, found, firsts, rule)
    rest = further(found, reduce(DataFrame.unionByName, tables))
    if rest is not None:
        tables += late_lines(docs, rest, firsts, rule)
    lines = reduce(DataFrame.unionByName, [copies, *(t.select("doc_id", "mark", "line") for t in tables)])
    gone = scratch.written(lines.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("lines")), "gone")
    scratch.discard(*tables)
    found.discard()
    if rest is not None:
        rest.discard()
    return gone


def without_lines(schema: pa.Schema, gone: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(gone)
            hit = np.flatnonzero(np.asarray(lines.is_valid()))
            keep = np.ones(batch.num_rows, dtype=bool)
            shorter: dict[int, str] = {}
            if len(hit):
                taken = pa.array(hit)
                for r, body, out in zip(hit.tolist(), batch.column("text").take(taken).to_pylist(), lines.take(taken).to_pylist()):
                    drop = set(out)
                    text = "\n".join(x for i, x in enumerate(body.split("\n")) if i not in drop)
                    keep[r] = bool(text.strip(_BLANK))
                    shorter[r] = text
            columns = []
            for field in schema:
                column = batch.column(field.name)
                if shorter and field.name == "text":
                    mask = np.zeros(batch.num_rows, dtype=bool)
                    mask[hit] = True
                    column = pa.compute.replace_with_mask(column, pa.array(mask), pa.array(list(shorter.values()), column.type))
                elif shorter and field.name == "n_chars":
                    column = pa.array([c if r not in shorter else len(shorter[r]) for r, c in enumerate(column.to_pylist())], field.type)
                columns.append(column if keep.all() else column.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(schema, columns)]))

    return run


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the lines that repeat an earlier line of the whole table, exactly or nearly.

    Lines end at a line feed.  A line is its set of distinct words, maximal runs of other
    than ASCII white space, case kept; it goes if an earlier line, by doc_id and then by
    place, has a Jaccard similarity of at least `threshold` with it.  Lines of equal sets
    are equal whatever their order of words.  Lines without words are never removed.

    A document that had lines with words and loses all of them goes, for nothing is left of
    it.  Others keep their rows, and n_chars, if there is such a column, follows the text;
    texts that are null, empty or blank stay as they are, and so do rows with a null doc_id.
    Rows that repeat a doc_id and its text are one document, and lose the same lines; with
    different texts they are documents of their own, at one place in an order by hash of the
    text.  All columns are kept, whatever their names.  An empty table gives an empty table.

    Texts move once to be verified and once to be cut, by hash joins on doc_id whatever
    their size; rows without an id or a text don't move.
    """
    gone, mark = scratch.free_name(docs, "gone"), scratch.free_name(docs, "mark")
    named = "doc_id is not null and text is not null"
    lines = removed_lines(docs, threshold).select(F.col("doc_id"), F.col("mark").alias(mark), F.col("lines").alias(gone))
    joined = docs.where(named).withColumn(mark, F.xxhash64("text")).join(lines.hint("shuffle_hash"), ["doc_id", mark], "left").select(*docs.columns, gone)
    cut = joined.mapInArrow(without_lines(docs.limit(0).toArrow().schema, gone), docs.schema)
    return cut.unionByName(docs.where(f"NOT ({named})"))


SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), pieces AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM d
), lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(0, len(p))) AS k FROM pieces
), sets AS (
  SELECT doc_id, k, line, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[ \\t\\r\\f\\x0b]+'), lambda x: x <> ''))) AS s FROM lines
), firsts AS (
  SELECT s, len(s) AS n, min((doc_id, k)) AS first, row_number() OVER (ORDER BY min((doc_id, k))) AS r FROM sets WHERE len(s) > 0 GROUP BY s
), words AS (SELECT r, n, unnest(s) AS w FROM firsts
), counted AS (SELECT w, count(*) AS df FROM words GROUP BY w
), ranked AS (
  SELECT r, n, w, row_number() OVER (PARTITION BY r ORDER BY df, w) AS i FROM words JOIN counted USING (w)
), prefixes AS (SELECT r, n, w FROM ranked WHERE i <= n - ceil(n * {THRESHOLD} - 1e-9) + 1
), near AS (
  SELECT DISTINCT a.r AS x, b.r AS y FROM prefixes a JOIN prefixes b ON a.w = b.w AND a.r < b.r
  AND least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9
), late AS (
  SELECT DISTINCT y AS r FROM near JOIN firsts a ON a.r = x JOIN firsts b ON b.r = y
  WHERE len(list_intersect(a.s, b.s)) >= {THRESHOLD} * (a.n + b.n - len(list_intersect(a.s, b.s))) - 1e-9
), kept AS (
  SELECT doc_id, k, line, s.s AS s, len(s.s) = 0 OR ((doc_id, k) = f.first AND NOT EXISTS (SELECT 1 FROM late WHERE late.r = f.r)) AS stays
  FROM sets s LEFT JOIN firsts f ON s.s = f.s
), texts AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE stays) AS text, bool_and(stays) AS whole, bool_or(stays AND len(s) > 0) AS part
  FROM kept GROUP BY doc_id
)
SELECT documents.doc_id, CASE WHEN whole THEN documents.text ELSE texts.text END AS text, lang, source, CASE WHEN whole THEN n_chars ELSE length(texts.text) END AS n_chars
FROM documents JOIN texts USING (doc_id) WHERE whole OR part
"""
