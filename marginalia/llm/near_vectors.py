"""Operator 7: near-duplicate embeddings by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .near_docs import groups

THRESHOLD, RECALL, SEED = 0.95, 0.98, 11
#: Vectors that train the codebooks at least, if there are as many, and vectors that set how far to visit cells.
TRAINING, CALIBRATION = 20_000, 1_000
#: Vectors that train a word of a large codebook, and bytes of float32 that the driver samples for it at most.
PER_WORD, SAMPLE_BYTES = 64, 128 << 20
#: Vectors of an average cell, words of a codebook at most, and vectors that meet in one task.
CELL, LARGEST_BOOK, MEET = 32, 4096, 40_000


def unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one, and which rows those are: of the right length, without nulls, finite, not zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()[: len(column) + 1].astype(np.int64)
    fits = (np.diff(at) == dim) & np.asarray(column.is_valid())
    values = column.values
    if values.null_count:
        nulls = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
        fits &= nulls[at[1:]] == nulls[at[:-1]]
    kept = np.flatnonzero(fits)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[at[kept][:, None] + np.arange(dim)]
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), kept[good]


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1))


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means by Lloyd's rounds; a word that loses all its vectors moves to the vector that is farthest from its own."""
    book = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    step = max(1, (1 << 23) // len(book))
    for _ in range(rounds):
        parts = (distances(x[low : low + step], book) for low in range(0, len(x), step))
        own, d = (np.concatenate(c) for c in zip(*((p.argmin(1), p.min(1)) for p in parts)))
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(book))
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
        far = np.argsort(-d)[: int((n == 0).sum())]
        book[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return book.astype(np.float32)


@dataclass
class MultiIndex:
    """Codebooks of the two halves of a vector, and how much farther than its nearest cell a query still visits cells of the product grid.

    A cell is as far as the words of both halves together.
    """

    left: np.ndarray
    right: np.ndarray
    gap: float

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = x.shape[1] // 2
        return distances(x[:, :at], self.left), distances(x[:, at:], self.right)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return a.argmin(1), b.argmin(1)

    def visited(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells that a multi-sequence traversal of each row comes to before it may stop, as (row, first word, second word).

        With the words of both halves sorted by distance, the cells of one first word that
        are near enough are a beginning of the second sequence, the longer the nearer that
        word; how many there are in all differs from row to row.
        """
        a, b = self.halves(x)
        limit = a.min(1) + b.min(1) + self.gap
        by = np.argsort(b, 1, kind="stable")
        near = np.take_along_axis(b, by, 1)
        row, first = np.nonzero(a + near[:, :1] <= limit[:, None])
        left = limit[row] - a[row, first]
        # All rows' sequences lie one after the other, each lifted above the one before.
        lift = float(near.max(initial=0) + np.abs(left).max(initial=0) + 1)
        ends = np.searchsorted((near + lift * np.arange(len(x))[:, None]).ravel(), left + lift * row, side="right")
        count = np.maximum(1, ends - row * near.shape[1])
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        row, first = np.repeat(row, count), np.repeat(first, count)
        return row, first, by[row, np.minimum(inner, near.shape[1] - 1)]


def words_of(total: int) -> int:
    """Words of a codebook for `total` vectors."""
    return int(np.clip(np.ceil(np.sqrt(total / CELL)), 1, LARGEST_BOOK))


def sampled(rows: DataFrame, dim: int, total: int, training: int) -> np.ndarray:
    """Unit vectors for the codebooks: at least `training` and PER_WORD for each word, as far as SAMPLE_BYTES go, and those to calibrate with."""
    wanted = max(training, min(PER_WORD * words_of(total), SAMPLE_BYTES // (4 * dim))) + CALIBRATION
    own = rows.where(F.size("embedding") == dim)
    if wanted * 4 < total:
        # Else each partition would send `wanted` vectors to one task.
        share = F.xxhash64("vec_id") < int(-(2**63) + 2**64 * (2 * wanted / total))
        own = own.where(share) if own.where(share).limit(wanted).count() == wanted else own
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("embedding").toArrow()
    parts = [unit(chunk, dim)[0] for chunk in sample.column("embedding").chunks]
    return np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)


def build(sample: np.ndarray, total: int, threshold: float, recall: float, seed: int = SEED) -> MultiIndex:
    """Codebooks for `total` vectors like the sample's, and how far to visit cells for the recall.

    A vector exactly at the threshold from a sampled one, in a random direction, is the
    hardest partner to find.  How much farther its cell is than the nearest one is measured,
    and at the quantile `recall` of that a query's traversal stops.

    Vectors lie nearer to words that they trained than others do.  Where the sample isn't the
    whole table, those that are counted with are therefore kept out of the training.
    """
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    train, held = sample, None
    if 1 < len(sample) < total:
        order = rng.permutation(len(sample))
        cut = min(CALIBRATION, len(sample) // 2)
        train, held = sample[np.sort(order[cut:])], sample[order[:cut]]
    k = min(words_of(total), len(train))
    index = MultiIndex(codebook(train[:, :half], k, rng), codebook(train[:, half:], k, rng), 0.0)
    x = (held if held is not None else sample[rng.choice(len(sample), min(CALIBRATION, len(sample)), replace=False)]).astype(np.float64)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    u /= np.maximum(np.sqrt((u * u).sum(1)), 1e-12)[:, None]
    i, j = index.home(threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * u)
    a, b = index.halves(x)
    row = np.arange(len(x))
    gaps = a[row, i] + b[row, j] - a.min(1) - b.min(1)
    # Halves are summed in another order when they are visited.
    index.gap = float(np.quantile(gaps, recall, method="higher")) + 1e-9 if len(gaps) else 0.0
    return index


def placed(shared, dim: int, split: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: MultiIndex = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                x, kept = unit(batch.column("embedding"), dim)
                if not len(x):
                    continue
                ids, weight = (batch.column(c).to_numpy(zero_copy_only=False)[kept].astype(np.int64) for c in ("vec_id", "weight"))
                home_a, home_b = index.home(x)
                row, first, second = index.visited(x)
                part = first.astype(np.int64) * split + second % split
                order = np.lexsort((part, row))
                row, part, second = row[order], part[order], second[order]
                head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
                who, where = row[head], part[head]
                # A vector goes once to each part of the grid that it visits; the nearest cell, in which it lives, is among those.
                lives = np.where(where == home_a[who].astype(np.int64) * split + home_b[who] % split, home_b[who], -1)
                cells = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)), pa.int32()), pa.array(second, pa.int32()))
                sent = np.ascontiguousarray(x[who])
                vectors = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(np.arange(0, sent.nbytes + 1, 4 * dim, dtype=np.int32)), pa.py_buffer(sent)])
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(ids[who]), pa.array(weight[who]), pa.array(lives, pa.int32()), cells, vectors], ["part", "vec_id", "weight", "home", "cells", "x"])

    return run


def met(threshold: float, dim: int):
    def run(table: pa.Table) -> pa.Table:
        ids, weights, home = (table.column(c).to_numpy() for c in ("vec_id", "weight", "home"))
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, dim)
        cells = table.column("cells").combine_chunks()
        cell, visitor = cells.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(cells.offsets.to_numpy()))
        order = np.argsort(cell, kind="stable")
        cell, visitor = cell[order], visitor[order]
        lived = np.argsort(home, kind="stable")
        at = home[lived]
        found: list[tuple] = []
        for c in np.unique(at[at >= 0]):
            own = lived[np.searchsorted(at, c) : np.searchsorted(at, c, side="right")]
            seen = visitor[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
            for begin in range(0, len(own), 4096):
                some = own[begin : begin + 4096]
                step = max(1, (1 << 20) // len(some))
                for low in range(0, len(seen), step):
                    rows = seen[low : low + step]
                    r, k = np.nonzero(x[rows] @ x[some].T >= threshold - 1e-4)
                    r, k = rows[r], some[k]
                    apart = ids[r] != ids[k]
                    r, k = r[apart], k[apart]
                    for i in range(0, len(r), 100_000):
                        p, q = r[i : i + 100_000], k[i : i + 100_000]
                        hit = (x[p].astype(np.float64) * x[q]).sum(1) >= threshold - 1e-7
                        p, q = p[hit], q[hit]
                        first = ids[p] < ids[q]
                        found.append((np.where(first, p, q), np.where(first, q, p)))
        a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"a": ids[a], "b": ids[b], "weight_a": weights[a], "weight_b": weights[b]})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, training: int = TRAINING) -> DataFrame:
    """The class of every vector, as (vec_id, class_id, links).

    Vectors at a cosine of at least `threshold` are linked.  A class is what links connect,
    and class_id its least vec_id; links is how many other vectors a vector is linked to.
    Equal embeddings are one vector to the index, which stands for them all; every vector is
    a query, and what it meets is verified exactly.  Of the pairs there are, at least the
    share `recall` is expected to be met, also of those just at the threshold, and most from
    either side.

    Rows with a null vec_id are left out.  Embeddings that are null, zero, not finite, with a
    null in them, or of another length than most have (the lesser length if two are as
    common) are linked to nothing.  Rows that share a vec_id are one row: in one class, with
    the links of each of their embeddings added up, and not linked to each other.  Other
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    every = rows.select("vec_id").distinct()
    alone = every.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    sizes = rows.where("embedding is not null").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None or sizes[0] < 2:
        return alone
    dim, total = int(sizes[0]), int(sizes[1])
    rows = rows.where(F.size("embedding") == dim)
    x = sampled(rows, dim, total, training)
    if not len(x):
        return alone
    index = build(x, total, threshold, recall)
    marked = rows.withColumn("mark", F.xxhash64("embedding")).withColumn("check", F.xxhash64(F.lit(1), "embedding"))
    members = marked.select("vec_id", "mark", "check").distinct()
    heads = members.groupBy("mark", "check").agg(F.min("vec_id").alias("head"), F.count("*").alias("weight"))
    heads = scratch.written(heads, "heads")
    one = marked.join(heads.withColumnRenamed("head", "vec_id").hint("shuffle_hash"), ["vec_id", "mark", "check"]).dropDuplicates(["vec_id", "mark", "check"]).select("vec_id", "weight", "embedding")
    # A vector goes to as many parts as it visits words of the first codebook; parts are split so that MEET vectors meet.
    visits = np.bincount(index.visited(x[:CALIBRATION])[0]).mean()
    split = int(max(1, np.ceil(total * min(visits, len(index.left)) / len(index.left) / MEET)))
    parts = one.mapInArrow(placed(spark.sparkContext.broadcast(index), dim, split), "part long, vec_id long, weight long, home int, cells array<int>, x binary")
    pairs = scratch.written(parts.groupBy("part").applyInArrow(met(threshold, dim), "a long, b long, weight_a long, weight_b long").distinct(), "pairs")
    far = pairs.select(F.col("a").alias("head"), F.col("weight_b").alias("far")).unionByName(pairs.select(F.col("b").alias("head"), F.col("weight_a").alias("far"))).groupBy("head").agg(F.sum("far").alias("far"))
    named = scratch.written(members.join(heads, ["mark", "check"]).join(far, "head", "left").select("vec_id", "head", (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("links")), "named")
    several = named.groupBy("vec_id").agg(F.min("head").alias("doc_a"), F.collect_set("head").alias("heads")).where("size(heads) > 1").select("doc_a", F.explode("heads").alias("doc_b"))
    roots = groups(pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).unionByName(several)).select(F.col("doc_id").alias("head"), F.col("head").alias("root"))
    placed_ = named.join(roots, "head", "left").groupBy("vec_id").agg(F.min(F.coalesce("root", "head")).alias("class_id"), F.sum("links").alias("links"))
    return every.join(placed_, "vec_id", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
