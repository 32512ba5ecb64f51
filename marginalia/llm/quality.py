"""Operator 4: document quality by a convolutional network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blocks, flat

#: Bytes under a filter, filters, bytes of a chunk, and how far apart chunks begin.
WIDTH, FILTERS, CHUNK, STEP = 6, 12, 512, 448
#: Labelled documents of each class that training reads at most.
SAMPLE_PER_CLASS = 1000
EPOCHS, BATCH, RATE, SEED = 5, 32, 0.01, 7
KEEP_AT = 0.3
_BLOCK = 1 << 19


def padded(at: np.ndarray, raw: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows low to high with zero bytes between them, so that each byte begins a window of its own row; begins and lengths of the rows (an empty one has one window)."""
    size = np.diff(at[low : high + 1])
    count = np.maximum(size, 1)
    begin = np.concatenate([[0], np.cumsum(count + WIDTH - 1)])
    data = np.zeros(begin[-1], dtype=np.uint8)
    row = np.repeat(np.arange(high - low), size)
    place = np.arange(len(row)) - (at[low:high] - at[low])[row]
    data[begin[:-1][row] + place] = raw[at[low] : at[high]]
    return data, begin[:-1], count


def chunked(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the overlapping chunks that cover every window, and the first chunk of each row (and their number)."""
    parts = 1 + np.maximum(0, -(-(count - CHUNK) // STEP))
    first = np.concatenate([[0], np.cumsum(parts)])
    row = np.repeat(np.arange(len(count)), parts)
    nth = np.arange(first[-1]) - first[:-1][row]
    low = begin[row] + nth * STEP
    return low, np.minimum(low + CHUNK, (begin + count)[row]), first


@dataclass
class Net:
    """filters: WIDTH tables of a weight for each byte and filter; bias of the filters; head: weights of the mean and of the maximum over chunks, then a constant."""

    filters: np.ndarray
    bias: np.ndarray
    head: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Weights of each pair of neighbouring bytes: the same sums with half the lookups."""
        pair = [(self.filters[k][:, None, :] + self.filters[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]
        return [p.astype(np.float32) for p in pair]

    def score(self, at: np.ndarray, raw: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """The probability of each row's bytes, all of them."""
        tables = tables or self.tables()
        out = []
        for low, high in blocks(at, _BLOCK):
            data, begin, count = padded(at, raw, low, high)
            left, right, first = chunked(begin, count)
            pooled = np.empty((len(left), len(self.bias)), np.float32)
            # A long row is a block of its own; its windows are met a stretch of chunks at a time.
            edge = np.arange(0, len(left) + 64, 64)
            for a, b in zip(edge[:-1], np.minimum(edge[1:], len(left))):
                base, top = left[a], right[b - 1]
                piece = data[base : top + WIDTH - 1].astype(np.int32)
                pair = (piece[:-1] << 8) | piece[1:]
                n = top - base
                seen = tables[0][pair[:n]]
                for k in range(1, len(tables)):
                    seen += tables[k][pair[2 * k : 2 * k + n]]
                cuts = np.stack([left[a:b] - base, np.minimum(right[a:b] - base, n - 1)], 1).ravel()
                part = np.maximum.reduceat(seen, cuts, axis=0)[::2]
                # reduceat cannot end at the array's end but by running to it; the last window is added by hand.
                part[right[a:b] - base == n] = np.maximum(part[right[a:b] - base == n], seen[n - 1])
                pooled[a:b] = part
            pooled = np.maximum(pooled + self.bias, 0)
            mean = np.add.reduceat(pooled, first[:-1], axis=0) / np.diff(first)[:, None]
            most = np.maximum.reduceat(pooled, first[:-1], axis=0)
            z = np.hstack([mean, most]) @ self.head[:-1] + self.head[-1]
            out.append(1 / (1 + np.exp(-z)))
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def fit(texts: list[str], label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Trains by Adam on batches of whole documents; classes weigh alike. The same input gives the same network."""
    rng = np.random.default_rng(seed)
    at, raw = flat(pa.array(texts, pa.large_string()))
    net = Net(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), np.append(rng.normal(0, 0.3, 2 * FILTERS), 0.0))
    params = [net.filters, net.bias, net.head]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    share = np.array([np.mean(label == 0), np.mean(label == 1)])
    weight = 0.5 / share[label]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            sizes = np.concatenate([[0], np.cumsum(at[rows + 1] - at[rows])])
            data, begin, count = padded(sizes, np.concatenate([raw[at[r] : at[r + 1]] for r in rows]), 0, len(rows))
            left, right, first = chunked(begin, count)
            where = np.empty((len(left), FILTERS), np.int64)
            value = np.empty((len(left), FILTERS))
            small = net.filters.astype(np.float32)
            for c, (a, b) in enumerate(zip(left, right)):
                seen = small[0][data[a:b]]
                for k in range(1, WIDTH):
                    seen = seen + small[k][data[a + k : b + k]]
                top = seen.argmax(0)
                where[c], value[c] = a + top, seen[top, np.arange(FILTERS)]
            pooled = np.maximum(value + net.bias, 0)
            parts = np.diff(first)
            doc = np.repeat(np.arange(len(rows)), parts)
            mean = np.add.reduceat(pooled, first[:-1], axis=0) / parts[:, None]
            most = np.maximum.reduceat(pooled, first[:-1], axis=0)
            joined = np.hstack([mean, most])
            p = 1 / (1 + np.exp(-(joined @ net.head[:-1] + net.head[-1])))
            d = (p - label[rows]) * weight[rows] / len(rows)
            g_head = np.append(joined.T @ d, d.sum())
            g_joined = d[:, None] * net.head[None, :-1]
            top = pooled == most[doc]
            g_pool = g_joined[doc, :FILTERS] / parts[doc][:, None] + top * g_joined[doc, FILTERS:] / np.add.reduceat(top, first[:-1], axis=0)[doc]
            g_pool = g_pool * (pooled > 0)
            g_filters = np.zeros_like(net.filters)
            column = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(WIDTH):
                np.add.at(g_filters[k], (data[where + k], column), g_pool)
            step += 1
            for param, grad, (m, v) in zip(params, (g_filters, g_pool.sum(0), g_head), moment):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most per_class labelled documents of each class, those whose hashed doc_id is least."""
    clean = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    picked = None
    for value in (0, 1):
        part = clean.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").toPandas()
    texts = texts.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    return texts["text"].tolist(), texts["quality"].to_numpy(np.int64)


def scored(docs: DataFrame, labels: DataFrame, column: str = "probability", per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """`docs` with the probability that each document is of good quality, its last column, named `column`.

    The network is trained here, on a sample of the labelled documents whose bound,
    per_class for each class, is a parameter; it then reads every byte of every document.
    A null text has a null probability.  An empty text, and texts of a few bytes, are
    padded with zero bytes and scored like any other.  Repeated rows score alike.  Rows
    with a null doc_id are scored but don't train.  If the labelled documents aren't of
    both classes, nothing can be learned, and every text has the share of class 1 among
    them, 1 if there are none.  A column of `docs` that has the name `column` already is
    replaced.  An empty table gives an empty table.
    """
    texts, label = sample(docs, labels, per_class)
    docs = docs.drop(column)
    if len(set(label.tolist())) < 2:
        return docs.withColumn(column, F.when(F.col("text").isNotNull(), F.lit(float(label.mean()) if len(label) else 1.0)))
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for batch in batches:
            text = batch.column("text")
            at, raw = flat(text)
            p = pa.array(net.score(at, raw, tables), mask=np.asarray(text.is_null()))
            yield pa.RecordBatch.from_arrays([*batch.columns, p], [*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def kept(docs: DataFrame, labels: DataFrame, least: float = KEEP_AT) -> DataFrame:
    """The documents whose probability is at least `least`, with the columns of `docs`; those with a null text go."""
    return scored(docs, labels, "__quality").where(F.col("__quality") >= least).drop("__quality")
