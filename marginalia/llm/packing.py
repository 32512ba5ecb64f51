"""Operator 6: best-fit packing of documents into training sequences under several capacities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, scratch
from .text import blocks, flat, spans

#: Pieces that are packed together; groups are by hash of doc_id, so that they don't depend on order or partitioning.
GROUP_PIECES = 4096


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens of the byte-level BPE, pieces, and attention cost, the sum of the pieces' squared lengths in tokens.

    score: 'norm' puts a piece where the weighted norm of what stays free is least, 'dot'
    where the weighted product of its demands and what is free is greatest; both look only
    at sequences in which it fits in every respect.
    """

    tokens: int = 4096
    docs: int = 16
    attention: int = 4096 * 4096 // 2
    weights: tuple[float, float, float] = (1.0, 0.25, 0.5)
    score: str = "norm"

    @property
    def piece(self) -> int:
        """The longest piece that fits in an empty sequence; longer documents are cut."""
        return int(min(self.tokens, np.floor(np.sqrt(self.attention))))


def best_fit(length: np.ndarray, capacity: Capacity) -> np.ndarray:
    """The sequence of each piece, taking the pieces as they come; of sequences that are equally good, the first."""
    whole = np.array([capacity.tokens, capacity.docs, capacity.attention], dtype=np.float64)
    weight = np.array(capacity.weights)
    demand = np.stack([length, np.ones(len(length)), length.astype(np.float64) ** 2], 1)
    free = np.tile(whole, (max(1, len(length)), 1))
    chosen, used = np.zeros(len(length), np.int64), 0
    live = np.zeros(len(length), np.int64)  # open sequences, in the order in which they were begun
    n_live = 0
    least = np.minimum.accumulate(length[::-1])[::-1] if len(length) else length
    for i, need in enumerate(demand):
        own = live[:n_live]
        rest = free[own]
        fits = np.flatnonzero((rest >= need).all(1))
        if len(fits):
            if capacity.score == "dot":
                value = -((rest[fits] / whole) * (need / whole) * weight).sum(1)
            else:
                value = (((rest[fits] - need) / whole) ** 2 * weight).sum(1)
            at = own[fits[np.argmin(value)]]
        else:
            at = used
            live[n_live] = at
            used, n_live = used + 1, n_live + 1
        free[at] -= need
        chosen[i] = at
        # Sequences with no room for any later piece are closed now and then.
        if i + 1 < len(length) and i % 64 == 63:
            small = least[i + 1]
            rest = free[live[:n_live]]
            open_ = (rest[:, 0] >= small) & (rest[:, 1] >= 1) & (rest[:, 2] >= float(small) ** 2)
            kept = live[:n_live][open_]
            live[: len(kept)], n_live = kept, len(kept)
    return chosen


def counted(shared, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: bpe.Vocabulary = shared.value
        encoder = bpe.Encoder(vocabulary, bpe.PATTERN)
        for batch in batches:
            texts = batch.column("text")
            at, raw = flat(texts)
            for low, high in blocks(at, bpe.BATCH_BYTES):
                cuts = at[low : high + 1] - at[low]
                starts, _ = spans(raw[at[low] : at[high]], cuts)
                bounds = np.searchsorted(starts, cuts)
                rows = encoder.rows(texts.slice(low, high - low).to_pylist())
                row, first, n_ids, first_word = [], [], [], []
                for r, word in enumerate(rows):
                    n = int(encoder.count[word].sum())
                    if bounds[r] == bounds[r + 1]:
                        continue
                    step = np.arange(0, n, longest)
                    into = np.zeros(1, np.int64)
                    if len(step) > 1:
                        # A word belongs to the piece in which its first byte lies.
                        ids = bpe.gather(encoder.ids, encoder.begin[word], encoder.count[word])
                        into = np.concatenate([[0], np.cumsum(vocabulary.length[ids])])[step]
                    row.append(np.full(len(step), r))
                    first.append(step)
                    n_ids.append(np.minimum(longest, n - step))
                    first_word.append(np.searchsorted(starts[bounds[r] : bounds[r + 1]], cuts[r] + into))
                if not row:
                    continue
                row, first, n_ids, first_word = (np.concatenate(c) for c in (row, first, n_ids, first_word))
                last = np.append(row[1:] != row[:-1], True)
                n_words = np.where(last, np.diff(bounds)[row], np.append(first_word[1:], 0)) - first_word
                columns = [pa.array(c, pa.int64()) for c in (first // longest, first, n_ids, first_word, n_words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low).take(pa.array(row)), *columns], ["doc_id", "piece", "first_id", "n_ids", "first_token", "n_tokens"])

    return run


def packed(docs: DataFrame, capacity: Capacity = Capacity(), group_pieces: int = GROUP_PIECES, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Where each piece of each document goes: (doc_id, piece, first_token, n_tokens, first_id, n_ids, sequence, place).

    Capacities hold in ids, the tokens of bpe.encoded for the whole text; first_id and n_ids
    are a piece's range of them.  A document of more than capacity.piece ids is cut into
    pieces of that length and a last one of the rest, wherever that falls, so that every id
    has exactly one place.  first_token and n_tokens count words, maximal runs of other than
    ASCII white space: those that begin in the piece, which may be none.

    Pieces meet by group, a hash of doc_id, sorted by falling n_ids and then by doc_id and
    piece; `sequence` names the group and the sequence in it, `place` the order within the
    sequence.

    Rows with a null doc_id are packed like others.  Texts that are null or have no word
    have nothing to pack and no row.  Repeated rows are packed once for each.  Other columns
    are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe.Vocabulary(bpe.read_ranks(vocabulary)))
    schema = "doc_id long, piece long, first_id long, n_ids long, first_token long, n_tokens long"
    pieces = scratch.written(docs.select("doc_id", "text").mapInArrow(counted(shared, capacity.piece), schema), "lengths")
    groups = int(max(1, -(-pieces.count() // group_pieces)))
    pieces = pieces.withColumn("piece", F.col("piece").cast("int")).withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))

    def place(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["n_ids", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        chosen = best_fit(table["n_ids"].to_numpy(np.int64), capacity)
        group = f"{int(table['group'].iloc[0]):07d}"
        table["sequence"] = [f"{group}-{b:05d}" for b in chosen]
        table["place"] = table.groupby("sequence").cumcount().astype("int32")
        table["doc_id"] = table["doc_id"].astype("Int64")
        return table[["doc_id", "piece", "first_token", "n_tokens", "first_id", "n_ids", "sequence", "place"]]

    return pieces.groupBy("group").applyInPandas(place, "doc_id long, piece int, first_token long, n_tokens long, first_id long, n_ids long, sequence string, place int")
