"""Operator 5: byte-level BPE, encoding and decoding, over numpy matrices of words."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks, flat

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut into words before any merge; every character falls into one of them.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes than this are merged one by one with a heap, not in a matrix.
WIDEST = 256
#: Words that a task remembers, and bytes of text that make a batch of its output.
REMEMBERED, BATCH_BYTES = 300_000, 2 << 20
_NONE = np.int32(1 << 30)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Tokens and their ranks, from a file with a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ids of the bytes, the pairs that merge in a hash table, and the bytes of every id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(made)) * 4))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        made = np.array(made, np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            # Of several keys that want one slot the last that is written has it; the others go on.
            self.keys[slot[todo[free]]] = key[todo[free]]
            won = self.keys[slot[todo]] == key[todo]
            self.ranks[slot[todo[won]]] = made[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        size = max(ranks.values(), default=-1) + 1
        held: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            held[rank] = token
        self.length = np.array([len(t) for t in held], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(held), dtype=np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, also its rank; _NONE where it doesn't merge. A negative id merges with nothing."""
        key = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        out[(left.ravel() < 0) | (right.ravel() < 0)] = _NONE
        return out.reshape(left.shape)

    def encode_matrix(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids, padded with -1: in each round every row merges its leftmost pair of least rank; rows with none left are set aside."""
        out, count = np.full_like(ids, -1), size.copy()
        row = np.arange(len(ids))
        if ids.shape[1] < 2:
            return ids, count
        rank = self.merged(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(rank)), at]
            done = best == _NONE
            if done.any():
                out[row[done], : ids.shape[1]] = ids[done]
                row, ids, rank, at, best = row[~done], ids[~done], rank[~done], at[~done], best[~done]
            if not len(row):
                return out, count
            count[row] -= 1
            every = np.arange(len(row))
            ids[every, at] = best
            # The token to the right of each merge falls out, and its row moves up by one.
            width = count[row].max()
            place = np.arange(width)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
            if width < 2:
                rank = np.full((len(row), 1), _NONE, np.int32)
                continue
            place = np.arange(width - 1)
            rank = np.take_along_axis(rank, np.minimum(place + (place > at[:, None]), rank.shape[1] - 1), 1)
            rank[place >= (count[row] - 1)[:, None]] = _NONE
            for near in (at - 1, at):
                own = np.flatnonzero((near >= 0) & (near < width - 1))
                rank[own, near[own]] = self.merged(ids[own, near[own]], ids[own, near[own] + 1])

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same merges in the same order for one word of any length."""
        ids = self.byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.merged(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    pair = (ids[x], ids[y])
                    if pair not in known:
                        known[pair] = int(self.merged(np.array(pair[:1], np.int32), np.array(pair[1:], np.int32))[0])
                    if known[pair] != _NONE:
                        heapq.heappush(heap, (known[pair], x, *pair))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        parts: list[np.ndarray] = []
        number: list[np.ndarray] = []
        wide = 2
        low = -1
        while low < WIDEST:
            own = np.flatnonzero((size > low) & (size <= wide))
            for k in range(0, len(own), max(1, (1 << 20) // wide)):
                some = own[k : k + max(1, (1 << 20) // wide)]
                place = np.arange(wide)
                inside = place < size[some][:, None]
                ids = np.where(inside, self.byte[data[np.minimum(start[some][:, None] + place, max(0, len(data) - 1))]] if len(data) else -1, -1).astype(np.int32)
                ids, count = self.encode_matrix(ids, size[some])
                parts.append(ids[ids >= 0])
                number.append(np.stack([some, count], 1))
            low, wide = wide, wide * 2
        for w in np.flatnonzero(size > WIDEST):
            parts.append(self.encode_long(words[w]))
            number.append(np.array([[w, len(parts[-1])]]))
        if not number:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        order, count = np.concatenate(number).T
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        back = np.argsort(order, kind="stable")
        count, begin = count[back], begin[back]
        return gather(np.concatenate(parts), begin, count), count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        return gather(self.data, self.start[ids], self.length[ids])


def gather(data: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """data[begin : begin + count] for each pair, one after the other."""
    total = int(count.sum())
    to = np.concatenate([[0], np.cumsum(count)[:-1]])
    return data[np.repeat(begin - to, count) + np.arange(total)] if total else data[:0]


class Words(dict):
    """Numbers words as they are first met."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """Cuts texts into words and encodes each word once, as long as it is remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.cut = vocabulary, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.seen = Words()
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's words, which index begin and count; good until the next call."""
        if len(self.seen) > REMEMBERED:
            self.forget()
        seen = self.seen
        rows = [np.fromiter(map(seen.__getitem__, self.cut(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if seen.fresh:
            more, number = self.vocabulary.encode_words([w.encode() for w in seen.fresh])
            self.begin = np.concatenate([self.begin, len(self.ids) + np.concatenate([[0], np.cumsum(number)[:-1]])])
            self.ids, self.count = np.concatenate([self.ids, more]), np.concatenate([self.count, number])
            seen.fresh = []
        return rows


def encoder(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Vocabulary = shared.value
        words = Encoder(vocabulary, pattern)
        for batch in batches:
            texts, docs = batch.column("text"), batch.column("doc_id")
            at, raw = flat(texts)
            for low, high in blocks(at, BATCH_BYTES):
                rows = words.rows(texts.slice(low, high - low).to_pylist())
                ids, begin, count = words.ids, words.begin, words.count
                word = np.concatenate(rows)
                out = gather(ids, begin[word], count[word])
                ends = np.concatenate([[0], np.cumsum(count[word])])[np.cumsum([0] + [len(r) for r in rows])]
                back = vocabulary.decode(out)
                place = np.concatenate([[0], np.cumsum(vocabulary.length[out])])[ends]
                size, source = np.diff(at[low : high + 1]), at[low:high] - at[low]
                fits = (np.diff(place) == size) & (place[:-1] == source)
                wrong = np.concatenate([[0], np.cumsum(back != raw[at[low] : at[high]])]) if len(back) == at[high] - at[low] else None
                same = fits & (wrong[source + size] == wrong[source]) if wrong is not None else np.array([back[place[i] : place[i + 1]].tobytes() == raw[at[low + i] : at[low + i + 1]].tobytes() for i in range(high - low)])
                absent = np.asarray(texts.slice(low, high - low).is_null())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()), mask=pa.array(absent)) if absent.any() else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([docs.slice(low, high - low), lists, pa.array(np.diff(ends), pa.int32(), mask=absent), pa.array(same, mask=absent)], ["doc_id", "ids", "n_ids", "restored"])

    return run


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Token ids of each whole text: (doc_id, ids, n_ids, restored); restored tells whether decoding gave the text's bytes back.

    vocabulary: path of a rank file, read on the driver.  A text is cut into words by
    `pattern`; words of a batch are encoded once each.  Null texts have null ids, empty ones
    no ids.  Strings of special tokens are ordinary text.  Repeated rows give repeated rows.
    Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(vocabulary)))
    return docs.select("doc_id", "text").mapInArrow(encoder(shared, pattern), "doc_id long, ids array<int>, n_ids int, restored boolean")


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts of the ids of `encoded`: (doc_id, text). Null ids give a null text, none an empty one; bytes that aren't UTF-8 become replacement characters; an id outside the vocabulary is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else shared.value.decode(np.array(ids, np.int64)).tobytes().decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
