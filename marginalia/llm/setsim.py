"""Exact set-similarity self-join of documents or lines, shared by line dedup and the n-gram join.

A record is a set: the words of a line, or the n-grams of a document's words.  Tokens are
64-bit hashes.  Their global order is by rarity: exact counts over the whole corpus, of
which those above a floor go into a table of constant size; tokens under the floor come
first, all as rare.  Any such order gives the same pairs, a better one gives fewer
candidates.

Records with the same set are one record to the join, known by a 128-bit digest of the
set, and by half of it on the way.  Prefix tokens travel packed, by range of token hash,
one range to a task, and are joined in numpy; records travel with them by range of their
digest, where the first of each set is found.  What comes out are pairs of digests that
pass the filters.  Verification brings the texts of a cluster together once, not once for
every pair, and compares whole sets, by 128 bits of hash for each token.

Lines ask less: whether any earlier line is similar.  A cluster of c lines has c * c / 2
pairs, so each list passes on only a few earlier sets for each set, and notes where there
may be more.  Sets that none of these settles ask those lists again, for all that is
earlier, with more bits to filter by.

No step broadcasts what grows with the input; each one's partitions follow from counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .text import blocks, distinct, flat, mix, other_hashes, shingles, words

CLASS_BITS = 22
#: At most so many frequent tokens are told apart; the floor rises until they fit. It changes the order and with it the cost, not the result.
FREQUENT = 1_000_000
#: Counts under this are never told apart.
FLOOR = 4
#: Postings that one task joins, postings that a batch gathers before it sends them, and postings' matches asked for at most.
RANGE_POSTINGS, SENT_POSTINGS, MOST_MATCHES = 3_000_000, 600_000, 8
#: Earlier sets that a list passes on for one set before it is asked again, words of parity bits when it is, and slots of the tables of what is asked.
EARLIER, PARITIES, SLOT_BITS = 2, 4, 24
#: Tokens that stand for a prefix, so that a pair of near copies goes on from one range only.
SKETCH = 4
#: Pairs that a task sums before it passes them on, and pairs in a batch of its output.
HELD_PAIRS, MOVED_PAIRS = 1_000_000, 50_000
#: Pairs and tokens that meet in one task of the verification.
TASK_PAIRS, TASK_TOKENS = 2_000_000, 4_000_000
#: Tokens that a task of the verification numbers at a time, of one range of their hashes.
NUMBERED_TOKENS = 500_000
VERIFY_COST = 8.0


@dataclass(frozen=True)
class Rule:
    """unit: 'line' or 'doc'; n: words in a token; threshold: least Jaccard similarity; adaptive: multi-match prefixes, else prefixes of one match with the positional filter."""

    unit: str
    n: int
    threshold: float
    adaptive: bool


def needed(size: np.ndarray, threshold: float) -> np.ndarray:
    """ceil(threshold * size), safe against the rounding of products such as 0.7 * 10."""
    return np.ceil(np.asarray(size) * threshold - 1e-9).astype(np.int64)


def record_tokens(at: np.ndarray, raw: np.ndarray, low: int, high: int, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of rows low to high with the bounds of the records in them, each record's row, and its line number."""
    data, cuts = raw[at[low] : at[high]], at[low : high + 1] - at[low]
    starts, _, hashes = words(data, cuts)
    if rule.unit == "doc":
        tokens, bounds = shingles(hashes, np.searchsorted(starts, cuts), rule.n)
        return tokens, bounds, np.arange(low, high), np.zeros(high - low, np.int64)
    ends = np.flatnonzero(data == 10) + 1
    begins = distinct(np.concatenate([cuts[:-1][np.diff(cuts) > 0], ends[ends < len(data)]]))
    row = np.searchsorted(cuts, begins, side="right") - 1
    line = np.arange(len(begins)) - np.searchsorted(row, row)
    tokens, bounds = shingles(hashes, np.searchsorted(starts, np.append(begins, len(data))), rule.n)
    return tokens, bounds, row + low, line


def packed_count(rule: Rule, ranges: int):
    def counted(parts: list) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_counts=True)
        edge = np.searchsorted(value, (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))
        rows = []
        for k in np.flatnonzero(np.diff(edge)):
            own, times = value[edge[k] : edge[k + 1]], count[edge[k] : edge[k + 1]]
            gaps = np.diff(own, prepend=np.uint32(0))
            first, gaps[0] = int(own[0]), 0
            small = gaps.max() < 1 << 16
            many = times.max() > 1
            rows.append((int(k), first, gaps.astype(np.uint16 if small else np.uint32).tobytes(), 2 if small else 4, least_bytes(times).tobytes() if many else b""))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["part", "first", "gaps", "width", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = flat(batch.column("text"))
            parts, held = [], 0
            for low, high in blocks(at):
                if held > 2 * SENT_POSTINGS:
                    yield counted(parts)
                    parts, held = [], 0
                tokens, bounds, _, _ = record_tokens(at, raw, low, high, rule)
                held += len(tokens)
                if rule.unit == "doc" and len(tokens):
                    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
                    parts.append((distinct((tokens >> np.uint64(32) << np.uint64(32)) | row) >> np.uint64(32)).astype(np.uint32))
                else:
                    parts.append((tokens >> np.uint64(32)).astype(np.uint32))
            yield counted(parts)

    return run


def one_array(parts: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; the list is emptied, so that they can go."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def count_range(table: pa.Table) -> pa.Table:
    value, times = [], []
    for first, gaps, width, count in zip(*(table.column(c).to_pylist() for c in ("first", "gaps", "width", "times"))):
        own = np.cumsum(np.frombuffer(gaps, dtype=np.uint16 if width == 2 else np.uint32), dtype=np.int64) + first
        value.append(own)
        times.append(as_sent(count, len(own)) if count else np.ones(len(own), np.int64))
    value, times = np.concatenate(value), np.concatenate(times)
    order = np.argsort(value, kind="stable")
    value, times = value[order], times[order]
    head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    total = np.add.reduceat(times, head)
    keep = total >= FLOOR
    # The last row has the number of all tokens in the range.
    return pa.table({"token": pa.array(np.append(value[head][keep], -1), pa.int64()), "n": pa.array(np.append(total[keep], total.sum()), pa.int64())})


def rarity(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, int]:
    """Class of each slot of token hashes (0: rare, else 8 times the binary logarithm of the count), and the number of all tokens."""
    ranges = scratch.pieces(docs, 8 << 20)
    packed = docs.select("text").mapInArrow(packed_count(rule, ranges), "part int, first long, gaps binary, width int, times binary")
    counts = scratch.written(packed.groupBy("part").applyInArrow(count_range, "token long, n long"), "counts")
    total = counts.where("token < 0").agg(F.sum("n")).first()[0] or 0
    frequent = counts.where("token >= 0")
    sizes = {int(r[0]): r[1] for r in frequent.groupBy(F.floor(F.log2("n")).alias("size")).count().collect()}
    floor, held = max(sizes, default=0), 0
    for size in sorted(sizes, reverse=True):
        if held + sizes[size] > FREQUENT:
            break
        floor, held = size, held + sizes[size]
    table = np.zeros(1 << CLASS_BITS, dtype=np.uint8)
    if held:
        found = frequent.where(F.col("n") >= (1 << floor)).toArrow()
        token, n = found.column("token").to_numpy(), found.column("n").to_numpy()
        np.maximum.at(table, token >> (32 - CLASS_BITS), np.minimum(255, np.round(8 * np.log2(n))).astype(np.uint8))
    return table, total


def ordered_sets(tokens: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each record's distinct tokens, rare ones first, as keys of a class and 56 bits of hash, with their bounds."""
    record = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = (classes[tokens >> np.uint64(64 - CLASS_BITS)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
    order = np.argsort(key)
    own = record[order]
    order = order[np.argsort(own.astype(np.uint16) if len(bounds) <= 1 << 16 else own, kind="stable")]
    key, record = key[order], record[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (record[1:] != record[:-1])
    return key[fresh], np.searchsorted(record[fresh], np.arange(len(bounds)))


_LOW = np.uint64((1 << 56) - 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def digests(key: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each record's set, whatever the order of its tokens."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(key) + 1, dtype=np.uint64)
        np.cumsum(mix((key & _LOW) ^ np.uint64(salt)), out=total[1:])
        out.append(mix((total[bounds[1:]] - total[bounds[:-1]]) ^ np.uint64(salt)).view(np.int64))
    return out[0], out[1]


def matches_asked(key: np.ndarray, bounds: np.ndarray, size: np.ndarray, rule: Rule) -> np.ndarray:
    """For each record the number of shared prefix tokens to ask for, by least estimated cost.

    A prefix that asks for l matches is l - 1 tokens longer.  Its lists hold S postings in
    all, by the tokens' counts, and at most S / l records can occur l times in them; each
    of those costs a verification.
    """
    if not rule.adaptive:
        return np.ones(len(size), np.int64)
    share = np.concatenate([[0.0], np.cumsum(np.exp2((key >> np.uint64(56)).astype(np.float64) / 8))])
    must = needed(size, rule.threshold)
    best, cost = np.ones(len(size), np.int64), np.full(len(size), np.inf)
    for asked in range(1, MOST_MATCHES + 1):
        length = np.minimum(size, size - must + asked)
        lists = share[bounds[:-1] + length] - share[bounds[:-1]]
        now = np.where(asked <= np.maximum(must, 1), lists * (1 + VERIFY_COST / asked), np.inf)
        best, cost = np.where(now < cost, asked, best), np.minimum(now, cost)
    return best


def parities(key: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """A row of `width` times 64 bits for each set, each the parity of how many of its tokens hash to it. Bits that differ are tokens that only one of two sets has, at least."""
    out = np.empty((len(bounds) - 1, width), np.uint64)
    slot = mix(key & _LOW)
    bit, word = np.uint64(1) << (slot & np.uint64(63)), (slot >> np.uint64(6)) % np.uint64(width)
    flips = np.zeros(len(key) + 1, dtype=np.uint64)
    for w in range(width):
        np.bitwise_xor.accumulate(bit if width == 1 else np.where(word == w, bit, np.uint64(0)), out=flips[1:])
        out[:, w] = flips[bounds[1:]] ^ flips[bounds[:-1]]
    return out


def slots(x: np.ndarray) -> np.ndarray:
    return (x & ((1 << SLOT_BITS) - 1)).astype(np.int64)


def in_slots(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the slots of x are set in packed bits."""
    at = slots(x)
    return (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def sketches(prefix: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The SKETCH tokens of each prefix that come first by their lower bits, which say nothing of their range; _NONE where it has fewer."""
    turned = (prefix << np.uint64(32)) | (prefix >> np.uint64(32))
    length = np.diff(np.append(starts, len(prefix)))
    out = np.empty((len(starts), SKETCH), np.uint64)
    for i in range(SKETCH):
        least = np.minimum.reduceat(turned, starts)
        out[:, i] = (least << np.uint64(32)) | (least >> np.uint64(32))
        turned = np.where(turned == np.repeat(least, length), _NONE, turned)
    return out


def range_of(token: np.ndarray, ranges: int) -> np.ndarray:
    return ((token >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def least_bytes(x: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in as few bytes each as hold them all."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def as_sent(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{max(1, len(data) // max(1, n))}").astype(kind)


def least_ids(x: np.ndarray) -> bytes:
    """Any ids as the least one and what the others have more."""
    base = x.min()
    return base.tobytes() + least_bytes(x.view(np.uint64) - base.view(np.uint64)).tobytes()


def ids_as_sent(data: bytes, n: int) -> np.ndarray:
    return as_sent(data[8:], n) + np.frombuffer(data, np.int64, 1)


POSTINGS, CLASSES, COPIES, ASKED = 0, 1, 2, 3
_SENT = "part int, kind byte, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, c5 binary, c6 binary, c7 binary"
_SENT_NAMES = ["part", "kind", *(f"c{i}" for i in range(8))]


def sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int8(), *[pa.binary()] * 8]
    rows = [r + (b"",) * (10 - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], _SENT_NAMES)


def packed_postings(rule: Rule, classes, ranges: int, asked_for=None):
    """Prefix tokens by range, and records by range of their digest; sets that a batch repeats are sent once, and their other records only as copies. With `asked_for`, only the tokens in its slots, and no records."""

    def packed(blocks_: list) -> pa.RecordBatch:
        one, two, rid, mark, line, size, extra, length, sketch, prefix = (np.concatenate(x) for x in zip(*blocks_))
        order = np.lexsort((mark, line, rid, two, one))
        fresh = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
        first = order[fresh]
        lead = first[np.cumsum(fresh) - 1]
        copy = order[(rid[order] != rid[lead]) | (line[order] != line[lead]) | (mark[order] != mark[lead])]
        rows: list[tuple] = []
        home = range_of(one[first].view(np.uint64), ranges)
        at = np.argsort(home, kind="stable")
        edge = np.searchsorted(home[at], np.arange(ranges + 1))
        for k in np.flatnonzero(np.diff(edge)) if asked_for is None else ():
            own = first[at[edge[k] : edge[k + 1]]]
            rows.append((int(k), CLASSES, *(x[own].tobytes() for x in (one, two, rid, mark, line, size))))
        if len(copy) and asked_for is None:
            rows.append((int(rid[copy[0]] % ranges), COPIES, *(x[copy].tobytes() for x in (one, two, rid, mark, line))))
        sends = np.zeros(len(one), dtype=bool)
        sends[first] = True
        record = np.repeat(np.arange(len(one)), length)
        place = np.arange(len(record)) - np.repeat(np.cumsum(length) - length, length)
        goes = sends[record]
        if asked_for is not None:
            goes &= in_slots(asked_for.value[1], prefix)
        token, record, place = prefix[goes], record[goes], place[goes]
        part = range_of(token, ranges)
        at = np.argsort(part.astype(np.uint16) if ranges < 1 << 16 else part, kind="stable")
        token, record, place, part = token[at].astype(np.uint32), record[at], place[at], part[at]
        edge = np.searchsorted(part, np.arange(ranges + 1))
        for k in np.flatnonzero(np.diff(edge)):
            own = slice(edge[k], edge[k + 1])
            head = np.flatnonzero(np.append(True, record[own][1:] != record[own][:-1]))
            who = record[own][head]
            count = np.diff(np.append(head, edge[k + 1] - edge[k]))
            rest = (least_bytes(count), one[who], least_bytes(size[who]), extra[who], sketch[who] if rule.adaptive else least_bytes(place[own]))
            when = () if rule.adaptive else (least_ids(rid[who]), least_bytes(line[who]).tobytes())
            rows.append((int(k), POSTINGS, token[own].tobytes(), *(x.tobytes() for x in rest), *when))
        return sent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = flat(batch.column("text"))
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            parts, held = [], 0
            for low, high in blocks(at):
                if held > SENT_POSTINGS:
                    yield packed(parts)
                    parts, held = [], 0
                tokens, bounds, row, line = record_tokens(at, raw, low, high, rule)
                filled = np.diff(bounds) > 0
                if asked_for is not None:
                    # Records that have no such token at all needn't be put in order.
                    seen = np.append(0, np.cumsum(in_slots(asked_for.value[1], mix(tokens >> np.uint64(8)))))
                    filled = seen[bounds[1:]] > seen[bounds[:-1]]
                    tokens = tokens[np.repeat(filled, np.diff(bounds))]
                bounds, row, line = np.append(0, np.cumsum(np.diff(bounds)[filled])), row[filled], line[filled]
                if not len(row):
                    continue
                key, edge = ordered_sets(tokens, bounds, classes.value)
                size = np.diff(edge)
                asked = matches_asked(key, edge, size, rule)
                length = np.minimum(size, size - needed(size, rule.threshold) + asked)
                starts = np.cumsum(length) - length
                place = np.arange(length.sum()) - np.repeat(starts, length)
                prefix = mix(key[np.repeat(edge[:-1], length) + place] & _LOW)
                if asked_for is not None:
                    meets = np.logical_or.reduceat(in_slots(asked_for.value[1], prefix), starts)
                    if not meets.any():
                        continue
                    key, prefix = key[np.repeat(meets, size)], prefix[np.repeat(meets, length)]
                    row, line, size, asked, length = (x[meets] for x in (row, line, size, asked, length))
                    edge, starts = np.append(0, np.cumsum(size)), np.cumsum(length) - length
                one, two = digests(key, edge)
                extra = asked.astype(np.uint8) if rule.adaptive else parities(key, edge, 1 if asked_for is None else PARITIES)
                sketch = sketches(prefix, starts) if rule.adaptive else np.zeros((len(size), 0), np.uint64)
                parts.append((one, two, ids[row].astype(np.int64), marks[row].astype(np.int64), line.astype(np.int32), size.astype(np.int32), extra, length, sketch, prefix))
                held += len(prefix)
            if parts:
                yield packed(parts)

    return run


def list_pairs(token: np.ndarray, size: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that share a token and whose lesser set has at least the threshold's share of the greater one's size; sorted by token, and by size within it."""
    head = np.append(True, token[1:] != token[:-1])
    start = np.flatnonzero(head)
    end = np.repeat(np.append(start[1:], len(token)), np.diff(np.append(start, len(token))))
    must = needed(size, rule.threshold)
    here = np.flatnonzero(end - np.arange(len(token)) > 1)
    step = 1
    while len(here):
        here = here[must[here + step] <= size[here]]  # sizes rise within a list, so that what is too long once stays so
        for low in range(0, len(here), 1 << 18):
            a = here[low : low + (1 << 18)]
            yield a, a + step
        here = here[here + step + 1 < end[here]]
        step += 1


def earlier_pairs(token: np.ndarray, size: np.ndarray, place: np.ndarray, bits: np.ndarray, when: np.ndarray, asks: np.ndarray, most: int, stopped: list, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y) of sets y that ask and sets x not later that share a token with them and pass the filters; sorted by token, and by size within it.

    The nearest by size come first, lesser ones before greater ones, and y gets `most` in a
    list and no more; those that get so many are told in `stopped`.  Filters: length, as in
    list_pairs; position: from the shared token on, the shorter rest must have what the
    overlap needs, for before its first shared token a pair has none; and parity: bits that
    differ bound the overlap from above.
    """
    must, found = needed(size, rule.threshold), np.zeros(len(token), np.int64)
    for step in (-1, 1):
        side, here = step, np.flatnonzero(asks & (found < most))
        while len(here):
            here = here[here + step >= 0] if side < 0 else here[here + step < len(token)]
            far = here + step
            long, short = (here, far) if side < 0 else (far, here)
            here = here[(token[here] == token[far]) & (must[long] <= size[short])]  # what is too long or too short once stays so
            for low in range(0, len(here), 1 << 18):
                y = here[low : low + (1 << 18)]
                fit = when[y + step] <= when[y]
                y = y[fit]
                x = y + step
                least = np.ceil((size[x] + size[y]) * (rule.threshold / (1 + rule.threshold)) - 1e-9)
                fit = np.minimum(size[x] - place[x], size[y] - place[y]) >= least
                x, y, least = x[fit], y[fit], least[fit]
                fit = size[x] + size[y] - np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) >= 2 * least
                x, y = x[fit], y[fit]
                found[y] += 1
                yield x, y
            here = here[found[here] < most]
            step += side
    stopped.append(np.flatnonzero(found >= most))


def gathered(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs once each, with the sum of their matches."""
    order = np.argsort(code)
    code, n = code[order], n[order]
    if not len(code):
        return code, n
    head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[head], np.add.reduceat(n, head, dtype=np.int32)


def range_pairs(rows: list[tuple], rule: Rule, own: int, ranges: int, most: int, asked_for, more: list) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of sets that share tokens of one range: (a, b, matches, matches asked for). Where prefixes ask for one match, see earlier_pairs; `more` gets the sets and tokens where it stopped.

    Near copies share tokens in most ranges.  Where the sketches of two sets have a token in
    common, only the range of the first such token, which both see, passes the pair on, and
    its matches count as enough; other pairs are passed on by each range that has matches,
    to be added up.  Texts decide in the end.
    """
    columns: tuple[list, ...] = ([], [], [], [], [], [], *([], []) * (not rule.adaptive))
    for t, c, o, s, e, last, ids, line in rows:
        one = np.frombuffer(o, np.int64)
        n = len(one)
        own_kinds = (np.frombuffer(e, np.uint8), np.frombuffer(last, np.uint64).reshape(-1, SKETCH)) if rule.adaptive else (np.frombuffer(e, np.uint64).reshape(n, -1), as_sent(last, len(t) // 4, np.int32), ids_as_sent(ids, n), as_sent(line, n, np.int32))
        for column, part in zip(columns, (np.frombuffer(t, np.uint32), as_sent(c, n, np.int32), one, as_sent(s, n, np.int32), *own_kinds)):
            column.append(part)
    rows.clear()
    token, count, one, size, extra, last, *at = map(one_array, columns)
    # A set that came from several batches counts once, where it is first; sets are numbered in the order of their digests.
    if rule.adaptive:
        names, first, number = np.unique(one, return_index=True, return_inverse=True)
    else:
        ids, line = at
        at.clear()
        order = np.lexsort((line, ids))
        when, ids, line = np.empty(len(one), np.int32), ids[order], line[order]
        when[order] = np.cumsum(np.append(False, (ids[1:] != ids[:-1]) | (line[1:] != line[:-1])))
        order = order[np.argsort(one[order], kind="stable")]
        head = np.append(True, one[order][1:] != one[order][:-1])
        first, number = order[head], np.empty(len(one), np.int32)
        number[order] = np.cumsum(head) - 1
        names, when = one[first], when[first]
        del ids, line, order, head
    fresh = np.zeros(len(one), dtype=bool)
    fresh[first] = True
    goes = np.repeat(fresh, count)
    record = np.repeat(number.astype(np.int32, copy=False), count)[goes]
    token, place = token[goes], None if rule.adaptive else last[goes]
    size, extra = size[first], extra[first]
    del one, count, number, fresh, goes
    order = np.argsort((token.astype(np.uint64) << np.uint64(32)) | size[record].astype(np.uint64))
    token, record = token[order], record[order]
    alike = np.append(False, token[1:] == token[:-1])
    alike[:-1] |= alike[1:]
    token, record = token[alike], record[alike]
    if not len(token):
        return
    place = None if place is None else place[order][alike]
    del order, alike
    total = len(names)

    def passed(code: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for low in range(0, len(code), MOVED_PAIRS):
            x, y = np.divmod(code[low : low + MOVED_PAIRS], total)
            if not rule.adaptive:
                none = np.ones(len(x), np.int32)
                yield names[x], names[y], none, none
                continue
            matches, asked = n[low : low + MOVED_PAIRS], np.minimum(extra[x], extra[y]).astype(np.int32)
            mine, other = last[first[x]], last[first[y]]
            both = (mine[:, :, None] == other[:, None, :]).any(2) & (mine != _NONE)
            meets = both.any(1)
            at = mine[np.arange(len(x)), both.argmax(1)]
            goes = ~meets | (range_of(at, ranges) == own)
            matches = np.where(meets, asked, matches)
            yield names[x[goes]], names[y[goes]], matches[goes], asked[goes]

    done, times = np.zeros(0, np.int64), np.zeros(0, np.int32)
    fresh, waiting = [], 0
    stopped: list[np.ndarray] = []
    if rule.adaptive:
        pairs = list_pairs(token, size[record], rule)
    else:
        asks = np.ones(len(names), bool) if asked_for is None else in_slots(asked_for.value[0], names)
        pairs = earlier_pairs(token, size[record], place, extra[record], when[record], asks[record], most, stopped, rule)
    for x, y in pairs:
        a, b = record[x].astype(np.int64), record[y].astype(np.int64)
        fresh.append(np.minimum(a, b) * total + np.maximum(a, b))
        waiting += len(a)
        if waiting > max(HELD_PAIRS // 2, len(done)):
            new = np.concatenate(fresh)
            done, times = gathered(np.concatenate([done, new]), np.concatenate([times, np.ones(len(new), np.int32)]))
            fresh, waiting = [], 0
            if len(done) > HELD_PAIRS:
                yield from passed(done, times)
                done, times = done[:0], times[:0]
    new = np.concatenate([*fresh, done[:0]])
    yield from passed(*gathered(np.concatenate([done, new]), np.concatenate([times, np.ones(len(new), np.int32)])))
    more += [(names[record[p]], token[p].astype(np.int64)) for p in stopped]


def first_places(rows: list[tuple]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the records of each set the first by doc_id, line and mark, and all others."""
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
    columns = [np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate(kinds)]
    order = np.lexsort((columns[3], columns[4], columns[2], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    differs = lambda c: np.append(True, c[1:] != c[:-1])
    head = differs(columns[0]) | differs(columns[1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    other = (columns[2] != columns[2][lead]) | (columns[3] != columns[3][lead]) | (columns[4] != columns[4][lead])
    return [c[head] for c in columns], [c[other] for c in columns]


_JOINED = "kind byte, a long, b long, n int, need int, doc_id long, mark long, line int"


def join_ranges(rule: Rule, ranges: int, most: int, asked_for=None):
    """One partition is one range: the pairs among its postings, the sets and tokens that have more, and the first place of each set whose digest lies in it."""

    def rows(kind: int, total: int, **columns: np.ndarray) -> pa.RecordBatch:
        kinds = {"a": pa.int64(), "b": pa.int64(), "n": pa.int32(), "need": pa.int32(), "doc_id": pa.int64(), "mark": pa.int64(), "line": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(np.full(total, kind, np.int8)), *(pa.array(columns[c], t) if c in columns else pa.nulls(total, t) for c, t in kinds.items())], ["kind", *kinds])

    def records(kind: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(columns[0]), MOVED_PAIRS):
            part = [c[low : low + MOVED_PAIRS] for c in columns]
            yield rows(kind, len(part[0]), **dict(zip(("a", "b", "doc_id", "mark", "line", "n"), part)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, homes, own = [], [], 0
        for batch in batches:
            for part, kind, *blobs in zip(*(batch.column(c).to_pylist() for c in _SENT_NAMES)):
                own = part
                if kind == POSTINGS:
                    postings.append(blobs)
                elif kind == CLASSES:
                    homes.append(blobs)
                else:
                    yield from records(COPIES, [np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.int64, np.int64, np.int64, np.int32))])
        if homes:
            first, others = first_places(homes)
            homes.clear()
            yield from records(CLASSES, first)
            yield from records(COPIES, others[:5])
        if postings:
            more: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b, n, need in range_pairs(postings, rule, own, ranges, most, asked_for, more):
                yield rows(POSTINGS, len(a), a=a, b=b, n=n, need=need)
            for a, b in more:
                for low in range(0, len(a), MOVED_PAIRS):
                    yield rows(ASKED, len(a[low : low + MOVED_PAIRS]), a=a[low : low + MOVED_PAIRS], b=b[low : low + MOVED_PAIRS])

    return run


def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs once each that have the matches they need, with the least digest that is paired with b: a key that most pairs of a cluster share."""
    parts = [tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n", "need")) for batch in batches]
    if not parts:
        return
    a, b, n, need = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((a, b))
    a, b, n, need = a[order], b[order], n[order], need[order]
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    good = np.add.reduceat(n, head, dtype=np.int64) >= need[head] if len(head) else np.zeros(0, bool)
    a, b = a[head][good], b[head][good]
    if not len(a):
        return
    new = np.append(True, b[1:] != b[:-1])
    key = a[np.flatnonzero(new)[np.cumsum(new) - 1]]
    for low in range(0, len(a), MOVED_PAIRS):
        yield pa.RecordBatch.from_arrays([pa.array(x[low : low + MOVED_PAIRS]) for x in (a, b, key)], ["a", "b", "key"])


@dataclass
class Found:
    """records: (kind, one, two, doc_id, mark, line, size), CLASSES for the first of each set, COPIES for all others; pairs: (a, b, part) of candidates, part the task that verifies them; parts: how many of those there are; again: what `further` needs to join anew; tokens: how many all records have."""

    records: DataFrame
    pairs: DataFrame
    parts: int
    tables: list[DataFrame]
    again: tuple
    tokens: int

    def discard(self) -> None:
        scratch.discard(*self.tables)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark) of the rows that have an id and a text; mark tells texts apart that share an id."""
    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").withColumn("mark", F.xxhash64("text"))


def candidates(docs: DataFrame, rule: Rule) -> Found:
    """All records of `docs`, and the pairs of sets that pass the filters; for lines, some of them for each set, and `further` has the rest."""
    docs = marked(docs)
    spark = docs.sparkSession
    table, total = rarity(docs, rule)
    # A prefix is about (1 - threshold) of a record; lines are short, so that rounding and the one token more count.
    postings = total * (1 - rule.threshold) * (1.1 if rule.unit == "doc" else 1.5) + 1
    ranges = int(max(8, np.ceil(postings / RANGE_POSTINGS)))
    classes = spark.sparkContext.broadcast(table)
    packed = docs.mapInArrow(packed_postings(rule, classes, ranges), _SENT)
    joined = scratch.written(packed.repartitionById(ranges, "part").mapInArrow(join_ranges(rule, ranges, EARLIER), _JOINED), "joined")
    records = joined.where(F.col("kind").isin(CLASSES, COPIES)).select("kind", F.col("a").alias("one"), F.col("b").alias("two"), "doc_id", "mark", "line", F.col("n").alias("size"))
    sizes = joined.agg(F.count_if(F.col("kind") == POSTINGS).alias("pairs"), F.count_if(F.col("kind") == CLASSES).alias("sets"), F.coalesce(F.sum(F.when(F.col("kind") == CLASSES, F.col("n"))), F.lit(0)).alias("tokens")).first()
    pairs, parts, keyed = placed(joined, sizes["pairs"], sizes["sets"], sizes["tokens"])
    return Found(records, pairs, parts, [joined, keyed], (docs, rule, classes, ranges, sizes), total)


def further(found: Found, settled: DataFrame) -> Found | None:
    """All candidates of the sets that stopped at some and are not among `settled`, a table with their digests as `one`; None if there are none.

    What is asked goes to the tasks as slots of hashes in tables of one size. Slots that
    others share bring more pairs, which is no harm.
    """
    docs, rule, classes, ranges, sizes = found.again
    asked = found.tables[0].where(f"kind = {ASKED}").select(F.col("a").alias("one"), F.col("b").alias("token")).join(settled.select("one").distinct(), "one", "left_anti")
    rows = asked.coalesce(8).mapInArrow(slots_asked, "one binary, token binary").collect()
    if not rows:
        return None
    bits = tuple(np.bitwise_or.reduce([np.frombuffer(r[c], np.uint8) for r in rows]) for c in ("one", "token"))
    asked_for = docs.sparkSession.sparkContext.broadcast(bits)
    packed = docs.mapInArrow(packed_postings(rule, classes, ranges, asked_for), _SENT)
    joined = scratch.written(packed.repartitionById(ranges, "part").mapInArrow(join_ranges(rule, ranges, np.iinfo(np.int64).max, asked_for), _JOINED), "joined")
    pairs, parts, keyed = placed(joined, joined.count(), sizes["sets"], sizes["tokens"])
    return Found(found.records, pairs, parts, [joined, keyed], found.again, found.tokens)


def slots_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = None
    for batch in batches:
        if batch.num_rows:
            seen = np.zeros((2, 1 << SLOT_BITS), bool) if seen is None else seen
            for k, c in enumerate(("one", "token")):
                seen[k, slots(batch.column(c).to_numpy())] = True
    if seen is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(x).tobytes()], pa.binary()) for x in seen], ["one", "token"])


def placed(joined: DataFrame, pairs: int, sets: int, tokens: int) -> tuple[DataFrame, int, DataFrame]:
    """The pairs of a joined table once each as (a, b, part), how many parts there are, and the table they are read from."""
    keyed = joined.where(f"kind = {POSTINGS}").select("a", "b", "n", "need").repartition(int(max(1, -(-pairs // TASK_PAIRS))), "b")
    keyed = scratch.written(keyed.mapInArrow(clusters, "a long, b long, key long"), "keyed")
    links = keyed.count()
    parts = int(max(1, np.ceil(min(2 * links, sets) * (tokens / max(1, sets)) / TASK_TOKENS), np.ceil(links / TASK_PAIRS)))
    # Keys of more than TASK_PAIRS pairs are cut into square blocks; there is one at most for every TASK_PAIRS pairs.
    heavy = keyed.groupBy("key").agg(F.count("*").alias("links")).where(F.col("links") > TASK_PAIRS)
    heavy = heavy.select("key", F.ceil(F.sqrt(F.col("links") * 2 / TASK_PAIRS)).cast("int").alias("side"))
    block = F.when(F.col("side").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("a"), "side"), F.pmod(F.xxhash64("b"), "side")))
    return keyed.join(F.broadcast(heavy), "key", "left").select("a", "b", F.pmod(block, F.lit(parts)).cast("int").alias("part")), parts, keyed


def packed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, a, b = (batch.column(c).to_numpy() for c in ("part", "a", "b"))
        order = np.argsort(part, kind="stable")
        part, a, b = part[order], a[order], b[order]
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        rows = [(int(part[i]), 0, pa.compress(a[i:j].tobytes() + b[i:j].tobytes(), "lz4", asbytes=True), int(j - i)) for i, j in zip(head, np.append(head[1:], len(part)))]
        yield met_rows(rows)


def met_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "kind": pa.int8(), "body": pa.binary(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def record_texts(rule: Rule):
    """The text of each wanted record, of a whole row or of one line, compressed together with others that go to the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # of rows that are repeated one is enough
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                by: dict[int, tuple[list, list]] = {}
                for doc_id, mark, body, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text", "wanted"))):
                    if (doc_id, mark) in seen:
                        continue
                    seen.add((doc_id, mark))
                    cut = body.split("\n") if rule.unit == "line" else None
                    for w in wanted:
                        fields, texts = by.setdefault(w["part"], ([], []))
                        texts.append((body if cut is None else cut[w["line"]]).encode())
                        fields += (w["one"], doc_id, mark, w["line"], w["weight"], len(texts[-1]))
                rows = []
                for part, (fields, texts) in by.items():
                    data = np.array(fields, np.int64).tobytes() + b"".join(texts)
                    rows.append((part, 1, len(fields).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True), len(data)))
                yield met_rows(rows)

    return run


def hashed_sets(at: np.ndarray, raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of hash, in two arrays, for the n-grams of each text, and how many of them each text has."""
    first, second, count = [], [], []
    for low, high in blocks(at):
        data, cuts = raw[at[low] : at[high]], at[low : high + 1] - at[low]
        starts, ends, hashes = words(data, cuts)
        bounds = np.searchsorted(starts, cuts)
        for out, own in ((first, hashes), (second, other_hashes(data, starts, ends))):
            tokens, edge = shingles(own, bounds, n)
            out.append(tokens)
        count.append(np.diff(edge))
    return tuple(np.concatenate(x) for x in (first, second, count))


def numbered_sets(token: np.ndarray, other: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The set of n-grams of each text as numbers, with bounds; n-grams that no two texts share have no number, but count in the sizes.

    token, other and count are those of hashed_sets.  N-grams are numbered by range of their
    hash, so that sorting takes memory for one range and not for all that meet in a task.
    """
    ends, size, met = np.cumsum(count), np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
    high, ranges, total, parts = (token >> np.uint64(48)).astype(np.uint16), -(-len(token) // NUMBERED_TOKENS), 0, []
    for k in range(ranges):
        at = np.flatnonzero((high >= (k << 16) // ranges) & (high < (k + 1 << 16) // ranges))
        own, also, record = token[at], other[at], np.searchsorted(ends, at, side="right")
        order = np.argsort(own)
        own, also, record = own[order], also[order], record[order]
        if (also[1:] != also[:-1])[own[1:] == own[:-1]].any():
            # Two n-grams share the first hash: all are sorted by both.
            order = np.lexsort((also, own))
            own, also, record = own[order], also[order], record[order]
        number = np.cumsum(np.append(True, (own[1:] != own[:-1]) | (also[1:] != also[:-1]))[: len(own)]) - 1
        code = distinct((record << 32) | number)
        record, number = code >> 32, code & 0xFFFFFFFF
        size += np.bincount(record, minlength=len(count))
        shared = np.bincount(number) > 1
        kept = shared[number]
        record, number = record[kept], (np.cumsum(shared) - 1)[number[kept]] + total
        met += np.bincount(record, minlength=len(count))
        total += int(shared.sum())
        parts.append((record.astype(np.int32), number.astype(np.int32)))
    edge = np.append(0, np.cumsum(met))
    out, free = np.empty(edge[-1], np.int32), edge[:-1].copy()
    for record, number in parts:
        times = np.bincount(record, minlength=len(count))
        out[np.arange(len(record)) + (free - np.cumsum(times) + times)[record]] = number
        free += times
    return out, edge, size, total


def overlaps(token: np.ndarray, edge: np.ndarray, a: np.ndarray, b: np.ndarray, total: int) -> np.ndarray:
    """How many tokens the sets a[i] and b[i] share; pairs sorted by a. The tokens of some sets are marked in a table, a row for each, and those of their partners looked up."""
    out, size = np.zeros(len(a), np.int64), np.diff(edge)
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(a))
    slots = int(max(1, min(512, (1 << 24) // max(1, total))))
    seen = np.zeros(slots * max(1, total), dtype=bool)

    def places(row: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[who]
        begin = np.cumsum(n) - n
        at = np.repeat(edge[who] - begin, n) + np.arange(n.sum())
        return np.repeat(row * total, n) + token[at], begin

    for i in range(0, len(head), slots):
        low, high = int(head[i]), int(ends[min(i + slots, len(head)) - 1])
        own = a[head[i : i + slots]]
        marks, _ = places(np.arange(len(own)), own)
        seen[marks] = True
        row = np.repeat(np.arange(len(own)), ends[i : i + slots] - head[i : i + slots])
        # In slices, so that sets with many partners don't bring all their tokens together.
        bound = np.cumsum(size[b[low:high]])
        at = 0
        while at < high - low:
            upto = max(at + 1, int(np.searchsorted(bound, (bound[at - 1] if at else 0) + TASK_TOKENS // 4, side="right")))
            other, begin = places(row[at:upto], b[low + at : low + upto])
            hits = np.concatenate([[0], np.cumsum(seen[other])])
            out[low + at : low + upto] = hits[begin + size[b[low + at : low + upto]]] - hits[begin]
            at = upto
        seen[marks] = False
    return out


def verify(rule: Rule, told):
    """Counts the overlap of each pair that meets here, on whole texts; `told` makes rows of those that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, fields, sets = [], [], ([], [], [])
        for batch in batches:
            for kind, body, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "body", "n"))):
                if kind == 0:
                    pairs.append(np.frombuffer(pa.decompress(body, 16 * n, "lz4", asbytes=True), np.int64).reshape(2, n))
                    continue
                k = int.from_bytes(body[:8], "little")
                data = pa.decompress(body[8:], n, "zstd", asbytes=True)
                # Texts are hashed as they come; what is kept of each message is copied out of it.
                fields.append(np.frombuffer(data, np.int64, k).reshape(-1, 6).copy())
                for column, own in zip(sets, hashed_sets(np.append(0, np.cumsum(fields[-1][:, 5])), np.frombuffer(data, np.uint8, offset=8 * k), rule.n)):
                    column.append(own)
        if not pairs:
            return
        if not fields:
            raise RuntimeError("no text of a candidate was found: the table changed while it was read")
        known = np.concatenate(fields)
        order = np.argsort(known[:, 0], kind="stable")
        names = known[order, 0]
        a, b = np.concatenate(pairs, axis=1)
        slot_a, slot_b = (np.minimum(np.searchsorted(names, x), len(names) - 1) for x in (a, b))
        if (names[slot_a] != a).any() or (names[slot_b] != b).any():
            raise RuntimeError("the text of a candidate was not found: the table changed while it was read")
        a, b = order[slot_a], order[slot_b]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        token, edge, size, total = numbered_sets(*map(one_array, sets))
        shared = overlaps(token, edge, a, b, total)
        good = shared >= rule.threshold * (size[a] + size[b] - shared) - 1e-9
        yield from told(known, a[good], b[good])

    return run


def verified(docs: DataFrame, found: Found, firsts: DataFrame, rule: Rule, told, schema: str) -> DataFrame:
    """Rows that `told(known, a, b)` makes of the pairs whose sets reach the threshold; a and b are rows of known: (one, doc_id, mark, line, weight, bytes).

    firsts: (one, doc_id, mark, line, weight) of each set.  Pairs of a cluster meet in one
    task, and the text of a set is brought there once for all of them.  Nothing that grows
    with the input is broadcast: the texts move once, joined by a hash table of the places
    that are wanted of each partition.
    """
    wanted = found.pairs.select("part", F.explode(F.array("a", "b")).alias("one")).distinct()
    wanted = wanted.join(firsts, "one").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("line", "part", "one", "weight")).alias("wanted"))
    fetched = marked(docs).join(wanted.hint("shuffle_hash"), ["doc_id", "mark"])
    schema_in = "part int, kind byte, body binary, n long"
    texts = fetched.mapInArrow(record_texts(rule), schema_in)
    pairs = found.pairs.mapInArrow(packed_pairs, schema_in)
    return texts.unionByName(pairs).repartitionById(found.parts, "part").mapInArrow(verify(rule, told), schema)
