import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import line_dedup, near_docs, setsim

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(60)]


def corpus(seed, n, edits):
    """Random texts over a Zipf-like vocabulary, most of them edited copies of earlier ones."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(WORDS[min(59, int(rng.paretovariate(0.6)))] for _ in range(rng.randrange(1, 60))))
    return texts


def jaccard(a, b):
    return len(a & b) / len(a | b)


def grams(text, n=3):
    w = text.split()
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def expected_classes(rows, threshold=0.5):
    """(class_id, links) of every doc_id, by comparing all documents with all."""
    docs = sorted({(i, t) for i, t in rows if i is not None}, key=str)
    sets = [(i, grams(t)) for i, t in docs if t is not None and grams(t)]
    links, root = {i: 0 for i, _ in docs}, {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if jaccard(a, b) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i: (top(i), links[i]) for i, _ in docs}


def classes_of(df):
    got = df.collect()
    found = {r.doc_id: (r.class_id, r.links) for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_equal_brute_force(spark, seed):
    rows = list(enumerate(corpus(seed, 120, 12)))
    want = expected_classes(rows)
    assert classes_of(near_docs.near_classes(spark.createDataFrame(rows, DOCS).repartition(3))) == want
    assert sum(k for _, k in want.values()) > 40 and len({c for c, _ in want.values()}) > 10


@pytest.mark.parametrize("pairs, tokens, postings", [(3, 50, 3_000_000), (2_000_000, 4_000_000, 40)])
def test_near_classes_in_many_tasks(spark, monkeypatch, pairs, tokens, postings):
    """Clusters that are cut into blocks, and ranges of few postings, change nothing."""
    for name, value in (("TASK_PAIRS", pairs), ("TASK_TOKENS", tokens), ("RANGE_POSTINGS", postings)):
        monkeypatch.setattr(setsim, name, value)
    rows = list(enumerate(corpus(7, 40, 8)))
    assert classes_of(near_docs.near_classes(spark.createDataFrame(rows, DOCS).repartition(2))) == expected_classes(rows)


def test_near_classes_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "one"), (None, "one"), (6, "a b c d"), (6, "a b c d"), (6, "x y z"), (7, "x y z"), (8, long), (9, long + " more"), (10, "a b c d")]
    df = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("links"), F.lit("x").alias("one"), F.lit(2).alias("k"))
    want = {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 2), 7: (6, 1), 8: (8, 1), 9: (8, 1), 10: (6, 1)}
    assert classes_of(near_docs.near_classes(df)) == want
    assert near_docs.near_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_words_of_two_letters_keep_apart(spark):
    """Thue-Morse words collide under polynomials modulo a power of two."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    assert classes_of(near_docs.near_classes(spark.createDataFrame(rows, DOCS))) == {1: (1, 1), 2: (2, 0), 3: (1, 1)}


def test_one_of_each_group(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (9, 20), (5, 6), (6, 5)], "doc_a long, doc_b long")
    assert {(r.doc_id, r.head) for r in near_docs.groups(pairs).collect()} == {(2, 1), (3, 1), (9, 1), (20, 1), (6, 5)}
    base = [f"u{i}" for i in range(40)]
    rows = [(10, " ".join(base)), (11, " ".join(base[:38] + ["p", "q"])), (12, "other text here entirely"), (13, None), (None, "x")]
    left = near_docs.one_of_each(spark.createDataFrame(rows, DOCS))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["10", "12", "13", "None"]


def kept_lines(rows, threshold=0.8):
    seen, out = [], {}
    for doc_id, text in sorted(set(r for r in rows if None not in r)):
        keep, had = [], False
        for line in text.split("\n"):
            words = frozenset(line.split())
            if not words:
                keep.append((line, False))
                continue
            had = True
            if not any(jaccard(words, s) >= threshold - 1e-12 for s in seen):
                keep.append((line, True))
            seen.append(words)
        if not had:
            out[doc_id] = text
        elif any(k for _, k in keep):
            out[doc_id] = "\n".join(line for line, _ in keep)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_lines_equal_brute_force(spark, seed):
    lines = corpus(seed, 160, 5)
    rng = random.Random(seed)
    rows, at = [], 0
    while at < len(lines):
        n = rng.randrange(1, 6)
        rows.append((len(rows), "\n".join(lines[at : at + n]) + rng.choice(["", "\n", "\n\n"])))
        at += n
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == kept_lines(rows)


def test_lines_odd_rows(spark):
    schema = "doc_id long, text string, n_chars long, line string, one long"
    rows = [(1, None, None, "a", 1), (2, "", 0, None, 2), (3, "\n \n", 3, "b", 3), (4, "a b c\nfresh one", 15, "c", 4), (5, "c b a\nnew words", 15, "d", 5), (6, "a b c", 5, "e", 6), (None, "a b c", 5, "f", 7), (7, "z y\n" * 3000, 12000, "g", 8), (4, "a b c\nfresh one", 15, "h", 9)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.text, r.n_chars))
    assert by == {1: [(None, None)], 2: [("", 0)], 3: [("\n \n", 3)], 4: [("a b c\nfresh one", 15)] * 2, 5: [("new words", 9)], None: [("a b c", 5)], 7: [("z y\n", 4)]}
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0


def cluster(n, edits=(1, 1, 1, 8, 10), words=80):
    """Copies of a line, each with words of its own: one (like all such), 8 (like few, though many pass the filters) or 10 (like none)."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(words), rng.choice(edits)):
            own[k] = f"x{i}_{k}"
        out.append(" ".join(own))
    return out


def test_candidates_of_a_cluster_of_lines_are_few(spark):
    """A cluster of lines has as many pairs as the square of its size; what is written of them follows the size."""
    made = []
    for n in (150, 600):
        found = setsim.candidates(spark.createDataFrame(list(enumerate(cluster(n))), DOCS), setsim.Rule("line", 1, 0.8, False))
        made.append(found.tables[0].where(f"kind in ({setsim.POSTINGS}, {setsim.ASKED})").count())
        found.discard()
    assert made[1] < 6 * made[0] and made[1] < 600 * 60


@pytest.mark.parametrize("earlier", [1, setsim.EARLIER])
def test_lines_that_ask_again_equal_brute_force(spark, monkeypatch, earlier):
    monkeypatch.setattr(setsim, "EARLIER", earlier)
    lines = cluster(160)
    rows = [(i, "\n".join(lines[2 * i : 2 * i + 2])) for i in range(80)] + [(-(2**63), lines[7]), (2**63 - 1, lines[9])]
    asked = []
    monkeypatch.setattr(line_dedup, "further", lambda *x: asked.append(setsim.further(*x)) or asked[-1])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == kept_lines(rows)
    assert asked[0] is not None and 10 < len(got) < 80


def traced(run, batches):
    """What a task yields for the batches, and the most bytes it held on the way."""
    tracemalloc.start()
    try:
        return list(run(iter(batches))), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_task_of_the_verification_holds_few_bytes_a_token():
    """Texts of millions of tokens meet in a task, and executors have little memory besides the JVM's."""
    rng, n, width = np.random.default_rng(5), 5000, 500
    words = rng.integers(0, 50_000, (n, width))
    words[1::2] = words[::2]
    words[3::4, 100:] = rng.integers(0, 50_000, (n // 4, 400))  # every second pair is unlike
    lines = [" ".join(map(str, w)) for w in words.tolist()]
    wanted = [[{"part": 0, "one": i, "line": 0, "weight": 0}] for i in range(n)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n), pa.array(lines), pa.array(wanted)], ["doc_id", "mark", "text", "wanted"])
    pairs = pa.RecordBatch.from_arrays([pa.array([0] * (n // 2), pa.int32()), pa.array(range(0, n, 2)), pa.array(range(1, n, 2))], ["part", "a", "b"])
    rule = setsim.Rule("line", 1, 0.8, False)
    sent = [*setsim.record_texts(rule)(iter([whole])), *setsim.packed_pairs(iter([pairs]))]
    got, most = traced(setsim.verify(rule, line_dedup.late), sent)
    assert [x for batch in got for x in batch.column("doc_id").to_pylist()] == list(range(1, n, 4))
    assert most < 60 * n * width, most / (n * width)


def test_a_task_of_the_join_holds_few_bytes_a_posting():
    rng, n = np.random.default_rng(6), 120_000
    lines = [" ".join(map(str, w)) for w in rng.integers(0, 30_000, (n, 10)).tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n), pa.array(lines)], ["doc_id", "mark", "text"])
    rule, classes = setsim.Rule("line", 1, 0.8, False), SimpleNamespace(value=np.zeros(1 << setsim.CLASS_BITS, np.uint8))
    sent = [b.filter(pa.array([k == setsim.POSTINGS for k in b.column("kind").to_pylist()])) for b in setsim.packed_postings(rule, classes, 1)(iter([batch]))]
    postings = sum(len(t) // 4 for b in sent for t in b.column("c0").to_pylist())
    assert postings > 2 * n
    _, most = traced(setsim.join_ranges(rule, 1, setsim.EARLIER), sent)
    assert most < 140 * postings, most / postings


def test_lines_are_verified_in_rounds_of_a_share_of_the_input(spark, monkeypatch):
    """Where candidates' texts are more than the input's share, they meet round by round; nothing is lost."""
    monkeypatch.setattr(setsim, "TASK_TOKENS", 600)
    lines = cluster(160)
    rows = [(i, "\n".join(lines[2 * i : 2 * i + 2])) for i in range(80)]
    rounds, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda docs, found, *x: rounds.append(found) or verified(docs, found, *x))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == kept_lines(rows)
    assert len(rounds) > 2 and max(f.parts for f in rounds) * 600 <= 0.5 * 160 * 80
