import random

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import quality as Q
from marginalia.llm.text import flat

ROOT = "/root/testdata/sf0.01"


def texts(seed, n, bad):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "on", "and", "of", "tree", "house"]) + ("%%%" if bad and rng.random() < 0.5 else "") for _ in range(rng.randrange(3, 200))) for _ in range(n)]


def windows(net, text):
    """The network by its definition: every window of every chunk of one text."""
    data = np.frombuffer(text.encode() or b"\0", np.uint8)
    n = len(data)
    data = np.concatenate([data, np.zeros(Q.WIDTH, np.uint8)])
    seen = np.array([sum(net.filters[k][data[i + k]] for k in range(Q.WIDTH)) for i in range(n)])
    chunks = [seen[i : i + Q.CHUNK].max(0) for i in range(0, max(1, n - Q.CHUNK + Q.STEP), Q.STEP)]
    pooled = np.maximum(np.array(chunks) + net.bias, 0)
    z = np.concatenate([pooled.mean(0), pooled.max(0)]) @ net.head[:-1] + net.head[-1]
    return 1 / (1 + np.exp(-z))


@pytest.fixture(scope="module")
def net():
    good, bad = texts(1, 100, False), texts(2, 100, True)
    return Q.fit(good + bad, np.array([1] * 100 + [0] * 100), epochs=4)


def test_scores_equal_the_definition(net):
    rng = random.Random(3)
    samples = ["", "a", "ab" * 256, "x" * 511, "x" * 512, "x" * 513, "x" * 960, "x" * 961, "".join(rng.choice("abc %é") for _ in range(60_000))] + texts(4, 20, True)
    at, raw = flat(pa.array(samples, pa.large_string()))
    assert np.allclose(net.score(at, raw), [windows(net, t) for t in samples], atol=1e-4)


def test_unseen_texts_are_told_apart(net):
    at, raw = flat(pa.array(texts(5, 60, False) + texts(6, 60, True), pa.large_string()))
    p = net.score(at, raw)
    assert (p[:60] > 0.5).mean() > 0.95 and (p[60:] < 0.5).mean() > 0.95


def test_held_out_accuracy_on_the_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    train, test = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    rows = Q.scored(docs, train).join(test, "doc_id").select("probability", "quality").collect()
    assert np.mean([(r.probability >= Q.KEEP_AT) == (r.quality == 1) for r in rows]) > 0.95


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = [(i, t, 1.0, "z") for i, t in enumerate(texts(7, 20, False) + texts(8, 20, True))] + [(50, None, 2.0, None), (51, "", 3.0, "q"), (None, "tree", 4.0, ""), (1, "again", 5.0, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, probability double, quality string")
    out = Q.scored(docs, labels)
    assert out.columns == ["doc_id", "text", "quality", "probability"] and out.count() == 44
    assert {r.doc_id: r.probability for r in out.where("doc_id = 50").collect()} == {50: None}
    assert Q.kept(docs, labels).columns == docs.columns
    assert Q.scored(docs, labels.where("quality = 1")).where("text is not null").agg({"probability": "min"}).first()[0] == 1.0
    assert Q.scored(docs.limit(0), labels.limit(0)).count() == 0
