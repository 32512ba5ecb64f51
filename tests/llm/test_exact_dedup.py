import pytest

from marginalia.llm import exact_dedup as X

DOCS = "doc_id long, text string, digest string, locator string"


def put(spark, path, rows, mode="append"):
    spark.createDataFrame([(a, b, "x", "y") for a, b in rows], DOCS).coalesce(1).write.mode(mode).parquet(path)


def ids(df):
    return sorted((-1 if r.doc_id is None else r.doc_id) for r in df.collect())


def test_first_of_equal_documents_stays(spark, tmp_path):
    path = str(tmp_path / "docs")
    long = "é" * 300_000
    put(spark, path, [(5, "a"), (2, "a"), (7, ""), (8, ""), (9, None), (10, None), (None, "a"), (11, long), (12, long), (13, "b"), (13, "b")])
    assert ids(X.exact_dedup(spark, path)) == [2, 7, 9, 10, 11, 13]


def test_state_outlives_batches_and_runs(spark, tmp_path):
    path, checkpoint = str(tmp_path / "docs"), f"file://{tmp_path}/state"
    put(spark, path, [(4, "a"), (6, "b")])
    options = {"checkpoint": checkpoint, "expected": 100}
    assert ids(X.exact_dedup(spark, path, **options)) == [4, 6]
    put(spark, path, [(1, "a"), (7, "c"), (8, "c")])
    assert ids(X.exact_dedup(spark, path, **options)) == [4, 6, 7]


def test_a_checkpoint_keeps_its_entries_whatever_the_count(spark, tmp_path):
    """The counts of the two runs ask for prefixes of different lengths."""
    path, checkpoint = str(tmp_path / "docs"), f"file://{tmp_path}/state"
    put(spark, path, [(i, f"t{i}") for i in range(100)])
    assert ids(X.exact_dedup(spark, path, checkpoint)) == list(range(100))
    put(spark, path, [(1000 + i, f"t{i}") for i in range(100)])
    assert ids(X.exact_dedup(spark, path, checkpoint)) == list(range(100))
    assert spark.read.parquet(f"{checkpoint}/compared").count() == 100
    put(spark, path, [(2000, "t5"), (2001, "new")])
    assert ids(X.exact_dedup(spark, path, checkpoint)) == [*range(100), 2001]
    assert spark.read.parquet(f"{checkpoint}/compared").count() == 101


def test_texts_that_share_a_digest_are_told_apart_over_runs(spark, tmp_path):
    path, checkpoint = str(tmp_path / "docs"), f"file://{tmp_path}/state"
    put(spark, path, [(i, f"text {i % 40}") for i in range(60)])
    assert ids(X.exact_dedup(spark, path, checkpoint, digest_bits=4)) == list(range(40))
    put(spark, path, [(100 + i, f"text {i % 50}") for i in range(60)])
    assert ids(X.exact_dedup(spark, path, checkpoint, digest_bits=4)) == [*range(40), *range(140, 150)]


@pytest.mark.parametrize("bits", [4, 8])
def test_equal_digests_of_different_texts_are_told_apart(spark, tmp_path, bits):
    path = str(tmp_path / "docs")
    rows = [(i, f"text {i % 40}") for i in range(120)]
    put(spark, path, rows)
    assert ids(X.exact_dedup(spark, path, digest_bits=bits)) == list(range(40))


def test_empty(spark, tmp_path):
    path = str(tmp_path / "docs")
    put(spark, path, [])
    assert X.exact_dedup(spark, path).count() == 0
