import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import packing, quality, scratch
from marginalia.llm.text import flat
from tests.llm.test_setsim import cluster, expected_classes, kept_lines


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(120)
    for name, df in (("documents", docs), ("labels", spark.read.parquet(f"{root}/labels.parquet"))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts, label = quality.sample(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    net = quality.fit(texts, label)
    p = net.score(*flat(pa.array([t for _, t in rows], pa.large_string())))
    rows = [r for r, x in zip(rows, p) if x >= quality.KEEP_AT]
    rows = sorted(kept_lines(rows).items())
    found = expected_classes(rows)
    rows = [r for r in rows if found[r[0]][0] == r[0]]
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(set(got.doc_id)) == sorted(i for i, t in rows if t.split())
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == {i: len(t.split()) for i, t in rows if t.split()}
    c = packing.Capacity()
    by = got.groupby("sequence").n_tokens
    assert (by.sum() <= c.tokens).all() and (by.size() <= c.docs).all() and (by.apply(lambda x: (x**2).sum()) <= c.attention).all()
    assert 10 < len(rows) < 120 and np.isfinite(p).all()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", None, 0), (None, "lost words", None, "s", 10), (3, "a line of words", "en", "s", 15), (3, "a line of words", "en", "s", 15), (4, "a line of words", "de", "s", 15)]])
def test_odd_rows_pass_all_stages(spark, tmp_path, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame(rows, docs.schema)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    named = docs.join(labels, "doc_id", "left_semi").withColumn("doc_id", F.col("doc_id") + 1000) if rows else docs.limit(0)
    odd.unionByName(named).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    (labels.withColumn("doc_id", F.col("doc_id") + 1000) if rows else labels.limit(0)).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = [r.doc_id for r in got.where("doc_id < 1000 or doc_id is null").collect()]
    assert set(kept) <= {None, 3} and kept.count(4) == 0
    assert rows or got.count() == 0


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_line_stage_writes_a_cluster_by_its_size(spark, monkeypatch):
    """A cluster of lines that are all alike takes disk as its size, not as the square of it."""
    made, written = {150: 0, 600: 0}, scratch.written

    def counting(df, name):
        table = written(df, name)
        made[n] += table.count() if name in ("joined", "keyed") else 0
        return table

    monkeypatch.setattr(scratch, "written", counting)
    for n in made:
        corpus_pipeline.line_stage(spark, spark.createDataFrame(list(enumerate(cluster(n, [1]))), "doc_id long, text string"), "").count()
    assert 0 < made[600] < 6 * made[150], made


def shuffles(spark):
    """Numbers of the shuffles that have files on this machine's disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {int(x) for x in re.findall(r"shuffle_(\d+)_", files)}


def test_line_stage_drops_the_shuffles_of_each_table_it_writes(spark, monkeypatch):
    """Together they are several times the input; that they go must not wait for the driver's garbage collection."""
    left, written = {}, scratch.written

    def watching(df, name):
        before = shuffles(spark)
        table = written(df, name)
        until = time.monotonic() + 10
        while (new := shuffles(spark) - before) and time.monotonic() < until:  # they go in the background
            time.sleep(0.1)
        left[name] = len(new)
        return table

    monkeypatch.setattr(scratch, "written", watching)
    docs = spark.createDataFrame(list(enumerate(cluster(60))), "doc_id long, text string").repartition(3)
    assert 0 < corpus_pipeline.line_stage(spark, docs, "").count() < 60
    assert {"counts", "joined", "keyed", "near", "gone"} <= set(left) and not any(left.values()), left
