import hashlib
from collections import Counter

import pytest

from marginalia.llm import sharding as S


def brute(rows, shards, seed):
    keys = {}
    for doc_id, source, text in rows:
        key = hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        keys.setdefault(source, []).append((key, doc_id, text))
    out = {}
    for source, own in keys.items():
        own.sort(key=lambda k: k[0])
        ranks = {}
        for i, (key, _, _) in enumerate(own):
            ranks.setdefault(key, i + 1)
        for key, doc_id, text in own:
            twice, n = 2 * ranks[key] - 1, len(own)
            out.setdefault(twice * shards // (2 * n), []).append((twice / (2.0 * n), source is not None, source or "", key, doc_id is not None, doc_id or 0, text is not None, text or "", source))
    return {(s, i + 1): (r[5] if r[4] else None, r[8], r[7] if r[6] else None) for s, rows in out.items() for i, r in enumerate(sorted(rows))}


@pytest.mark.parametrize("slice_bytes", [32 << 20, 40])
def test_equals_brute_force_and_matches_the_mixture(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(S, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(S, "RANKED_ROWS", 30)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", f"t{i}") for i in range(400)]
    rows += [(None, "hot", "x"), (None, None, None), (7, "hot", "again"), (7, "hot", "again"), (900, None, ""), (901, "one", "z" * 100_000)]
    df = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, source string, text string, shard int, cuts_ string").repartition(3)
    out = S.sharded(df, 8, 11)
    assert out.columns == ["doc_id", "source", "text", "cuts_", "shard", "position"]
    got = out.collect()
    assert {(r.shard, r.position): (r.doc_id, r.source, r.text) for r in got} == brute(rows, 8, 11)
    total = Counter(r[1] for r in rows)
    for shard in range(8):
        own = Counter(r.source for r in got if r.shard == shard)
        assert all(abs(own[s] - n / 8) <= 2 for s, n in total.items())
    assert S.sharded(df.limit(0), 8).count() == 0
