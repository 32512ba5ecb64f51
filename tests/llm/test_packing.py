import random

import numpy as np
import pytest

from marginalia.llm import bpe
from marginalia.llm import packing as P


def slow_fit(lengths, c):
    """Best fit with nothing left out: every sequence is looked at for every piece."""
    whole, bins, out = np.array([c.tokens, c.docs, c.attention], float), [], []
    for n in lengths:
        need, best = np.array([n, 1, n * n], float), None
        for i, free in enumerate(bins):
            if (free >= need).all():
                v = -sum(c.weights * (free / whole) * (need / whole)) if c.score == "dot" else sum(c.weights * ((free - need) / whole) ** 2)
                if best is None or v < best[0] - 1e-12:
                    best = (v, i)
        if best is None:
            bins.append(whole.copy())
            best = (0, len(bins) - 1)
        bins[best[1]] -= need
        out.append(best[1])
    return out


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("seed", [1, 2])
def test_best_fit_equals_the_plain_search(score, seed):
    rng = random.Random(seed)
    c = P.Capacity(100, 4, 5000, score=score)
    lengths = sorted((rng.randrange(1, c.piece + 1) for _ in range(400)), reverse=True)
    assert P.best_fit(np.array(lengths), c).tolist() == slow_fit(lengths, c)


def test_every_token_has_one_place_and_no_capacity_is_exceeded(spark):
    rng = random.Random(3)
    rows = [(i % 190, " ".join("w" for _ in range(rng.choice([1, 5, 50, 90, 400])))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, "a b c")]
    c = P.Capacity(100, 4, 5000)
    df = spark.createDataFrame([(a, t, 1, "s") for a, t in rows], "doc_id long, text string, n_tokens int, sequence string")
    out = P.packed(df, c, group_pieces=64).toPandas()
    assert out.n_tokens.sum() == sum(len((t or "").split()) for _, t in rows)
    by = out.groupby("sequence").agg(t=("n_tokens", "sum"), n=("n_tokens", "size"), a=("n_tokens", lambda x: (x**2).sum()))
    assert (by.t <= c.tokens).all() and (by.n <= c.docs).all() and (by.a <= c.attention).all()
    assert (out.n_tokens <= c.piece).all() and out[out.doc_id.isna()].n_tokens.tolist() == [3]
    whole = out[out.doc_id < 10].sort_values(["doc_id", "piece"])
    assert all(r.first_token == r.piece * c.piece for r in whole.itertuples())
    assert by.t.sum() / (len(by) * c.tokens) > 0.5
    assert P.packed(df.limit(0), c).count() == 0


def test_capacities_hold_in_ids_of_the_encoder(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789/+") for _ in range(900))
    texts = ["Être où ça naïveté; überflüssigerweise! " * 40, long, f"head {long} tail", "日本語テスト🙂" * 60, "word " * 30, " \n ", None, "a"]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    c = P.Capacity(100, 4, 5000)
    out = P.packed(df, c, group_pieces=16).toPandas()
    by = out.groupby("sequence").agg(t=("n_ids", "sum"), n=("n_ids", "size"), a=("n_ids", lambda x: (x**2).sum()))
    assert (by.t <= c.tokens).all() and (by.n <= c.docs).all() and (by.a <= c.attention).all() and (out.n_ids <= c.piece).all()
    ids = {r.doc_id: r.ids for r in bpe.encoded(df).collect()}
    table = bpe.Vocabulary(bpe.read_ranks())
    assert sorted(set(out.doc_id)) == [0, 1, 2, 3, 4, 7] and len(out[out.doc_id == 1]) > 3
    for i in set(out.doc_id):
        rows = out[out.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert rows.n_ids.sum() == len(ids[i]) and rows.first_id.tolist() == [k * c.piece for k in range(len(rows))]
        text = texts[i].encode()
        for r in rows.itertuples():
            start, end = (len(table.decode(np.array(ids[i][:n], np.int64))) for n in (r.first_id, r.first_id + r.n_ids))
            heads = [p for p in range(len(text)) if text[p] not in b" \t\n\r\f\v" and (not p or text[p - 1] in b" \t\n\r\f\v")]
            assert (r.first_token, r.n_tokens) == (sum(p < start for p in heads), sum(start <= p < end for p in heads))
