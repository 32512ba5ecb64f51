import numpy as np

from marginalia.llm import near_vectors as V


def clustered(seed, groups, alone, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for size in groups:
        base = rng.normal(size=dim)
        rows += [base + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.22]) for _ in range(size)]
    rows += list(rng.normal(size=(alone, dim)))
    order = rng.permutation(len(rows))
    return np.array(rows, np.float32)[order]


def brute(x, threshold):
    """(class, links) of each row, by comparing all with all."""
    x = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        least = np.array([min(root[i], *root[near[i]]) if near[i].any() else root[i] for i in range(len(x))])
        if (least == root).all():
            return {i: (int(root[i]), int(near[i].sum())) for i in range(len(x))}
        root = least


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)


def test_recall_against_brute_force(spark):
    x = clustered(1, [2] * 100 + [5] * 30 + [150], 800)
    want = brute(x, 0.95)
    got = {r.vec_id: (r.class_id, r.links) for r in V.near_vectors(frame(spark, x)).collect()}
    assert set(got) == set(want)
    links = sum(k for _, k in want.values())
    assert sum(k for _, k in got.values()) >= V.RECALL * links and links > 5000
    assert all(got[i][1] <= want[i][1] for i in want)
    linked = [i for i in want if want[i][1]]
    assert np.mean([got[i][1] > 0 for i in linked]) >= V.RECALL and np.mean([got[i][0] == want[i][0] for i in linked]) >= V.RECALL
    assert all(got[i] == (i, 0) for i in want if not want[i][1])


def test_thousands_of_equal_vectors_are_one(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 16))
    x = np.concatenate([np.repeat(base[:1], 3000, 0), base[:1] + 0.01 * rng.normal(size=(2, 16)), base[1:], rng.normal(size=(300, 16))]).astype(np.float32)
    got = {r.vec_id: (r.class_id, r.links) for r in V.near_vectors(frame(spark, x)).collect()}
    assert got == brute(x, 0.95) and got[0] == (0, 3001)


def test_traversal_comes_to_all_cells_that_are_near_enough():
    rng = np.random.default_rng(2)
    index = V.MultiIndex(rng.normal(size=(9, 4)).astype(np.float32), rng.normal(size=(7, 4)).astype(np.float32), 2.5)
    x = rng.normal(size=(50, 8)).astype(np.float32)
    row, a, b = index.visited(x)
    left, right = index.halves(x)
    counts = set()
    for r in range(50):
        far = left[r][:, None] + right[r][None, :]
        want = {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= far.min() + 2.5))}
        assert {(int(i), int(j)) for i, j in zip(a[row == r], b[row == r])} == want
        counts.add(len(want))
    assert len(counts) > 5


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0, 0.0]), (6, [1.0, 0.0]), (7, [None, 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.0, 0.0]), (9, []), (10, [1.0, 0.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, class_id int, part string, mark double")
    got = {r.vec_id: (r.class_id, r.links) for r in V.near_vectors(df).collect()}
    assert got == {i: (i, 0) for i in range(3, 10)} | {1: (1, 2), 2: (1, 2), 10: (1, 2)}
    assert V.near_vectors(df.limit(0)).count() == 0


def test_embeddings_that_share_an_id_are_one_row(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])]
    got = {r.vec_id: (r.class_id, r.links) for r in V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 2), 4: (4, 0)}


def met_share(index, x, threshold, rng):
    """The share of partners exactly at the threshold that live in a cell which their vectors visit."""
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1)[:, None] * x
    u /= np.sqrt((u * u).sum(1))[:, None]
    i, j = index.home(threshold * x + np.sqrt(1 - threshold**2) * u)
    row, a, b = index.visited(x)
    return len(np.unique(row[(a == i[row]) & (b == j[row])])) / len(x)


def test_vectors_outside_the_sample_reach_the_recall():
    rng = np.random.default_rng(5)
    for spread in (None, 0.5):
        centre = rng.normal(size=(300, 32))
        draw = lambda n: rng.normal(size=(n, 32)) if spread is None else centre[rng.integers(300, size=n)] + spread * rng.normal(size=(n, 32))  # noqa: E731, B023
        x = draw(7000)
        x /= np.sqrt((x * x).sum(1))[:, None]
        index = V.build(x[:3000].astype(np.float32), 5_000_000, 0.95, 0.98)
        assert met_share(index, x[3000:], 0.95, rng) > 0.965


def test_the_sample_grows_with_the_codebooks(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 1)
    monkeypatch.setattr(V, "CALIBRATION", 100)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2500, 4)))], "vec_id long, embedding array<float>")
    assert len(V.sampled(df, 4, 2500, 10)) == 2500
    monkeypatch.setattr(V, "PER_WORD", 4)
    assert len(V.sampled(df, 4, 2500, 10)) == 300
    assert len(V.sampled(df.selectExpr("7L as vec_id", "embedding"), 4, 2500, 10)) == 300
