import numpy as np
import pytest

from tabloom.operators.neighbors import nearest_neighbors, vote_class, vote_mean


def brute(train, queries, k):
    out = {}
    ids = np.arange(len(train))
    for q, x in enumerate(queries):
        d = np.sqrt(((train - x) ** 2).sum(axis=1))
        out[q] = [(int(i), float(d[i])) for i in np.lexsort((ids, d))[:k]]
    return out


def frames(spark, train, queries):
    t = spark.createDataFrame(
        [(i, x.tolist(), float(i % 3)) for i, x in enumerate(train)], "__id long, __x array<double>, label double"
    )
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "__q long, __x array<double>")
    return t.repartition(3), q.repartition(3)


@pytest.mark.parametrize("block_rows, rows_per_pivot", [(50_000, 20_000), (17, 20_000), (40, 60), (7, 25)])
def test_matches_brute_force(spark, block_rows, rows_per_pivot):
    """With many pivots, a third of all rows on one spot, and integer ties."""
    rng = np.random.default_rng(5)
    train = np.vstack([rng.integers(0, 6, (200, 3)), np.full((100, 3), 2)]).astype(float)
    train[:60] += rng.normal(0, 8, (60, 3))
    queries = np.vstack([train[::9], rng.normal(3, 6, (30, 3)), np.full((30, 3), 2.0)])
    t, q = frames(spark, train, queries)
    got = {}
    for r in nearest_neighbors(t, q, 4, block_rows, rows_per_pivot).orderBy("__q", "rank").collect():
        got.setdefault(r["__q"], []).append((r["__id"], r["__d"]))
    assert got == brute(train, queries, 4)


def test_dense_cell_and_far_queries(spark):
    """Most rows in one tight cell; queries inside it, between cells and far outside."""
    rng = np.random.default_rng(8)
    train = np.vstack([rng.normal(0, 0.01, (600, 4)), rng.normal(0, 30, (300, 4))])
    queries = np.vstack([rng.normal(0, 0.01, (40, 4)), rng.normal(0, 30, (40, 4)), rng.normal(0, 900, (10, 4))])
    t, q = frames(spark, train, queries)
    got = {}
    for r in nearest_neighbors(t, q, 6, 100, 20).orderBy("__q", "rank").collect():
        got.setdefault(r["__q"], []).append((r["__id"], r["__d"]))
    assert got == brute(train, queries, 6)


def test_no_cell_with_k_rows(spark):
    rng = np.random.default_rng(9)
    train, queries = rng.normal(0, 1, (40, 2)), rng.normal(0, 1, (5, 2))
    t, q = frames(spark, train, queries)
    got = nearest_neighbors(t, q, 39, 10, 1).groupBy("__q").count().collect()
    assert {r["count"] for r in got} == {39}


def test_votes(spark):
    near = spark.createDataFrame(
        [
            (1, 0.0, 1, 2.0),
            (1, 1.0, 2, 0.0),
            (1, 1.0, 3, 0.0),
            (2, 1.0, 1, 5.0),
            (2, 2.0, 2, 4.0),
        ],
        "__q long, __d double, __id long, label double",
    )
    uniform = {r["__q"]: r for r in vote_class(near).collect()}
    assert uniform[1]["prediction"] == 0.0 and uniform[2]["prediction"] == 4.0
    assert uniform[1]["shares"] == {0.0: pytest.approx(2 / 3), 2.0: pytest.approx(1 / 3)}
    weighted = {r["__q"]: r["prediction"] for r in vote_class(near, "distance").collect()}
    assert weighted == {1: 2.0, 2: 5.0}
    mean = {r["__q"]: r["prediction"] for r in vote_mean(near, "distance").collect()}
    assert mean[1] == 2.0 and mean[2] == pytest.approx((5 + 2) / 1.5)


def test_fewer_rows_than_neighbours(spark):
    t, q = frames(spark, np.eye(3), np.zeros((2, 3)))
    assert nearest_neighbors(t, q, 5).groupBy("__q").count().where("count = 3").count() == 2


def test_equal_rows_are_searched_once(spark, monkeypatch):
    """Few spots with many rows each: no block holds more than k rows of a spot."""
    from tabloom.operators import neighbors

    met = spark.sparkContext.accumulator(0)
    real = neighbors._best_of_block

    def counted(k):
        run = real(k)

        def inner(block, chunk):
            met.add(block.num_rows * chunk.num_rows)
            return run(block, chunk)

        return inner

    monkeypatch.setattr(neighbors, "_best_of_block", counted)
    rng = np.random.default_rng(3)
    train, queries = rng.integers(0, 3, (500, 2)).astype(float), rng.integers(0, 4, (300, 2)).astype(float)
    t, q = frames(spark, train, queries)
    got = {}
    for r in nearest_neighbors(t, q, 4).orderBy("__q", "rank").collect():
        got.setdefault(r["__q"], []).append((r["__id"], r["__d"]))
    assert got == brute(train, queries, 4)
    assert 0 < met.value <= 2 * 9 * 4 * 16
