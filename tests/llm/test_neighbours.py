import time
from pathlib import Path

import numpy as np

from tesserae.llm import queries
from tesserae.llm.neighbours import Curves, copies_beyond, hilbert, mutual, neighbours


def test_hilbert_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute(m, ids, k, least):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least), key=lambda j: (-round(s[i, j], 12), ids[j]))
        out |= {(a, ids[j]) for j in order[:k]}
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1500, 64))
    near = base[:600] + 0.15 * rng.standard_normal((600, 64))
    m = np.concatenate([base, near]).astype(np.float32)
    ids = list(range(10, 10 + len(m)))
    rows = [(i, x.tolist(), "x") for i, x in zip(ids, m, strict=True)]
    got = {(r.id, r.other) for r in neighbours(spark.createDataFrame(rows, "id long, embedding array<float>, other string"), "id", "embedding", 10, least=0.92).collect()}
    want = brute(m.astype(np.float64), ids, 10, 0.92)
    assert len(want) > 1000 and got <= want and len(got) >= 0.98 * len(want)


def test_dirty_rows_ties_and_copies(spark):
    v = [1.0] + [0.0] * 63
    w = [0.0, 2.0] + [0.0] * 62
    rows = [(i, v) for i in range(1, 31)] + [(5, v), (50, w), (51, [0.0, 1.0] + [0.0] * 62), (60, None), (61, []), (62, [1.0]), (63, [0.0] * 64), (64, [None] * 64), (65, [float("nan")] * 64), (None, v)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = neighbours(df, "id", "embedding", 3, least=0.9).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.rank, r.other))
    assert sorted(by[1]) == [(1, 2), (2, 3), (3, 4)] and sorted(by[4]) == [(1, 1), (2, 2), (3, 3)] and by[50] == [(1, 51)] and by[51] == [(1, 50)]
    rest = {}
    for r in copies_beyond(df, "id", "embedding", 3).collect():
        rest.setdefault(r.id, []).append((r.rank, r.other))
    assert set(rest) == set(range(5, 31)) and sorted(rest[30]) == [(1, 1), (2, 2), (3, 3)]
    pairs = {(r.id_a, r.id_b) for r in mutual(neighbours(df, "id", "embedding", 3, least=0.9)).collect()}
    assert pairs == {(50, 51)} | {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}
    assert neighbours(df.limit(0), "id", "embedding").count() == 0


def test_without_a_least_similarity(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    got = {(r.id, r.other) for r in neighbours(df, "id", "embedding", 5, width=8, curves=Curves(dims=8, bits=7)).collect()}
    want = brute(m.astype(np.float32).astype(np.float64), list(range(300)), 5, -2)
    assert len(got & want) >= 0.9 * len(want)


def test_query_gives_every_vector_its_ten_nearest(spark, tmp_path):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((2500, 64)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    got = queries.p2_neighbours(spark, str(tmp_path)).collect()
    assert len(got) == 10 * len(m)
    want = brute(m.astype(np.float64), list(range(len(m))), 10, -2)
    assert len({(r.id, r.other) for r in got} & want) >= 0.9 * len(want)


def crowd(seed, members, others):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    return np.concatenate([unit(centre + 0.23 * unit(rng.standard_normal((members, 64)))), unit(rng.standard_normal((others, 64)))]).astype(np.float32)


def test_crowd_is_compared_in_full(spark):
    m = crowd(6, 1500, 1500)
    ids = list(range(len(m)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, m, strict=True)], "id long, embedding array<float>")
    got = {(r.id_a, r.id_b) for r in mutual(neighbours(df, "id", "embedding", 10, least=0.92)).collect()}
    want = brute(m.astype(np.float64), ids, 10, 0.92)
    want = {(a, b) for a, b in want if a < b and (b, a) in want}
    assert len(want) > 1000 and got == want


def test_scaled_copies_are_one_direction(spark):
    rng = np.random.default_rng(7)
    v = rng.standard_normal(64)
    df = spark.createDataFrame([(i, (v * rng.uniform(0.1, 9)).astype(np.float32).tolist()) for i in range(60)], "id long, embedding array<float>")
    near, rest = neighbours(df, "id", "embedding", 3, least=0.9).collect(), copies_beyond(df, "id", "embedding", 3).collect()
    searched, left = {r.id for r in near}, {r.id for r in rest}
    assert len(searched) <= 20 and not searched & left and searched | left == set(range(60))
    assert len(rest) == 3 * len(left) and all(r.other in searched for r in rest)


def test_vectors_stay_in_place(spark, tmp_path):
    """What a search writes are sketches and ids, not all vectors again and again; repeated ids count by their least vector."""
    rng = np.random.default_rng(8)
    m = rng.standard_normal((6000, 64)).astype(np.float32)
    m[5000:] = m[:1000] + 0.1 * rng.standard_normal((1000, 64)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(m)]
    rows += [(i, (x + 9).tolist()) for i, x in list(enumerate(m))[:100]] + [(i, x.tolist()) for i, x in list(enumerate(m))[200:300]]
    spark.createDataFrame(rows, "id long, embedding array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    sc = spark.sparkContext
    before, kept = sc._jsc.sc().getCheckpointDir(), f"{tmp_path}/kept"
    sc.setCheckpointDir(kept)
    written = lambda: sc._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    try:
        began = written()
        got = {(r.id_a, r.id_b) for r in queries.p2_found(spark, str(tmp_path)).collect()}
        time.sleep(1)
        disk = written() - began + sum(p.stat().st_size for p in Path(kept).rglob("part-*"))
    finally:
        if before.isDefined():
            sc.setCheckpointDir(before.get())
    assert got == {(i, 5000 + i) for i in range(1000)}
    # 588 of them are sketches
    assert disk < 1000 * len(m)


def test_many_small_crowds_stay_apart(spark):
    """Each crowd meets the rows near it, however many crowds there are."""
    rng = np.random.default_rng(9)
    m = np.repeat(rng.standard_normal((1300, 64)), 6, 0) + 0.1 * rng.standard_normal((7800, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m.astype(np.float32))], "id long, embedding array<float>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    began = written()
    got = {(r.id_a, r.id_b) for r in mutual(neighbours(df, "id", "embedding", 10, least=0.92)).collect()}
    time.sleep(1)
    assert got == {(a, b) for g in range(1300) for a in range(6 * g, 6 * g + 6) for b in range(a + 1, 6 * g + 6)}
    assert written() - began < 3000 * len(m)
