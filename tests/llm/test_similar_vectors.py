import random

import numpy as np

from lexloom.llm.similar_vectors import hilbert_keys, most_similar, nearest, similar_pairs

SCHEMA = "id string, embedding array<float>, a string, b string, key int, curve int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], SCHEMA)


def test_hilbert_curve_visits_neighbours_in_turn():
    grid = np.array([[x, y] for x in range(8) for y in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(64))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def clustered(n=3000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.12 * rng.standard_normal((n, dim))).astype(np.float32)


def test_recall_against_brute_force(spark):
    v = clustered()
    df = frame(spark, [(f"v{i:05d}", row.tolist()) for i, row in enumerate(v)])
    got = most_similar(df, dim=16, k=5, part_rows=700, window=64).collect()
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :5]
    want = {(f"v{i:05d}", f"v{j:05d}") for i in range(len(v)) for j in best[i]}
    have = {(r["id"], r["neighbour"]) for r in got}
    assert len(have & want) >= 0.9 * len(want)
    assert all(abs(r["sim"] - sims[int(r["id"][1:]), int(r["neighbour"][1:])]) < 1e-6 for r in got[:500])
    pairs = {tuple(r) for r in similar_pairs(df, dim=16, k=5, min_sim=0.9, part_rows=700, window=64).collect()}
    true = {(min(a, b), max(a, b)) for a, b in want if sims[int(a[1:]), int(b[1:])] >= 0.9}
    assert pairs <= {(f"v{i:05d}", f"v{j:05d}") for i, j in zip(*np.nonzero(np.triu(sims >= 0.9)))} and len(pairs & true) >= 0.9 * len(true)


def test_unusable_rows_copies_and_repeats(spark):
    rng = random.Random(1)
    base = [rng.random() for _ in range(4)]
    rows = [(f"copy{i}", base) for i in range(30)] + [("near", [base[0] + 0.01, *base[1:]]), ("far", [-x for x in base]), ("copy0", base), ("near", [base[0] + 0.01, *base[1:]])]
    bad = [(None, base), ("null", None), ("zero", [0.0] * 4), ("short", [1.0]), ("nan", [float("nan"), 1.0, 1.0, 1.0]), ("hole", [None, 1.0, 1.0, 1.0]), ("inf", [float("inf"), 1.0, 1.0, 1.0]), ("empty", [])]
    got = most_similar(frame(spark, rows + bad), dim=4, k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert set(by) == {f"copy{i}" for i in range(30)} | {"near", "far"}
    copies = sorted(f"copy{i}" for i in range(30))
    for i in copies:
        assert [n for _, n in sorted(by[i])] == [c for c in copies[:4] if c != i][:3]
    assert [n for _, n in sorted(by["near"])] == copies[:3] and all(len(x) == 3 for x in by.values())
    assert most_similar(frame(spark, []), dim=4).count() == 0
    assert most_similar(frame(spark, bad), dim=4).count() == 0


def test_nearest_of_spread_out_vectors_is_whole(spark, tmp_path):
    from lexloom.llm.queries import p1_embedding_neighbours

    v = np.random.default_rng(5).standard_normal((4500, 64)).astype(np.float32)
    v[7] = 2 * v[6]
    rows = [(i, row.tolist()) for i, row in enumerate(v)] + [(9000, v[3].tolist()), (9001, None), (9002, [0.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = np.r_[v, v[3:4]].astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    ids = np.r_[np.arange(len(v)), 9000]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    want = {(ids[i], ids[j]) for i, best in enumerate(np.argsort(-sims, axis=1, kind="stable")[:, :5]) for j in best}
    found = p1_embedding_neighbours(spark, str(tmp_path)).collect()
    assert {(r["vec_id"], r["neighbour"]) for r in found} == want and len(found) == len(want)
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    cut = nearest(table, "vec_id", block_rows=700).collect()
    assert {(int(r["id"]), int(r["neighbour"])) for r in cut} == want


def test_nearest_of_unusable_rows_copies_and_ties(spark):
    base = [1.0, 0.0, 0.0, 0.0]
    rows = [(f"copy{i}", base) for i in range(9)] + [(f"tie{i}", [0.0, float(i + 1), 0.0, 0.0]) for i in range(6)]
    bad = [(None, base), ("null", None), ("zero", [0.0] * 4), ("short", [1.0]), ("nan", [float("nan"), 1.0, 1.0, 1.0]), ("hole", [None, 1.0, 1.0, 1.0])]
    by = {}
    for r in nearest(frame(spark, rows + bad), dim=4, k=3, block_rows=4).orderBy("rank").collect():
        by.setdefault(r["id"], []).append(r["neighbour"])
    assert by == {i: [x for x in sorted(j for j, _ in rows) if x != i and x[:3] == i[:3]][:3] for i, _ in rows}
    assert nearest(frame(spark, []), dim=4).count() == 0 and nearest(frame(spark, bad), dim=4).count() == 0
    assert len(nearest(frame(spark, rows[-2:]), dim=4).collect()) == 2
