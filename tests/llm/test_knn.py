import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import knn as N


def _brute(rows, k):
    keys = sorted(rows)
    x = np.stack([rows[q] for q in keys])
    out = set()
    for i, a in enumerate(keys):
        d = ((x - x[i]) ** 2).sum(1)
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (d[j], keys[j]))[:k]
        out |= {(a, keys[j]) for j in order}
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "path string, embedding array<float>, vid int, v string")


@pytest.mark.parametrize(("block", "pivot"), [(4096, 800), (37, 800), (4096, 15), (20, 40)])
def test_neighbours_match_brute_force(spark, monkeypatch, block, pivot):
    monkeypatch.setattr(N, "PIVOT_ROWS", pivot)
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[50]  # copies: more than k
    x[60:62] = x[60]
    x[100] *= 1e6  # far outlier
    x[101] *= 1e-6
    x[110:130] = np.round(x[110:130])  # ties
    data = {f"p{i:03d}": v for i, v in enumerate(x)}
    rows = [(k, v.tolist(), 1, "x") for k, v in data.items()]
    bad = [("z1", None), (None, x[0].tolist()), ("z2", [0.0] * 8), ("z3", [float("nan")] + [1.0] * 7), ("z4", [1.0] * 7), ("z5", [float("inf")] + [1.0] * 7), ("z6", []), ("z7", [None] + [1.0] * 7)]
    df = _frame(spark, rows + rows[:20] + [(k, v, 2, None) for k, v in bad])
    got = N.nearest_vectors(df, "path", "embedding", 3, 8, block).collect()
    pairs = {(a["path"], a["neighbour"]) for a in got}
    assert len(got) == len(pairs) == 900
    want = _brute({k: v.astype(np.float64) for k, v in data.items() if np.any(v)}, 3)
    assert pairs == want  # recall 1: bounds leave no true neighbour out


def test_few_and_no_rows(spark):
    df = _frame(spark, [("a", [1.0, 0.0], 1, ""), ("b", [1.0, 0.0], 1, ""), ("c", [0.0, 1.0], 1, "")])
    got = {(r["path"], r["neighbour"]) for r in N.nearest_vectors(df, "path", "embedding", 5, 2).collect()}
    assert got == {(a, b) for a in "abc" for b in "abc" if a != b}
    assert N.nearest_vectors(df.limit(0), "path", "embedding", 5, 2).count() == 0
    assert N.nearest_vectors(df.where("path = 'a'"), "path", "embedding", 5, 2).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 4)).astype(np.float32)
    x[:300] = x[0]
    df = _frame(spark, [(f"p{i:03d}", v.tolist(), 0, "") for i, v in enumerate(x)])
    got = N.nearest_vectors(df, "path", "embedding", 2, 4)
    assert got.count() == 1800
    copies = got.where(F.col("path") < "p300").select("neighbour").distinct().collect()
    assert {c[0] for c in copies} == {"p000", "p001", "p002"}


def test_few_blocks_are_visited_and_none_is_missed(spark, monkeypatch):
    monkeypatch.setattr(N, "PIVOT_ROWS", 25)
    r = np.random.default_rng(7)
    middles = r.normal(size=(20, 16))
    x = (middles[r.integers(0, 20, 600)] + 0.05 * r.normal(size=(600, 16))).astype(np.float32)
    x[::97] += r.normal(size=(7, 16)).astype(np.float32)  # far from all
    groups = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vid long, v array<float>")


    got = {(q["vid"], q["other"]) for q in N.nearest_groups(groups, 4, 16, visitors=50).collect()}
    d = ((x.astype(np.float64)[:, None] - x.astype(np.float64)[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(600) for j in np.argsort(d[i], kind="stable")[:4]}


def test_products_of_codes_are_exact():
    r = np.random.default_rng(3)
    codes, fine, scale, err, fine_err = N.quantise(r.normal(size=(200, 64)))
    assert codes.dtype == np.int8 and np.array_equal(codes.astype(np.float32) @ codes.astype(np.float32).T, (codes.astype(np.int64) @ codes.astype(np.int64).T).astype(np.float32))
