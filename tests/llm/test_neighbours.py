import numpy as np
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from shellac.llm import graph, neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in good:
        if asked(i):
            near = sorted({(-float(v @ w) / float(np.sqrt(v @ v) * np.sqrt(w @ w)), j) for j, w in good if j != i and len(w) == len(v)})[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert got.keys() <= want.keys()
    hits = sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in near}) for q, near in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_recall_over_shards_and_blocks(spark):
    x = np.random.default_rng(0).normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = found(neighbours.nearest(df, df.where("vec_id % 50 = 0"), shard_vectors=800))
    want = brute(rows, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.97
    best = {q: dict(near) for q, near in want.items()}
    assert all(abs(s - best[q][j]) < 1e-12 for q, near in got.items() for j, s in near if j in best[q])


def test_copies_ties_and_bad_vectors(spark):
    base = [1.0, 2.0, 3.0, 0.5]
    rows = [(i, base) for i in range(0, 400)] + [(i, [1.0, 2.0, 3.0, 0.5 + i / 1000]) for i in range(400, 500)]
    rows += [(900 + i, [v * 2.0**i for v in [3.0, -1.0, 0.25, 2.0]]) for i in range(60)]
    rows += [(500, None), (550, [0.0] * 4), (600, [1.0, None, 2.0, 3.0]), (650, [float("nan")] * 4), (700, [float("inf"), 1.0, 1.0, 1.0]), (750, []), (None, base), (800, [1.0, 2.0]), (50, base), (100, base)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = found(neighbours.nearest(df, df.where("vec_id % 50 = 0")))
    want = brute(rows, lambda i: i % 50 == 0)
    del want[800]
    assert {q: [j for j, _ in near] for q, near in got.items()} == {q: [j for j, _ in near] for q, near in want.items()}
    assert [j for j, _ in got[900]] == [901, 902, 903, 904, 905]
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[50]] == [0, 1, 2, 3, 4]


def test_few_rows(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 0.0], 0)], SCHEMA)
    assert [j for j, _ in found(neighbours.nearest(three, three.where("vec_id = 0")))[0]] == [1, 2]
    assert neighbours.nearest(three.limit(0), three).count() == 0 and neighbours.nearest(three, three.limit(0)).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5))
def test_small_graphs_are_exact(n, dim):
    x = np.random.default_rng(n).normal(size=(n, dim)).astype(np.float32)
    x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
    n = len(x)
    g = graph.build(x, degree=8, beam=16)
    ids, dist = g.search(x, max(n, 3))
    reached = [{int(i) for i in row if i >= 0} for row in ids]
    assert all(i in r for i, r in enumerate(reached)) and all((np.diff(d[np.isfinite(d)]) >= 0).all() for d in dist)


def test_robust_prune_keeps_diverse_edges():
    x = np.array([[1, 0, 0], [0.99, 0.1, 0], [0.98, 0.12, 0], [0.9, 0, 0.4]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = graph.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 0, -1]], np.int32), 3, 1.2)[0].tolist()
    assert kept == [1, 3, -1]


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert recall(found(queries.op7_nearest_neighbours(spark, SF)), brute(rows, lambda i: i % 50 == 0)) >= 0.95
