import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import neighbours
from listwright.llm.neighbours import bands_of, build_bands, build_graph, nearest, op1_neighbours, search_bands, walk
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank int"


def brute(rows, is_query, k):
    fine = {}
    for vec_id, v, *_ in rows:
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[vec_id, tuple(v)] = np.array(v, np.float32).astype(float)
    out = {}
    for q, x in fine.items():
        if is_query(q[0]):
            scored = [(-float((x * y).sum()), o[0]) for o, y in fine.items() if o[0] != q[0] and len(o[1]) == len(q[1])]
            out[q[0]] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1, "x", 1), (1, [1.0, 0.0], 1, "x", 1), (2, [0.0, 0.0], 1, "x", 1), (3, None, 1, "x", 1),
        (4, [None, 1.0], 1, "x", 1), (5, [float("nan"), 1.0], 1, "x", 1), (6, [float("inf"), 1.0], 1, "x", 1),
        (7, [0.5, 0.5], 1, None, None), (7, [0.5, 0.5], 1, None, None), (8, [-3.0, 1.0], None, "x", 1),
        (None, [1.0, 1.0], 1, "x", 1), (9, [1.0, 2.0, 3.0], 1, "x", 1), (10, [2.0, 0.0], 1, "x", 1), (20, [], 1, "x", 1),
    ]
    found = got(nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") >= 0, 3))
    want = brute(rows, lambda i: True, 3)
    assert found == {k: v for k, v in want.items() if v}


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") >= 0, 3).count() == 0


def test_one_very_common_vector(spark):
    rows = [(k, [1.0, 0.0] if k % 3 else [float(k), 1.0], 0, "", 0) for k in range(300)]
    assert got(nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 7)) == brute(rows, lambda i: i % 20 == 0, 7)


def test_recall_of_graphs_over_shards(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(8, 16))[rng.integers(8, size=3000)]
    rows = [(k, v.tolist(), 0, "", 0) for k, v in enumerate(x)]
    found = got(nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20, shard_rows=1000, beam=64))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert found.keys() == want.keys()
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - exact[q, i]) < 1e-12 for q in found for i, s in found[q] if (q, i) in exact)


def test_graph_is_sparse_and_searchable():
    x = np.random.default_rng(2).normal(size=(900, 8))
    edges, entry = build_graph(x, degree=12, beam=32)
    assert edges.shape == (900, 12) and edges.max() < 900 and (edges != np.arange(900)[:, None]).all()
    found, near = walk(x.astype(np.float32), edges, entry, x[:50].astype(np.float32), 48)
    assert (np.diff(near, axis=1)[np.isfinite(near[:, 1:])] <= 0).all()
    best = np.argsort(-(x[:50] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, best.tolist(), strict=True)]) >= 0.9


def spread(kind, n=6000):
    """Vectors of lengths that differ much, or without any clusters."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, 64))
    if kind == "lengths":
        return x * np.exp(rng.normal(size=(n, 1)))
    return x if kind == "gaussian" else x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["lengths", "gaussian", "unit"])
def test_recall_of_one_shard_by_kind_of_vectors(kind):
    x = spread(kind)
    first, bands = 0, []
    places = []
    for band, edges, entries, beam in build_bands(x, 21, neighbours.BEAM):
        bands.append((first, x[band], edges, entries, beam, True))
        places.append(band)
        first += len(band)
    places = np.concatenate(places)
    asked = np.arange(0, len(x), 20)
    exact = x[asked] @ x.T
    exact[np.arange(len(asked)), asked] = -np.inf
    hits = []
    for row, (nodes, score) in enumerate(search_bands(bands, x[asked], 20)):
        found = places[nodes][np.argsort(-score)]
        found = [k for k in found.tolist() if k != asked[row]][:20]
        hits.append(len(set(found) & set(np.argsort(-exact[row])[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_recall_of_several_shards_of_uneven_lengths(spark):
    rows = [(k, v.tolist(), 0, "", 0) for k, v in enumerate(spread("lengths", 5000))]
    found = got(nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20, shard_rows=2500))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert found.keys() == want.keys()
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_bands_hold_all_and_are_narrow():
    x = np.random.default_rng(8).normal(size=(500, 3)) * np.array([[1.0], [100.0]] * 250)
    bands = bands_of(x)
    assert sorted(np.concatenate(bands).tolist()) == list(range(500))
    length = [np.linalg.norm(x[b], axis=1) for b in bands]
    assert all(a.max() <= neighbours.BAND * a.min() * (1 + 1e-12) for a in length)
    assert all(a.min() >= b.max() for a, b in zip(length, length[1:], strict=False))


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.5]), (2, [0.5, 3.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0])]
    best = {}
    for a, v in rows:
        for b, w in rows:
            if a != b:
                best[a, b] = max(best.get((a, b), -np.inf), float(np.dot(v, w)))
    want = {a: sorted(((b, s) for (x, b), s in best.items() if x == a), key=lambda x: (-x[1], x[0]))[:2] for a, _ in rows}
    assert got(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") > 0, 2)) == want


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found, want = got(op1_neighbours(spark, SF)), brute(rows, lambda i: i % 20 == 0, 20)
    assert found.keys() == want.keys()
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.95


def test_parameters():
    assert neighbours.ALPHA > 1 and neighbours.BEAM >= 20
    assert pytest.approx(float(np.ones(2) @ np.ones(2))) == 2
