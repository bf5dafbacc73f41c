import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import clusters as C
from fleetgauge.operators import models as M
from fleetgauge.operators import neighbours as N
from tests.data import by


def _frame(spark, x):
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def _dtw(p, q):
    cost = np.full((len(p) + 1, len(q) + 1), np.inf)
    cost[0, 0] = 0
    for i in range(len(p)):
        for j in range(len(q)):
            gap = np.square(p[i] - q[j]).sum()
            cost[i + 1, j + 1] = gap + min(cost[i, j + 1], cost[i + 1, j], cost[i, j])
    return np.sqrt(cost[-1, -1])


def _distances(x, metric, channels=1):
    n = len(x)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            u, w = x[i].reshape(-1, channels), x[j].reshape(-1, channels)
            d[i, j] = _dtw(u, w) if metric == "dtw" else np.linalg.norm(x[i] - x[j])
    return d


@pytest.mark.parametrize("share", [4, 256])
@pytest.mark.parametrize("metric,channels", [("euclid", 1), ("dtw", 1), ("dtw", 2), ("euclid", 2)])
def test_near_pairs_are_all_pairs_within_the_radius(spark, metric, channels, share):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(14, 10)), np.repeat(rng.normal(size=(1, 10)), 10, axis=0)])
    d = _distances(x, metric, channels)
    radius = float(np.quantile(d[np.triu_indices(len(x), 1)], 0.4))
    s = _frame(spark, x)
    got = {(r.a, r.b): r.d for r in N.near_pairs(s.withColumn("r", F.lit(radius)), s, metric, channels, share=share).collect()}
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= radius}
    assert set(got) == want
    assert all(v == pytest.approx(d[k]) for k, v in got.items())


def test_knn_and_lof(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(30, 6)), [[9.0] * 6]])
    s = _frame(spark, x)
    d = _distances(x, "euclid")
    near = N.knn(s, 5, 0.8)
    got = {}
    for r in near.collect():
        got.setdefault(r.a, []).append((r.rank, r.b))
    order = {i: [j for j in np.argsort(d[i], kind="stable") if j != i][:5] for i in range(31)}
    assert {k: [b for _, b in sorted(v)] for k, v in got.items()} == order
    out = {r.id: (r.lof, r.flag) for r in N.lof(near, 5).collect()}
    assert out[30][1] == -1 and max(v for v, _ in out.values()) == out[30][0]
    with pytest.raises(ValueError):
        N.knn(s, 31, 1.0)


def test_dbscan_on_two_blobs_and_noise(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.1, (12, 4)), rng.normal(5, 0.1, (9, 4)), [[20.0] * 4]])
    s = _frame(spark, x)
    near = N.near_pairs(s.withColumn("r", F.lit(1.0)), s, every=True)
    labels = C.dbscan(s, near, 4)
    assert [label for _, label in by(labels, "id", "label")] == [0] * 12 + [12] * 9 + [-1]
    assert C.cluster_count(labels).first()[0] == 2


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60)
    edges = spark.range(59).where("id <> 30").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [r for _, r in by(C.components(nodes, edges), "id", "root")] == [0] * 31 + [31] * 29


def _merge_by_hand(d, method):
    """One merge at a time over the full table."""
    fold = {"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[method]
    groups = {k: [k] for k in range(len(d))}
    out = []
    while len(groups) > 1:
        h, a, b = min((fold([d[i, j] for i in groups[p] for j in groups[q]]), p, q) for p in groups for q in groups if p < q)
        groups[a] += groups.pop(b)
        out.append((round(h, 9), a, b, len(groups[a])))
    return sorted(out)


@pytest.mark.parametrize("method", ["single", "complete"])
def test_linkage_gives_the_tree_of_one_merge_at_a_time(spark, method):
    x = np.random.default_rng(8).normal(size=(12, 3))
    s = _frame(spark, x)
    merges = C.linkage_table(s, N.within(s, 100.0), method)
    got = sorted((round(r.height, 9), r.a, r.b, r.size) for r in merges.collect())
    assert got == _merge_by_hand(_distances(x, "euclid"), method)


def test_spanning_edges_cut_like_single_linkage(spark):
    x = np.random.default_rng(9).normal(size=(14, 3))
    s = _frame(spark, x)
    near = N.within(s, 100.0)
    one = C.cut_linkage(s, C.spanning_edges(s, near), 4)
    two = C.cut_linkage(s, C.linkage_table(s, near, "single"), 4)
    assert by(one, "id", "label") == by(two, "id", "label")
    assert one.select("label").distinct().count() == 4


def test_row_norms_equal_the_full_table(spark):
    x = np.random.default_rng(10).normal(size=(9, 5))
    norms = np.linalg.norm(_distances(x, "euclid"), axis=1)
    assert np.allclose([n for _, n in by(N.row_norms(_frame(spark, x)), "id", "norm")], norms)


def test_dtw_kmeans_parts_shifted_shapes(spark):
    t = np.arange(24)
    up = [np.exp(-((t - 8 - k) ** 2) / 8) for k in range(4)]
    down = [-np.exp(-((t - 8 - k) ** 2) / 8) for k in range(4)]
    s = _frame(spark, np.array(up + down))
    best = min((C.dtw_kmeans(s.withColumn("id", F.col("id") + shift), 2, 5) for shift in (0, 100)), key=lambda r: r[0].agg(F.sum("d")).first()[0])
    labels = [label for _, label in by(best[0], "id", "label")]
    assert len(set(labels[:4])) == len(set(labels[4:])) == 1 and labels[0] != labels[4]


def test_learners(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.1, (20, 4)) for c in (0, 3)])
    s = _frame(spark, x).withColumn("label", (F.col("id") >= 20).cast("int"))
    scores, shares = M.pca3(s)
    assert abs(scores.agg(F.avg("pc1")).first()[0]) < 1e-9 and shares[0] > 0.9
    labels, centers = M.kmeans8(s, k=2, starts=2)
    parts = [label for _, label in by(labels, "id", "label")]
    assert len(centers) == 2 and len(set(parts[:20])) == 1 and parts[0] != parts[-1]
    assert M.accuracy(M.logreg(s, s)).first()[0] == 1.0
    with pytest.raises(ValueError):
        M.logreg(s, s, "onehot_encoding")
