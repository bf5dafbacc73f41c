"""Complete linkage beyond the radius of the pairs, against one merge at a time over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import catalog_series
from checks.registry import QUERIES
from fleetgauge.operators import clusters as C
from fleetgauge.operators import neighbours as N
from tests.data import by
from tests.test_series import _distances, _frame, _merge_by_hand


def _points(n=24, seed=5):
    return np.random.default_rng(seed).normal(size=(n, 3)).round(3)


@pytest.mark.parametrize("dense,radius", [(1, 1.5), (2048, 0.01)])
def test_merges_go_on_to_one_cluster(spark, monkeypatch, dense, radius):
    monkeypatch.setattr(C, "_DENSE", dense)
    x = _points()
    s = _frame(spark, x)
    merges = C.linkage_table(s, N.within(s, radius), "complete")
    got = sorted((round(r.height, 9), r.a, r.b) for r in C.complete_further(s, merges, radius, 1, 3.0).collect())
    assert got == [m[:3] for m in _merge_by_hand(_distances(x, "euclid"), "complete")]


@pytest.mark.parametrize("share", [4, 1000])
def test_group_pairs_are_the_largest_distances(spark, monkeypatch, share):
    monkeypatch.setattr(N, "_CELLS", 64)
    x = _points(60, 6)
    x[7] = x[40]
    d = _distances(x, "euclid")
    group = np.where(np.arange(60) % 3 == 0, 0, np.arange(60) // 4)
    s = _frame(spark, x).withColumn("group", F.when(F.col("id") % 3 == 0, 0).otherwise(F.floor(F.col("id") / 4)))
    want = {}
    for a in np.unique(group):
        for b in np.unique(group[group > a]):
            want[a, b] = d[np.ix_(group == a, group == b)].max()
    for radius in (None, 3.0):
        got = {(r.a, r.b): r.d for r in N.group_pairs(s, radius, share).collect()}
        assert got.keys() == {k for k, v in want.items() if radius is None or v <= radius}
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)


def test_hier_clusters_is_complete_linkage(spark, tmp_path, monkeypatch):
    x = _points(50, 7)
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(catalog_series, "RADIUS", 0.7)
    root = list(range(50))
    for _, a, b, _ in _merge_by_hand(_distances(x.astype(np.float32).astype(float), "euclid"), "complete")[:43]:
        root = [a if r == b else r for r in root]
    assert by(QUERIES["hier_clusters"](spark, str(tmp_path)), "id", "label") == list(enumerate(root))
