"""Whole series: neighbours, outliers, clusters, learners (the vectors of `embeddings`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.sql import r
from checks.tables import series
from fleetgauge.operators import clusters as C
from fleetgauge.operators import models as M
from fleetgauge.operators import neighbours as N

RADIUS = 1.25  # fixed value: keeps a few percent of all pairs of these vectors
_V = "s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
_D = """dist AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM s a JOIN s b ON a.id <> b.id)"""
_ELEM = "el AS (SELECT id, label, unnest(range(64)) AS off, unnest(v) AS x FROM s)"


@query("euclid_pairs", f"WITH {_V}, {_D} SELECT a, b, {r('d')} AS d FROM dist WHERE a < b AND d <= {RADIUS}")
def _(spark, sf):
    return N.within(series(spark, sf), RADIUS)


@query("dtw_pairs")
def _(spark, sf):
    return N.within(series(spark, sf), 0.62, "dtw")


@query("dtw_pairs_banded")
def _(spark, sf):
    return N.within(series(spark, sf), 0.8, "dtw", band=6)


@query("dbscan_warped")
def _(spark, sf):
    """Density clusters on warping distances divided by the length of their row of the table."""
    s = series(spark, sf)
    return C.dbscan(s, N.row_scaled_pairs(s, 0.87 / s.count() ** 0.5, "dtw"), 15)


@query("row_norms", f"WITH {_V}, {_D} SELECT a AS id, {r('sqrt(sum(d * d))')} AS norm FROM dist GROUP BY a")
def _(spark, sf):
    return N.row_norms(series(spark, sf))


_KNN = f"""WITH {_V}, {_D}, nn AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM dist QUALIFY rank <= 40)"""


@query("knn", _KNN + f" SELECT a, b, {r('d')} AS d, CAST(rank AS INTEGER) AS rank FROM nn")
def _(spark, sf):
    return N.knn(series(spark, sf), 40, RADIUS)


@query("lof", _KNN + f""", kd AS (SELECT a AS b, d AS kd FROM nn WHERE rank = 40),
    lrd AS (SELECT a, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM nn JOIN kd USING (b) GROUP BY a),
    sc AS (SELECT n.a AS id, avg(o.lrd) / any_value(m.lrd) AS lof FROM nn n JOIN lrd o ON n.b = o.a JOIN lrd m ON n.a = m.a GROUP BY n.a)
    SELECT id, {r('lof')} AS lof, CASE WHEN round(lof, 9) > round((SELECT quantile_cont(lof, 0.95) FROM sc), 9) THEN -1 ELSE 1 END AS flag FROM sc""")
def _(spark, sf):
    return N.lof(N.knn(series(spark, sf), 40, RADIUS), 40)


_CORES = f"""WITH RECURSIVE {_V}, {_D}, near AS MATERIALIZED (SELECT a, b FROM dist WHERE d <= {RADIUS}),
    core AS MATERIALIZED (SELECT id FROM s LEFT JOIN near ON id = a GROUP BY id HAVING count(b) + 1 >= 25),
    link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    walk(id, root) AS (SELECT id, id FROM core UNION SELECT l.b, w.root FROM walk w JOIN link l ON w.id = l.a WHERE w.root < l.b),
    roots AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
    lab AS (SELECT s.id, s.id IN (SELECT id FROM core) AS core,
      coalesce((SELECT root FROM roots WHERE roots.id = s.id),
               (SELECT min(root) FROM near JOIN roots ON roots.id = near.b WHERE near.a = s.id), -1) AS label FROM s)"""


def _labels(spark, sf):
    s = series(spark, sf)
    every = N.near_pairs(s.withColumn("r", F.lit(RADIUS)), s, every=True, measure=False)
    return C.dbscan(s, every, 25, again=True)


@query("dbscan", _CORES + " SELECT id, core, label FROM lab")
def _(spark, sf):
    return _labels(spark, sf)


@query("dbscan_row_scaled", f"""WITH RECURSIVE {_V}, {_D}, nm AS (SELECT a, sqrt(sum(d * d)) AS norm FROM dist GROUP BY a),
    near AS MATERIALIZED (SELECT a, b FROM dist JOIN nm USING (a) WHERE d / norm <= 0.88 / sqrt((SELECT count(*) FROM s))),
    core AS MATERIALIZED (SELECT id FROM s LEFT JOIN near ON id = a GROUP BY id HAVING count(b) + 1 >= 15),
    one AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    link AS MATERIALIZED (SELECT a, b FROM one UNION SELECT b, a FROM one),
    walk(id, root) AS (SELECT id, id FROM core UNION SELECT l.b, w.root FROM walk w JOIN link l ON w.id = l.a WHERE w.root < l.b),
    roots AS (SELECT id, min(root) AS root FROM walk GROUP BY id)
    SELECT s.id, s.id IN (SELECT id FROM core) AS core, coalesce((SELECT root FROM roots WHERE roots.id = s.id),
      (SELECT min(root) FROM near JOIN roots ON roots.id = near.b WHERE near.a = s.id), -1) AS label FROM s""")
def _(spark, sf):
    """Distances divided by the length of their row of the table; the bound becomes a radius per series."""
    s = series(spark, sf)
    eps = 0.88 / s.count() ** 0.5
    own = s.join(N.row_norms(s), "id").select("id", "v", (F.col("norm") * eps).alias("r"))
    return C.dbscan(s, N.near_pairs(own, s, every=True, measure=False), 15, again=True)


@query("cluster_count", _CORES + " SELECT count(DISTINCT label) FILTER (label <> -1) AS clusters FROM lab")
def _(spark, sf):
    return C.cluster_count(_labels(spark, sf))


@query("linkage_table")
def _(spark, sf):
    s = series(spark, sf)
    return C.linkage_table(s, N.within(s, RADIUS), "complete")


@query("hier_clusters")
def _(spark, sf):
    """Complete linkage, cut to 7 clusters: merges within the radius, then of the clusters that these leave."""
    s = series(spark, sf)
    merges = C.linkage_table(s, N.within(s, RADIUS), "complete")
    return C.cut_linkage(s, C.complete_further(s, merges, RADIUS, 7), 7)


@query("dtw_kmeans")
def _(spark, sf):
    return C.dtw_kmeans(series(spark, sf), 8)[0]


@query("kmeans8")
def _(spark, sf):
    return M.kmeans8(series(spark, sf))[0].select("id", "label", F.array_min("dist").alias("nearest"))


@query("pca3")
def _(spark, sf):
    return M.pca3(series(spark, sf))[0]


@query("logreg")
def _(spark, sf):
    s = series(spark, sf)
    late = F.col("id") % 4 == 0
    return M.logreg(s.where(~late), s.where(late))


@query("accuracy", "SELECT round(avg(CASE WHEN vec_id % 10 = label THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS accuracy FROM embeddings")
def _(spark, sf):
    guess = series(spark, sf).select("id", "label", (F.col("id") % 10).cast("int").alias("pred"))
    return M.accuracy(guess)


@query("vector_normalize", f"WITH {_V}, {_ELEM} SELECT id, CAST(off AS INTEGER) AS off, {r('x / sqrt(sum(x * x) OVER (PARTITION BY id))')} AS x FROM el")
def _(spark, sf):
    return M.vector_normalize(series(spark, sf)).select("id", F.posexplode("v").alias("off", "x"))


@query("standard_scale", f"WITH {_V}, {_ELEM} SELECT id, CAST(off AS INTEGER) AS off, {r('(x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0)')} AS x FROM el WINDOW w AS (PARTITION BY off)")
def _(spark, sf):
    return M.standard_scale(series(spark, sf)).select("id", F.posexplode("v").alias("off", "x"))


@query("series_by_cluster", f"""WITH {_V}, {_ELEM} SELECT label, CAST(off AS INTEGER) AS off, count(*) AS n, {r('avg(x)')} AS mean,
    {r('min(x)')} AS low, {r('max(x)')} AS high FROM el GROUP BY label, off""")
def _(spark, sf):
    s = series(spark, sf)
    return C.series_by_cluster(s, s)
