"""Exploration of vectors with Spark's own learners."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _vector(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, array_to_vector(column))


def pca3(series: DataFrame, k: int = 3) -> tuple[DataFrame, list[float]]:
    """Centred scores on the k leading axes, and the share of variance each explains."""
    vec = _vector(series, "v", "_x")
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_c").fit(vec).transform(vec)
    model = PCA(k=k, inputCol="_c", outputCol="_s").fit(centred)
    scores = model.transform(centred).select("id", vector_to_array("_s").alias("s"))
    out = scores.select("id", *[F.col("s")[n].alias(f"pc{n + 1}") for n in range(k)])
    return out, [float(x) for x in model.explainedVariance.toArray()]


_AT_ONCE = 8  # starts that share the cluster; each is a chain of short jobs


def _best(df: DataFrame, k: int, starts: int, seed: int):
    """The start of least cost, the first among equals."""

    def fit(n: int):
        return KMeans(k=k, seed=seed + n, featuresCol="_x").fit(df)

    with ThreadPool(min(starts, _AT_ONCE)) as pool:
        fits = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(starts))
    return min(fits, key=lambda m: m.summary.trainingCost)


def _distances(centers: list) -> Column:
    """Euclidean distance to each centre; centres are k short lists."""

    def to(center) -> Column:
        c = F.array(*[F.lit(float(x)) for x in center])
        gaps = F.zip_with("v", c, lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g))

    return F.array(*[to(c) for c in centers])


def kmeans8(series: DataFrame, k: int = 8, starts: int = 20, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """Two stages: cluster the vectors, then cluster their distances to the first centres.

    Returns `id, dist, label` and the centres of the second stage; the best of `starts` runs
    counts in each stage.
    """
    plain = _vector(series, "v", "_x").cache()
    first = _best(plain, k, starts, seed)
    plain.unpersist()
    away = series.select("id", _distances(first.clusterCenters()).alias("dist"))
    vec = _vector(away, "dist", "_x").cache()
    second = _best(vec, k, starts, seed)
    vec.unpersist()
    labels = second.transform(vec).select("id", "dist", F.col("prediction").alias("label"))
    return labels, [list(map(float, c)) for c in second.clusterCenters()]


def logreg(train: DataFrame, test: DataFrame, encoding: str = "label_encoding", c: float = 1.0) -> DataFrame:
    """Fit on train, predict test: `id, label, pred`. One-hot labels are refused."""
    if encoding not in ("label_encoding", "None"):
        raise ValueError("one-hot labels are not supported")
    model = LogisticRegression(
        featuresCol="_x", labelCol="label", standardization=False, regParam=1.0 / (c * train.count()), maxIter=100
    ).fit(_vector(train, "v", "_x"))
    return model.transform(_vector(test, "v", "_x")).select("id", "label", F.col("prediction").cast("int").alias("pred"))


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def vector_normalize(series: DataFrame) -> DataFrame:
    """Rows scaled to length one."""
    out = Normalizer(p=2.0, inputCol="_x", outputCol="_y").transform(_vector(series, "v", "_x"))
    return out.withColumn("v", vector_to_array("_y")).drop("_x", "_y")


def standard_scale(series: DataFrame) -> DataFrame:
    """Each position scaled to mean 0 and deviation 1 (population)."""
    vec = _vector(series, "v", "_x")
    n = vec.count()
    model = StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="_y").fit(vec)
    # The learner divides by the sample deviation; n / (n - 1) turns it into the population one.
    lift = float((n / (n - 1)) ** 0.5)
    scaled = model.transform(vec).withColumn("v", F.transform(vector_to_array("_y"), lambda x: x * lift))
    return scaled.drop("_x", "_y")
