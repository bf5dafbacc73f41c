"""Session set-up and reliable cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fleetgauge", master: str | None = None, **conf: object) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    ship(spark)
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on.

    UTC clock; skewed partitions are split also ahead of a further exchange; tables laid out by
    (node, span) are joined on (node, span, step) without a new exchange; small shuffles keep
    enough partitions for all cores, as a few wide rows may unfold into many; files with nanosecond
    times can be read; many folders are listed by some hundred tasks (10,000 otherwise).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "256")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, where it is not installed there."""
    context = spark.sparkContext
    if getattr(context, "_fleetgauge_sent", False):
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="fleetgauge-"), "fleetgauge.zip")
    with zipfile.ZipFile(target, "w") as out:
        for base, _, names in os.walk(folder):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(folder)))
    context.addPyFile(target)
    context._fleetgauge_sent = True


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see; a temporary one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="fleetgauge-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_scratch = threading.local()


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work tables written inside are removed at the end: for loops that go on for ever."""
    outer, _scratch.paths, _scratch.made = (getattr(_scratch, "paths", None), getattr(_scratch, "made", None)), [], {}
    try:
        yield
    finally:
        paths, (_scratch.paths, _scratch.made) = _scratch.paths, outer
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def made_once(source: DataFrame, asked: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once for this table and `asked` inside a `scratch`, as its work tables last that long; outside it anew."""
    made = getattr(_scratch, "made", None)
    if made is None:
        return make()
    key = (id(source), *asked)
    if key not in made:
        made[key] = (source, make())
    return made[key][1]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table that several later steps read, and read it back: short plan, pruned columns,
    known size, and nothing to recompute when an executor is lost."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there; survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
