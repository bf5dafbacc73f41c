"""Streams on keyed state against the batch forms, over many micro-batches with late and repeated rows."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from fleetgauge.operators.grid import time_grid
from fleetgauge.operators.reconstruct import fit_profile
from fleetgauge.operators.scale import apply_scale, fit_scale
from fleetgauge.plans.realtime import node_status
from fleetgauge.streaming import keyed, live

START = datetime(2024, 1, 1, 5)
CH = ["power", "cpu1"]
SCHEMA = "node string, ts timestamp, power double, cpu1 double"
OPTIONS = dict(window=5, windows=40, long=12, short=4, trim="warmup")


def _rows():
    """Four machines, a step a minute; one falls silent for a while, one has gaps, one jumps at the end."""
    r = np.random.default_rng(3)
    rows = []
    for n in range(4):
        for k in range(130):
            if (n == 1 and 60 <= k < 90) or (n == 2 and k % 17 == 5):
                continue
            jump = 6.0 if n == 3 and k > 118 else 0.0
            rows.append((f"n{n}", START + timedelta(minutes=k, seconds=int(r.integers(0, 50)) if k else 0), float(r.normal(3, 0.2) + jump), float(r.normal(1, 0.1))))
    return rows


def _deliver(spark, rows, source, batches):
    """Files in order of time, some rows up to eight minutes late, some twice, a newer reading of one step later."""
    some = random.Random(1)
    due = [[] for _ in range(batches)]
    for row in rows:
        minute = (row[1] - START).total_seconds() / 60
        at = min(batches - 1, int((minute + (some.random() < 0.1) * some.randrange(1, 9)) // 4.4))
        due[at].append(row)
        if some.random() < 0.05 and at + 1 < batches:
            due[at + 1].append(row)
    for part in due:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def _run(stream, sink, progress):
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).start(sink).awaitTermination()


def test_streamed_statuses_are_those_of_the_batch(spark, tmp_path):
    rows = _rows()
    table = spark.createDataFrame(rows, SCHEMA).checkpoint()
    grid = time_grid(table, CH, 60, 0.0)
    scale = fit_scale(grid, CH)
    profile = fit_profile(apply_scale(grid, scale, CH), CH).checkpoint()
    source, sink, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))

    def stream():
        readings = live.ingest(spark, source, table.schema, files=1)
        return keyed.status_stream(readings, CH, scale, profile, lateness="10 minutes", **OPTIONS)

    _deliver(spark, rows[:], source, 30)
    _run(stream(), sink, progress)
    _run(stream(), sink, progress)  # nothing new: nothing changes
    got = {(r.node, r.as_of): (r.r_err, r.is_anomaly) for r in spark.read.parquet(sink).collect()}
    assert len(got) == spark.read.parquet(sink).count()  # each step once
    ends = sorted({as_of for _, as_of in got})
    assert ends[-1] >= START + timedelta(minutes=117) and len(ends) > 60
    seen = set()
    for as_of in [ends[0], *ends[11::24], ends[-1]]:
        so_far = table.where(F.col("ts") < F.lit(as_of + timedelta(minutes=1)))
        want = node_status(time_grid(so_far, CH, 60, 0.0), CH, scale=scale, profile=profile, **OPTIONS).collect()
        assert {w.node for w in want} == {n for n, at in got if at == as_of}
        for w in want:
            r_err, flag = got[w.node, as_of]
            assert abs(r_err - w.r_err) < 1e-9 and flag == w.is_anomaly
            seen.add(flag)
    assert seen == {True, False}
    held = spark.read.format("statestore").option("path", progress).option("stateVarName", "ring").load()
    sizes = [len(r.held) // 8 // 3 for r in held.select("value.held").collect()]
    assert len(sizes) == 4 and max(sizes) <= OPTIONS["window"] + OPTIONS["windows"] + 25  # bounded, not the whole past


def test_history_in_state_is_the_history_in_files(spark, tmp_path):
    rows = _rows()
    source, sink, progress, files = (str(tmp_path / x) for x in ("in", "out", "progress", "files"))
    schema = spark.createDataFrame([], SCHEMA).schema
    _deliver(spark, rows, source, 4)
    changed = [(n, t, 9.0, None) for n, t, _, _ in rows[-3:]]
    # The stream stops, goes on with changed rows of old times, and with rows of the next day.
    later = [("n0", START + timedelta(minutes=100, hours=1, seconds=1), 1.0, 2.0)]
    for part in ([], changed, later):
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        _run(keyed.history_stream(live.ingest(spark, source, schema, files=1), CH, hours=2), sink, progress)
    live.append_history(spark.createDataFrame(rows, SCHEMA), 0, files)
    live.append_history(spark.createDataFrame(changed, SCHEMA), 1, files)
    live.append_history(spark.createDataFrame(later, SCHEMA), 2, files)
    want = live.read_history(spark, files, 2)
    got = keyed.read_state(spark, progress, 2)
    key = lambda df: sorted(map(str, df.select("node", "ts", *CH).collect()))
    assert key(got) == key(want) and got.count() < len(rows)
    # What left the history leaves the state, once the watermark has passed it by an hour at most.
    for hours in (5, 6):
        spark.createDataFrame([("n0", START + timedelta(hours=hours), 0.5, 0.5)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        _run(keyed.history_stream(live.ingest(spark, source, schema, files=1), CH, hours=2), sink, progress)
    state = spark.read.format("statestore").option("path", progress).option("stateVarName", "readings").load()
    assert state.count() == 2 and keyed.read_state(spark, progress, 2).count() == 2


def test_the_plain_verdict_on_missing_windows():
    series = np.array([1.0] * 30 + [np.nan] * 3 + [1.0] * 10 + [5.0, 5.0])
    assert keyed.judge(series, 12, 4, "warmup") is True
    assert keyed.judge(np.full(20, np.nan), 5, 2, "tail") is None
    assert keyed.judge(series[:10], 12, 4, "tail") is None


def test_the_keyed_loop_publishes_and_cleans_up(spark, tmp_path):
    """Newest status of every machine, a verdict on the fleet, no work tables left behind."""
    rows = [(n, START + timedelta(minutes=k), 1.0 + 0.1 * ((k * 7 + len(n)) % 5), 1.0 + (k % 3)) for n in ("a", "bb") for k in range(100)]
    table = spark.createDataFrame(rows, SCHEMA).checkpoint()
    scale = fit_scale(table, CH)
    profile = fit_profile(apply_scale(table, scale, CH), CH).checkpoint()
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    for low in range(0, 100, 10):
        since = F.lit(START + timedelta(minutes=low))
        table.where((F.col("ts") >= since) & (F.col("ts") < since + F.make_interval(mins=F.lit(10)))).coalesce(1).write.mode("append").parquet(source)
    before = {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).iterdir()}
    live.start_keyed(live.ingest(spark, source, table.schema, files=1), work, CH, scale, profile, lateness="0 seconds", **OPTIONS).awaitTermination()
    status = {r.node: r for r in live.read_status(spark, f"{work}/status").collect()}
    assert set(status) == {"a", "bb"} and all(r.as_of == START + timedelta(minutes=98) for r in status.values())
    assert spark.read.parquet(f"{work}/fleet").count() >= 1
    after = {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).iterdir()}
    assert not {p for p in after - before if p.startswith(("verdicts", "means"))}
    # A publication that is not complete is not read.
    (Path(work) / "status" / "batch=999").mkdir()
    assert live.read_status(spark, f"{work}/status").count() == 2
