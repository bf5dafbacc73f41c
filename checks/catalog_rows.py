"""Reading, writing, choosing, joining and shaping rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from checks.registry import query
from checks.sql import CH, each, r, with_
from checks.tables import DIGITS, HOUR, errors, event_incidents, events, faulty, incidents, readings, telemetry
from fleetgauge.functions import scalars as S
from fleetgauge.operators import errors as E
from fleetgauge.operators import filters as B
from fleetgauge.operators import grid as G
from fleetgauge.operators import regions as R
from fleetgauge.operators import scale as SC
from fleetgauge.operators import stats as ST
from fleetgauge.operators import windows as WN
from fleetgauge.operators.intervals import overlap_totals
from fleetgauge.operators.reconstruct import apply_profile, fit_profile
from fleetgauge.plans.realtime import profile_errors
from fleetgauge.schema import CHANNELS
from fleetgauge.session import work_path, written
from fleetgauge.sources import readers, writers

ALL = each(r("@") + " AS @")
TEL = with_("tel")
TELF = with_("telf")
EN = with_("en")
# Spans and names used by the filter queries.
DAYS = ("2024-01-08", "2024-01-21")
GAPS = [("2024-01-03", "2024-01-05"), ("2024-01-14", "2024-01-15")]
HOSTS = ["u000003", "u000008", "nobody"]
_HOSTS = "('u000003', 'u000008', 'nobody')"


# --- sources and sinks -------------------------------------------------------------------------

@query("read_raw", f"SELECT CAST(user_id AS VARCHAR) AS node, ts, {r('value')} AS power FROM events")
def _(spark, sf):
    return readers.read_raw(spark, f"{sf}/events.parquet", {"power": "value"}, "user_id", "ts")


@query("read_node_files", TEL + f"SELECT node, ts, {', '.join(r(f'CAST({c} AS DOUBLE)') + ' AS ' + c for c in CH)} FROM tel")
def _(spark, sf):
    """A folder with a file per machine, laid out by partition and read by file name."""
    path = work_path(spark, "node-files")
    writers.write_node_files(telemetry(spark, sf), path)
    files = readers.read_node_files(spark, path, CHANNELS, "ts", recursive=True)
    return files


@query("node_index", "SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS INTEGER) AS node_no FROM "
       "(SELECT DISTINCT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS node FROM events)")
def _(spark, sf):
    return G.node_index(readings(spark, sf))


@query("dates_range", "SELECT min(ts) AS start_ts, max(ts) AS end_ts FROM events")
def _(spark, sf):
    return G.dates_range(events(spark, sf).select(F.col("ts").cast("timestamp")))


@query("time_grid", TEL + f"SELECT node, ts, i, {ALL.replace('round(cpus_alloc, 6) + 0.0', 'cpus_alloc')} FROM tel")
def _(spark, sf):
    return telemetry(spark, sf)


@query("write_node_files", TEL + f"SELECT node, ts, {ALL} FROM tel".replace("round(cpus_alloc, 6)", "round(cpus_alloc::DOUBLE, 6)"))
def _(spark, sf):
    path = work_path(spark, "nodes")
    writers.write_node_files(telemetry(spark, sf), path)
    return readers.read_node_table(spark, path)


@query("export_error_matrix", EN + f"SELECT node, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, {r('e')} AS e FROM en ")
def _(spark, sf):
    """Errors of all windows out to a wide table (a column per window) and back to rows."""
    errs = written(E.err_node(profile_errors(faulty(spark, sf), CHANNELS)), "errors")
    last = G.dates_range(errs).first()
    hours = int((last.end_ts - last.start_ts).total_seconds()) // 3600
    times = [f"{last.start_ts + timedelta(hours=h):%Y-%m-%d %H:%M:%S}" for h in range(hours + 1)]
    path = work_path(spark, "matrix")
    writers.export_error_matrix(errs, times, path)
    return SC.to_long(spark.read.parquet(path), ["node"], times, "e").withColumnRenamed("channel", "at")


@query("import_error_table", EN + f"""SELECT CAST(win AS BIGINT) AS row, name, {r('e')} AS e FROM (
    SELECT min(win) OVER (PARTITION BY node, CAST(ts AS DATE)) AS win, strftime(ts, '%H:%M') AS name, e FROM en)""")
def _(spark, sf):
    """Errors written as JSON tables, a line per machine and day with its hours as columns."""
    cell = F.struct(F.date_format("ts", "HH:mm").alias("name"), "e")
    lines = (
        E.err_node(errors(spark, sf)).groupBy("node", F.to_date("ts").alias("day"))
        .agg(F.array_sort(F.collect_list(cell)).alias("c"), F.min("win").cast("long").alias("first_row"))
        .select(F.col("c.name").alias("columns"), F.array(F.col("c.e")).alias("data"), "first_row")
    )
    path = work_path(spark, "tables")
    lines.write.json(path)
    return readers.import_error_table(spark, path)


@query("publish_status", EN + f"""SELECT node, {r('max_by(e, win)')} AS r_err, max_by(e > 0.2, win) AS is_anomaly,
    max(ts) AS as_of FROM en GROUP BY node""")
def _(spark, sf):
    seen = E.err_node(errors(spark, sf)).select(
        "node", F.col("e").alias("r_err"), (F.col("e") > 0.2).alias("is_anomaly"), F.col("ts").alias("as_of")
    )
    path = work_path(spark, "status")
    writers.publish_status(seen, path)
    return writers.newest_status(spark.read.parquet(path))


@query("load_ground_truth", with_("inc") + "SELECT id, description, severity, date_start, date_end, "
       "event_type || ',' || user_id AS tags FROM inc")
def _(spark, sf):
    path = work_path(spark, "incidents")
    event_incidents(spark, sf).write.json(path)
    return readers.load_ground_truth(spark, path, "UTC").withColumn("tags", F.array_join("tags", ","))


_SCALES = " UNION ALL ".join(
    f"SELECT '{c}' AS channel, {r(f'CAST(min({c}) AS DOUBLE)')} AS mn, {r(f'CAST(max({c}) AS DOUBLE)')} AS mx FROM telf" for c in CH
)


@query("fit_scale", TELF + _SCALES)
def _(spark, sf):
    return SC.fit_scale(faulty(spark, sf), CHANNELS)


@query("save_scale", TELF + _SCALES)
def _(spark, sf):
    path = work_path(spark, "scale")
    writers.save_scale(SC.fit_scale(faulty(spark, sf), CHANNELS), path)
    return readers.load_scale(spark, path)


@query("save_metrics", EN + f"""SELECT run AS run_id, node, {r('avg(e)')} AS mean_e, {r('stddev_pop(e)')} AS std_e
    FROM en, (SELECT unnest(['a', 'b']) AS run) GROUP BY run, node""")
def _(spark, sf):
    path = work_path(spark, "metrics")
    result = ST.node_mean_std(E.err_node(errors(spark, sf)))
    for run in ("a", "b", "a"):
        writers.save_metrics(result, path, run)
    return readers.load_metrics(spark, path)


# --- projection and filters --------------------------------------------------------------------

@query("select_channels", TEL + f"SELECT node, ts, i, {r('power')} AS power, cpus_alloc FROM tel")
def _(spark, sf):
    return B.select_channels(telemetry(spark, sf), ["power", "cpus_alloc"])


@query("filter_host", TEL + f"SELECT node, ts, {r('power')} AS power FROM tel WHERE node IN {_HOSTS}")
def _(spark, sf):
    return B.filter_host(telemetry(spark, sf), HOSTS).select("node", "ts", "power")


@query("absent_hosts", f"""SELECT h AS node FROM (SELECT unnest(['u000003', 'u000008', 'nobody']) AS h)
    WHERE h NOT IN (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') FROM events)""")
def _(spark, sf):
    return B.absent_hosts(readings(spark, sf), HOSTS)


@query("date_range_filter", TEL + f"""SELECT node, ts, {r('power')} AS power FROM tel
    WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'""")
def _(spark, sf):
    return B.date_range_filter(telemetry(spark, sf), *DAYS).select("node", "ts", "power")


@query("remove_periods", TEL + f"""SELECT node, ts, {r('power')} AS power FROM tel
    WHERE NOT (ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05')
      AND NOT (ts BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-15')""")
def _(spark, sf):
    return B.remove_periods(telemetry(spark, sf), GAPS).select("node", "ts", "power")


_PERIODS = """WITH periods AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS node, date_trunc('second', ts) AS a,
        date_trunc('second', ts) + to_hours(CAST(props->>'$.k' AS INTEGER)) AS b FROM events WHERE event_type = 'error'), """


def _periods(spark, sf):
    """Error events of a machine, as many hours as `k` says."""
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    hours = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf).where(F.col("event_type") == "error").select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("node"),
        start.alias("start_ts"), F.timestamp_add("HOUR", hours, start).alias("end_ts"),
    )


@query("remove_period_table", _PERIODS + TEL[5:] + f"""SELECT node, ts, {r('power')} AS power FROM tel
    WHERE NOT EXISTS (SELECT 1 FROM periods p WHERE p.node = tel.node AND ts BETWEEN a AND b)""")
def _(spark, sf):
    return B.remove_period_table(telemetry(spark, sf), _periods(spark, sf), ["node"]).select("node", "ts", "power")


@query("overlapping_periods", _PERIODS + """spans AS (SELECT min(ts) AS lo, max(ts) AS hi, CAST(user_id AS VARCHAR) AS machine FROM events GROUP BY user_id
      UNION ALL SELECT min(ts) - INTERVAL 10 YEAR, max(ts), 'all' FROM events)
    SELECT machine, count(*) AS n, min(a) AS first_start FROM spans JOIN periods ON lo <= b AND a <= hi GROUP BY machine""")
def _(spark, sf):
    """How many error periods of any machine meet the time a machine was seen, and ten years before."""
    lo, hi = F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")
    seen = events(spark, sf).groupBy(F.col("user_id").cast("string").alias("machine")).agg(lo.alias("lo"), hi.alias("hi"))
    ever = events(spark, sf).agg((lo - F.expr("INTERVAL 10 YEARS")).alias("lo"), hi.alias("hi")).withColumn("machine", F.lit("all"))
    return overlap_totals(seen.unionByName(ever), _periods(spark, sf), ("lo", "hi"), ("start_ts", "end_ts"), "machine", "first_start")


@query("hosts_blacklist", TEL + f"SELECT node, ts, {r('power')} AS power FROM tel WHERE node NOT IN {_HOSTS}")
def _(spark, sf):
    return B.hosts_blacklist(telemetry(spark, sf), HOSTS).select("node", "ts", "power")


@query("top_nodes", TEL + f"""SELECT node, count(*) AS n, {r('sum(power)')} AS total FROM tel WHERE node IN (
    SELECT node FROM tel GROUP BY node ORDER BY sum(CAST(round(power * 1000000) AS BIGINT)) DESC, node LIMIT 40) GROUP BY node""")
def _(spark, sf):
    score = F.sum(F.round(F.col("power") * 1_000_000).cast("long"))
    best = B.top_nodes(telemetry(spark, sf), 40, score)
    return best.groupBy("node").agg(F.count("*").alias("n"), F.sum("power").alias("total"))


@query("active_nodes", TEL + "SELECT node, count(*) AS active_steps FROM tel WHERE power > 0.001 GROUP BY node")
def _(spark, sf):
    return B.active_nodes(telemetry(spark, sf))


@query("head_steps", TEL + f"SELECT node, ts, i, {r('power')} AS power FROM tel WHERE i < 5")
def _(spark, sf):
    return G.head_steps(telemetry(spark, sf), 5).select("node", "ts", "i", "power")


@query("drop_head", TEL + f"SELECT node, ts, i, {r('power')} AS power FROM tel WHERE i >= 5")
def _(spark, sf):
    return G.drop_head(telemetry(spark, sf), 5).select("node", "ts", "i", "power")


@query("truncate_to_slide", TEL + f"""SELECT node, ts, i, {r('power')} AS power FROM tel
    WHERE i < (SELECT max(i) + 1 - (max(i) + 1) % 7 FROM tel)""")
def _(spark, sf):
    return G.truncate_to_slide(telemetry(spark, sf), 7).select("node", "ts", "i", "power")


@query("cast_channels", TEL + "SELECT node, ts, CAST(trunc(power) AS INTEGER) AS power, CAST(cpus_alloc AS DOUBLE) AS cpus_alloc FROM tel")
def _(spark, sf):
    return G.cast_channels(telemetry(spark, sf), {"power": "int", "cpus_alloc": "double"}).select("node", "ts", "power", "cpus_alloc")


@query("describe", TEL + " UNION ALL ".join(
    f"""SELECT '{c}' AS channel, count({c}) AS n, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
    {r(f'CAST(min({c}) AS DOUBLE)')} AS min, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50,
    {r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'CAST(max({c}) AS DOUBLE)')} AS max FROM tel""" for c in CH))
def _(spark, sf):
    return B.describe(written(telemetry(spark, sf)), CHANNELS)


@query("check_aligned", TEL + """, a AS (SELECT node, count(*) AS n FROM tel GROUP BY node),
    b AS (SELECT node, count(*) AS n FROM cells GROUP BY node)
    SELECT a.node, a.n AS left_steps, b.n AS right_steps FROM a JOIN b ON a.node = b.node WHERE a.n <> b.n""")
def _(spark, sf):
    return G.check_aligned(telemetry(spark, sf), readings(spark, sf))


@query("same_index", TEL + """SELECT DISTINCT node, 'left' AS side FROM tel
    WHERE node NOT IN (SELECT node FROM cells WHERE ts >= TIMESTAMP '2024-01-29')
    UNION ALL SELECT 'all', 'right'""")
def _(spark, sf):
    late = readings(spark, sf).where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp")).select("node")
    extra = spark.createDataFrame([("all",)], "node string")
    return G.same_index(telemetry(spark, sf), late.unionByName(extra))


# --- joins -------------------------------------------------------------------------------------

@query("join_alloc", with_("ea") + f"SELECT node, win, ts, {r('e')} AS e, cpus_alloc FROM ea")
def _(spark, sf):
    return ST.join_alloc(E.err_node(errors(spark, sf)), faulty(spark, sf))


@query("join_names", EN + f"""SELECT n.node, n.node_no, {r('avg(e)')} AS mean_e FROM en JOIN (
    SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS INTEGER) AS node_no FROM (SELECT DISTINCT node FROM cells)) n
    ON en.node = n.node GROUP BY ALL""")
def _(spark, sf):
    names = G.node_index(readings(spark, sf))
    means = E.err_node(errors(spark, sf)).groupBy("node").agg(F.avg("e").alias("mean_e"))
    return ST.join_names(means.join(names, "node").select("node_no", "mean_e"), names)


@query("join_scale", with_("nrm") + " UNION ALL ".join(f"SELECT node, ts, '{c}' AS channel, {r(c)} AS x FROM nrm" for c in CH))
def _(spark, sf):
    tel = faulty(spark, sf).withColumn("cpus_alloc", F.col("cpus_alloc").cast("double"))
    scale = SC.fit_scale(tel, CHANNELS)
    return SC.join_scale(SC.to_long(tel, ["node", "ts"], CHANNELS), scale).select("node", "ts", "channel", "x")


def _rebuilt_windows(spark, sf, window=12, slide=12):
    tel = faulty(spark, sf)
    scaled = SC.apply_scale(tel, SC.fit_scale(tel, CHANNELS), CHANNELS)
    both = apply_profile(scaled, fit_profile(scaled, CHANNELS))
    return WN.sliding_windows(both, [*CHANNELS, *[f"{c}_hat" for c in CHANNELS]], window, slide)


_PAIRS = " UNION ALL ".join(
    f"""SELECT node, CAST(i // 12 AS INTEGER) AS win, '{c}' AS channel, CAST(i % 12 AS INTEGER) AS off,
    {r(c)} AS x, {r('p_' + c)} AS x_hat FROM points WHERE i < (SELECT max(i) + 1 - (max(i) + 1) % 12 FROM points)""" for c in CH)


@query("orig_vs_recon", with_("points") + _PAIRS)
def _(spark, sf):
    return E.orig_vs_recon(_rebuilt_windows(spark, sf), CHANNELS)


@query("reconstruction_report", with_("points") + f"SELECT * FROM ({_PAIRS}) WHERE win BETWEEN 10 AND 19")
def _(spark, sf):
    both = E.orig_vs_recon(_rebuilt_windows(spark, sf), CHANNELS)
    return both.where(F.col("win").between(10, 19))


@query("per_node_threshold", with_("lim") + f"""SELECT e.node, win, ts, {r('e')} AS e,
    CAST(round(e, 9) > round(p95, 9) AS INTEGER) AS flag FROM en e JOIN lim l ON e.node = l.node""")
def _(spark, sf):
    errs = E.err_node(errors(spark, sf))
    limits = ST.node_percentile(errs, [95])
    return ST.per_node_threshold(errs, limits, "p95", DIGITS).select("node", "win", "ts", "e", "flag")


@query("truth_in_range", with_("inc", "cells") + """SELECT id, severity, date_start, date_end FROM inc
    WHERE date_start >= (SELECT min(ts) + INTERVAL 3 DAY FROM cells) AND date_end <= (SELECT max(ts) FROM cells)""")
def _(spark, sf):
    span = G.dates_range(readings(spark, sf)).select(
        (F.col("start_ts") + F.expr("interval 3 days")).alias("start_ts"), "end_ts"
    )
    known = readers.parse_incidents(event_incidents(spark, sf))
    return R.truth_in_range(known, span).select("id", "severity", "date_start", "date_end")


# --- sort, top-k, set operations ---------------------------------------------------------------

@query("sort_nodes", "SELECT node, readings FROM (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS node, "
       "count(*) AS readings FROM events GROUP BY 1) ORDER BY node")
def _(spark, sf):
    return readings(spark, sf).groupBy("node").agg(F.sum("cpus_alloc").alias("readings")).orderBy("node")


@query("order_by_window", with_("fl") + f"SELECT win, ts, {r('e')} AS e FROM fl ORDER BY win")
def _(spark, sf):
    return E.err_fleet(errors(spark, sf)).orderBy("win")


@query("last_value", EN + f"SELECT node, {r('max_by(e, win)')} AS last_e FROM en GROUP BY node")
def _(spark, sf):
    return E.err_node(errors(spark, sf)).groupBy("node").agg(F.max_by("e", "win").alias("last_e"))


@query("append_batch", TEL + f"SELECT node, ts, {r('power')} AS power FROM tel")
def _(spark, sf):
    tel = telemetry(spark, sf)
    return G.append_batch(G.head_steps(tel, 700), G.drop_head(tel, 700)).select("node", "ts", "power")


@query("union_nodes", """SELECT 'event' AS node, ts FROM events UNION ALL SELECT 'ship' AS node, l_shipdate FROM lineitem""")
def _(spark, sf):
    a = events(spark, sf).select(F.lit("event").alias("node"), F.col("ts").cast("timestamp"))
    b = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.lit("ship").alias("node"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return G.union_nodes(a, b)


@query("history_window", TEL + f"SELECT node, ts, {r('power')} AS power FROM tel WHERE ts > (SELECT max(ts) - INTERVAL 24 HOUR FROM tel)")
def _(spark, sf):
    return G.history_window(telemetry(spark, sf), 24).select("node", "ts", "power")


# --- scalar functions --------------------------------------------------------------------------

@query("normalize", with_("nrm") + f"SELECT node, ts, {ALL} FROM nrm")
def _(spark, sf):
    tel = faulty(spark, sf)
    return SC.apply_scale(tel, SC.fit_scale(tel, CHANNELS), CHANNELS).select("node", "ts", *CHANNELS)


@query("denormalize", TELF + f"SELECT node, ts, {ALL.replace('round(cpus_alloc, 6)', 'round(cpus_alloc::DOUBLE, 6)')} FROM telf")
def _(spark, sf):
    tel = faulty(spark, sf)
    scale = SC.fit_scale(tel, CHANNELS)
    return SC.revert_scale(SC.apply_scale(tel, scale, CHANNELS), scale, CHANNELS).select("node", "ts", *CHANNELS)


@query("threshold_gt", EN + f"SELECT node, win, CAST(e > 0.05 AS INTEGER) AS flag FROM en")
def _(spark, sf):
    return E.err_node(errors(spark, sf)).select("node", "win", S.threshold_gt("e", 0.05).alias("flag"))


@query("threshold_ge", EN + f"SELECT node, win, CAST(e >= 0.05 AS INTEGER) AS flag FROM en")
def _(spark, sf):
    return E.err_node(errors(spark, sf)).select("node", "win", S.threshold_ge("e", 0.05).alias("flag"))


@query("abs_error", with_("points") + f"SELECT node, ts, {each(r('l1_@') + ' AS @')} FROM points")
def _(spark, sf):
    scaled = SC.apply_scale(faulty(spark, sf), SC.fit_scale(faulty(spark, sf), CHANNELS), CHANNELS)
    both = apply_profile(scaled, fit_profile(scaled, CHANNELS))
    return both.select("node", "ts", *[S.abs_error(c, f"{c}_hat").alias(c) for c in CHANNELS])


@query("sq_error", with_("points") + f"SELECT node, ts, {each(r('l2_@') + ' AS @')} FROM points")
def _(spark, sf):
    scaled = SC.apply_scale(faulty(spark, sf), SC.fit_scale(faulty(spark, sf), CHANNELS), CHANNELS)
    both = apply_profile(scaled, fit_profile(scaled, CHANNELS))
    return both.select("node", "ts", *[S.sq_error(c, f"{c}_hat").alias(c) for c in CHANNELS])


@query("to_long", TEL + " UNION ALL ".join(f"SELECT node, ts, '{c}' AS channel, {r(f'CAST({c} AS DOUBLE)')} AS x FROM tel" for c in CH))
def _(spark, sf):
    return SC.to_long(G.cast_channels(telemetry(spark, sf), {"cpus_alloc": "double"}), ["node", "ts"], CHANNELS)


@query("to_wide", TEL + f"SELECT node, ts, {', '.join(r(f'CAST({c} AS DOUBLE)') + ' AS ' + c for c in CH)} FROM tel")
def _(spark, sf):
    long = SC.to_long(G.cast_channels(telemetry(spark, sf), {"cpus_alloc": "double"}), ["node", "ts"], CHANNELS)
    return SC.to_wide(long, ["node", "ts"], CHANNELS)


@query("flatten_window", TEL + " UNION ALL ".join(
    f"""SELECT node, CAST(i // 24 AS INTEGER) AS win, CAST(i % 24 + {24 * k} AS INTEGER) AS off, {r(f'CAST({c} AS DOUBLE)')} AS x
    FROM tel WHERE i < (SELECT max(i) + 1 - (max(i) + 1) % 24 FROM tel)""" for k, c in enumerate(CH)))
def _(spark, sf):
    tel = G.cast_channels(telemetry(spark, sf), {"cpus_alloc": "double"})
    wins = WN.sliding_windows(tel, CHANNELS, 24, 24)
    return wins.select("node", "win", F.posexplode(S.flatten_window(CHANNELS)).alias("off", "x"))


@query("node_from_path", "SELECT DISTINCT 'e' || user_id || '_x' AS node, substr('e' || user_id || '_x.parquet', 1, 5) AS short FROM events")
def _(spark, sf):
    path = F.concat(F.lit("/data/run.1/e"), F.col("user_id").cast("string"), F.lit("_x.parquet"))
    seen = events(spark, sf).select(S.node_from_path(path).alias("node"), S.node_prefix(path).alias("short"))
    return seen.distinct()


@query("parse_periods", """SELECT event_id, CAST(ts AS DATE) + d AS "from", CAST(ts AS DATE) + d + 2 AS "to"
    FROM events, (SELECT unnest([0, 10]) AS d)""")
def _(spark, sf):
    def day(n):
        return F.date_format(F.date_add(F.to_date("ts"), n), "yyyy-MM-dd")

    text = F.concat(day(0), F.lit(","), day(2), F.lit(" & "), day(10), F.lit(" , "), day(12))
    return events(spark, sf).select("event_id", F.inline(S.parse_periods(text)))


@query("parse_hosts", "SELECT event_id, h FROM (SELECT event_id, unnest([event_type, 'e' || user_id]) AS h FROM events)")
def _(spark, sf):
    text = F.concat("event_type", F.lit(", e"), F.col("user_id").cast("string"), F.lit(","))
    return events(spark, sf).select("event_id", F.explode(S.parse_hosts(text)).alias("h"))


@query("parse_ts", """SELECT event_id, date_trunc('second', ts) AS utc,
    date_trunc('second', ts) - INTERVAL 1 HOUR AS from_warsaw, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text,
    date_trunc('second', ts) + INTERVAL 1 HOUR AS warsaw FROM events""")
def _(spark, sf):
    text = S.format_ts("ts")
    return events(spark, sf).select(
        "event_id", S.parse_ts(text).alias("utc"), S.parse_ts(text, "Europe/Warsaw").alias("from_warsaw"),
        text.alias("text"), S.local_ts(S.parse_ts(text), "Europe/Warsaw").alias("warsaw"),
    )


@query("shift_minutes", "SELECT event_id, ts - INTERVAL 5 MINUTE AS earlier, ts + to_minutes(CAST(user_id AS INTEGER)) AS later FROM events")
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return events(spark, sf).select(
        "event_id", S.shift_minutes(ts, -5).alias("earlier"), S.shift_minutes(ts, F.col("user_id").cast("int")).alias("later")
    )


@query("fleet_json", EN + """SELECT '{' || string_agg('"' || node || '":{"r_err":' || CAST(r_err AS VARCHAR) || ',"is_anomaly":' ||
    is_anomaly || '}', ',' ORDER BY node) || '}' AS status FROM (SELECT node, max_by(CAST(floor(e * 1000) AS INTEGER), win) AS r_err,
      CASE WHEN max_by(e, win) > 0.2 THEN 'true' ELSE 'false' END AS is_anomaly FROM en GROUP BY node)""")
def _(spark, sf):
    """Newest status of all machines in one document."""
    last = errors(spark, sf).groupBy("node").agg(F.max_by("l1", "win").alias("e"))
    return S.fleet_json(last.select("node", F.floor(F.col("e") * 1000).cast("int").alias("r_err"), (F.col("e") > 0.2).alias("is_anomaly")))


@query("status_json", EN + """SELECT node, '{"r_err":' || CAST(max_by(CAST(floor(e * 1000) AS INTEGER), win) AS VARCHAR) || ',"is_anomaly":' ||
    max_by(CASE WHEN e > 0.2 THEN 'true' ELSE 'false' END, win) || '}' AS status FROM en GROUP BY node""")
def _(spark, sf):
    last = E.err_node(errors(spark, sf)).groupBy("node").agg(F.max_by("e", "win").alias("e"))
    return last.select("node", S.status_json(F.floor(F.col("e") * 1000).cast("int"), F.col("e") > 0.2).alias("status"))
