"""Windows, errors, statistics and detection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.registry import query
from checks.sql import CH, each, judged, padded, r, with_
from checks.tables import DIGITS, HOUR, errors, faulty, incidents, readings, series, telemetry
from fleetgauge.operators import errors as E
from fleetgauge.operators import grid as G
from fleetgauge.operators import reconstruct as RC
from fleetgauge.operators import regions as R
from fleetgauge.operators import rolling as RO
from fleetgauge.operators import scale as SC
from fleetgauge.operators import stats as ST
from fleetgauge.operators import windows as WN
from fleetgauge.plans import evaluation as EV
from fleetgauge.plans import realtime as RT
from fleetgauge.plans.preparation import Settings, prepare_dataset
from fleetgauge.schema import CHANNELS

EN = with_("en")
FL = with_("fl")


def err(spark, sf, window=60):
    return E.err_node(errors(spark, sf, window))


def scaled(spark, sf):
    tel = faulty(spark, sf)
    return SC.apply_scale(tel, SC.fit_scale(tel, CHANNELS), CHANNELS)


# --- windows -----------------------------------------------------------------------------------

_SLICES = each("list(@) OVER w AS @")
_OFFS = " UNION ALL ".join(f"SELECT node, win, ts AS start_ts, '{c}' AS channel, CAST(unnest(range(24)) AS INTEGER) AS off, unnest({c}) AS x FROM win" for c in CH)


@query("sliding_windows", with_("tel") + f""", win AS (
    SELECT node, CAST((i - 23) // 12 AS INTEGER) AS win, ts - INTERVAL 23 HOUR AS ts, {each("@")} FROM (
      SELECT node, i, ts, {_SLICES} FROM tel WINDOW w AS (PARTITION BY node ORDER BY i ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    WHERE i >= 23 AND (i - 23) % 12 = 0)
    SELECT node, win, start_ts, channel, off, round(x, 6) + 0.0 AS x FROM ({_OFFS.replace('unnest(cpus_alloc)', 'unnest(cpus_alloc)::DOUBLE')})""")
def _(spark, sf):
    wins = WN.sliding_windows(G.cast_channels(telemetry(spark, sf), {"cpus_alloc": "double"}), CHANNELS, 24, 12)
    return E.window_elements(wins.where(F.col("node").isNotNull()), CHANNELS, ("start_ts",))


@query("window_count", with_("tel") + "SELECT node, (max(i) + 1 - 60) // 7 + 1 AS windows FROM tel GROUP BY node".replace("(max(i) + 1 - 60) // 7 + 1", "CAST((max(i) + 1 - 60) // 7 + 1 AS BIGINT)"))
def _(spark, sf):
    return G.window_count(telemetry(spark, sf), 60, 7)


@query("usable_length", with_("tel") + """SELECT node, max(i) + 1 AS steps, CAST(ceil((max(i) + 1 - 60) / 7.0) AS BIGINT) AS usable,
    CAST((max(i) + 1) // 7 AS BIGINT) AS "full", (max(i) + 1) % 7 <> 0 AS misfit FROM tel GROUP BY node""")
def _(spark, sf):
    return G.usable_length(telemetry(spark, sf), 60, 7)


@query("window_at", with_("w60") + f"SELECT node, win, ts, {r('l1')} AS l1 FROM w60 WHERE win = 100")
def _(spark, sf):
    return WN.window_at(errors(spark, sf), 100).select("node", "win", "ts", "l1")


@query("last_window", with_("w60") + f"SELECT node, win, ts, {r('l1')} AS l1 FROM w60 WHERE win = (SELECT max(win) FROM w60)")
def _(spark, sf):
    return WN.last_window(errors(spark, sf)).select("node", "win", "ts", "l1")


@query("last_n_windows", with_("fl") + f"SELECT win, ts, {r('e')} AS e FROM fl WHERE win > (SELECT max(win) FROM fl) - 360")
def _(spark, sf):
    return WN.last_n_windows(E.err_fleet(errors(spark, sf)), 360)


# --- errors ------------------------------------------------------------------------------------

@query("recon_profile", with_("points") + f"SELECT node, ts, i, {each(r('p_@') + ' AS @')} FROM points")
def _(spark, sf):
    s = scaled(spark, sf)
    both = RC.apply_profile(s, RC.fit_profile(s, CHANNELS))
    return both.select("node", "ts", "i", *[F.col(f"{c}_hat").alias(c) for c in CHANNELS])


@query("err_node_channel", with_("w60") + " UNION ALL ".join(f"SELECT node, win, ts, '{c}' AS channel, {r('l1_' + c)} AS e FROM w60" for c in CH))
def _(spark, sf):
    return E.err_node_channel(errors(spark, sf), CHANNELS)


@query("err_node", EN + f"SELECT node, win, ts, {r('e')} AS e FROM en")
def _(spark, sf):
    return err(spark, sf)


@query("err_fleet", FL + f"SELECT win, ts, {r('e')} AS e FROM fl")
def _(spark, sf):
    return E.err_fleet(errors(spark, sf))


@query("replay", with_("w60b") + "SELECT node, win, ts, " + ", ".join(each(r(m + "_@") + f" AS {m}_@") for m in ("l1", "l2"))
       + f", {r('l1')} AS l1, {r('l2')} AS l2 FROM w60b")
def _(spark, sf):
    return EV.replay(faulty(spark, sf), CHANNELS)


@query("replay_fleet", with_("w60b") + f"SELECT win, {r('avg(l1)')} AS l1, {r('avg(l2)')} AS l2 FROM w60b GROUP BY win")
def _(spark, sf):
    return EV.replay_fleet(EV.replay(faulty(spark, sf), CHANNELS))


_COVER = """SELECT p.* FROM points p JOIN (SELECT unnest(generate_series(0, (SELECT (max(i) + 1 - 12) // 5 FROM points))) AS k) w
    ON p.i >= k * 5 AND p.i < k * 5 + 12"""
_REL = " + ".join(f"coalesce(sum(l1_{c} / nullif(abs({c}), 0)), 0)" for c in CH)
_RELN = " + ".join(f"count(l1_{c} / nullif(abs({c}), 0))" for c in CH)


@query("recon_losses", with_("points") + f"""SELECT {r(f"avg({each('l2_@', ' + ')})")} AS mse,
    {r(f"avg({each('l1_@', ' + ')}) / 4")} AS mae, {r(f'({_REL}) / ({_RELN})')} AS mape FROM ({_COVER})""")
def _(spark, sf):
    s = scaled(spark, sf)
    return E.recon_losses(RC.apply_profile(s, RC.fit_profile(s, CHANNELS)), CHANNELS, 12, 5)


@query("kld_loss", f"""SELECT {r('avg(mse)')} AS mse, {r('avg(kld)')} AS kld, {r('avg(mse) + 2.5 * avg(kld)')} AS loss FROM (
    SELECT list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]),
             lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) / 32 AS mse,
           -0.5::DOUBLE * list_sum(list_transform(list_zip(embedding[1:32], embedding[33:64]),
             lambda p: 1 + p[2]::DOUBLE - p[1]::DOUBLE * p[1]::DOUBLE - exp(p[2]::DOUBLE))) AS kld FROM embeddings)""")
def _(spark, sf):
    halves = series(spark, sf).select(F.slice("v", 1, 32).alias("mu"), F.slice("v", 33, 32).alias("logvar"))
    gap = F.zip_with("mu", "logvar", lambda a, b: (a - b) * (a - b))
    mse = F.aggregate(gap, F.lit(0.0), lambda a, x: a + x) / 32
    return E.kld_loss(halves, mse, weight=E.balanced_weight(5.0, 32, 64))


# --- statistics --------------------------------------------------------------------------------

@query("fleet_mean", EN + f"SELECT ts, {r('avg(e)')} AS mean_e FROM en GROUP BY ts")
def _(spark, sf):
    return ST.fleet_mean(err(spark, sf))


@query("fleet_median", EN + f"SELECT ts, {r('median(e)')} AS median_e FROM en GROUP BY ts")
def _(spark, sf):
    return ST.fleet_median(err(spark, sf))


@query("working_mean", with_("ea") + f"SELECT ts, {r('coalesce(avg(e) FILTER (cpus_alloc > 0), 0)')} AS working_e FROM ea GROUP BY ts")
def _(spark, sf):
    return ST.working_mean(ST.join_alloc(err(spark, sf), faulty(spark, sf)))


@query("node_percentile", EN + "SELECT node, " + ", ".join(f"{r(f'quantile_cont(e, {p / 100})')} AS p{p}" for p in (99, 95, 90, 80)) + " FROM en GROUP BY node")
def _(spark, sf):
    return ST.node_percentile(err(spark, sf), [99, 95, 90, 80])


@query("node_mean_std", EN + f"SELECT node, {r('avg(e)')} AS mean_e, {r('stddev_pop(e)')} AS std_e FROM en GROUP BY node")
def _(spark, sf):
    return ST.node_mean_std(err(spark, sf))


@query("flag_counts", with_("flags5") + "SELECT ts, " + ", ".join(f"CAST(sum({f}) AS BIGINT) AS n_{f}" for f in ST.FLAGS) + " FROM flags5 GROUP BY ts")
def _(spark, sf):
    return ST.flag_counts(err(spark, sf), DIGITS)


@query("aux_stats", with_("w60", "fl") + f"""SELECT node, NULL::VARCHAR AS channel, {r('avg(l1)')} AS mean_e, {r('stddev_pop(l1)')} AS std_e FROM w60 GROUP BY node
    UNION ALL SELECT NULL, NULL, {r('avg(e)')}, {r('stddev_pop(e)')} FROM fl UNION ALL """
    + " UNION ALL ".join(f"SELECT node, '{c}', {r(f'avg(l1_{c})')}, {r(f'stddev_pop(l1_{c})')} FROM w60 GROUP BY node" for c in CH))
def _(spark, sf):
    return ST.aux_stats(errors(spark, sf), CHANNELS)


@query("fleet_band", EN + f"""SELECT ts, {r('median(e)')} AS median_e, {r('median(e) - stddev_samp(e)')} AS lower,
    {r('median(e) + stddev_samp(e)')} AS upper FROM en GROUP BY ts""")
def _(spark, sf):
    return ST.fleet_band(err(spark, sf))


def _entropy_sql(window, name="ent"):
    values = " UNION ALL ".join(f"SELECT node, i, {c} AS x FROM nrm" for c in CH)
    return f"""{name} AS (SELECT node, win, log2({4 * window}) - sum(n * log2(n)) / {4 * window} AS entropy FROM (
      SELECT node, win, x, count(*) AS n FROM (
        SELECT node, CAST(i - o AS INTEGER) AS win, x FROM ({values}), (SELECT unnest(range({window})) AS o))
      WHERE win BETWEEN 0 AND (SELECT max(i) + 1 - {window} FROM nrm) GROUP BY node, win, x) GROUP BY node, win)"""


@query("window_entropy", with_("nrm") + ", " + _entropy_sql(60) + f" SELECT node, win, {r('entropy')} AS entropy FROM ent")
def _(spark, sf):
    return ST.window_entropy(scaled(spark, sf), CHANNELS)


@query("join_entropy", with_("en") + ", " + _entropy_sql(60) + f""" SELECT e.node, e.win, ts, {r('e')} AS e, {r('entropy')} AS entropy
    FROM en e JOIN ent n ON e.node = n.node AND e.win = n.win""")
def _(spark, sf):
    return ST.join_entropy(err(spark, sf), ST.window_entropy(scaled(spark, sf), CHANNELS))


@query("entropy_weighted_error", with_("en") + ", " + _entropy_sql(60) + f""" SELECT ts, {r('avg(e * entropy)')} AS weighted_e
    FROM en e JOIN ent n ON e.node = n.node AND e.win = n.win GROUP BY ts""")
def _(spark, sf):
    return ST.entropy_weighted_error(err(spark, sf), ST.window_entropy(scaled(spark, sf), CHANNELS))


@query("zscore_time", EN + f"""SELECT node, win, ts, {r('e')} AS e,
    {r('abs(e - avg(e) OVER w) / nullif(stddev_pop(e) OVER w, 0)', 5)} AS z FROM en WINDOW w AS (PARTITION BY node)""".replace(r('e'), r('e', 5)), digits=5)
def _(spark, sf):
    return ST.zscore_time(err(spark, sf))


@query("zscore_nodes", with_("zn") + f"SELECT node, win, ts, {r('e', 5)} AS e, {r('z', 5)} AS z FROM zn", digits=5)
def _(spark, sf):
    return ST.zscore_nodes(err(spark, sf))


@query("fleet_flag_sum", with_("zn") + "SELECT ts, " + ", ".join(
    f"CAST(sum(coalesce(CAST(round(z, 9) >= {k} AS INTEGER), 0)) AS BIGINT) AS n_sigma{k}" for k in (1, 2, 3)) + " FROM zn GROUP BY ts")
def _(spark, sf):
    return ST.fleet_flag_sum(err(spark, sf), digits=DIGITS)


# --- moving averages ---------------------------------------------------------------------------

@query("rolling_mean_fleet", FL + f"SELECT win, ts, {r('e')} AS e, {r(padded('e', 180))} AS m FROM fl")
def _(spark, sf):
    return RO.rolling_mean(E.err_fleet(errors(spark, sf)), [], "win", "e", 180)


@query("rolling_mean_node", EN + f"SELECT node, win, ts, {r('e')} AS e, {r(padded('e', 30, 'node'))} AS m FROM en")
def _(spark, sf):
    return RO.rolling_mean(err(spark, sf), ["node"], "win", "e", 30)


def _diffs(keep):
    return f"""SELECT node, win, ts, {r('e')} AS e, {r('ml')} AS m_long, {r('ms')} AS m_short, {r('ms - ml')} AS diff FROM (
      SELECT *, {padded('e', 180, 'node')} AS ml, {padded('e', 60, 'node')} AS ms,
        row_number() OVER (PARTITION BY node ORDER BY win) AS rn, count(*) OVER (PARTITION BY node) AS n FROM en) WHERE {keep}"""


@query("long_short_diff", EN + _diffs("rn <= n - 180"))
def _(spark, sf):
    return RO.long_short_diff(err(spark, sf), ["node"], "win", "e", 180, 60)


@query("long_short_diff_warmup", EN + _diffs("rn > 180"))
def _(spark, sf):
    return RO.long_short_diff(err(spark, sf), ["node"], "win", "e", 180, 60, trim="warmup")


# --- is it abnormal now? -----------------------------------------------------------------------

_VERDICT = f"{r('last_diff')} AS last_diff, {r('avg_diff')} AS avg_diff, {r('std_diff')} AS std_diff, as_of, is_anomaly"


def _verdict(source, keys, trim):
    return f"SELECT {keys} {_VERDICT} FROM ({judged(source, keys, trim)})"


@query("detect_fleet_last", FL + _verdict("fl", "", "tail"))
def _(spark, sf):
    return RT.detect_fleet_last(errors(spark, sf), digits=DIGITS)


@query("detect_fleet_last_warmup", FL + _verdict("fl", "", "warmup"))
def _(spark, sf):
    return RT.detect_fleet_last(errors(spark, sf), trim="warmup", digits=DIGITS)


@query("detect_node_last", EN + _verdict("en", "node,", "tail"))
def _(spark, sf):
    return RT.detect_node_last(errors(spark, sf), digits=DIGITS)


@query("detect_node_last_warmup", EN + _verdict("en", "node,", "warmup"))
def _(spark, sf):
    return RT.detect_node_last(errors(spark, sf), trim="warmup", digits=DIGITS)


@query("contribution", EN + f"""SELECT node, {r('last_diff')} AS last_diff, {r('last_diff / nullif(sum(last_diff) OVER (), 0)', 4)} AS share
    FROM ({judged('en', 'node,', 'warmup')})""".replace(r('last_diff'), r('last_diff', 4)), digits=4)
def _(spark, sf):
    return RT.node_contribution(RT.detect_node_last(errors(spark, sf), trim="warmup"))


@query("top_contributors", EN + f"""SELECT node, {r('last_diff')} AS last_diff FROM ({judged('en', 'node,', 'warmup')})
    ORDER BY round(last_diff, 9) DESC, node LIMIT 10""")
def _(spark, sf):
    shares = RT.node_contribution(RT.detect_node_last(errors(spark, sf), trim="warmup"))
    shares = shares.withColumn("last_diff", F.round("last_diff", DIGITS))
    return RT.top_contributors(shares, 10).select("node", "last_diff")


@query("last_window_metrics", with_("w60") + f"SELECT node, {r('l1')} AS r_err, " + ", ".join(f"{r('l1_' + c)} AS channel_{k}_r_err" for k, c in enumerate(CH))
       + f", {r('avg(l1) OVER ()')} AS total_r_err FROM w60 WHERE win = (SELECT max(win) FROM w60)")
def _(spark, sf):
    return RT.last_window_metrics(errors(spark, sf), CHANNELS)


def _status(trim):
    return with_("en") + f"""SELECT e.node, {r('e.e')} AS r_err, j.is_anomaly FROM en e JOIN ({judged('en', 'node,', trim)}) j
        ON e.node = j.node WHERE e.win = (SELECT max(win) FROM en)"""


@query("node_status", _status("tail"))
def _(spark, sf):
    return RT.node_status(faulty(spark, sf), CHANNELS, digits=DIGITS)


@query("node_status_warmup", _status("warmup"))
def _(spark, sf):
    return RT.node_status(faulty(spark, sf), CHANNELS, trim="warmup", digits=DIGITS)


# --- looking back ------------------------------------------------------------------------------

@query("metrics_panel", with_("flags5") + f"""SELECT ts, {r('median(e)')} AS median_e, {r('avg(e)')} AS mean_e,
    {r('coalesce(avg(e) FILTER (cpus_alloc > 0), 0)')} AS working_e, """ + ", ".join(f"CAST(sum({f}) AS BIGINT) AS n_{f}" for f in ST.FLAGS) + " FROM flags5 GROUP BY ts")
def _(spark, sf):
    return EV.metrics_panel(ST.join_alloc(err(spark, sf), faulty(spark, sf)), DIGITS)


@query("smoothed", with_("sm12") + f"SELECT win, ts, {r('median_e')} AS median_e, {r('m_long')} AS m_long, {r('m_short')} AS m_short, {r('diff')} AS diff FROM sm12")
def _(spark, sf):
    return EV.smoothed(err(spark, sf, 12))


def _sens(spark, sf):
    return EV.threshold_sensitivity(EV.smoothed(err(spark, sf, 12)), digits=DIGITS)


@query("threshold_sensitivity", with_("sens") + f"SELECT win, ts, {r('diff')} AS diff, k, flag FROM sens")
def _(spark, sf):
    return _sens(spark, sf)


@query("regions", EN + """SELECT node, min(win) AS first_step, max(win) AS last_step, min(ts) AS start_ts, max(ts) AS end_ts FROM (
    SELECT *, win - row_number() OVER (PARTITION BY node ORDER BY win) AS isle FROM en WHERE e > 0.03) GROUP BY node, isle""")
def _(spark, sf):
    flags = err(spark, sf).withColumn("flag", (F.col("e") > 0.03).cast("int"))
    return R.regions(flags, ["node"])


@query("detected_regions", with_("reg") + "SELECT k, first_step, last_step, start_ts, end_ts FROM reg")
def _(spark, sf):
    return EV.detected_regions(_sens(spark, sf))


_MATCH = with_("reg", "truth") + """, hits AS (SELECT first_step, last_step, start_ts, end_ts, id, date_start, date_end
    FROM reg JOIN truth ON start_ts <= date_end AND date_start <= end_ts WHERE k = 2)"""


@query("match_regions", _MATCH + " SELECT * FROM hits")
def _(spark, sf):
    found = EV.detected_regions(_sens(spark, sf), 2)
    pairs = R.match_regions(found, incidents(spark))
    return pairs.select("first_step", "last_step", "start_ts", "end_ts", "id", "date_start", "date_end")


@query("regions_vs_truth", _MATCH + """, known AS (SELECT * FROM truth
      WHERE date_start >= (SELECT min(ts) FROM sm12) AND date_end <= (SELECT max(ts) FROM sm12))
    SELECT 'detected' AS outcome, h.* FROM hits h WHERE id IN (SELECT id FROM known)
    UNION ALL SELECT 'missed', NULL, NULL, NULL, NULL, id, date_start, date_end FROM known WHERE id NOT IN (SELECT id FROM hits)
    UNION ALL SELECT 'false_alarm', first_step, last_step, start_ts, end_ts, NULL, NULL, NULL FROM reg
      WHERE k = 2 AND first_step NOT IN (SELECT first_step FROM hits WHERE id IN (SELECT id FROM known))""")
def _(spark, sf):
    flags = _sens(spark, sf)
    known = R.truth_in_range(incidents(spark), G.dates_range(flags))
    return R.regions_vs_truth(EV.detected_regions(flags, 2), known)


@query("zscore_panel", with_("zn") + f"SELECT ts, {r('avg(z)')} AS mean_z, " + ", ".join(
    f"CAST(sum(coalesce(CAST(round(z, 9) >= {k} AS INTEGER), 0)) AS BIGINT) AS n_sigma{k}" for k in (1, 2, 3)) + " FROM zn GROUP BY ts")
def _(spark, sf):
    return EV.zscore_panel(err(spark, sf), digits=DIGITS)


# --- training period, test period --------------------------------------------------------------

# The settings of the preparation queries.
SETTINGS = Settings(
    train=("2024-01-02", "2024-01-20"), test=("2024-01-21", "2024-01-29"),
    train_remove=Settings.periods("2024-01-05,2024-01-07&2024-01-12,2024-01-13"),
    blacklist=Settings.hosts("u000003, u000008,"), nodes=100, seconds=HOUR,
)
_PREP = with_("cells") + """, keep AS (SELECT node FROM cells WHERE node NOT IN ('u000003', 'u000008') GROUP BY node
      ORDER BY round(sum(power), 6) DESC, node LIMIT 100),
    grid AS (SELECT period, n.node, ts, CAST(date_diff('hour', min(ts) OVER (PARTITION BY period), ts) AS INTEGER) AS i FROM
      (SELECT 'train' AS period, min(ts) AS lo, max(ts) AS hi FROM cells JOIN keep USING (node) WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-21'
       UNION ALL SELECT 'test', min(ts), max(ts) FROM cells JOIN keep USING (node) WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-30') p
      CROSS JOIN LATERAL (SELECT unnest(generate_series(p.lo, p.hi, INTERVAL 1 HOUR)) AS ts)
      JOIN (SELECT DISTINCT 'train' AS period, node FROM cells JOIN keep USING (node) WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-21'
            UNION ALL SELECT DISTINCT 'test', node FROM cells JOIN keep USING (node) WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-30') n USING (period)),
    full_ AS (SELECT g.period, g.node, g.ts, g.i, """ + each("CAST(coalesce(@, 0) AS DOUBLE) AS @") + """ FROM grid g LEFT JOIN cells c ON g.node = c.node AND g.ts = c.ts
      WHERE NOT (g.period = 'train' AND (g.ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07' OR g.ts BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-13'))),
    sc AS (SELECT """ + each("min(@) AS @_mn, max(@) AS @_mx") + """ FROM full_ WHERE period = 'train'),
    prep AS (SELECT period, node, ts, i, """ + each("(@ - @_mn) / nullif(@_mx - @_mn, 0) AS @") + """ FROM full_, sc)
"""


def _prepared(spark, sf):
    raw = readings(spark, sf)
    raw = raw.withColumn("power", F.col("power"))
    return prepare_dataset(raw, SETTINGS)


@query("prepare_dataset", _PREP + f"SELECT period, node, ts, i, {each(r('@') + ' AS @')} FROM prep")
def _(spark, sf):
    train, test, _scale = _prepared(spark, sf)
    return train.withColumn("period", F.lit("train")).unionByName(test.withColumn("period", F.lit("test")))


_EVAL = _PREP + """, profile AS (SELECT node, hour(ts) AS h, """ + each("avg(@) AS p_@") + """ FROM prep WHERE period = 'train' GROUP BY 1, 2),
    nrm AS (SELECT node, ts, i, """ + each("@") + """ FROM prep WHERE period = 'test'),
    pts AS (SELECT n.node, n.ts, n.i, (""" + each("abs(@ - p_@)", " + ") + """) / 4 AS e FROM nrm n JOIN profile p ON n.node = p.node AND hour(n.ts) = p.h),
    we AS (SELECT node, i - 59 AS win, ts - INTERVAL 59 HOUR AS ts, e FROM (
      SELECT node, i, ts, avg(e) OVER (PARTITION BY node ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS e FROM pts) WHERE i >= 59),
    """ + _entropy_sql(60)


@query("evaluate", _EVAL + f"""SELECT w.node, w.win, w.ts, {r('e')} AS e, {r('entropy')} AS entropy, {r('e * entropy')} AS weighted
    FROM we w JOIN ent n ON w.node = n.node AND w.win = n.win""")
def _(spark, sf):
    train, test, _scale = _prepared(spark, sf)
    profile = RC.fit_profile(train, CHANNELS)
    return EV.evaluate(test, CHANNELS, profile)


@query("evaluate_fleet", _EVAL + f"""SELECT w.ts, {r('avg(e)')} AS mean_e, {r('avg(e * entropy)')} AS mean_weighted
    FROM we w JOIN ent n ON w.node = n.node AND w.win = n.win GROUP BY w.ts""")
def _(spark, sf):
    train, test, _scale = _prepared(spark, sf)
    return EV.evaluate_fleet(EV.evaluate(test, CHANNELS, RC.fit_profile(train, CHANNELS)))


# --- models on windows -------------------------------------------------------------------------

def _halves(block: np.ndarray) -> np.ndarray:
    """Stand-in model with a closed form: the mean of the window and its first value."""
    return (block.mean(axis=2, keepdims=True) + block[:, :, :1]) / 2 + np.zeros_like(block)


_HALF = with_("nrm") + """, wn AS (SELECT node, i - 23 AS w0, ts - INTERVAL 23 HOUR AS ts, """ + each("list(@) OVER w AS @") + """ FROM nrm
      WINDOW w AS (PARTITION BY node ORDER BY i ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
    hv AS (SELECT node, CAST(w0 // 6 AS INTEGER) AS win, ts, """ + ", ".join(
    f"""list_avg(list_transform({c}, lambda x: abs(x - (list_avg({c}) + {c}[1]) / 2))) AS l1_{c},
        list_avg(list_transform({c}, lambda x: (x - (list_avg({c}) + {c}[1]) / 2) ^ 2)) AS l2_{c}""" for c in CHANNELS) + """
      FROM wn WHERE w0 >= 0 AND w0 % 6 = 0)
"""


@query("score_series", _HALF + "SELECT node, win, ts, " + ", ".join(each(r(m + "_@", 8) + f" AS {m}_@") for m in ("l1", "l2"))
       + ", " + ", ".join(f"{r('(' + each(m + '_@', ' + ') + ') / 4', 8)} AS {m}" for m in ("l1", "l2")) + " FROM hv", digits=8)
def _(spark, sf):
    return RC.score_series(scaled(spark, sf), _halves, CHANNELS, 24, 6)


@query("score_windows", _HALF + f"SELECT node, win, ts, {each(r('l1_@', 8) + ' AS l1_@')}, {r('(' + each('l1_@', ' + ') + ') / 4', 8)} AS l1 FROM hv", digits=8)
def _(spark, sf):
    wins = WN.sliding_windows(scaled(spark, sf), CHANNELS, 24, 6)
    return E.array_errors(RC.score_windows(wins, _halves, CHANNELS), CHANNELS)


@query("recon_linear")
def _(spark, sf):
    s = scaled(spark, sf)
    model = RC.fit_linear_series(s, CHANNELS, 24, 12, 8)
    return RC.score_series(s, RC.linear_reconstructor(model), CHANNELS, 24, 1)
