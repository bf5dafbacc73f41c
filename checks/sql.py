"""Shared parts of the comparison SQL, put together on demand as WITH clauses."""

from __future__ import annotations

CH = ["power", "cpu1", "cpu2", "cpus_alloc"]


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def each(template: str, sep: str = ", ") -> str:
    return sep.join(template.replace("@", c) for c in CH)


def _windows(name: str, window: int, metrics: tuple[str, ...] = ("l1",)) -> str:
    frame = f"OVER (PARTITION BY node ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    means = ", ".join(each(f"avg({m}_@) {frame} AS {m}_@") for m in metrics)
    total = ", ".join(f"({each(f'{m}_@', ' + ')}) / 4 AS {m}" for m in metrics)
    return f"""{name} AS (
      SELECT node, i - {window - 1} AS win, ts - INTERVAL '{window - 1} hours' AS ts,
             {", ".join([each(f"{m}_@") + f", {m}" for m in metrics])}
      FROM (SELECT *, {total} FROM (SELECT node, i, ts, {means} FROM points)) WHERE i >= {window - 1})"""


_PARTS: dict[str, tuple[list[str], str]] = {
    "cells": ([], """cells AS (
      SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS node, date_trunc('hour', ts) AS ts,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)) AS power,
             CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS DOUBLE) / count(*) AS cpu1,
             max(value) AS cpu2, count(*) AS cpus_alloc
      FROM events GROUP BY 1, 2)"""),
    "bounds": (["cells"], "bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM cells)"),
    "axis": (["bounds"], """axis AS (
      SELECT n.node, s.ts, CAST(date_diff('hour', (SELECT lo FROM bounds), s.ts) AS INTEGER) AS i
      FROM (SELECT DISTINCT node FROM cells) n
      CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM bounds) s)"""),
    "tel": (["axis"], """tel AS (
      SELECT a.node, a.ts, a.i, coalesce(power, 0.0) AS power, coalesce(cpu1, 0.0) AS cpu1,
             coalesce(cpu2, 0.0) AS cpu2, CAST(coalesce(cpus_alloc, 0) AS INTEGER) AS cpus_alloc
      FROM axis a LEFT JOIN cells c ON a.node = c.node AND a.ts = c.ts)"""),
    "telf": (["tel"], """telf AS (
      SELECT node, ts, i, power + x AS power, cpu1 + x AS cpu1, cpu2 + x AS cpu2, cpus_alloc FROM (
        SELECT *, CASE WHEN i BETWEEN 150 AND 155 OR i BETWEEN 360 AND 369 OR
          (CAST(substr(node, 2, 6) AS INTEGER) % 16 = 3 AND i BETWEEN 700 AND 719)
          THEN 400.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM tel))"""),
    "scale": (["telf"], "scale AS (SELECT " + each("CAST(min(@) AS DOUBLE) AS @_mn, CAST(max(@) AS DOUBLE) AS @_mx") + " FROM telf)"),
    "nrm": (["scale"], "nrm AS (SELECT node, ts, i, " + each("(@ - @_mn) / nullif(@_mx - @_mn, 0) AS @") + " FROM telf, scale)"),
    "prof": (["nrm"], "prof AS (SELECT node, hour(ts) AS h, " + each("avg(@) AS p_@") + " FROM nrm GROUP BY 1, 2)"),
    "points": (["prof"], "points AS (SELECT n.node, n.ts, n.i, " + each("abs(@ - p_@) AS l1_@, (@ - p_@) * (@ - p_@) AS l2_@, @, p_@")
               + " FROM nrm n JOIN prof p ON n.node = p.node AND hour(n.ts) = p.h)"),
    "w60": (["points"], _windows("w60", 60)),
    "w12": (["points"], _windows("w12", 12)),
    "w60b": (["points"], _windows("w60b", 60, ("l1", "l2"))),
    "en": (["w60"], "en AS (SELECT node, win, ts, l1 AS e FROM w60)"),
    "en12": (["w12"], "en12 AS (SELECT node, win, ts, l1 AS e FROM w12)"),
    "fl": (["w60"], "fl AS (SELECT win, min(ts) AS ts, avg(l1) AS e FROM w60 GROUP BY win)"),
    "ea": (["en"], "ea AS (SELECT e.*, t.cpus_alloc FROM en e JOIN telf t ON e.node = t.node AND e.ts = t.ts)"),
    "lim": (["en"], """lim AS (
      SELECT node, avg(e) AS m, stddev_pop(e) AS s, quantile_cont(e, 0.95) AS p95,
             quantile_cont(e, 0.9) AS p90, quantile_cont(e, 0.8) AS p80 FROM en GROUP BY node)"""),
    "flags5": (["lim", "ea"], """flags5 AS (
      SELECT e.*, coalesce(CAST(round(abs(e - m) / nullif(s, 0), 9) > 2 AS INTEGER), 0) AS z2,
             coalesce(CAST(round(abs(e - m) / nullif(s, 0), 9) > 3 AS INTEGER), 0) AS z3,
             CAST(round(e, 9) > round(p95, 9) AS INTEGER) AS over95,
             CAST(round(e, 9) > round(p90, 9) AS INTEGER) AS over90,
             CAST(round(e, 9) > round(p80, 9) AS INTEGER) AS over80
      FROM ea e JOIN lim l ON e.node = l.node)"""),
    "zn": (["en"], """zn AS (
      SELECT node, win, ts, e, (e - avg(e) OVER w) / nullif(stddev_pop(e) OVER w, 0) AS z
      FROM en WINDOW w AS (PARTITION BY ts))"""),
    "med12": (["en12"], "med12 AS (SELECT ts, min(win) AS win, median(e) AS median_e FROM en12 GROUP BY ts)"),
    "sm12": (["med12"], """sm12 AS (SELECT * FROM (
      SELECT win, ts, median_e, m_long, m_short, m_short - m_long AS diff, row_number() OVER (ORDER BY win) AS rn,
             count(*) OVER () AS n FROM (
        SELECT *, """ + "{m180} AS m_long, {m30} AS m_short" + """ FROM med12)) WHERE rn <= n - 180)"""),
    "sens": (["sm12"], """sens AS (
      SELECT win, ts, diff, k, CAST(round(diff, 9) >= round(m + k * s, 9) AS INTEGER) AS flag
      FROM sm12, (SELECT avg(diff) AS m, stddev_pop(diff) AS s FROM sm12),
           (SELECT unnest([1.0, 2.0, 2.5, 3.0, 4.0]::DOUBLE[]) AS k))"""),
    "reg": (["sens"], """reg AS (
      SELECT k, min(win) AS first_step, max(win) AS last_step, min(ts) AS start_ts, max(ts) AS end_ts FROM (
        SELECT *, win - row_number() OVER (PARTITION BY k ORDER BY win) AS isle FROM sens WHERE flag = 1)
      GROUP BY k, isle)"""),
    "truth": ([], """truth(id, description, severity, date_start, date_end) AS (VALUES
      (1, 'fleet burst', 3, TIMESTAMP '2024-01-07 06:00:00', TIMESTAMP '2024-01-07 11:00:00'),
      (2, 'fleet heat', 4, TIMESTAMP '2024-01-16 00:00:00', TIMESTAMP '2024-01-16 09:00:00'),
      (3, 'late fault', 2, TIMESTAMP '2024-01-20 04:00:00', TIMESTAMP '2024-01-20 23:00:00'),
      (4, 'quiet', 1, TIMESTAMP '2024-01-11 02:00:00', TIMESTAMP '2024-01-11 05:00:00'),
      (5, 'outside', 1, TIMESTAMP '2024-01-30 20:00:00', TIMESTAMP '2024-02-02 00:00:00'))"""),
    "inc": ([], """inc AS (
      SELECT CAST(event_id AS INTEGER) AS id, 'error of user ' || user_id AS description,
             CAST(props->>'$.k' AS INTEGER) % 5 AS severity, date_trunc('second', ts) AS date_start,
             date_trunc('second', ts) + to_minutes(CAST(props->>'$.k' AS INTEGER)) AS date_end,
             event_type, user_id FROM events WHERE event_type = 'error')"""),
}


def padded(x: str, width: int, part: str = "") -> str:
    """Trailing mean over `width` rows, missing leading rows counted as the overall mean."""
    by = f"PARTITION BY {part} " if part else ""
    frame = f"OVER ({by}ORDER BY win ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    whole = f"OVER ({by.strip()})"
    return f"(sum({x}) {frame} + ({width} - count({x}) {frame}) * avg({x}) {whole}) / {width}"


def with_(*names: str) -> str:
    """WITH clause holding the named parts and all they rest on."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for dep in _PARTS[name][0]:
            add(dep)
        done.append(name)

    for n in names:
        add(n)
    text = ",\n".join(_PARTS[n][1] for n in done)
    return "WITH " + text.replace("{m180}", padded("median_e", 180)).replace("{m30}", padded("median_e", 30)) + "\n"


def judged(source: str, keys: str, trim: str, long: int = 180, short: int = 60, last: int = 360) -> str:
    """Newest difference, its mean and deviation, and the verdict, per key."""
    part = keys.strip(", ")
    by = f"PARTITION BY {part} " if part else ""
    keep = f"rn <= n - {long}" if trim == "tail" else f"rn > {long}"
    group = f"GROUP BY {part}" if part else ""
    return f"""SELECT {keys} last_diff, avg_diff, std_diff, as_of,
        round(abs(last_diff), 9) > round(avg_diff + 2 * std_diff, 9) AS is_anomaly FROM (
      SELECT {keys} max_by(d, win) AS last_diff, avg(d) AS avg_diff, stddev_pop(d) AS std_diff, max_by(ts, win) AS as_of
      FROM (SELECT *, ms - ml AS d, row_number() OVER ({by}ORDER BY win) AS rn, count(*) OVER ({by.strip()}) AS n
            FROM (SELECT *, {padded("e", long, part)} AS ml, {padded("e", short, part)} AS ms
                  FROM {source} WHERE win > (SELECT max(win) FROM {source}) - {last}))
      WHERE {keep} {group})"""
