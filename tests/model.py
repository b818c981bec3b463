"""Brute-force model of the rules: one buffer per series, rescanned at every row.

Times are epoch ms, rows are dicts. It is the yardstick of the window formulas, not a copy of
their method.
"""

import math


def buffer_at(rows, i, window_ms):
    """Rows that arrived up to row i and are younger than the window."""
    now = rows[i]["ts"]
    return [r for r in rows[: i + 1] if r["ts"] > now - window_ms]


def band_severity(history, levels, recurrence):
    level = -1
    for lo, hi in levels:
        run = 0
        for k in range(len(history) - 1, -1, -1):
            if not (history[k] < lo or history[k] > hi):
                break
            run += 1
            if run >= recurrence or k == 0:
                level += 1
                break
    return level


def simple(rows, rule, window_ms):
    bands = [(rule["setpoint"] + lo, rule["setpoint"] + hi) for lo, hi in rule["levels"]]
    return [
        band_severity([r["value"] for r in buffer_at(rows, i, window_ms)], bands,
                      rule["recurrence"])
        for i in range(len(rows))
    ]


def integral(buffer, setpoint, dt_s):
    t0 = buffer[-1]["ts"] - dt_s * 1000
    # Times relative to now: seconds since 1970 are too coarse for a double's microseconds.
    now = buffer[-1]["ts"]
    points = [((r["ts"] - now) / 1000, r["value"] - setpoint) for r in buffer if r["ts"] >= t0]
    area = (points[0][0] + dt_s) * points[0][1]
    for (t1, v1), (t2, v2) in zip(points, points[1:]):
        area += 0.5 * (t2 - t1) * (v1 + v2)
    return area


def slope(buffer, dt_s, include_latest=False):
    t0 = buffer[-1]["ts"] - dt_s * 1000
    now = buffer[-1]["ts"]
    points = [(r["ts"] - now, r["value"]) for r in buffer if r["ts"] >= t0]
    if not include_latest:
        points = points[:-1]
    if len({t for t, _ in points}) < 2:
        return 0.0
    mean_t = sum(t for t, _ in points) / len(points)
    mean_v = sum(v for _, v in points) / len(points)
    over = sum((t - mean_t) * (v - mean_v) for t, v in points)
    under = sum((t - mean_t) ** 2 for t, v in points)
    return 1000 * over / under


def pid_terms(rows, rule, window_ms):
    out = []
    for i, row in enumerate(rows):
        buffer = buffer_at(rows, i, window_ms)
        p = rule["a"] * (row["value"] - rule["setpoint"])
        area = integral(buffer, rule["setpoint"], rule["dt_int"])
        rate = slope(buffer, rule["dt_diff"])
        out.append((area, rate, p + rule["b"] * area + rule["c"] * rate))
    return out


def pid(rows, rule, window_ms):
    pids = [t[2] for t in pid_terms(rows, rule, window_ms)]
    out = []
    for i, row in enumerate(rows):
        history = [p for p, r in zip(pids[: i + 1], rows) if r["ts"] > row["ts"] - window_ms]
        out.append((pids[i], band_severity(history, rule["levels"], rule["recurrence"])))
    return out


def time_since(rows, rule, window_ms):
    out = []
    for i, row in enumerate(rows):
        buffer = buffer_at(rows, i, window_ms)
        since = buffer[0]["ts"]
        for r in buffer:
            if rule["lower"] <= r["value"] <= rule["upper"]:
                since = r["ts"]
        seconds = (row["ts"] - since) / 1000
        out.append((seconds, sum(seconds > d for d in rule["max_duration"]) - 1))
    return out


def same(a, b, tolerance=1e-6):
    if a is None or b is None:
        return a is None and b is None
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    if math.isinf(a) or math.isinf(b):
        return a == b
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
