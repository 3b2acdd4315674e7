"""Spell feature specs as plain SQL sliding windows (for the DuckDB oracles).

The Spark plans compute windows with prefix sums, doubling tables and halo buckets;
the oracle states the same semantics with ordinary ``ROWS BETWEEN`` frames, so the two
formulations are independent.
"""

from __future__ import annotations

from flowrisk.operators.windows import Feat


def _w(part: str, order: str, frame: str) -> str:
    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {frame})"


def feature_sql(f: Feat, part: str, order: str, step_hours: float,
                calendar_sql: dict[str, str] | None = None) -> str:
    c = f.col
    n = f.n
    trail = _w(part, order, f"{n - 1} PRECEDING AND CURRENT ROW")
    run = _w(part, order, "UNBOUNDED PRECEDING AND CURRENT ROW")
    lagw = f"(PARTITION BY {part} ORDER BY {order})"
    aggs = {"max": "max", "min": "min", "sum": "sum", "mean": "avg", "std": "stddev_samp",
            "var": "var_samp"}

    def guarded(frame, agg_expr):
        return f"CASE WHEN count({c}) OVER {frame} = {n} THEN {agg_expr} END"

    op = f.op
    if op.startswith("trail_"):
        a = aggs[op[6:]]
        return guarded(trail, f"{a}({c}) OVER {trail}")
    if op == "range":
        return guarded(trail, f"max({c}) OVER {trail} - min({c}) OVER {trail}")
    if op.startswith("fwd_"):
        fw = _w(part, order, f"CURRENT ROW AND {n - 1} FOLLOWING")
        return guarded(fw, f"{aggs[op[4:]]}({c}) OVER {fw}")
    if op == "next_max":
        fw = _w(part, order, f"1 FOLLOWING AND {n} FOLLOWING")
        return guarded(fw, f"max({c}) OVER {fw}")
    if op == "lag":
        return f"lag({c}, {n}) OVER {lagw}"
    if op == "diff_rate":
        return f"({c} - lag({c}, 1) OVER {lagw}) / {step_hours!r}"
    if op == "slope":
        return f"({c} - lag({c}, {n}) OVER {lagw}) / {f.hours!r}"
    if op == "cum_diff":
        return f"{c} - lag({c}, {n}) OVER {lagw}"
    if op == "accel":
        return (f"((({c} - lag({c}, 1) OVER {lagw}) / {step_hours!r}) - "
                f"((lag({c}, {n}) OVER {lagw} - lag({c}, {n + 1}) OVER {lagw}) / {step_hours!r}))"
                f" / {f.hours!r}")
    if op in ("hours_above", "count_above"):
        s = f"sum(CASE WHEN {c} > {f.thr!r} THEN 1 ELSE 0 END) OVER {trail}"
        v = f"{s} * {step_hours!r}" if op == "hours_above" else f"CAST({s} AS DOUBLE)"
        return f"CASE WHEN count(*) OVER {trail} = {n} THEN {v} END"
    if op in ("hours_since", "hours_since_nonzero"):
        m = (f"coalesce({c}, 0) <> 0" if op == "hours_since_nonzero" else f"{c} > {f.thr!r}")
        return f"({order} - max(CASE WHEN {m} THEN {order} END) OVER {run}) * {step_hours!r}"
    if op == "cumsum":
        return f"CASE WHEN {c} IS NOT NULL THEN sum({c}) OVER {run} END"
    if op == "median_ratio":
        return f"{c} / NULLIF({guarded(trail, f'median({c}) OVER {trail}')}, 0)"
    if op == "median":
        return guarded(trail, f"median({c}) OVER {trail}")
    if op == "quantile":
        return guarded(trail, f"quantile_cont({c}, {f.q!r}) OVER {trail}")
    if op == "gt_quantile":
        q = guarded(trail, f"quantile_cont({c}, {f.q!r}) OVER {trail}")
        return f"CASE WHEN {c} > {q} THEN 1 ELSE 0 END"
    if op == "pct_current":
        lst = f"list({c}) OVER {trail}"
        return guarded(trail, f"len(list_filter({lst}, lambda x: x <= {c})) / {n}")
    if op == "product":
        return f"{c} * {f.col2}"
    if op == "flag_gt":
        return f"CASE WHEN {c} > {f.thr!r} THEN 1 ELSE 0 END"
    if op == "expr":
        return (calendar_sql or {})[f.name]
    raise ValueError(op)


def calendar_sql(time_col: str, horizon_hours: float) -> dict[str, str]:
    ht = f"({time_col} + to_seconds({horizon_hours * 3600.0!r}))"
    hour = f"(hour({ht}) + minute({ht}) / 60.0)"
    doy = f"dayofyear({ht})"
    return {
        "hour_of_day_sin": f"sin(2 * pi() * {hour} / 24.0)",
        "hour_of_day_cos": f"cos(2 * pi() * {hour} / 24.0)",
        "day_of_week": f"CAST(isodow({ht}) - 1 AS INTEGER)",
        "day_of_year_sin": f"sin(2 * pi() * {doy} / 365.25)",
        "day_of_year_cos": f"cos(2 * pi() * {doy} / 365.25)",
    }
