"""The forecast-time feature catalogue (target + 78 features) as data.

Each entry is a ``Feat`` (name, operator, column, rows, ...) so one plan computes all
of them with shared window helpers, and the SQL oracle is spelled from the same list.
Window lengths are given in hours and converted with ``rows(hours, freq_minutes)``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import functions as F

from flowrisk.operators.windows import Feat, rows


@dataclass(frozen=True)
class Cols:
    """Column names of a prepared panel."""
    time: str = "time"
    fill: str = "fill_ratio"
    depth: str = "depth_mm"
    flow: str = "flow_l_s"
    velocity: str = "velocity_m_s"
    precip: str = "precipitation_surface"
    precip_cum: str = "precipitation_surface_cum"
    rain: str = "rain_hde"
    grnd: str = "grnd_hde"


def catalogue(horizon_hours: float, freq_minutes: float = 2, baseline_hours: float = 24,
              percentile_window_hours: float = 24, surcharge_threshold: float = 0.9,
              high_flow_quantile: float = 0.9, c: Cols = Cols()) -> list[Feat]:
    r = lambda h: rows(h, freq_minutes)
    step = freq_minutes / 60.0
    n_h = r(horizon_hours)
    n10, n30, n1, n3, n6 = r(10 / 60), r(30 / 60), r(1), r(3), r(6)
    n24, n72, n7d, n30d = r(24), r(72), r(24 * 7), r(24 * 30)
    fr, dp, fl, ve, pr, pc, rh, gh = (c.fill, c.depth, c.flow, c.velocity, c.precip,
                                      c.precip_cum, c.rain, c.grnd)
    feats = [
        Feat("fill_ratio_target", "next_max", fr, n_h),
        Feat("normalized_flow", "median_ratio", fl, r(baseline_hours)),
        Feat("depth_percentile", "pct_current", dp, r(percentile_window_hours)),
        Feat("d_depth_dt", "diff_rate", dp),
        Feat("d_flow_dt", "diff_rate", fl),
        Feat("d_velocity_dt", "diff_rate", ve),
        Feat("depth_slope_10min", "slope", dp, n10, hours=10 / 60),
        Feat("depth_slope_30min", "slope", dp, n30, hours=30 / 60),
        Feat("depth_slope_1h", "slope", dp, n1, hours=1),
        Feat("flow_slope_10min", "slope", fl, n10, hours=10 / 60),
        Feat("depth_acceleration", "accel", dp, n10, hours=10 / 60),
        Feat("fill_ratio_lag_2min", "lag", fr, 1),
        Feat("fill_ratio_lag_10min", "lag", fr, n10),
        Feat("fill_ratio_lag_30min", "lag", fr, n30),
        Feat("fill_ratio_lag_1h", "lag", fr, n1),
        Feat("fill_ratio_lag_3h", "lag", fr, n3),
        Feat("depth_lag_10min", "lag", dp, n10),
        Feat("flow_lag_10min", "lag", fl, n10),
        Feat("velocity_lag_10min", "lag", ve, n10),
        Feat("fill_ratio_max_10min", "trail_max", fr, n10),
        Feat("fill_ratio_max_30min", "trail_max", fr, n30),
        Feat("fill_ratio_max_1h", "trail_max", fr, n1),
        Feat("fill_ratio_mean_1h", "trail_mean", fr, n1),
        Feat("fill_ratio_std_1h", "trail_std", fr, n1),
        Feat("depth_range_1h", "range", dp, n1),
        Feat("flow_mean_1h", "trail_mean", fl, n1),
        Feat("fill_ratio_max_3h", "trail_max", fr, n3),
        Feat("fill_ratio_max_6h", "trail_max", fr, n6),
        Feat("fill_ratio_max_24h", "trail_max", fr, n24),
        Feat("fill_ratio_mean_24h", "trail_mean", fr, n24),
        Feat("fill_ratio_max_72h", "trail_max", fr, n72),
        Feat("fill_ratio_max_7d", "trail_max", fr, n7d),
        Feat("flow_sum_6h", "trail_sum", fl, n6),
        Feat("flow_sum_24h", "trail_sum", fl, n24),
        Feat("time_since_fill_ratio_gt_0.7", "hours_since", fr, thr=0.7),
        Feat("time_since_fill_ratio_gt_0.8", "hours_since", fr, thr=0.8),
        Feat("time_above_0.7_last_1h", "hours_above", fr, n1, thr=0.7),
        Feat("time_above_0.8_last_6h", "hours_above", fr, n6, thr=0.8),
        Feat("count_exceedances_0.8_last_6h", "count_above", fr, n6, thr=0.8),
        Feat("max_fill_ratio_last_1h", "trail_max", fr, n1),
        Feat("rainfall_sum_10min", "fwd_sum", pr, n10),
        Feat("rainfall_sum_30min", "fwd_sum", pr, n30),
        Feat("rainfall_sum_1h", "fwd_sum", pr, n1),
        Feat("rainfall_sum_3h", "fwd_sum", pr, n3),
        Feat("rainfall_sum_6h", "fwd_sum", pr, n6),
        Feat("rainfall_intensity_max_1h", "fwd_max", pr, n1),
        Feat("rainfall_variance_1h", "fwd_var", pr, n1),
        Feat("rainfall_sum_horizon", "fwd_sum", pr, n_h),
        Feat("rainfall_max_horizon", "fwd_max", pr, n_h),
        Feat("rainfall_sum_24h", "cum_diff", pc, n24),
        Feat("rainfall_sum_72h", "cum_diff", pc, n72),
        Feat("rainfall_sum_7d", "cum_diff", pc, n7d),
        Feat("rainfall_sum_30d", "cum_diff", pc, n30d),
        Feat("antecedent_dry_period", "hours_since_nonzero", pr),
        Feat("rain_hde_lag_1h", "lag", rh, n1),
        Feat("rain_hde_smooth", "trail_mean", rh, n1),
        Feat("grnd_hde_lag_6h", "lag", gh, n6),
        Feat("grnd_hde_smooth", "trail_mean", gh, n6),
        Feat("d_grnd_hde_dt", "diff_rate", gh),
        Feat("grnd_hde_slope_1h", "slope", gh, n1, hours=1),
        Feat("grnd_hde_slope_6h", "slope", gh, n6, hours=6),
        Feat("grnd_hde_slope_24h", "slope", gh, n24, hours=24),
        Feat("grnd_hde_slope_7d", "slope", gh, n7d, hours=24 * 7),
        Feat("grnd_hde_slope_30d", "slope", gh, n30d, hours=24 * 30),
        Feat("grnd_hde_acceleration", "accel", gh, n1, hours=1),
        Feat("fill_ratio_x_rainfall_1h", "product", fr, col2="rainfall_sum_1h"),
        Feat("depth_x_rainfall_1h", "product", dp, col2="rainfall_sum_1h"),
        Feat("flow_x_rainfall", "product", fl, col2=pr),
        Feat("grnd_hde_x_rainfall", "product", gh, col2=pr),
        Feat("velocity_x_depth", "product", ve, col2=dp),
    ]
    feats += calendar(c.time, horizon_hours)
    feats += [
        Feat("is_raining", "flag_gt", "rainfall_sum_horizon", thr=0.0),
        Feat("is_high_flow", "gt_quantile", fl, r(24), q=high_flow_quantile),
        Feat("is_rising_depth", "flag_gt", "depth_slope_1h", thr=0.0),
        Feat("is_surcharged", "flag_gt", fr, thr=surcharge_threshold),
    ]
    assert step > 0
    return feats


def calendar(time_col: str, horizon_hours: float) -> list[Feat]:
    """calendar encodings at ``time + horizon`` (Monday = 0, year of 365.25 days).

    Expressions are built lazily (``expr`` is a callable) so the catalogue can be
    listed without an active session.
    """
    two_pi = 2 * math.pi

    def ht():
        return F.col(time_col) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                    F.lit(horizon_hours * 3600.0))

    def hour():
        return F.hour(ht()) + F.minute(ht()) / F.lit(60.0)

    return [
        Feat("hour_of_day_sin", "expr", expr=lambda: F.sin(F.lit(two_pi) * hour() / F.lit(24.0))),
        Feat("hour_of_day_cos", "expr", expr=lambda: F.cos(F.lit(two_pi) * hour() / F.lit(24.0))),
        Feat("day_of_week", "expr", expr=lambda: F.weekday(ht())),
        Feat("day_of_year_sin", "expr",
             expr=lambda: F.sin(F.lit(two_pi) * F.dayofyear(ht()) / F.lit(365.25))),
        Feat("day_of_year_cos", "expr",
             expr=lambda: F.cos(F.lit(two_pi) * F.dayofyear(ht()) / F.lit(365.25))),
    ]


def feature_names(feats: list[Feat]) -> list[str]:
    return list(dict.fromkeys(f.name for f in feats))
