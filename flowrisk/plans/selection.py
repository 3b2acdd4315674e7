"""Splits, conformal calibration and feature selection on driver tables.

* temporal hold-out / forward folds (M1, M2, W18) on the hourly event panel
* conformal threshold (A15, M10, M11) per station and horizon (the evaluation's five) on training rows
* correlation matrix (A14), importance filter (M5), correlation groups (M6) and
  representatives (T3, T4) on ``lineitem`` features, importance = |corr with charge|
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk import session
from flowrisk.functions.columns import rnd
from flowrisk.operators import conformal as cf
from flowrisk.operators import cv
from flowrisk.operators import select as sel
from flowrisk.operators.metrics import exceed, persistence_prob
from flowrisk.operators.windows import Feat
from flowrisk.plans import evaluation as evq
from flowrisk.plans import event_panel as ep
from flowrisk.session import stage, tasks_needed
from flowrisk.sources.tables import table

TEST_FRAC = 0.2
N_SPLITS = 5
ALPHA = 0.10


def _complete_panel(spark, sf_dir):
    feats = [Feat(f"target_{h}", "next_max", "fill_ratio", h) for h in (1, 6, 24)]
    feats.append(Feat("mx24", "trail_max", "fill_ratio", 24))
    p = ep.fill_panel(spark, sf_dir, feats)
    return stage(p.dropna(subset=["fill_ratio", "mx24", "target_6"]), "panel")


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _complete_panel(spark, sf_dir)
    p = cv.ordinal(p, "event_type", "rn", F.floor(F.col("rn") / 4096))
    p = cv.holdout(p, TEST_FRAC)
    return p.groupBy("event_type").agg(
        F.first("n_rows").alias("n_rows"), F.first("n_train").alias("n_train"),
        F.count_if("is_test").alias("n_test"),
        F.min(F.when(F.col("is_test"), F.col("time"))).alias("test_start"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _complete_panel(spark, sf_dir)
    p = cv.holdout(cv.ordinal(p, "event_type", "rn", F.floor(F.col("rn") / 4096)), TEST_FRAC)
    fr = cv.fold_roles(p, N_SPLITS)
    return fr.groupBy("event_type", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_idx"),
        F.max("row_idx").alias("last_idx"))


def conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lg = evq.horizon_rows(spark, sf_dir)
    keys = ["station_id", "horizon_hours"]
    lg = cv.holdout(cv.ordinal(lg, keys, "rn", F.floor(F.col("rn") / 4096)), TEST_FRAC)
    train = lg.where(~F.col("is_test")).select(*keys, exceed("target", 0.5).alias("y"),
                                                persistence_prob("mx24").alias("p"))
    c = cf.conformal_threshold(train, keys, ALPHA)
    return c.select(*keys, "n_scores", rnd("q_level", 9).alias("q_level"),
                    rnd("q_hat", 9).alias("q_hat"), rnd("conf_threshold", 9).alias("conf_threshold"))


LINEITEM_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue",
                     "unit_price", "discount_amount")


def lineitem_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"))


def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sel.correlation_pairs(lineitem_features(spark, sf_dir), LINEITEM_FEATURES)
    return c.select("a", "b", rnd("abs_corr", 6).alias("abs_corr"))


def selected_features(spark: SparkSession, sf_dir: str, frac: float = 0.05,
                      corr_threshold: float = 0.9) -> DataFrame:
    df = lineitem_features(spark, sf_dir)
    imp_row = df.agg(*[F.abs(F.corr(f, "charge")).alias(f) for f in LINEITEM_FEATURES])
    imp = imp_row.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance"))
        for f in LINEITEM_FEATURES])).alias("_i")).select("_i.feature", "_i.importance")
    imp = sel.importance_filter(imp, frac)
    kept = imp.select("feature")
    pairs = sel.correlation_pairs(df, LINEITEM_FEATURES)
    edges = (pairs.where(F.col("abs_corr") >= corr_threshold)
             .join(kept.withColumnRenamed("feature", "a"), "a")
             .join(kept.withColumnRenamed("feature", "b"), "b"))
    groups = sel.connected_components(spark, kept, edges)
    reps = sel.group_representatives(groups, imp)
    return reps.select("feature", "group", rnd("importance", 6).alias("importance"), "rank")


# ----------------------------------------------------------------------------- oracle
_PANEL_SQL = """
WITH hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS t, sum(round(value * 100)) / 100.0 AS load
  FROM events GROUP BY 1, 2),
cap AS (SELECT event_type, max(load) AS capacity, min(t) AS t0, max(t) AS t1 FROM hourly GROUP BY 1),
grid AS (SELECT event_type, capacity, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS t FROM cap),
panel AS (SELECT g.event_type, g.t, h.load / g.capacity AS fill_ratio
          FROM grid g LEFT JOIN hourly h ON h.event_type = g.event_type AND h.t = g.t),
feat AS (SELECT event_type, t, fill_ratio,
    CASE WHEN count(fill_ratio) OVER w1 = 1 THEN max(fill_ratio) OVER w1 END AS target_1,
    CASE WHEN count(fill_ratio) OVER w6 = 6 THEN max(fill_ratio) OVER w6 END AS target_6,
    CASE WHEN count(fill_ratio) OVER w24f = 24 THEN max(fill_ratio) OVER w24f END AS target_24,
    CASE WHEN count(fill_ratio) OVER w24 = 24 THEN max(fill_ratio) OVER w24 END AS mx24
  FROM panel
  WINDOW w1 AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING),
         w6 AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING),
         w24f AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING),
         w24 AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
cp AS (SELECT * FROM feat WHERE fill_ratio IS NOT NULL AND mx24 IS NOT NULL AND target_6 IS NOT NULL),
ix AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS row_idx,
              count(*) OVER (PARTITION BY event_type) AS n_rows FROM cp),
hx AS (SELECT *, CAST(floor(n_rows * 0.8) AS BIGINT) AS n_train FROM ix)
"""

HOLDOUT_SQL = _PANEL_SQL + """
SELECT event_type, any_value(n_rows) AS n_rows, any_value(n_train) AS n_train,
       count(*) FILTER (WHERE row_idx >= n_train) AS n_test,
       min(t) FILTER (WHERE row_idx >= n_train) AS test_start
FROM hx GROUP BY event_type"""

FOLDS_SQL = _PANEL_SQL + f"""
, fx AS (SELECT hx.*, f.fold, n_train // {N_SPLITS + 1} AS ts FROM hx
         CROSS JOIN range(1, {N_SPLITS + 1}) f(fold) WHERE row_idx < n_train),
rx AS (SELECT event_type, fold, row_idx,
              CASE WHEN row_idx < n_train - ({N_SPLITS} - fold + 1) * ts THEN 'train'
                   WHEN row_idx < n_train - ({N_SPLITS} - fold) * ts THEN 'val' END AS role
       FROM fx WHERE ts > 0)
SELECT event_type, CAST(fold AS INTEGER) AS fold, role, count(*) AS n, min(row_idx) AS first_idx,
       max(row_idx) AS last_idx
FROM rx WHERE role IS NOT NULL GROUP BY 1, 2, 3"""

CONFORMAL_SQL = evq.FEATURES_SQL + f"""
cp AS (SELECT * FROM lg WHERE target IS NOT NULL AND fill_ratio IS NOT NULL AND mx24 IS NOT NULL),
ix AS (SELECT *, row_number() OVER (PARTITION BY station_id, horizon_hours ORDER BY t) - 1 AS row_idx,
              count(*) OVER (PARTITION BY station_id, horizon_hours) AS n_rows FROM cp),
hx AS (SELECT *, CAST(floor(n_rows * (1.0 - {TEST_FRAC!r})) AS BIGINT) AS n_train FROM ix)
, tr AS (SELECT station_id, horizon_hours,
                CASE WHEN target > 0.5 THEN 1 ELSE 0 END AS y,
                least(greatest(mx24, 0.0), 1.0) AS p FROM hx WHERE row_idx < n_train),
sc AS (SELECT station_id, horizon_hours, y, CASE WHEN y = 1 THEN 1.0 - p ELSE p END AS s FROM tr),
st AS (SELECT station_id, horizon_hours, count(*) AS n_scores, sum(y) AS npos,
              least(1.0, ceil((count(*) + 1) * {1.0 - ALPHA!r}) / count(*)) AS q_level
       FROM sc GROUP BY 1, 2),
st2 AS (SELECT *, CAST(ceil(q_level * (n_scores - 1)) AS BIGINT) AS k FROM st),
ranked AS (SELECT station_id, horizon_hours, s,
                  row_number() OVER (PARTITION BY station_id, horizon_hours ORDER BY s) - 1 AS pos
           FROM sc),
q AS (SELECT st2.station_id, st2.horizon_hours, ranked.s AS q_hat FROM st2 JOIN ranked
      ON ranked.station_id = st2.station_id AND ranked.horizon_hours = st2.horizon_hours
      AND ranked.pos = st2.k)
SELECT st2.station_id, st2.horizon_hours, st2.n_scores, round(st2.q_level, 9) AS q_level,
       round(CASE WHEN npos > 0 AND npos < n_scores THEN q.q_hat END, 9) AS q_hat,
       round(CASE WHEN npos > 0 AND npos < n_scores THEN 1.0 - q.q_hat END, 9) AS conf_threshold
FROM st2 LEFT JOIN q ON q.station_id = st2.station_id AND q.horizon_hours = st2.horizon_hours"""

_LI_SQL = """
WITH li AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax,
                   l_extendedprice * (1 - l_discount) AS revenue,
                   CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_price,
                   l_extendedprice * l_discount AS discount_amount,
                   l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
            FROM lineitem)
"""


def _corr_pairs_sql() -> str:
    f = LINEITEM_FEATURES
    parts = []
    for i, a in enumerate(f):
        for b in f[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS abs_corr FROM li")
    return " UNION ALL ".join(parts)


CORRELATION_SQL = _LI_SQL + f", pr AS ({_corr_pairs_sql()}) SELECT a, b, round(abs_corr, 6) AS abs_corr FROM pr"

SELECTED_SQL = _LI_SQL + f""",
imp0 AS ({" UNION ALL ".join(f"SELECT '{x}' AS feature, abs(corr({x}, charge)) AS importance FROM li" for x in LINEITEM_FEATURES)}),
imp AS (SELECT * FROM imp0 WHERE importance > 0.05 * (SELECT max(importance) FROM imp0)),
pr AS ({_corr_pairs_sql()}),
e AS (SELECT a, b FROM pr WHERE abs_corr >= 0.9 AND a IN (SELECT feature FROM imp)
      AND b IN (SELECT feature FROM imp)),
ue AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, w) AS (
  SELECT feature, feature FROM imp
  UNION
  SELECT reach.v, ue.b FROM reach JOIN ue ON ue.a = reach.w),
grp AS (SELECT v AS feature, min(w) AS "group" FROM reach GROUP BY v),
best AS (SELECT g."group", arg_max(i.feature, (i.importance, i.feature)) AS feature,
                max(i.importance) AS importance
         FROM grp g JOIN imp i USING (feature) GROUP BY g."group")
SELECT feature, "group", round(importance, 6) AS importance,
       CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank
FROM best"""
SELECTED_SQL = SELECTED_SQL.replace("WITH li AS", "WITH RECURSIVE li AS", 1)


def _with_features(df: DataFrame) -> DataFrame:
    """The features and the label that follow from a line's columns, unless they are there."""
    if "revenue" in df.columns:
        return df
    return df.select("*",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                     F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
                     (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
                     .alias("charge"))


def _ordered_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete lineitem feature rows with their global position by ship date (ties by the
    line's key); the ordering is dealt by day and order-key range, never in one task.

    Rows that the cores cannot take at once are moved and sorted without the features that follow
    from the others (``_with_features`` adds them again), by day; only a day with more rows than
    a task should have is dealt by order-key range as well."""
    li = table(spark, sf_dir, "lineitem")
    df = li.select("l_orderkey", "l_linenumber", "l_shipdate", *[F.col(c) for c in
                   ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    own, rows = df.columns, li.count()
    df = _with_features(df).dropna()
    if tasks_needed(spark, rows) is None:
        df = df.withColumn("_order", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
        block = F.struct("l_shipdate", F.floor(F.col("l_orderkey") / (1 << 16)).alias("range"))
        df = cv.ordinal(df, [], "_order", block).drop("_order")
    else:
        df, day = df.select(*own), F.to_date("l_shipdate")
        crowded = df.groupBy(day.alias("day")).count().where(F.col("count") > session.ROWS_PER_TASK)
        crowded = [r["day"] for r in crowded.collect()]            # at most as many as there are tasks
        part = F.when(day.isin(crowded), F.struct("l_shipdate", F.floor(F.col("l_orderkey") / (1 << 16)).alias("range")))
        block = F.struct(day.alias("day"), part.alias("part")) if crowded else day
        df = cv.ordinal(df, [], ["l_shipdate", "l_orderkey", "l_linenumber"], block, outer=day, rows=rows)
    return df.withColumn("n_train", F.col("n_rows"))


def permutation(spark: SparkSession, sf_dir: str, max_iter: int = 20) -> DataFrame:
    """M3 + M4: regressor on the last forward fold (k = 3) of lineitem ordered by ship
    date; permutation importance on all of its validation rows."""
    from flowrisk.operators import models as ml
    ordered = _with_features(stage(_ordered_lineitem(spark, sf_dir), "lineitem-order"))
    train, val = (cv.fold_part(ordered, 3, 3, role) for role in ("train", "val"))
    model = ml.fit_regressor(train, LINEITEM_FEATURES, "charge", seed=42, max_iter=max_iter, order="row_idx", binned=True)
    imp = ml.permutation_importance(model, val, LINEITEM_FEATURES, "charge", ["l_orderkey", "l_linenumber"], seed=42)
    return imp.select("feature", rnd("importance", 6).alias("importance"))


def permutation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows around the fit of ``permutation``: size and span of every fold and role."""
    roles = cv.fold_roles(stage(_ordered_lineitem(spark, sf_dir), "lineitem-order"), 3)
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return roles.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_idx"), F.max("row_idx").alias("last_idx"),
        F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"), cents.alias("price_cents"))


PERMUTATION_ROWS_SQL = """
WITH o AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS row_idx,
                  count(*) OVER () AS n FROM lineitem WHERE l_quantity <> 0),
r AS (SELECT o.*, CAST(f AS INTEGER) AS fold, n // 4 AS ts,
             CASE WHEN row_idx < n - (4 - f) * (n // 4) THEN 'train'
                  WHEN row_idx < n - (3 - f) * (n // 4) THEN 'val' END AS role
      FROM o CROSS JOIN range(1, 4) t(f))
SELECT fold, role, count(*) AS n, min(row_idx) AS first_idx, max(row_idx) AS last_idx,
       min(l_shipdate) AS first_day, max(l_shipdate) AS last_day,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price_cents
FROM r WHERE role IS NOT NULL GROUP BY 1, 2
"""


def sampled_lines(spark: SparkSession, sf_dir: str, n: int = 20_000) -> DataFrame:
    """T5: the seeded sampling operator on all of lineitem."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sel.seeded_sample(li, n, 42, ["l_orderkey", "l_linenumber"])


SAMPLED_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT 20000
"""
