"""Query definitions registered in the catalog (one per operator family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowrisk.plans import artifacts as arq
from flowrisk.plans import event_features as ef
from flowrisk.plans import event_panel as ep
from flowrisk.plans import evaluation as evq
from flowrisk.plans import scoring as sc
from flowrisk.plans import selection as slq
from flowrisk.plans import supplier_panel as spq
from flowrisk.plans import training as trq
from flowrisk.plans import model_runs as mrq
from flowrisk.plans import monitors as moq
from flowrisk.plans import readings_sync as rsq
from flowrisk.plans import gridpoints as gpq
from flowrisk.plans import risk_table as rkq
from flowrisk.streaming import upsert as stq
from flowrisk.plans import report_roundtrip as rpq
from flowrisk.plans.catalog import register


@register("exceedance_rate", ep.EXCEEDANCE_RATE_SQL)
def exceedance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.exceedance_rate(spark, sf_dir)


@register("feature_catalogue_counts", ef.feature_summary_sql())
def feature_catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 78 features + target on the 10-minute event panel: non-null counts per type."""
    return ef.feature_summary(spark, sf_dir)


@register("feature_catalogue", ef.feature_table_sql())
def feature_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grid row with the target and all 78 features."""
    return ef.feature_table(spark, sf_dir)


@register("classification_metrics_labels", sc.LABEL_METRICS_SQL)
def classification_metrics_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6-A12 on document quality labels scored by length, per language."""
    return sc.metrics_of(sc.scored_labels(spark, sf_dir))


@register("classification_metrics_events", sc.EVENT_METRICS_SQL)
def classification_metrics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6-A12 on 'error' events scored by value, per day."""
    return sc.metrics_of(sc.scored_events(spark, sf_dir))


@register("evaluation_comparison", evq.COMPARISON_SQL)
def evaluation_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate metrics vs the persistence baseline."""
    return evq.comparison(spark, sf_dir)


@register("evaluation_summary", evq.SUMMARY_SQL)
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean / std / count of % improvement by horizon, model, metric."""
    return evq.summary(spark, sf_dir)


@register("evaluation_beat_rate", evq.BEAT_RATE_SQL)
def evaluation_beat_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beat rate by horizon and model."""
    return evq.beat_rates(spark, sf_dir)


@register("evaluation_beat_rate_by_metric", evq.BEAT_RATE_BY_METRIC_SQL)
def evaluation_beat_rate_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beat rate by horizon, model and metric."""
    return evq.beat_rates(spark, sf_dir, by_metric=True)


@register("evaluation_best_model", evq.BEST_MODEL_SQL)
def evaluation_best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model with the lowest average rank per station and horizon."""
    return evq.best(spark, sf_dir)


@register("evaluation_best_model_table", evq.BEST_TABLE_SQL)
def evaluation_best_model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station x horizon pivot of the best model."""
    return evq.best_table(spark, sf_dir)


@register("temporal_holdout", slq.HOLDOUT_SQL)
def temporal_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributed row ordinals and the last-20 % hold-out per entity."""
    return slq.holdout_split(spark, sf_dir)


@register("temporal_folds", slq.FOLDS_SQL)
def temporal_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: forward-chaining fold roles on the training rows."""
    return slq.folds(spark, sf_dir)


@register("conformal_calibration", slq.CONFORMAL_SQL)
def conformal_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformal quantile and threshold per station and horizon."""
    return slq.conformal(spark, sf_dir)


@register("feature_correlation", slq.CORRELATION_SQL)
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute Pearson correlation of every lineitem feature pair."""
    return slq.correlation(spark, sf_dir)


@register("feature_selection", slq.SELECTED_SQL)
def feature_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance filter, correlation groups, ranked representatives."""
    return slq.selected_features(spark, sf_dir)


@register("long_window_panel", spq.LONG_WINDOW_SQL)
def long_window_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1-W3, W7, W11, W13, W16 with windows up to 365 rows per supplier."""
    return spq.long_window_table(spark, sf_dir)


@register("fitted_model_scores", mrq.fitted_model_scores_sql())
def fitted_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7-M15, S16, J8 for all five horizons: fold models stored, reloaded and scored; runs
    that the manifest has are not fitted again."""
    return mrq.fitted_model_scores(spark, sf_dir)


@register("exceedance_model_metrics")
def exceedance_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold-trained classifiers, conformal calibration and the 3-model metric table
    (model fits are stochastic in general: rows-only check)."""
    return trq.training_metrics(spark, sf_dir)


@register("report_roundtrip", rpq.ROUNDTRIP_SQL)
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports rendered from events, parsed back into records."""
    return rpq.roundtrip(spark, sf_dir)


@register("flow_id_resolution", moq.FLOW_ID_SQL)
def flow_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 + J4: alias map (id, alt id, site code; first source wins) and flow-id cleaning."""
    return moq.flow_id_resolution(spark, sf_dir)


@register("gauge_id_resolution", moq.GAUGE_ID_SQL)
def gauge_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 + J5: rain-gauge alias map and gauge-id cleaning rules."""
    return moq.gauge_id_resolution(spark, sf_dir)


@register("active_monitor_records", moq.ACTIVE_SQL)
def active_monitor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + P1 + P2 + P3: records of active flow monitors matched by id or alt id."""
    return moq.active_monitor_records(spark, sf_dir)


@register("preferred_measures", rsq.PREFERRED_SQL)
def preferred_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute measures per station, else hourly, else none."""
    return rsq.preferred(spark, sf_dir)


@register("candidate_choice", rsq.CANDIDATE_SQL)
def candidate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First candidate station with data per target."""
    return rsq.candidate_choice(spark, sf_dir)


@register("incremental_upsert", rsq.UPSERT_SQL)
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append readings newer than the stored maximum, keep the last arrival."""
    return rsq.upsert(spark, sf_dir)


@register("gridpoint_series", gpq.GRIDPOINT_SQL)
def gridpoint_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-cell point series, z-score and cumulative sum."""
    return gpq.gridpoint_summary(spark, sf_dir)


@register("risk_table", rkq.RISK_SQL)
def risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold-out rows scored by the best model with conformal
    confidence, categories, trend and the performance sentence."""
    return rkq.risk(spark, sf_dir)


@register("streaming_upsert", stq.STREAM_SQL)
def streaming_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermark-bounded dedup + foreachBatch merge, run with availableNow."""
    return stq.stream_events(spark, sf_dir)


@register("rain_report_roundtrip", rpq.RAIN_ROUNDTRIP_SQL)
def rain_report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2/F3/F8 (two-digit years): rain reports rendered from events, parsed back."""
    return rpq.rain_roundtrip(spark, sf_dir)


@register("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3/M4/T5: gradient-boosted regressor + permutation importance (rows-only)."""
    return slq.permutation(spark, sf_dir)


@register("gridpoint_sparse_axes", gpq.SPARSE_AXES_SQL)
def gridpoint_sparse_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 on coarse and uneven axes, with points beyond their ends."""
    return gpq.sparse_axes(spark, sf_dir)


@register("streaming_replay", stq.REPLAY_SQL)
def streaming_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 on several files in reverse time order, then corrections of every reading."""
    return stq.replay_out_of_order(spark, sf_dir)


@register("permutation_fold_rows", slq.PERMUTATION_ROWS_SQL)
def permutation_fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the importance fit trains on and scores, per fold."""
    return slq.permutation_rows(spark, sf_dir)


@register("seeded_sample", slq.SAMPLED_SQL)
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: 20,000 lines chosen by a seeded hash."""
    return slq.sampled_lines(spark, sf_dir)


@register("training_folds", trq.training_folds_sql())
def training_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5, M1, M2, M7: rows, classes and weights of every station's folds."""
    return trq.training_folds(spark, sf_dir)


@register("horizon_targets", trq.horizon_targets_sql())
def horizon_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of all five horizons, 1 to 720 hours, on the 10-minute grid."""
    return trq.horizon_targets(spark, sf_dir)


@register("report_tables", arq.REPORT_TABLES_SQL)
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, S8-S10, S19, C1, C3, D3, U1: report files to partitioned tables and back."""
    return arq.report_tables(spark, sf_dir)


@register("envelope_readings", arq.ENVELOPE_SQL)
def envelope_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reading envelopes, first reading per hour, exogenous join."""
    return arq.envelope_readings(spark, sf_dir)


@register("artifact_tables", arq.ARTIFACT_SQL)
def artifact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts written and read back."""
    return arq.artifact_tables(spark, sf_dir)


@register("landed_tables", arq.LANDED_SQL)
def landed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed CSV inputs through the typed readers."""
    return arq.landed_tables(spark, sf_dir)
