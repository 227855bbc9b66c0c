"""The registered queries: every operator on the given tables, with its SQL where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilseries.config import DAY, DetectorConfig, FeatureShape
from vigilseries.functions.columns import (
    INSTANCE,
    SERIES,
    decode_destination,
    encode_destination,
    epoch,
    vector_distance,
)
from vigilseries.functions.storage import materialise, stage_path
from vigilseries.operators import align, detect, features, forest, gates, kmeans, nsa, select
from vigilseries.operators import neighbours as nb
from vigilseries.plans import oracle as o
from vigilseries.plans import cycles, pipeline, tables
from vigilseries.sources import control, store, upserts
from vigilseries.sources import points as source
from vigilseries.streaming import rings, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

C, NOW, LO, MID = o.C, o.NOW, o.LO, o.MID
r7, big, KEY, SER = o.r7, o.big, o.KEY, o.SER


def tidy(df: DataFrame) -> DataFrame:
    """Seven decimals, whole numbers as long, times as epoch seconds."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            short = F.round(c, 7)
            c = F.when(short == 0, F.lit(0.0)).otherwise(short)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(field.dataType, T.TimestampType):
            c = F.unix_seconds(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(query(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = o.query(sql)
        return query

    return add


def training(spark: SparkSession, sf_dir: str, cfg=C) -> pipeline.TrainingRun:
    return pipeline.TrainingRun(tables.points(spark, sf_dir), NOW, cfg)


def scoring(spark: SparkSession, sf_dir: str) -> tuple[pipeline.TrainingRun, DataFrame]:
    """A training run and the aligned scoring window of its gated metrics."""
    run = training(spark, sf_dir)
    return run, pipeline.scoring_frame(run.points, run.scored_metrics, NOW, C)


def coordinates(df: DataFrame, column: str) -> DataFrame:
    """A vector column as one row per coordinate."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(column).alias("pos", "x"))


UNNESTED = "unnest(range(len(centre))) AS pos, unnest(centre) AS x"


def centres_sql(source_sql: str, columns: str) -> str:
    return f"SELECT {columns}, {big('pos')} AS pos, {r7('x')} AS x FROM (SELECT {columns}, {UNNESTED} FROM {source_sql})"


# --- scans ------------------------------------------------------------------------------------

POINT = ["application", "instance", "measurement", "destination_key", "ts", "value"]
POINT_SQL = f"application, instance, measurement, destination_key, {big('sec')} AS ts, {r7('value')} AS value"


@register(
    "scan_metric",
    f"""SELECT {POINT_SQL}, field FROM x_points WHERE measurement = 'adt_click' AND instance = 'instance_0'
    AND destination_key = 'eth0, in' AND sec >= {LO} AND sec < {MID}""",
)
def scan_metric(spark, sf_dir):
    rows = tables.points(spark, sf_dir)
    key = "eth0---in".replace("---", ", ")
    return source.scan_metric(rows, "adt_click", "instance_0", key, LO, MID).select(*POINT, "field")


@register("range_train", f"SELECT {POINT_SQL} FROM x_points WHERE sec >= {LO} AND sec < {MID}")
def range_train(spark, sf_dir):
    return source.training_range(tables.points(spark, sf_dir), NOW, C).select(*POINT)


@register("range_infer", f"SELECT {POINT_SQL} FROM x_points WHERE sec >= {MID} AND sec < {NOW}")
def range_infer(spark, sf_dir):
    return source.scoring_range(tables.points(spark, sf_dir), NOW, C).select(*POINT)


@register(
    "filter_prefix", f"SELECT {POINT_SQL} FROM x_points WHERE substr(measurement, 1, 4) = 'adt_'"
)
def filter_prefix(spark, sf_dir):
    return source.with_prefix(tables.points(spark, sf_dir), C.metric_prefix).select(*POINT)


@register(
    "discover_instances",
    f"""SELECT DISTINCT {KEY} FROM x_series WHERE sec >= {NOW - 30 * DAY} AND sec < {NOW}""",
)
def discover_instances(spark, sf_dir):
    return source.discover_instances(tables.points(spark, sf_dir), NOW, C)


@register(
    "discover_metrics",
    f"""SELECT {SER}, {big(f'row_number() OVER (PARTITION BY {KEY} ORDER BY measurement, destination) - 1')} AS ord
    FROM (SELECT DISTINCT {SER}, measurement, destination FROM x_train)""",
)
def discover_metrics(spark, sf_dir):
    return source.discover_metrics(tables.points(spark, sf_dir), LO, MID, C.metric_prefix)


ENCODED_TEXT = o.ENCODED.replace("destination_key", "text")


@register(
    "destkey_encode",
    f"SELECT doc_id, md5({ENCODED_TEXT}) AS encoded, {big(f'length({ENCODED_TEXT})')} AS size FROM documents",
)
def destkey_encode(spark, sf_dir):
    encoded = encode_destination(F.col("text"))
    return tables.read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(encoded).alias("encoded"), F.length(encoded).alias("size")
    )


@register(
    "destkey_decode",
    f"""SELECT doc_id, md5(decoded) AS decoded, decoded = text AS same FROM (SELECT doc_id, text,
    replace(replace({ENCODED_TEXT}, '---', ', '), '--', ',') AS decoded FROM documents)""",
)
def destkey_decode(spark, sf_dir):
    decoded = decode_destination(encode_destination(F.col("text")))
    return tables.read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(decoded).alias("decoded"), (decoded == F.col("text")).alias("same")
    )


@register(
    "scan_field",
    f"""SELECT {POINT_SQL}, field FROM x_points WHERE measurement = 'adt_view' AND field = 'value'
    AND sec >= {LO} AND sec < {NOW}""",
)
def scan_field(spark, sf_dir):
    rows = tables.points(spark, sf_dir)
    return source.scan_field(rows, "adt_view", "value", LO, NOW).select(*POINT, "field")


@register(
    "scan_recent",
    f"SELECT {POINT_SQL} FROM x_points WHERE measurement = 'adt_view' AND ts >= {o.moment(NOW - DAY)}"
    f" AND ts <= {o.moment(NOW)}",
)
def scan_recent(spark, sf_dir):
    rows = tables.points(spark, sf_dir)
    return source.scan_recent(rows, "adt_view", NOW, seconds=DAY).select(*POINT)


@register(
    "control_filter",
    f"""SELECT subject, application, version, metric, {big('1')} AS bounds, {big('received_at')} AS received_at,
    event_id AS "offset" FROM x_control""",
)
def control_filter(spark, sf_dir):
    found = control.control_messages(tables.control(spark, sf_dir))
    return found.select(
        "subject",
        "application",
        "version",
        F.col("metric_list")[0]["name"].alias("metric"),
        F.size("metric_list").alias("bounds"),
        "received_at",
        "offset",
    )


@register(
    "subject_filter",
    f"""SELECT subject, application, version, {big('received_at')} AS received_at, event_id AS "offset"
    FROM x_control WHERE subject = 'shop_1'""",
)
def subject_filter(spark, sf_dir):
    found = control.for_subject(control.control_messages(tables.control(spark, sf_dir)), "shop_1")
    return found.select("subject", "application", "version", "received_at", "offset")


@register("app_registry", "SELECT application, version FROM x_registry")
def app_registry(spark, sf_dir):
    return control.registry(control.control_messages(tables.control(spark, sf_dir)))


@register(
    "monitored_semi",
    f"""SELECT 'shop_' || CAST(user_id % 4 AS VARCHAR) AS application, event_id, {big(o.SECONDS.format('ts'))} AS ts
    FROM events WHERE 'shop_' || CAST(user_id % 4 AS VARCHAR) IN (SELECT application FROM x_registry)""",
)
def monitored_semi(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "events").select(
        F.concat(F.lit("shop_"), F.col("user_id") % 4).alias("application"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
    )
    known = control.registry(control.control_messages(tables.control(spark, sf_dir)))
    return source.monitored(rows, known)


# --- CSV --------------------------------------------------------------------------------------

WIDE_SQL = f"SELECT {KEY}, t, {o.PIVOTED} FROM x_tr_aligned GROUP BY ALL"


def exported_wide(spark: SparkSession, sf_dir: str) -> str:
    path = stage_path(spark, "wide-csv")
    wide = align.pivot_wide(training(spark, sf_dir).aligned, tables.METRICS)
    store.export_wide_csv(wide, tables.METRICS, path)
    return path


@register("scan_csv_wide", WIDE_SQL)
def scan_csv_wide(spark, sf_dir):
    rows = store.read_csv(spark, exported_wide(spark, sf_dir), tables.METRICS)
    return rows.select(*INSTANCE, F.col("ems_time").alias("t"), *tables.METRICS)


@register(
    "export_wide_csv",
    WIDE_SQL.replace(f"{KEY}, t,", f"{KEY}, t AS \"Timestamp\", t AS ems_time,").replace(
        "GROUP BY ALL", f"GROUP BY {KEY}, t"
    ),
)
def export_wide_csv(spark, sf_dir):
    rows = store.read_csv(spark, exported_wide(spark, sf_dir), tables.METRICS)
    return rows.select(*INSTANCE, "Timestamp", "ems_time", *tables.METRICS)


@register("wide_to_long", f"SELECT {SER}, t, {r7('value')} AS value FROM x_tr_aligned")
def wide_to_long(spark, sf_dir):
    wide = align.pivot_wide(training(spark, sf_dir).aligned, tables.METRICS)
    csv = wide.select(
        *INSTANCE, F.col("t").alias("Timestamp"), F.col("t").alias("ems_time"), *tables.METRICS
    )
    return align.wide_to_long(csv, tables.METRICS)


@register(
    "export_metric_csv",
    f"SELECT {SER}, {big('sec')} AS ems_time, {r7('value')} AS value FROM x_train",
)
def export_metric_csv(spark, sf_dir):
    path = stage_path(spark, "metric-csv")
    store.export_metric_csv(training(spark, sf_dir).series_points, path)
    return store.read_metric_csv(spark, path).select(*SERIES, "ems_time", "value")


# --- gates ------------------------------------------------------------------------------------

GATE = 205  # near the middle of the record counts, so that the gate divides the metrics
SHOPS = 60  # many small applications, so that some have no data
SHOP_SQL = (
    f"'shop_' || CAST(user_id % {SHOPS} AS VARCHAR) AS application, "
    f"'instance_' || CAST((user_id // {SHOPS}) % 2 AS VARCHAR) AS instance"
)


@register(
    "gate_min_records",
    f"SELECT {SER}, count(*) AS records FROM x_train GROUP BY ALL HAVING count(*) > {GATE}",
)
def gate_min_records(spark, sf_dir):
    return gates.enough_records(training(spark, sf_dir).series_points, GATE)


FEW_RECORDS = 160


@register(
    "missing_metrics_anti",
    f"SELECT {SER} FROM x_metrics EXCEPT SELECT {SER} FROM x_series WHERE sec >= {NOW - 6 * 3600} AND sec < {NOW}",
)
def missing_metrics_anti(spark, sf_dir):
    run = training(spark, sf_dir)
    last_hours = replace(C, score_seconds=6 * 3600)
    window = source.scoring_range(run.points, NOW, last_hours)
    return gates.missing_metrics(run.gated, source.series_points(window, C.metric_prefix))


@register(
    "instances_without_data",
    f"""SELECT DISTINCT {SHOP_SQL} FROM events WHERE event_type <> 'signup' EXCEPT
    SELECT {KEY} FROM (SELECT {SHOP_SQL}, event_type, {o.K} % 2 AS way FROM events
      WHERE event_type <> 'signup' AND {o.SECONDS.format('ts')} < {MID}) GROUP BY {KEY}, event_type, way
      HAVING count(*) > 12""",
)
def instances_without_data(spark, sf_dir):
    rows = tables.points(spark, sf_dir, SHOPS)
    found = source.discover_instances(rows, NOW, C)
    usable = gates.enough_records(
        source.series_points(source.training_range(rows, NOW, C), C.metric_prefix), 12
    )
    return gates.instances_without_data(found, usable)


@register(
    "complete_instances",
    f"""SELECT s.application, s.instance, count(*) AS n_selected, count(p.metric) AS n_present FROM x_selected s
    LEFT JOIN (SELECT DISTINCT {SER} FROM x_series WHERE sec >= {NOW - 12 * 3600} AND sec < {NOW}) p
      ON {o.eq('s', 'p', SER)} GROUP BY ALL HAVING count(*) = count(p.metric)""",
)
def complete_instances(spark, sf_dir):
    run = training(spark, sf_dir)
    window = source.scoring_range(run.points, NOW, replace(C, score_seconds=12 * 3600))
    return gates.complete_instances(
        run.selected, source.series_points(window, C.metric_prefix)
    )


@register(
    "left_out",
    f"""SELECT {SER}, '{cycles.FEW}' AS reason FROM x_series WHERE sec >= {LO} AND sec < {MID}
      GROUP BY ALL HAVING count(*) <= {FEW_RECORDS}
    UNION ALL SELECT application, instance, NULL, '{cycles.NO_DATA}' FROM (SELECT DISTINCT {KEY} FROM x_series WHERE sec < {NOW} EXCEPT
      SELECT {KEY} FROM (SELECT {SER} FROM x_series WHERE sec >= {LO} AND sec < {MID} GROUP BY ALL HAVING count(*) > {FEW_RECORDS}))
    UNION ALL SELECT {SER}, '{cycles.MISSING}' FROM (SELECT {SER} FROM x_metrics EXCEPT
      SELECT {SER} FROM x_series WHERE sec >= {NOW - 6 * 3600} AND sec < {NOW})
    UNION ALL SELECT application, instance, NULL, '{cycles.INCOMPLETE}' FROM (SELECT s.application, s.instance FROM x_selected s
      LEFT JOIN (SELECT DISTINCT {SER} FROM x_series WHERE sec >= {NOW - 6 * 3600} AND sec < {NOW}) p
      ON {o.eq('s', 'p', SER)} GROUP BY ALL HAVING count(*) <> count(p.metric))""",
)
def left_out(spark, sf_dir):
    """A cycle over the last hours leaves metrics out; its record is read back. A stricter gate shows
    what training leaves out."""
    run = training(spark, sf_dir)
    folder = stage_path(spark, "cycle")
    short = replace(C, score_seconds=6 * 3600)
    cycles.run(run.points, run.models, NOW, short, f"{folder}/store", f"{folder}/status")
    strict = replace(C, min_records=FEW_RECORDS)
    trained = cycles.left_out_of_training(run.points, NOW, strict)
    return trained.unionByName(cycles.read_skipped(spark, f"{folder}/status").drop("time"))


@register("outliers_iqr", o.IQR_PLAIN_SQL)
def outliers_iqr(spark, sf_dir):
    wide = tables.daily_wide(spark, sf_dir)
    return gates.remove_outliers_iqr(wide, tables.DAILY, rows_per_key=None)


@register("outliers_iqr_bounds", o.IQR_BOUND_SQL)
def outliers_iqr_bounds(spark, sf_dir):
    lower = {c: b[0] for c, b in o.IQR_BOUNDS.items() if b[0] is not None}
    upper = {c: b[1] for c, b in o.IQR_BOUNDS.items() if b[1] is not None}
    wide = tables.daily_wide(spark, sf_dir)
    return gates.remove_outliers_iqr(wide, tables.DAILY, lower, upper, rows_per_key=4000)


# --- alignment --------------------------------------------------------------------------------

VALUE_SQL = f"SELECT {SER}, t, {r7('value')} AS value FROM"


def gated_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = training(spark, sf_dir)
    return run.means.join(run.gated.select(*SERIES), [*SERIES], "left_semi")


@register("minute_mean", f"{VALUE_SQL} x_tr_mm")
def minute_mean(spark, sf_dir):
    rows = training(spark, sf_dir).series_points
    kept = gates.gate_points(rows, C.min_records)
    return align.grid_means(kept, C.freq).select(*SERIES, "t", "value")


@register("spine", f"SELECT {KEY}, t FROM x_tr_spine")
def spine(spark, sf_dir):
    return align.spine(gated_means(spark, sf_dir), C.freq)


@register("reindex", f"{VALUE_SQL} x_tr_reindex")
def reindex(spark, sf_dir):
    return align.reindex(gated_means(spark, sf_dir), C, steps=C.train_steps)


@register("pivot_wide", WIDE_SQL)
def pivot_wide(spark, sf_dir):
    return align.pivot_wide(training(spark, sf_dir).aligned, tables.METRICS)


@register("interpolate_linear", f"{VALUE_SQL} x_tr_interp")
def interpolate_linear(spark, sf_dir):
    return align.interpolate(gated_means(spark, sf_dir), C, steps=C.train_steps)


@register("fill_zero", f"SELECT {SER}, t, {r7('coalesce(value, 0.0)')} AS value FROM x_tr_reindex")
def fill_zero(spark, sf_dir):
    return align.zero_fill(align.reindex(gated_means(spark, sf_dir), C, steps=C.train_steps))


WEEK = replace(C, freq=7 * DAY, chunk_steps=40)
o.part(
    "x_week",
    f"""SELECT {KEY}, t - t % {7 * DAY} AS w, avg(quantity) AS value FROM x_daily GROUP BY ALL""",
)
o.part(
    "x_week_grid",
    f"""SELECT s.application, s.instance, s.w, k.value FROM (SELECT {KEY},
    unnest(generate_series(min(w), max(w), {7 * DAY})) AS w FROM x_week GROUP BY {KEY}) s
    LEFT JOIN x_week k ON {o.eq('s', 'k', KEY + ', w')}""",
)


@register(
    "resample",
    f"""SELECT {KEY}, 'quantity' AS metric, {big('w')} AS t, {r7('CASE WHEN nw = pw OR nv IS NULL THEN pv ELSE pv + (nv - pv) * ((w - pw) / (nw - pw)) END')} AS value
    FROM (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, first_value(value IGNORE NULLS) OVER f AS nv,
      last_value(CASE WHEN value IS NOT NULL THEN w END IGNORE NULLS) OVER b AS pw,
      first_value(CASE WHEN value IS NOT NULL THEN w END IGNORE NULLS) OVER f AS nw FROM x_week_grid
      WINDOW b AS (PARTITION BY {KEY} ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY {KEY} ORDER BY w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
)
def resample(spark, sf_dir):
    daily = tables.daily_wide(spark, sf_dir).select(
        *INSTANCE, F.lit("quantity").alias("metric"), "t", F.col("quantity").alias("value")
    )
    return align.resample(daily, WEEK)


@register("align_fleet", f"{VALUE_SQL} x_tr_aligned")
def align_fleet(spark, sf_dir):
    rows = gates.gate_points(training(spark, sf_dir).series_points, C.min_records)
    return align.align(rows, C, steps=C.train_steps)


def values_and_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    run, frame = scoring(spark, sf_dir)
    values = frame.join(run.selected.select(*SERIES), [*SERIES], "left_semi")
    scores = pipeline.kmeans_scores(frame, run.models_without_nsa, C)
    return values, scores


SCORED_SQL = f"""SELECT v.application, v.instance, v.metric, v.t, {r7('v.value')} AS value,
    {r7('k.anomaly_score')} AS anomaly_score, {big('k.anomaly_bit')} AS anomaly_bit
    FROM (SELECT * FROM x_sc_aligned WHERE ({SER}) IN (SELECT ({SER}) FROM x_selected)) v
    LEFT JOIN x_kscore k ON {o.eq('v', 'k', SER + ', t')}"""


@register("scores_outer", SCORED_SQL)
def scores_outer(spark, sf_dir):
    values, scores = values_and_scores(spark, sf_dir)
    return align.outer_scores(values, scores, [*SERIES, "t"])


@register("scores_dropna", f"{SCORED_SQL} WHERE k.anomaly_score IS NOT NULL")
def scores_dropna(spark, sf_dir):
    values, scores = values_and_scores(spark, sf_dir)
    return align.complete_scores(values, scores, [*SERIES, "t"], ["value", "anomaly_score"])


# --- selection --------------------------------------------------------------------------------

PROFILE_SQL = f"""SELECT {SER}, ord, n, {r7('vmin')} AS vmin, {r7('vmax')} AS vmax,
    {r7('variance')} AS variance FROM x_profile"""
PROFILE = [*SERIES, "ord", "n", "vmin", "vmax", "variance"]


@register("filter_variability", f"{PROFILE_SQL} WHERE vmin < vmax")
def filter_variability(spark, sf_dir):
    return select.variable(training(spark, sf_dir).stats).select(*PROFILE)


VARIANCE_SHOWN = 1500.0  # near the middle of the variances


@register("filter_variance", f"{PROFILE_SQL} WHERE variance > {VARIANCE_SHOWN}")
def filter_variance(spark, sf_dir):
    return select.varying_enough(training(spark, sf_dir).stats, VARIANCE_SHOWN).select(*PROFILE)


def blockers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    shown = replace(C, correlation_limit=o.LIMIT_SHOWN)
    run = training(spark, sf_dir, shown)
    stats = select.varying_enough(select.variable(run.stats), C.variance_floor)
    return stats, select.correlated(run.aligned, stats, shown, C.train_steps)


@register("corr_pairs", f"SELECT {SER}, blocker, {r7('r')} AS r FROM x_corr_shown")
def corr_pairs(spark, sf_dir):
    return blockers(spark, sf_dir)[1]


@register("filter_corr", f"SELECT {SER} FROM x_varying EXCEPT SELECT {SER} FROM x_corr_shown")
def filter_corr(spark, sf_dir):
    return select.uncorrelated(*blockers(spark, sf_dir)).select(*SERIES)


@register("importance_binned", f"SELECT {SER}, {r7('importance')} AS importance FROM x_importance")
def importance_binned(spark, sf_dir):
    run = training(spark, sf_dir)
    stats = select.varying_enough(select.variable(run.stats), C.variance_floor)
    kept = select.uncorrelated(stats, select.correlated(run.aligned, stats, C, C.train_steps))
    crowded = select.crowded(materialise(kept, "kept"), C.top_n)
    return select.importance(run.aligned, crowded, C, C.train_steps)


@register("importance_forest", f"SELECT {SER}, {r7('importance')} AS importance FROM x_forest")
def importance_forest(spark, sf_dir):
    run = training(spark, sf_dir)
    stats = select.varying_enough(select.variable(run.stats), C.variance_floor)
    kept = select.uncorrelated(stats, select.correlated(run.aligned, stats, C, C.train_steps))
    crowded = materialise(select.crowded(materialise(kept, "kept"), C.top_n), "crowded")
    return forest.importance(run.aligned, crowded, C, C.train_steps)


SELECTED_SQL = f"""SELECT {SER}, {big('ord')} AS ord, {r7('vmin')} AS vmin, {r7('vmax')} AS vmax,
    {r7('importance')} AS importance FROM x_selected"""


@register("top_n_metrics", f"SELECT {SER}, {big('ord')} AS ord FROM x_selected")
def top_n_metrics(spark, sf_dir):
    run = training(spark, sf_dir)
    stats = select.varying_enough(select.variable(run.stats), C.variance_floor)
    kept = materialise(
        select.uncorrelated(stats, select.correlated(run.aligned, stats, C, C.train_steps)), "kept"
    )
    scores = select.importance(run.aligned, select.crowded(kept, C.top_n), C, C.train_steps)
    return select.top_n(kept, scores, C.top_n).select(*SERIES, "ord")


@register("select_metrics", SELECTED_SQL)
def select_metrics(spark, sf_dir):
    return training(spark, sf_dir).selected


@register(
    "minmax_fit", f"SELECT {SER}, {r7('vmin')} AS vmin, {r7('vmax')} AS vmax FROM x_profile"
)
def minmax_fit(spark, sf_dir):
    return features.minmax_fit(training(spark, sf_dir).aligned)


@register(
    "minmax_transform", f"SELECT {SER}, {big('ord')} AS ord, t, {r7('value')} AS value FROM x_sc_scaled"
)
def minmax_transform(spark, sf_dir):
    run, frame = scoring(spark, sf_dir)
    return features.minmax_transform(frame, run.selected)


# --- features ---------------------------------------------------------------------------------

W = f"OVER (PARTITION BY {SER} ORDER BY t)"


def shaped(spark: SparkSession, sf_dir: str, shape: FeatureShape) -> DataFrame:
    frame = training(spark, sf_dir).scaled
    rows = features.featurise(frame, shape, C, steps=C.train_steps)
    return rows.select(*SERIES, "t", *features.lag_columns(shape))


@register(
    "feat_diff",
    f"SELECT {SER}, t, {r7('l0')} AS l0 FROM (SELECT *, abs(value - lag(value, 2) {W}) AS l0 FROM x_tr_scaled) WHERE l0 IS NOT NULL",
)
def feat_diff(spark, sf_dir):
    return shaped(spark, sf_dir, FeatureShape(lags=0, diffs=2, smooth=0))


@register(
    "feat_smooth",
    f"""SELECT {SER}, t, {r7('l0')} AS l0 FROM (SELECT *, row_number() {W} AS rn, abs(avg(value) OVER (PARTITION BY {SER}
    ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS l0 FROM x_tr_scaled) WHERE rn > 3""",
)
def feat_smooth(spark, sf_dir):
    return shaped(spark, sf_dir, FeatureShape(lags=0, diffs=0, smooth=4))


@register(
    "feat_lags",
    f"""SELECT {SER}, t, {r7('abs(value)')} AS l0, {r7('l1')} AS l1, {r7('l2')} AS l2 FROM (SELECT *,
    abs(lag(value, 1) {W}) AS l1, abs(lag(value, 2) {W}) AS l2 FROM x_tr_scaled) WHERE l2 IS NOT NULL""",
)
def feat_lags(spark, sf_dir):
    return shaped(spark, sf_dir, FeatureShape(lags=2, diffs=0, smooth=0))


L4 = ", ".join(f"{r7(f'l{n}')} AS l{n}" for n in range(4))


@register("featurise", f"SELECT {SER}, t, {L4} FROM x_tr_feat")
def featurise(spark, sf_dir):
    return shaped(spark, sf_dir, C.nsa_shape)


@register("score_rows", f"SELECT {SER}, t, {L4} FROM x_sc_warm")
def score_rows(spark, sf_dir):
    run, frame = scoring(spark, sf_dir)
    scaled = features.minmax_transform(frame, run.selected)
    rows = features.featurise(scaled, C.nsa_shape, C, steps=C.score_steps, scoring=True)
    return rows.select(*SERIES, "t", *features.lag_columns(C.nsa_shape))


# --- negative selection -----------------------------------------------------------------------

NSA_ROWS = C.train_steps + C.max_detectors


def self_vectors(run: pipeline.TrainingRun) -> DataFrame:
    return run.vectors.select(*INSTANCE, F.col("t").alias("rid"), "vec")


@register(
    "nsa_params",
    f"""SELECT {KEY}, {big('dim')} AS dim, {r7('self_radius')} AS self_radius FROM x_params0""",
)
def nsa_params(spark, sf_dir):
    return nsa.params(training(spark, sf_dir).vectors, C.self_percentage)


@register(
    "vec_distance",
    f"""SELECT rid, {r7('list_distance(vec, list_transform(vec, lambda x: 0.5))')} AS distance FROM x_lab""",
)
def vec_distance(spark, sf_dir):
    middle = F.transform("vec", lambda x: F.lit(0.5))
    rows = tables.labelled_vectors(spark, sf_dir)
    return rows.select("rid", vector_distance(F.col("vec"), middle).alias("distance"))


@register(
    "self_points",
    f"SELECT rid, {r7('sqrt(list_sum(list_transform(vec, lambda x: x * x)))')} AS norm FROM x_lab WHERE label = 0",
)
def self_points(spark, sf_dir):
    rows = nsa.self_points(tables.labelled_vectors(spark, sf_dir))
    return rows.select("rid", nsa.vector_norm(F.col("vec")).alias("norm"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(tables.labelled_vectors(spark, sf_dir), "labelled")


def as_queries(rows: DataFrame) -> DataFrame:
    return rows.select(*INSTANCE, F.col("rid").alias("qid"), "vec")


@register("nn_self", f"SELECT rid, {r7('near')} AS near FROM x_lab_near")
def nn_self(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    refs = nb.distinct_points(nsa.self_points(rows)).withColumn("aux", F.lit(None).cast("double"))
    return nb.nearest(as_queries(rows), refs).select(F.col("qid").alias("rid"), "near")


@register(
    "knn_labelled",
    f"""SELECT qid, {big('rk')} AS rank, rid, {big('label')} AS label, {r7('dist')} AS dist FROM x_knn""",
)
def knn_labelled(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    found = nsa.neighbours_of(as_queries(rows), rows, C.neighbours)
    return found.select("qid", "rank", "rid", F.col("aux").cast("long").alias("label"), "dist")


@register("nsa_seeds", centres_sql("x_seeds", f"{KEY}, {big('cand')} AS cand").replace(
    f"SELECT {KEY}, {big('cand')} AS cand, {big('pos')}", f"SELECT {KEY}, cand, {big('pos')}"))
def nsa_seeds(spark, sf_dir):
    selves = self_vectors(training(spark, sf_dir))
    found = nsa.seeds(selves, "corners", C.train_steps)
    return coordinates(found.select(*INSTANCE, "cand", "centre"), "centre")


@register("nsa_seeds_centroids", centres_sql("x_centroids", f"{KEY}, {big('cand')} AS cand").replace(
    f"SELECT {KEY}, {big('cand')} AS cand, {big('pos')}", f"SELECT {KEY}, cand, {big('pos')}"))
def nsa_seeds_centroids(spark, sf_dir):
    selves = self_vectors(training(spark, sf_dir))
    found = nsa.seeds(selves, "centroids", C.train_steps)
    return coordinates(found.select(*INSTANCE, "cand", "centre"), "centre")


@register("nsa_random_centres", centres_sql("x_random", f"{KEY}, cand"))
def nsa_random_centres(spark, sf_dir):
    run = training(spark, sf_dir)
    known = nsa.params(run.vectors, C.self_percentage)
    return coordinates(nsa.random_centres(known, C, run.max_dim), "centre")


def first_test(run: pipeline.TrainingRun) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct normal points, parameters and the candidates with the radius they could have."""
    selves = self_vectors(run)
    once = materialise(nb.distinct_points(selves), "once")
    known = materialise(nsa.params(selves, C.self_percentage), "params")
    drawn = nsa.candidates(selves, known, C, run.max_dim, C.train_steps)
    return once, known, nsa.measure(drawn, once, known, NSA_ROWS, C.train_steps)


@register(
    "nsa_accept",
    f"SELECT {KEY}, {big('cand')} AS cand, {r7('radius')} AS radius FROM x_tested WHERE radius > 0",
)
def nsa_accept(spark, sf_dir):
    _, _, tested = first_test(training(spark, sf_dir))
    return nsa.accepted(tested).select(*INSTANCE, "cand", "radius")


@register(
    "nsa_perturb",
    f"""SELECT {KEY}, {big('cand')} AS cand, {big('attempt')} AS attempt, {r7('radius')} AS radius,
    {r7('list_sum(centre)')} AS centre_sum FROM x_later""",
)
def nsa_perturb(spark, sf_dir):
    run = training(spark, sf_dir)
    once, known, tested = first_test(run)
    rejected = materialise(tested, "tested").where(F.col("radius") <= 0).drop("radius")
    later = nsa.retry(rejected, once, known, C, run.max_dim, C.train_steps)
    total = F.aggregate("centre", F.lit(0.0), lambda s, x: s + x)
    return later.select(*INSTANCE, "cand", "attempt", "radius", total.alias("centre_sum"))


@register(
    "nsa_detectors",
    f"""SELECT {KEY}, {big('det_id')} AS det_id, {r7('radius')} AS radius, {r7('list_sum(centre)')} AS centre_sum
    FROM x_detectors""",
)
def nsa_detectors(spark, sf_dir):
    found = training(spark, sf_dir).nsa_model.detectors
    total = F.aggregate("centre", F.lit(0.0), lambda s, x: s + x)
    return found.select(*INSTANCE, "det_id", "radius", total.alias("centre_sum"))


@register("nsa_threshold", f"SELECT {KEY}, {r7('threshold')} AS threshold FROM x_threshold")
def nsa_threshold(spark, sf_dir):
    once = nb.distinct_points(self_vectors(training(spark, sf_dir)))
    return nsa.threshold(materialise(once, "once"), C.nsa_percentile, C.train_steps)


def query_vectors(run: pipeline.TrainingRun, frame: DataFrame) -> DataFrame:
    scaled = features.minmax_transform(frame, run.selected)
    rows = features.featurise(scaled, C.nsa_shape, C, steps=C.score_steps, scoring=True)
    return features.vectors(rows, C.nsa_shape)


@register(
    "nsa_match",
    f"""SELECT h.application, h.instance, h.t, {r7('near')} AS near, hit FROM x_hit h JOIN x_near n
    ON {o.eq('h', 'n', KEY + ', t')}""",
)
def nsa_match(spark, sf_dir):
    run, frame = scoring(spark, sf_dir)
    rows = query_vectors(run, frame).select(*INSTANCE, F.col("t").alias("qid"), "vec")
    found = nsa.match(rows, run.nsa_model, C.score_steps, NSA_ROWS)
    return found.select(*INSTANCE, F.col("qid").alias("t"), "near", "hit")


@register(
    "nsa_outer_bound",
    f"""SELECT rid, sqrt(list_sum(list_transform(vec, lambda x: 6.25 * x * x))) >
    sqrt(64 * (1 + {o.LAB_RADIUS}) * (1 + {o.LAB_RADIUS})) AS beyond FROM x_lab""",
)
def nsa_outer_bound(spark, sf_dir):
    far = F.transform("vec", lambda x: 2.5 * x)
    radius = F.sqrt(F.lit(64.0)) * C.self_percentage
    rows = tables.labelled_vectors(spark, sf_dir)
    return rows.select("rid", nsa.outside(far, F.lit(64), radius).alias("beyond"))


@register("nsa_vote", "SELECT qid AS rid, vote FROM x_vote")
def nsa_vote(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    found = nsa.neighbours_of(as_queries(rows), rows, C.neighbours)
    known = nsa.params(rows, C.self_percentage)
    return nsa.vote(found, known, C.neighbours).select(F.col("qid").alias("rid"), "vote")


RANDOM_ONLY = replace(C, seed_mode="none", max_attempts=0)  # what x_lab_det holds


def labelled_model(rows: DataFrame, cfg: DetectorConfig = C) -> nsa.NsaModel:
    """Model of the labelled vectors: class 0 is normal."""
    selves = nsa.self_points(rows).select(*INSTANCE, "rid", "vec")
    return nsa.train(selves.withColumnRenamed("rid", "t"), cfg, 64)


@register(
    "nsa_predict",
    f"""SELECT j.rid, {r7('near')} AS distance_score, anomalous OR vote AS anomalous FROM x_judged j
    JOIN x_vote v ON j.rid = v.qid JOIN x_lab_near n ON n.rid = j.rid""",
)
def nsa_predict(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    found = nsa.predict(as_queries(rows), labelled_model(rows, RANDOM_ONLY), rows, C.neighbours)
    return found.select(F.col("qid").alias("rid"), "distance_score", "anomalous")


@register(
    "nsa_predict_whole",
    f"""SELECT j.rid, {r7('near')} AS distance_score, anomalous OR vote AS anomalous FROM x_whole_judged j
    JOIN x_vote v ON j.rid = v.qid JOIN x_lab_near n ON n.rid = j.rid""",
)
def nsa_predict_whole(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    found = nsa.predict(as_queries(rows), labelled_model(rows), rows, C.neighbours)
    return found.select(F.col("qid").alias("rid"), "distance_score", "anomalous")


@register(
    "nsa_score",
    f"SELECT {KEY}, t, {r7('distance_score')} AS distance_score, {big('anomaly_bit')} AS anomaly_bit FROM x_nsa",
)
def nsa_score(spark, sf_dir):
    run, frame = scoring(spark, sf_dir)
    return pipeline.nsa_scores(frame, run.models, C)


@register(
    "nsa_train",
    f"""SELECT p.application, p.instance, {big('p.dim')} AS dim, {r7('p.self_radius')} AS self_radius,
    {r7('p.threshold')} AS threshold, n_self, n_detectors, {r7('mean_radius')} AS mean_radius FROM x_params p
    JOIN (SELECT {KEY}, count(DISTINCT vec) AS n_self FROM x_vec GROUP BY ALL) s ON {o.eq('p', 's', KEY)}
    JOIN (SELECT {KEY}, count(*) AS n_detectors, avg(radius) AS mean_radius FROM x_detectors GROUP BY ALL) d
      ON {o.eq('p', 'd', KEY)}""",
)
def nsa_train(spark, sf_dir):
    model = training(spark, sf_dir).nsa_model
    selves = model.self_points.groupBy(*INSTANCE).agg(F.count("rid").alias("n_self"))
    balls = model.detectors.groupBy(*INSTANCE).agg(
        F.count("det_id").alias("n_detectors"), F.avg("radius").alias("mean_radius")
    )
    return model.params.join(selves, [*INSTANCE]).join(balls, [*INSTANCE])


@register("nsa_tune_predict", "SELECT rid, anomalous FROM x_judged")
def nsa_tune_predict(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    found = nsa.tuning_prediction(as_queries(rows), labelled_model(rows, RANDOM_ONLY))
    return found.select(F.col("qid").alias("rid"), "anomalous")


@register("nsa_tune_predict_whole", "SELECT rid, anomalous FROM x_whole_judged")
def nsa_tune_predict_whole(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    found = nsa.tuning_prediction(as_queries(rows), labelled_model(rows))
    return found.select(F.col("qid").alias("rid"), "anomalous")


# Classes 0..4 are known at training time; at tuning time all classes are, and class 1 is normal too.
o.part(
    "x_tune_sample",
    "SELECT j.rid, j.vec, j.anomalous, CASE WHEN kind IN (0, 1) THEN 0 ELSE 1 END AS label "
    "FROM x_judged j JOIN x_lab l ON l.rid = j.rid",
)
o.part(
    "x_tune_removed",
    f"""SELECT DISTINCT det_id FROM x_lab_det d, x_tune_sample s WHERE s.label = 0 AND s.anomalous
    AND list_distance(d.centre, s.vec) < {o.LAB_RADIUS}""",
)
o.part(
    "x_tune_added",
    f"""SELECT s.rid, any_value(s.vec) AS centre, min(list_distance(s.vec, l.vec)) - {o.LAB_RADIUS} AS radius
    FROM x_tune_sample s, x_lab l WHERE s.label = 1 AND NOT s.anomalous AND l.kind <= 4 GROUP BY s.rid""",
)


o.part(
    "x_whole_sample",
    "SELECT j.rid, j.vec, j.anomalous, CASE WHEN kind IN (0, 1) THEN 0 ELSE 1 END AS label "
    "FROM x_whole_judged j JOIN x_lab l ON l.rid = j.rid",
)
o.part(
    "x_whole_removed",
    f"""SELECT DISTINCT det_id FROM x_whole_det d, x_whole_sample s WHERE s.label = 0 AND s.anomalous
    AND list_distance(d.centre, s.vec) < {o.LAB_RADIUS}""",
)
o.part(
    "x_whole_added",
    f"""SELECT s.rid, any_value(s.vec) AS centre, min(list_distance(s.vec, l.vec)) - {o.LAB_RADIUS} AS radius
    FROM x_whole_sample s, x_lab l WHERE s.label = 1 AND NOT s.anomalous AND l.kind <= 4 GROUP BY s.rid""",
)


def tuned_detectors(rows: DataFrame, cfg: DetectorConfig) -> DataFrame:
    known = rows.where(F.col("kind") <= 4)
    sample = rows.withColumn("label", F.when(F.col("kind").isin(0, 1), 0).otherwise(1))
    tuned = nsa.tune(labelled_model(rows, cfg), known, sample.select(*INSTANCE, "rid", "label", "vec"))
    total = F.aggregate("centre", F.lit(0.0), lambda s, x: s + x)
    return tuned.select("det_id", total.alias("centre_sum"), "radius")


@register(
    "nsa_tune",
    f"""SELECT {big('det_id')} AS det_id, {r7('list_sum(centre)')} AS centre_sum, {r7('radius')} AS radius FROM (
    SELECT det_id, centre, radius FROM x_lab_det WHERE det_id NOT IN (SELECT det_id FROM x_tune_removed)
    UNION ALL SELECT NULL, centre, radius FROM x_tune_added WHERE radius > 0)""",
)
def nsa_tune(spark, sf_dir):
    return tuned_detectors(labelled(spark, sf_dir), RANDOM_ONLY)


@register(
    "nsa_tune_whole",
    f"""SELECT {big('det_id')} AS det_id, {r7('list_sum(centre)')} AS centre_sum, {r7('radius')} AS radius FROM (
    SELECT det_id, centre, radius FROM x_whole_det WHERE det_id NOT IN (SELECT det_id FROM x_whole_removed)
    UNION ALL SELECT NULL, centre, radius FROM x_whole_added WHERE radius > 0)""",
)
def nsa_tune_whole(spark, sf_dir):
    return tuned_detectors(labelled(spark, sf_dir), C)


# --- two clusters -----------------------------------------------------------------------------

CENTRE_SQL = ", ".join(f"{r7(f'c{i}[{n + 1}]')} AS c{i}_{n}" for i in (0, 1) for n in range(4))


def centre_columns() -> list:
    return [F.col(f"c{i}")[n].alias(f"c{i}_{n}") for i in (0, 1) for n in range(4)]


@register("kmeans_fit", f"SELECT {SER}, {CENTRE_SQL} FROM x_centres")
def kmeans_fit(spark, sf_dir):
    rows = training(spark, sf_dir).features(C.kmeans_shape)
    found = kmeans.fit(rows, C, C.train_steps)
    return found.select(*SERIES, *centre_columns())


def training_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training(spark, sf_dir).features(C.kmeans_shape)
    return kmeans.raw_scores(rows, kmeans.fit(rows, C, C.train_steps), C)


@register("kmeans_raw_score", f"SELECT {SER}, t, {r7('raw')} AS raw FROM x_raw")
def kmeans_raw_score(spark, sf_dir):
    return training_raw(spark, sf_dir).select(*SERIES, "t", "raw")


@register(
    "kmeans_score_range",
    f"SELECT {SER}, {r7('raw_min')} AS raw_min, {r7('raw_max')} AS raw_max FROM x_limits",
)
def kmeans_score_range(spark, sf_dir):
    return kmeans.score_range(training_raw(spark, sf_dir))


@register(
    "kmeans_threshold",
    f"""SELECT {SER}, {r7('raw_min')} AS raw_min, {r7('raw_max')} AS raw_max, {r7('threshold')} AS threshold
    FROM x_limits""",
)
def kmeans_threshold(spark, sf_dir):
    return kmeans.thresholds(training_raw(spark, sf_dir), C.kmeans_percentile, C.train_steps)


@register(
    "kmeans_norm_score", f"SELECT {SER}, t, {r7('anomaly_score')} AS anomaly_score FROM x_kscore"
)
def kmeans_norm_score(spark, sf_dir):
    run, frame = scoring(spark, sf_dir)
    found = pipeline.kmeans_scores(frame, run.models_without_nsa, C)
    return found.select(*SERIES, "t", "anomaly_score")


KSCORE_SQL = f"SELECT {SER}, t, {r7('anomaly_score')} AS anomaly_score, {big('anomaly_bit')} AS anomaly_bit FROM x_kscore"


@register("kmeans_score", KSCORE_SQL)
def kmeans_score(spark, sf_dir):
    run, frame = scoring(spark, sf_dir)
    return pipeline.kmeans_scores(frame, run.models_without_nsa, C)


@register(
    "kmeans_train",
    f"""SELECT c.application, c.instance, c.metric, {CENTRE_SQL}, {r7('raw_min')} AS raw_min,
    {r7('raw_max')} AS raw_max, {r7('threshold')} AS threshold FROM x_centres c JOIN x_limits m
    ON {o.eq('c', 'm', SER)}""",
)
def kmeans_train(spark, sf_dir):
    found = training(spark, sf_dir).kmeans_models
    return found.select(*SERIES, *centre_columns(), "raw_min", "raw_max", "threshold")


# --- detections -------------------------------------------------------------------------------

RATE_SQL = f"{r7('rate')} AS rate, {big('window_start')} AS window_start, {big('window_end')} AS window_end"


@register("nsa_window_rate", f"SELECT {KEY}, {RATE_SQL} FROM x_nsa_rate")
def nsa_window_rate(spark, sf_dir):
    run, frame = scoring(spark, sf_dir)
    return detect.nsa_window_rate(pipeline.nsa_scores(frame, run.models, C), C)


@register("kmeans_window_rate", f"SELECT {SER}, {RATE_SQL} FROM x_km_rate")
def kmeans_window_rate(spark, sf_dir):
    run, frame = scoring(spark, sf_dir)
    return detect.kmeans_window_rate(pipeline.kmeans_scores(frame, run.models_without_nsa, C), C)


@register(
    "detections_flag",
    f"SELECT {SER}, {RATE_SQL}, rate >= {C.kmeans_rate_limit} AS anomaly FROM x_km_rate",
)
def detections_flag(spark, sf_dir):
    run, frame = scoring(spark, sf_dir)
    rates = detect.kmeans_window_rate(pipeline.kmeans_scores(frame, run.models_without_nsa, C), C)
    return detect.flagged(rates, C.kmeans_rate_limit)


DETECTION_SQL = f"""SELECT {big(str(NOW))} AS time, measurement, application_name, node, method, metrics, level,
    {r7('metricValue')} AS "metricValue", anomaly, {big('predictionTime')} AS "predictionTime",
    {big('window_start')} AS window_start, {big('window_end')} AS window_end FROM x_detections"""


@register("detections", DETECTION_SQL)
def detections(spark, sf_dir):
    run = training(spark, sf_dir)
    return pipeline.detections(run.points, run.models, NOW, C)


@register(
    "detection_measurement",
    """SELECT event_id, '_predicted_two_' || replace(event_type, ' ', '_') || '_instance_' || CAST(user_id % 4 AS VARCHAR)
    || '_adt_' || event_type AS measurement FROM events""",
)
def detection_measurement(spark, sf_dir):
    method = F.concat(F.lit("two "), F.col("event_type"))
    node = F.concat(F.lit("instance_"), F.col("user_id") % 4)
    metric = F.concat(F.lit("adt_"), F.col("event_type"))
    return tables.read(spark, sf_dir, "events").select(
        "event_id", detect.measurement_name(method, node, metric).alias("measurement")
    )


@register(
    "alerts_json",
    f"""SELECT application_name AS application, node, method, metrics, {r7('metricValue')} AS rate,
    'topic://allmetrics' AS topic, '2024-01-31T00:00:00Z' AS "when", {big('3')} AS level FROM x_detections WHERE anomaly""",
)
def alerts_json(spark, sf_dir):
    run = training(spark, sf_dir)
    found = detect.alerts(pipeline.detections(run.points, run.models, NOW, C), NOW, C)
    field = lambda name: F.get_json_object("body", f"$.{name}")
    plain = F.regexp_replace(field("metrics"), r'[\[\]"]', "")
    return found.select(
        "application",
        field("node").alias("node"),
        field("method").alias("method"),
        plain.alias("metrics"),
        field("window_anomaly_rate").cast("double").alias("rate"),
        "topic",
        field("when").alias("when"),
        field("level").cast("long").alias("level"),
    )


@register(
    "prediction_time",
    f"SELECT event_id, {big(o.slot('sec', 'margin', 300))} AS prediction_time FROM (SELECT event_id, "
    f"{o.SECONDS.format('ts')} AS sec, {big('floor(value * 10)')} AS margin FROM events)",
)
def prediction_time(spark, sf_dir):
    now = epoch(F.col("ts").cast("timestamp"))
    margin = F.floor(F.col("value") * 10)
    return tables.read(spark, sf_dir, "events").select(
        "event_id", detect.prediction_time(now, 300, margin).alias("prediction_time")
    )


@register(
    "model_for_cycle",
    f"""WITH made AS (SELECT {SHOP_SQL}, event_id AS model_id, {o.SECONDS.format('ts')} AS trained_at FROM events
      WHERE event_type = 'signup'),
    cycles AS (SELECT {KEY}, unnest(generate_series(min(trained_at // 3600 * 3600), max(trained_at // 3600 * 3600), 3600))
      AS cycle_at FROM made GROUP BY {KEY})
    SELECT c.application, c.instance, {big('c.cycle_at')} AS cycle_at, arg_max(model_id, ROW(trained_at, model_id)) AS model_id,
      max(trained_at) AS trained_at FROM cycles c LEFT JOIN made m ON {o.eq('c', 'm', KEY)} AND trained_at <= cycle_at
      AND cycle_at < trained_at + 12 * 3600 GROUP BY ALL""",
)
def model_for_cycle(spark, sf_dir):
    rows = tables.points(spark, sf_dir, SHOPS).where(F.col("measurement") == "sys_signup")
    trained = tables.read(spark, sf_dir, "events").where(F.col("event_type") == "signup")
    models = trained.select(
        F.concat(F.lit("shop_"), F.col("user_id") % SHOPS).alias("application"),
        F.concat(F.lit("instance_"), F.floor(F.col("user_id") / SHOPS) % 2).alias("instance"),
        F.col("event_id").alias("model_id"),
        epoch(F.col("ts").cast("timestamp")).alias("trained_at"),
    )
    means = align.grid_means(rows.withColumn("metric", F.col("measurement")), 3600)
    cycles = align.spine(means, 3600).withColumnRenamed("t", "cycle_at")
    return detect.model_for_cycle(cycles, models, C)


# --- stored detections --------------------------------------------------------------------------

FIELD_TEXT = ", ".join(
    f'CAST("{f}" AS VARCHAR) AS "{f}"' for f in store.FIELDS
)
FIELD_NAMES = ", ".join(f'"{f}"' for f in store.FIELDS)


def detection_store(spark: SparkSession, sf_dir: str) -> str:
    """Written in three parts, the first two of them compacted."""
    rows, path = tables.stored_detections(spark, sf_dir), stage_path(spark, "detection-store")
    for part in range(3):
        upserts.upsert(rows.where(F.pmod("written", F.lit(3)) == part), path)
        if part == 1:
            upserts.compact(spark, path)
    return path


@register(
    "q_recent_detections",
    f"""SELECT {big('time')} AS time, method, node, metrics, field, field_value FROM (UNPIVOT (
    SELECT time, method, node, metrics, {FIELD_TEXT} FROM x_current WHERE application_name = 'shop_0'
      AND time >= {NOW - DAY} AND time < {NOW}) ON {FIELD_NAMES} INTO NAME field VALUE field_value)""",
)
def q_recent_detections(spark, sf_dir):
    path = detection_store(spark, sf_dir)
    return store.recent_detections(upserts.entries(spark, path, NOW - DAY, NOW), "shop_0", NOW)


@register(
    "q_kmeans_over",
    f"""SELECT {big('time')} AS time, node, metrics, {r7('metricValue')} AS anomaly_rate FROM x_current
    WHERE method = 'kmeans' AND metricValue > 30.0 AND time >= {NOW - 6 * 3600} AND time < {NOW}""",
)
def q_kmeans_over(spark, sf_dir):
    return store.kmeans_over(tables.stored_detections(spark, sf_dir), NOW, C)


@register(
    "q_nsa_mean_by_node",
    f"""SELECT node, {r7('avg(metricValue)')} AS mean_rate FROM x_current WHERE method = 'nsa'
    AND time >= {NOW - 12 * 3600} AND time < {NOW} GROUP BY ALL""",
)
def q_nsa_mean_by_node(spark, sf_dir):
    return store.nsa_mean_by_node(tables.stored_detections(spark, sf_dir), NOW, C)


@register(
    "detections_latest",
    f"""SELECT {big('time')} AS time, measurement, application_name, node, method, metrics, level,
    {r7('arg_max(metricValue, event_id)')} AS "metricValue", arg_max(anomaly, event_id) AS anomaly,
    {big('any_value(predictionTime)')} AS "predictionTime", {big('any_value(window_start)')} AS window_start,
    {big('any_value(window_end)')} AS window_end FROM x_stored
    GROUP BY x_stored.time, measurement, application_name, node, method, metrics, level""",
)
def detections_latest(spark, sf_dir):
    return upserts.read(spark, detection_store(spark, sf_dir)).drop("written")


def point_store(spark: SparkSession, sf_dir: str) -> str:
    path = stage_path(spark, "point-store")
    store.write_points(tables.points(spark, sf_dir), path)
    return path


@register(
    "retention_keep", f"SELECT {POINT_SQL} FROM x_points WHERE ts >= {o.moment(NOW - 10 * DAY)}"
)
def retention_keep(spark, sf_dir):
    path = point_store(spark, sf_dir)
    store.drop_expired(spark, path, NOW, 10 * DAY)
    return source.read_points(spark, path).select(*POINT)


@register(
    "purge_keep",
    f"""SELECT {POINT_SQL} FROM x_points WHERE NOT (measurement = 'adt_error' AND
    ts >= {o.moment(LO)} AND ts <= {o.moment(MID)})""",
)
def purge_keep(spark, sf_dir):
    path = point_store(spark, sf_dir)
    store.delete_points(spark, path, LO, MID, "adt_error")
    return source.read_points(spark, path).select(*POINT)


# --- streaming --------------------------------------------------------------------------------

DELAY = 600
o.part("x_seen", f"SELECT max(us) - {DELAY} * 1000000 AS watermark FROM x_series")
o.part("x_all_mm", f"SELECT {SER}, sec - sec % {C.freq} AS t, avg(value) AS value FROM x_series GROUP BY ALL")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = tables.read(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )


def point_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.series_points(tables.as_points(event_stream(spark, sf_dir)), C.metric_prefix)


def landed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end into a table and read the table."""
    path = stage_path(spark, name)
    streams.run_available(streams.table_sink(stream, path, f"{path}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


@register(
    "stream_minute_mean",
    f"""SELECT {SER}, t, {r7('value')} AS value FROM x_all_mm, x_seen
    WHERE (t + {C.freq}) * 1000000 <= watermark""",
)
def stream_minute_mean(spark, sf_dir):
    means = streams.grid_mean_stream(point_stream(spark, sf_dir), C, f"{DELAY} seconds")
    found = landed(spark, means, "stream-means")
    return found.select(*SERIES, epoch(F.col("step.start")).alias("t"), "value")


SLIDE = C.horizon
o.part(
    "x_windows",
    f"""SELECT w AS window_end FROM (SELECT unnest(generate_series({LO} + {SLIDE}, {NOW} + {C.score_seconds}, {SLIDE})) AS w),
    x_seen WHERE w * 1000000 <= watermark""",
)


# Every scoring window is an instance of its own in the SQL of the batch, next to a copy of its model.
WINDOWED = "instance || '@' || CAST(window_end AS VARCHAR)"
MODEL_PARTS = ("x_selected", "x_vec", "x_params", "x_detectors", "x_centres", "x_limits")
SCORE_PARTS = ("x_sc_bounds", "x_sc_spine", "x_sc_reindex", "x_sc_interp", "x_sc_aligned", "x_sc_scaled", "x_sc_diff",
               "x_sc_smooth", "x_sc_lags", "x_sc_warm", "x_qvec", "x_near", "x_hit", "x_nsa", "x_kraw", "x_kscore")
for name in MODEL_PARTS:
    o.part(name.replace("x_", "xw_", 1), f"SELECT m.* REPLACE ({WINDOWED} AS instance) FROM {name} m, x_windows")
o.part(
    "xw_sc_mm",
    f"""SELECT application, {WINDOWED} AS instance, metric, t, value FROM x_all_mm, x_windows
    WHERE t >= window_end - {C.score_seconds} AND t < window_end AND ({SER}) IN (SELECT ({SER}) FROM x_gate)""",
)
OF_WINDOWS = "|".join(n[2:] for n in ("x_sc_mm", *SCORE_PARTS, *MODEL_PARTS))
for name in SCORE_PARTS:
    o.part(name.replace("x_", "xw_", 1), re.sub(rf"\bx_(?=(?:{OF_WINDOWS})\b)", "xw_", o.PARTS[name]))
SPLIT = "split_part(instance, '@', 1) AS instance, CAST(split_part(instance, '@', 2) AS BIGINT) AS window_end"
WINDOW_RATE = f"sum(anomaly_bit) * 100.0 / (count(*) * {C.anomaly_bit_max}) AS rate, min(t) AS window_start, max(t) AS last_step"
o.part(
    "x_window_rates",
    f"""SELECT 'nsa' AS method, application, {SPLIT}, CAST(NULL AS VARCHAR) AS metric, {WINDOW_RATE} FROM xw_nsa GROUP BY ALL
    UNION ALL SELECT 'kmeans', application, {SPLIT}, metric, {WINDOW_RATE} FROM xw_kscore GROUP BY ALL""",
)
o.part(
    "x_window_flags",
    f"SELECT *, rate >= CASE WHEN method = 'nsa' THEN {C.nsa_rate_limit} ELSE {C.kmeans_rate_limit} END AS anomaly FROM x_window_rates",
)


SLIDING_SQL = f"""SELECT {SER}, {big('window_end')} AS window_end, count(*) AS steps, {r7('sum(value)')} AS total
    FROM x_all_mm, x_windows WHERE t >= window_end - {C.score_seconds} AND t < window_end GROUP BY ALL"""


@register("stream_sliding", SLIDING_SQL)
def stream_sliding(spark, sf_dir):
    means = streams.grid_mean_stream(point_stream(spark, sf_dir), C, f"{DELAY} seconds")
    found = landed(spark, streams.sliding_windows(means, C, SLIDE), "stream-windows")
    return window_totals(found)


def window_totals(found: DataFrame) -> DataFrame:
    total = F.aggregate("points", F.lit(0.0), lambda s, p: s + p["value"])
    return found.select(
        *SERIES,
        epoch(F.col("span.end")).alias("window_end"),
        F.size("points").alias("steps"),
        total.alias("total"),
    )


@register("stream_carried", SLIDING_SQL)
def stream_carried(spark, sf_dir):
    """The same windows from state that is carried from one to the next."""
    means = streams.grid_mean_stream(point_stream(spark, sf_dir), C, f"{DELAY} seconds")
    with rings.state_store(spark):
        found = landed(spark, rings.carried_windows(means, C, SLIDE), "stream-carried")
    return window_totals(found)


@register(
    "stream_score",
    f"""SELECT method, {KEY}, metric, {big('window_end')} AS window_end, {r7('rate')} AS rate,
    {big('window_start')} AS window_start, {big('last_step')} AS last_step FROM x_window_rates""",
)
def stream_score(spark, sf_dir):
    models = training(spark, sf_dir).models
    means = streams.grid_mean_stream(point_stream(spark, sf_dir), C, f"{DELAY} seconds")
    found = landed(spark, streams.sliding_windows(means, C, SLIDE), "stream-windows")
    return streams.score_windows(found, models, C)


@register(
    "stream_sinks",
    """SELECT application AS application_name, method, count(*) AS stored, CAST(count_if(anomaly) AS BIGINT) AS flagged,
    nullif(CAST(count_if(anomaly) AS BIGINT), 0) AS published FROM x_window_flags GROUP BY ALL""",
)
def stream_sinks(spark, sf_dir):
    models = training(spark, sf_dir).models
    path = stage_path(spark, "sinks")
    means = streams.grid_mean_stream(point_stream(spark, sf_dir), C, f"{DELAY} seconds")
    sink = streams.detection_sink(
        streams.sliding_windows(means, C, SLIDE),
        lambda: models,
        C,
        f"{path}/detections",
        f"{path}/alerts",
        f"{path}/checkpoint",
    )
    streams.run_available(sink)
    stored = spark.read.parquet(f"{path}/detections").select("application_name", "method", "anomaly")
    sent = spark.read.schema("topic string, application string, body string").json(f"{path}/alerts")
    method = F.get_json_object("body", "$.method")
    published = sent.groupBy(F.col("application").alias("application_name"), method.alias("method"))
    return (
        stored.groupBy("application_name", "method")
        .agg(F.count(F.lit(1)).alias("stored"), F.count_if("anomaly").alias("flagged"))
        .join(published.agg(F.count(F.lit(1)).alias("published")), ["application_name", "method"], "left")
    )


@register(
    "stream_carried_detections",
    f"""SELECT application AS application_name, instance AS node, method, metric,
    {big('window_end')} AS time, {r7('rate')} AS metricValue, anomaly, {big('window_start')} AS window_start,
    {big('last_step')} AS window_end FROM x_window_flags""",
)
def stream_carried_detections(spark, sf_dir):
    """Detections of every window of the stream, stored by a sink that reads carried windows."""
    models = training(spark, sf_dir).models
    path = stage_path(spark, "carried")
    means = streams.grid_mean_stream(point_stream(spark, sf_dir), C, f"{DELAY} seconds")
    windows = rings.carried_windows(means, C, SLIDE)
    folders = [f"{path}/{name}" for name in ("detections", "alerts", "checkpoint")]
    with rings.state_store(spark):
        streams.run_available(streams.detection_sink(windows, lambda: models, C, *folders))
    metric = F.when(F.col("method") == C.kmeans_method, F.col("metrics")).alias("metric")
    return spark.read.parquet(folders[0]).select(
        "application_name", "node", "method", metric, epoch(F.col("time")).alias("time"),
        "metricValue", "anomaly", "window_start", "window_end",
    )


@register(
    "stream_late",
    f"""SELECT {SER}, t, {r7('value')} AS value FROM (SELECT {SER}, sec - sec % {C.freq} AS t, avg(value) AS value
    FROM x_series WHERE sec >= {MID} GROUP BY ALL), x_seen WHERE (t + {C.freq}) * 1000000 <= watermark""",
)
def stream_late(spark, sf_dir):
    """The newest days arrive first; everything older is then later than the watermark."""
    path = stage_path(spark, "late")
    events = tables.read(spark, sf_dir, "events")
    split = F.unix_seconds(F.col("ts").cast("timestamp")) >= MID
    events.where(split).write.parquet(f"{path}/in")
    out, mark = f"{path}/out", f"{path}/checkpoint"

    def run() -> None:
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        rows = source.series_points(tables.as_points(stream), C.metric_prefix)
        means = streams.grid_mean_stream(rows, C, f"{DELAY} seconds")
        streams.run_available(streams.table_sink(means, out, mark))

    run()
    events.where(~split).write.mode("append").parquet(f"{path}/in")
    run()
    found = spark.read.parquet(out)
    return found.select(*SERIES, epoch(F.col("step.start")).alias("t"), "value")


@register("stream_registry", "SELECT application, version FROM x_registry")
def stream_registry(spark, sf_dir):
    path = stage_path(spark, "registry")
    messages = tables.as_control(event_stream(spark, sf_dir))
    streams.run_available(streams.registry_sink(messages, f"{path}/log", f"{path}/checkpoint"))
    return control.registry(spark.read.parquet(f"{path}/log"))
