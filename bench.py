"""Fleet benchmark: one JSON line with the seconds per stage and fleet size.

Every stage is timed on its own on written inputs of the stage before, for fleets of 4, 20 and 200
instances over the same events; ``rate`` lists instance-windows trained and scored per second. The
``fixed_`` entries take 2 and 20 of the 200 instances, so every instance has as many points as there:
they and the fleet of 200 show how the work grows with the number of instances alone.
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilseries.functions.storage import materialise  # noqa: E402
from vigilseries.plans import catalog, pipeline, tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FLEETS = {"4": 2, "20": 10, "200": 100}
FIXED = [2, 20]
SINGLE = ["align_fleet", "outliers_iqr", "knn_labelled", "detections_latest", "stream_minute_mean"]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("vigilseries-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}
    rates: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    # warm-up: JVM, code generation and Python workers
    pipeline.TrainingRun(tables.points(spark, SF_DIR), tables.NOW, tables.CONFIG).selected

    cfg = replace(tables.CONFIG, min_records=20)
    for fleet, groups in FLEETS.items():
        points = tables.points(spark, SF_DIR, groups)
        run = pipeline.TrainingRun(points, tables.NOW, cfg)
        timed(f"align_{fleet}", lambda: run.aligned)
        timed(f"select_{fleet}", lambda: run.selected)
        timed(f"featurise_{fleet}", lambda: (run.features(cfg.nsa_shape), run.vectors))
        timed(f"nsa_train_{fleet}", lambda: run.nsa_model)
        timed(f"kmeans_train_{fleet}", lambda: run.kmeans_models)
        frame = materialise(
            pipeline.scoring_frame(points, run.models, tables.NOW, cfg), "bench-scoring"
        )
        timed(f"nsa_score_{fleet}", lambda: drain(pipeline.nsa_scores(frame, run.models, cfg)))
        timed(
            f"kmeans_score_{fleet}", lambda: drain(pipeline.kmeans_scores(frame, run.models, cfg))
        )
        timed(
            f"detections_{fleet}",
            lambda: drain(pipeline.detections(points, run.models, tables.NOW, cfg)),
        )
        train = sum(
            seconds[f"{s}_{fleet}"]
            for s in ("align", "select", "featurise", "nsa_train", "kmeans_train")
        )
        rates[f"trained_per_sec_{fleet}"] = round(int(fleet) / train, 3)
        rates[f"scored_per_sec_{fleet}"] = round(int(fleet) / seconds[f"detections_{fleet}"], 3)

    for count in FIXED:
        shops = [f"shop_{k}" for k in range(count // 2)]
        points = tables.points(spark, SF_DIR, FLEETS["200"]).where(F.col("application").isin(shops))
        run = pipeline.TrainingRun(points, tables.NOW, cfg)
        timed(f"fixed_train_{count}", lambda: (run.nsa_model, run.kmeans_models))
        timed(
            f"fixed_detections_{count}",
            lambda: drain(pipeline.detections(points, run.models, tables.NOW, cfg)),
        )

    for name in SINGLE:
        timed(name, lambda: drain(catalog.QUERIES[name](spark, SF_DIR)))

    print(
        json.dumps(
            {
                "metric": "fleet_detection_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rate": rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
