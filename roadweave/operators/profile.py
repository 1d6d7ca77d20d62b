"""Data profile, readiness, model suitability and reports, off the station-day roll-up.

Every function here works on a handful of rows; the one pass over the lane table
is :func:`roadweave.operators.summary.station_day`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.rules import accuracy_midpoint
from roadweave.operators.summary import MEASURES, mean_of

# --- fixed values: readiness gates and model texts -------------------------
SEQUENCE_GATE = {"records": 50_000, "days": 5, "completeness": 80, "stations": 3}
BOOSTED_GATE = {"records": 10_000, "completeness": 70, "stations": 2}
FOREST_GATE = {"records": 5_000, "completeness": 60}
TARGETS = ("speed", "volume_total", "occupancy")
MODEL_TEXTS = {
    "lstm_time_series": {
        "pros": ("時間序列學習", "長期依賴捕捉", "15分鐘預測"),
        "cons": ("需要大量數據", "訓練時間長", "需要GPU"),
        "expected_accuracy": "85-92%",
    },
    "xgboost_ensemble": {
        "pros": ("高預測精度", "特徵重要性", "快速訓練"),
        "cons": ("需要調參", "記憶體需求高"),
        "expected_accuracy": "80-88%",
    },
    "random_forest_baseline": {
        "pros": ("穩定基線", "易於理解", "抗過擬合"),
        "cons": ("精度較低", "預測速度慢"),
        "expected_accuracy": "75-82%",
    },
}
PRIORITIES = ("🥇 首選", "🥈 次選", "🥉 備選")
RECORDS_PER_TRAINING_HOUR = 720


def by_dataset(rollup: DataFrame) -> DataFrame:
    """Roll-up rows tagged with the overlapping datasets: all, and peak or off-peak."""
    tags = F.array(F.lit("all"), F.when(F.col("is_peak"), "peak").otherwise("offpeak"))
    return rollup.withColumn("dataset", F.explode(tags))


def dataset_profile(rollup: DataFrame) -> DataFrame:
    """Rows, mean speed and volume, stations and cell completeness per dataset."""
    return (
        by_dataset(rollup)
        .groupBy("dataset")
        .agg(
            F.sum("n").alias("records"),
            F.round(mean_of("speed"), 2).alias("avg_speed"),
            F.round(mean_of("volume_total"), 2).alias("avg_volume"),
            F.countDistinct("vd_id").alias("unique_vd_stations"),
            F.round(
                F.sum("cells") * 100.0 / F.sum(F.col("n") * F.col("n_columns")), 1
            ).alias("completeness"),
        )
    )


def facts(rollup: DataFrame, compatible: bool = True) -> DataFrame:
    """Every base figure of the lane table as one row, from one aggregation.

    ``total_records`` is the number of lane rows. ``all_records`` adds up the
    overlapping datasets, so it counts a row twice (all, and peak or off-peak);
    with ``compatible=False`` it counts each row once.
    """
    peak = F.col("is_peak")
    targets = [t for t in TARGETS if f"{t}_n" in rollup.columns]

    def mean_where(measure: str, cond: Column) -> Column:
        return F.try_divide(
            F.sum(F.when(cond, F.col(f"{measure}_sum"))), F.sum(F.when(cond, F.col(f"{measure}_n")))
        )

    def rows_where(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    span = F.unix_micros(F.max("last_time").cast("timestamp")) - F.unix_micros(
        F.min("first_time").cast("timestamp")
    )
    base = rollup.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        rows_where(peak).alias("peak_records"),
        rows_where(~peak).alias("offpeak_records"),
        F.countDistinct("vd_id").alias("unique_vd_stations"),
        F.countDistinct("date").alias("time_span_days"),
        (span / F.lit(3_600_000_000.0)).alias("hours"),
        *[
            F.try_divide(F.sum(f"{t}_n") * 100.0, F.sum("n")).alias(f"{t}_completeness")
            for t in targets
        ],
        mean_where("volume_total", peak).alias("peak_volume"),
        mean_where("volume_total", ~peak).alias("offpeak_volume"),
        mean_where("speed", peak).alias("peak_speed"),
    )
    mean: Column = F.lit(0.0)
    for t in targets:
        mean = mean + F.col(f"{t}_completeness")
    return base.withColumns(
        {
            "all_records": F.col("total_records") * (2 if compatible else 1),
            "time_span_hours": F.coalesce("hours", F.col("time_span_days") * 24.0),
            "avg_completeness": F.coalesce(mean / max(len(targets), 1), F.lit(0.0)),
        }
    ).drop("hours")


def _coverage_columns() -> list[Column]:
    total, days = F.col("all_records"), F.col("time_span_days")
    return [
        total.alias("total_records"),
        days.alias("unique_dates"),
        days.alias("date_span_days"),
        F.round(total / F.greatest(days, F.lit(1)), 0).alias("records_per_day"),
        F.round(total / F.lit(float(RECORDS_PER_TRAINING_HOUR)), 1).alias(
            "estimated_ai_training_hours"
        ),
    ]


def time_coverage(base: DataFrame) -> DataFrame:
    """Rows, dates, rows per day and training hours, from the facts row."""
    return base.select(*_coverage_columns())


def readiness(base: DataFrame) -> DataFrame:
    """The facts row with the three model gates and the 0-100 readiness score.

    The score is 50 when there is no data.
    """
    n, done = F.col("total_records"), F.col("avg_completeness")
    stations, days = F.col("unique_vd_stations"), F.col("time_span_days")
    sequence = (
        (n >= SEQUENCE_GATE["records"])
        & (days >= SEQUENCE_GATE["days"])
        & (done >= SEQUENCE_GATE["completeness"])
        & (stations >= SEQUENCE_GATE["stations"])
    )
    boosted = (
        (n >= BOOSTED_GATE["records"])
        & (done >= BOOSTED_GATE["completeness"])
        & (stations >= BOOSTED_GATE["stations"])
    )
    forest = (n >= FOREST_GATE["records"]) & (done >= FOREST_GATE["completeness"])
    gate = F.when(sequence, 40.0).when(boosted, 25.0).when(forest, 15.0).otherwise(0.0)
    score = (
        gate
        + F.least(F.lit(30.0), done * 0.3)
        + F.least(F.lit(20.0), days * 2.0)
        + F.least(F.lit(10.0), stations * 2.0)
    )
    return base.withColumns(
        {
            "lstm_ready": sequence.cast("int"),
            "xgboost_ready": boosted.cast("int"),
            "rf_ready": forest.cast("int"),
            "prediction_ready": (sequence | boosted).cast("int"),
            "prediction_score": F.when(n == 0, 50.0).otherwise(score),
        }
    )


READINESS_COLUMNS = (
    "total_records",
    "unique_vd_stations",
    "time_span_days",
    "time_span_hours",
    "speed_completeness",
    "volume_total_completeness",
    "occupancy_completeness",
    "avg_completeness",
    "lstm_ready",
    "xgboost_ready",
    "rf_ready",
    "prediction_ready",
    "prediction_score",
)


def _quality_parts() -> dict[str, Column]:
    peak, off = F.col("peak_records"), F.col("offpeak_records")
    return {
        "volume_score": F.least(F.lit(100.0), F.col("all_records") / 1000.0),
        "time_score": F.least(F.lit(100.0), F.col("time_span_days") * 20.0),
        "balance_score": F.when(
            (peak > 0) & (off > 0), F.least(peak, off) * 100.0 / F.greatest(peak, off)
        ).otherwise(50.0),
        "prediction_score": F.col("prediction_score"),
    }


def overall_quality() -> Column:
    p = _quality_parts()
    return F.round(
        p["volume_score"] * 0.3
        + p["time_score"] * 0.3
        + p["balance_score"] * 0.2
        + p["prediction_score"] * 0.2,
        1,
    )


def _quality_columns() -> list[Column]:
    parts = [F.round(c, 1).alias(n) for n, c in _quality_parts().items()]
    return [*parts, overall_quality().alias("overall_quality")]


def quality_metrics(ready: DataFrame) -> DataFrame:
    """Volume, time, balance and readiness scores and their weighted sum."""
    return ready.select(*_quality_columns())


def _suitability() -> Column:
    """The three model families as an array of structs, from a readiness row."""
    n, done = F.col("total_records"), F.col("avg_completeness")
    score = {
        "lstm_time_series": F.least(F.lit(50.0), n / 1000.0)
        + F.least(F.lit(30.0), F.col("time_span_days") * 4.0)
        + F.least(F.lit(20.0), done * 0.2),
        "xgboost_ensemble": F.least(F.lit(100.0), n / 10000.0 * 40 + done * 0.6),
        "random_forest_baseline": F.least(F.lit(100.0), n / 5000.0 * 35 + done * 0.65),
    }
    gate = {
        "lstm_time_series": "lstm_ready",
        "xgboost_ensemble": "xgboost_ready",
        "random_forest_baseline": "rf_ready",
    }
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(m).alias("model"),
                F.round(score[m], 1).alias("score"),
                F.col(gate[m]).alias("suitable"),
                F.array(*[F.lit(t) for t in text["pros"]]).alias("pros"),
                F.array(*[F.lit(t) for t in text["cons"]]).alias("cons"),
                F.lit(text["expected_accuracy"]).alias("expected_accuracy"),
            )
            for i, (m, text) in enumerate(MODEL_TEXTS.items())
        ]
    )


def _recommended(keep: int) -> Column:
    """The suitable families, best score first, ranked and labelled."""

    def better(a: Column, b: Column) -> Column:
        return (
            F.when(a["score"] > b["score"], -1)
            .when(a["score"] < b["score"], 1)
            .otherwise(a["position"] - b["position"])
        )

    labels = F.array(*[F.lit(p) for p in PRIORITIES])
    ordered = F.array_sort(F.filter(_suitability(), lambda m: m["suitable"] == 1), better)

    def entry(m: Column, i: Column) -> Column:
        rank = i + 1
        return F.struct(
            rank.alias("rank"),
            m["model"].alias("model"),
            F.coalesce(
                F.try_element_at(labels, rank), F.concat(F.lit("#"), rank.cast("string"))
            ).alias("priority"),
            m["score"].alias("score"),
            F.concat(F.lit("適合交通預測的"), m["model"], F.lit("模型")).alias("reason"),
            F.slice(m["pros"], 1, 2).alias("pros"),
            m["expected_accuracy"].alias("expected_accuracy"),
            accuracy_midpoint(m["expected_accuracy"]).alias("expected_accuracy_mid"),
        )

    return F.transform(F.slice(ordered, 1, keep), entry)


def model_suitability(ready: DataFrame) -> DataFrame:
    """Score, gate and texts for each model family, one row per family."""
    return ready.select(F.explode(_suitability()).alias("r")).select("r.*")


def recommendations(ready: DataFrame, keep: int = 3) -> DataFrame:
    """Suitable models by score, best first, with place labels."""
    return ready.select(F.explode(_recommended(keep)).alias("r")).select("r.*")


def _insight_messages() -> Column:
    total, days, stations = F.col("all_records"), F.col("time_span_days"), F.col("unique_vd_stations")
    return F.array(
        F.when(
            total > 50_000,
            F.concat(
                F.lit("🚀 優秀數據規模："), F.format_number(total, 0), F.lit("筆記錄支援深度學習模型")
            ),
        ),
        F.when(F.col("lstm_ready") == 1, "🎯 LSTM模型就緒：數據符合時間序列深度學習要求")
        .when(F.col("xgboost_ready") == 1, "📊 XGBoost模型就緒：適合高精度梯度提升預測")
        .when(F.col("rf_ready") == 1, "🌲 隨機森林模型就緒：適合作為預測基線"),
        F.when(
            days >= 7,
            F.concat(F.lit("📅 週期性分析就緒："), days, F.lit("天數據支援週期模式學習")),
        ),
        F.when(
            stations >= 5,
            F.concat(F.lit("🛣️ 多站點預測："), stations, F.lit("個VD站點支援路段級預測")),
        ),
    )


def _action_messages() -> Column:
    top = F.try_element_at(_recommended(1), F.lit(1))
    return F.array(
        F.concat(F.lit("🎯 立即開發 "), top["model"], F.lit(" 模型")),
        F.concat(F.lit("📈 預期準確率: "), top["expected_accuracy"]),
        F.when(F.col("lstm_ready") == 1, "🚀 數據符合LSTM要求 - 可開始深度學習開發"),
        F.when(F.col("unique_vd_stations") >= 5, "🛣️ 多站點預測能力 - 可實現路段級交通預測"),
    )


def insights(ready: DataFrame) -> DataFrame:
    """Messages whose threshold is met, in fixed order."""
    return _numbered(ready, _insight_messages(), "insight")


def actions(ready: DataFrame) -> DataFrame:
    """What to do next, from the best model and the readiness flags."""
    return _numbered(ready, _action_messages(), "action")


def _present(messages: Column) -> Column:
    return F.filter(messages, lambda m: m.isNotNull())


def _numbered(df: DataFrame, messages: Column, name: str) -> DataFrame:
    return df.select(F.posexplode(_present(messages)).alias("position", name)).withColumn(
        "position", F.col("position") + 1
    )


def report(rollup: DataFrame, compatible: bool = True) -> DataFrame:
    """Everything above as one row of structs, ready for ``to_json``."""
    ready = readiness(facts(rollup, compatible))
    profile = dataset_profile(rollup)
    listed = profile.select(
        F.sort_array(F.collect_list(F.struct(*profile.columns))).alias("rows")
    ).scalar()

    return ready.select(
        listed.alias("data_summary"),
        F.struct(*_quality_columns()).alias("quality_assessment"),
        F.struct(*_coverage_columns()).alias("time_coverage"),
        F.struct(*READINESS_COLUMNS).alias("prediction_readiness"),
        _suitability().alias("model_suitability"),
        _recommended(3).alias("recommendations"),
        _present(_insight_messages()).alias("key_insights"),
        _present(_action_messages()).alias("actionable_recommendations"),
    )


def peak_comparison(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy(
        F.when(F.col("is_peak"), "peak").otherwise("offpeak").alias("period")
    ).agg(
        mean_of("speed").alias("avg_speed"),
        mean_of("volume_total").alias("avg_volume"),
        F.sum("n").alias("records"),
    )


def vehicle_mix(rollup: DataFrame) -> DataFrame:
    """Mean and summed volume per vehicle class, one row per class."""
    classes = [m for m in MEASURES if m in ("volume_small", "volume_large", "volume_truck")]
    row = rollup.agg(
        *[mean_of(c).alias(f"{c}__mean") for c in classes],
        *[F.sum(f"{c}_sum").alias(f"{c}__sum") for c in classes],
    )
    parts = ", ".join(f"'{c}', {c}__mean, {c}__sum" for c in classes)
    return row.select(
        F.expr(f"stack({len(classes)}, {parts}) as (vehicle_class, mean_volume, total_volume)")
    )


def dataset_quality(rollup: DataFrame) -> DataFrame:
    """Rows, measured completeness and quality score per dataset."""
    return dataset_profile(rollup).select(
        "dataset",
        "records",
        "completeness",
        F.when(F.col("records") > 1000, 90.0).otherwise(70.0).alias("quality_score"),
    )


def kpis(ready: DataFrame) -> DataFrame:
    """The dashboard figures as one row."""
    top = F.try_element_at(_recommended(1), F.lit(1))
    figures = ready.select(
        F.col("all_records").alias("total_records"),
        F.col("lstm_ready").alias("ai_ready"),
        F.coalesce(top["model"], F.lit("無推薦")).alias("top_model"),
        F.coalesce(top["score"], F.lit(0.0)).alias("top_score"),
        F.coalesce("peak_volume", F.lit(0.0)).alias("peak_volume"),
        F.coalesce("offpeak_volume", F.lit(0.0)).alias("offpeak_volume"),
        F.coalesce("peak_speed", F.lit(75.0)).alias("avg_speed"),
        overall_quality().alias("overall_quality"),
    )
    good = (
        (F.col("ai_ready") == 1) & (F.col("overall_quality") >= 80) & (F.col("total_records") >= 50_000)
    )
    return figures.withColumns(
        {
            "system_status": F.when(good, 100).otherwise(75),
            "prediction_ready": F.when(F.col("ai_ready") == 1, 90).otherwise(60),
        }
    )


def next_action(pending_files: DataFrame, stored_dates: DataFrame) -> DataFrame:
    """What the store needs: ingest pending files, analyse stored days, or get data."""
    counts = pending_files.agg(F.count(F.lit(1)).alias("pending_files")).withColumn(
        "stored_dates", stored_dates.agg(F.count(F.lit(1))).scalar()
    )
    pending, stored = F.col("pending_files") > 0, F.col("stored_dates") > 0
    return counts.withColumns(
        {
            "overall_readiness": F.when(pending, "raw_processing_needed")
            .when(stored, "ready_for_analysis")
            .otherwise("no_data"),
            "next_action": F.when(pending, "process_raw_files")
            .when(stored, "proceed_to_analysis")
            .otherwise("add_raw_files"),
        }
    )
