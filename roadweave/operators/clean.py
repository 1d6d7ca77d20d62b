"""Range and marker rules of the detector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave import constants as C
from roadweave.functions.rules import all_of


def checked_columns(df: DataFrame) -> list[str]:
    return [c for c in C.VALID_RANGES if c in df.columns]


def normalize_types(df: DataFrame) -> DataFrame:
    """Numbers as double, time as timestamp; text that is neither, and NaN, become null."""
    casts: dict[str, Column] = {}
    for c in checked_columns(df):
        number = F.col(c).try_cast("double")
        casts[c] = F.when(~F.isnan(number), number)
    if "update_time" in df.columns:
        casts["update_time"] = F.col("update_time").try_cast("timestamp")
    return df.withColumns(casts) if casts else df


def _in_range(c: str) -> Column:
    low, high = C.VALID_RANGES[c]
    value = F.col(c)
    # NaN compares greater than any number, so it is out of range as well.
    return F.coalesce((value >= low) & (value <= high), F.lit(False))


def _is_missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def _is_marker(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double").isin(*C.INVALID_MARKERS), F.lit(False))


def violations(df: DataFrame) -> DataFrame:
    """Per column: marker hits, out-of-range cells, missing cells, their sum, bad cells.

    ``rule_total`` adds the rules, so a marker outside the range counts twice;
    ``bad_cells`` counts each cell once. One aggregation, then one row per column.
    """
    cols = checked_columns(df)
    aggs = []
    for c in cols:
        missing = _is_missing(c)
        aggs += [
            F.count_if(_is_marker(c)).alias(f"{c}__marker"),
            F.count_if(~_in_range(c) & ~missing).alias(f"{c}__range"),
            F.count_if(missing).alias(f"{c}__missing"),
        ]
    row = df.agg(*aggs)
    parts = ", ".join(f"'{c}', `{c}__marker`, `{c}__range`, `{c}__missing`" for c in cols)
    return row.select(
        F.expr(f"stack({len(cols)}, {parts}) as (column, markers, out_of_range, missing)")
    ).select(
        "column",
        "markers",
        "out_of_range",
        "missing",
        (F.col("markers") + F.col("out_of_range") + F.col("missing")).alias("rule_total"),
        (F.col("out_of_range") + F.col("missing")).alias("bad_cells"),
    )


def mark_null(df: DataFrame) -> DataFrame:
    """Violating cells become null; every row stays."""
    return df.withColumns({c: F.when(_in_range(c), F.col(c)) for c in checked_columns(df)})


def drop_bad_rows(df: DataFrame) -> DataFrame:
    """Rows whose checked cells are all present and in range."""
    return df.where(all_of([_in_range(c) for c in checked_columns(df)]))


def clean(df: DataFrame, method: str = "mark_nan") -> DataFrame:
    if method == "mark_nan":
        return mark_null(df)
    if method == "remove_rows":
        return drop_bad_rows(df)
    raise ValueError(f"unknown cleaning method {method!r}")


def clean_report(df: DataFrame, by: list[str], method: str = "mark_nan") -> DataFrame:
    """Per group: rows before and after cleaning, rows removed, rule hits, share kept.

    Read off the uncleaned table in one pass.
    """
    cols = checked_columns(df)
    hits: Column = F.lit(0)
    for c in cols:
        hits = hits + _is_marker(c).cast("int") + (~_in_range(c)).cast("int")
    kept = (
        F.count_if(all_of([_in_range(c) for c in cols]))
        if method == "remove_rows"
        else F.count(F.lit(1))
    )
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("original_records"),
            kept.alias("cleaned_records"),
            F.sum(hits).cast("long").alias("invalid_values"),
        )
        .withColumn("removed_records", F.col("original_records") - F.col("cleaned_records"))
        .withColumn("kept_percent", F.col("cleaned_records") * 100.0 / F.col("original_records"))
    )


def clean_batch_report(report: DataFrame) -> DataFrame:
    """Totals over a per-group report; a date succeeds when rows of it remain."""
    per_date = report.groupBy("date").agg(
        F.sum("original_records").alias("o"),
        F.sum("cleaned_records").alias("c"),
        F.sum("removed_records").alias("r"),
        F.sum("invalid_values").alias("v"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("cleaned_records") > 0).alias("groups_ok"),
    )
    return per_date.agg(
        F.count(F.lit(1)).alias("total_dates"),
        F.count_if(F.col("groups_ok") > 0).alias("successful_dates"),
        F.sum("groups").alias("total_groups"),
        F.sum("groups_ok").alias("successful_groups"),
        F.sum("o").alias("original_records"),
        F.sum("c").alias("cleaned_records"),
        F.sum("r").alias("removed_records"),
        F.sum("v").alias("invalid_values"),
        (F.count_if(F.col("groups_ok") > 0) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias(
            "success_rate"
        ),
    )
