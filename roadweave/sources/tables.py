"""Day tables: partitioned Parquet in place of day folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.times import time_category
from roadweave.session import scratch_path

LANE_KEY = ("date", "vd_id", "lane_id", "update_time")
#: Partition column of tables that are kept by the hour.
HOUR = "at_hour"
LANE_SCHEMA = (
    "update_time timestamp, vd_id string, lane_id int, lane_type int, speed int, occupancy int,"
    " volume_total int, volume_small int, volume_large int, volume_truck int, speed_small int,"
    " speed_large int, speed_truck int, date date, time_category string"
)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_days(
    df: DataFrame, path: str, partitions: tuple[str, ...] = ("date",), mode: str = "overwrite"
) -> None:
    """Write by day; an overwrite replaces the touched days only.

    The rebalance hint gathers a day's rows into few files and splits a day that
    is much larger than the others.
    """
    (
        df.hint("rebalance", *[F.col(p) for p in partitions])
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def dates_in(df: DataFrame) -> list:
    """The distinct dates of a table (bounded by the calendar)."""
    return [r[0] for r in df.select("date").distinct().collect()]


def on_dates(df: DataFrame, dates: list) -> DataFrame:
    """Rows of the given dates; the literal list prunes partitions."""
    return df.where(F.col("date").isin(dates))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def one_per_key(df: DataFrame, key: tuple[str, ...], latest: tuple[str, ...] = ()) -> DataFrame:
    """One row of each key: the last by ``latest``, then by its values, so reruns agree."""
    rest = [c for c in df.columns if c not in key and c not in latest]
    pick = F.max(F.struct(*latest, *rest)).alias("_row")
    return df.groupBy(*key).agg(pick).select(*[c if c in key else f"_row.{c}" for c in df.columns])


def stored_keys(spark: SparkSession, path: str, key: tuple[str, ...], rows: DataFrame, hourly: bool) -> DataFrame:
    """The keys a table holds for the dates of ``rows``, with ``hourly`` for their hours only.

    Both lists are bounded by the calendar and prune partitions, so a batch of a few minutes
    reads the keys of an hour or two, however long the day already is.
    """
    held = spark.read.parquet(path)
    if not hourly:
        return on_dates(held, dates_in(rows)).select(*key)
    slots = rows.select("date", HOUR).distinct().collect()
    hours = F.col(HOUR).isin([r[1] for r in slots if r[1] is not None])
    if any(r[1] is None for r in slots):
        hours = hours | F.col(HOUR).isNull()
    return on_dates(held, list({r[0] for r in slots})).where(hours).select(*key)


def append_new(
    df: DataFrame,
    path: str,
    key: tuple[str, ...] = LANE_KEY,
    partitions: tuple[str, ...] = ("date",),
    latest: tuple[str, ...] = (),
    time: str | None = None,
    first: Callable[[DataFrame], None] | None = None,
) -> list:
    """Append the rows whose key the table does not hold yet; return the dates at hand.

    Of several new rows of one key the last by ``latest`` stays. The rows are written to
    the shared folder first, so their source is read once; that copy is removed at the
    end, also when a step fails. With ``time``, a column of the key, the table is also
    partitioned by its hour, and only the keys of the batch's hours are read back; else
    those of its dates. ``first`` is given the new rows before they are appended. Running a
    day again neither loses nor repeats rows.
    """
    spark = df.sparkSession
    copy = scratch_path(spark, "append")
    if time is not None:
        df, partitions = df.withColumn(HOUR, F.hour(time)), (*partitions, HOUR)
    try:
        one_per_key(df, key, latest).write.parquet(copy)
        fresh = spark.read.schema(df.schema).parquet(copy).select(*df.columns)
        dates = dates_in(fresh)
        if exists(spark, path):
            held = stored_keys(spark, path, key, fresh, time is not None)
            fresh = fresh.join(held, list(key), "left_anti")
        if first is not None:
            first(fresh.drop(HOUR))
        write_days(fresh, path, partitions, mode="append")
        return dates
    finally:
        remove(spark, copy)


def write_lane_days(vd: DataFrame, path: str, first: Callable[[DataFrame], None] | None = None) -> list:
    """Lane rows with their time category, partitioned by date, category and hour.

    Peak and off-peak copies are filters on ``time_category``, not further files.
    ``first`` is given the new rows before they are appended.
    """
    labelled = (
        vd
        if "time_category" in vd.columns
        else vd.withColumn("time_category", time_category(F.col("update_time")))
    )
    return append_new(labelled, path, LANE_KEY, ("date", "time_category"), time="update_time", first=first)


def load_days(
    spark: SparkSession, path: str, date: str | None = None, empty: str | None = None
) -> DataFrame:
    """All dates or one; an absent date gives no rows. The filter prunes partitions.

    With the schema ``empty`` a table that was never written reads as no rows.
    """
    if empty is not None and not exists(spark, path):
        return spark.createDataFrame([], empty)
    df = spark.read.parquet(path).drop(HOUR)
    return df if date is None else df.where(F.col("date") == F.to_date(F.lit(date)))


def available_dates(df: DataFrame) -> DataFrame:
    return df.select("date").where(F.col("date").isNotNull()).distinct().orderBy("date")


def newest_day(df: DataFrame) -> DataFrame:
    """Rows of the latest date (the date is looked up first, so the scan is pruned)."""
    newest = df.agg(F.max("date")).first()[0]
    return df.where(F.col("date") == F.lit(newest))


def named_dataset(df: DataFrame, name: str) -> DataFrame:
    """``all``, ``peak`` or ``offpeak`` rows of a lane table."""
    peak = F.col("time_category").contains("尖峰")
    return {"all": df, "peak": df.where(peak), "offpeak": df.where(~peak)}[name]


def prefer(cleaned: DataFrame, raw: DataFrame) -> DataFrame:
    """Cleaned days, and raw rows of the days that were not cleaned."""
    done = cleaned.select("date").distinct()  # bounded by the calendar
    rest = raw.join(F.broadcast(done), "date", "left_anti")
    return cleaned.unionByName(rest, allowMissingColumns=True)


def merge_days(*days: DataFrame, source: Column | None = None) -> DataFrame:
    """Union by name, tagged with the date rows come from."""
    out = days[0]
    for d in days[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.withColumn("source_date", F.col("date") if source is None else source)


def with_dataset(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("dataset", F.lit(name))


def store_files(spark: SparkSession, path: str) -> DataFrame:
    """Files, exact rows and size per date of a stored table."""
    files = (
        spark.read.parquet(path)
        .select("date", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
        .groupBy("date", "f")
        .agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("b"))
    )
    return files.groupBy("date").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("n").alias("records"),
        F.round(F.sum("b") / F.lit(1048576.0), 1).alias("size_mb"),
    )


def write_json_report(df: DataFrame, path: str) -> None:
    """A small report table as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def flag_schema_drift(files: DataFrame) -> DataFrame:
    """Compare each file's columns with the most common column count.

    ``files`` has (file, columns array<string>, size). Adds the modal column list,
    extra and missing columns and whether the size is an outlier.
    """
    modal = (
        files.groupBy(F.size("columns").alias("n"))
        .agg(F.count(F.lit(1)).alias("c"), F.min_by("columns", "file").alias("cols"))
        .agg(F.max_by(F.struct("n", "cols"), F.struct("c", -F.col("n"))))
        .scalar()
    )
    mean = files.agg(F.avg("size")).scalar()
    return (
        files.withColumn("_m", modal)
        .withColumn("_mean", mean)
        .select(
            "file",
            F.size("columns").alias("column_count"),
            F.col("_m.n").alias("modal_count"),
            F.sort_array(F.array_except("columns", "_m.cols")).alias("extra_columns"),
            F.sort_array(F.array_except("_m.cols", "columns")).alias("missing_columns"),
            "size",
            F.when(F.col("size") < F.col("_mean") * 0.5, "too small")
            .when(F.col("size") > F.col("_mean") * 2, "too large")
            .otherwise("normal")
            .alias("size_check"),
        )
    )


def column_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(F.size("columns").alias("column_count")).agg(
        F.count(F.lit(1)).alias("files")
    )


def file_completeness(files: DataFrame, expected_per_date: int = 4) -> DataFrame:
    """Files per date against the expected number."""
    return files.groupBy("date").agg(F.count(F.lit(1)).alias("files")).withColumns(
        {
            "expected": F.lit(expected_per_date),
            "is_complete": (F.col("files") >= expected_per_date).cast("int"),
        }
    )


def file_schemas(spark: SparkSession, path: str) -> DataFrame:
    """File, columns and size of every Parquet file below ``path``.

    Only footers are read, each by the task its file is dealt to.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length")
    )

    def footers(batches):
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            columns = []
            for uri in batch["path"]:
                fs, inner = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(inner) as handle:
                    columns.append(list(pq.read_schema(handle).names))
            yield batch.assign(columns=columns)[["path", "columns", "length"]].rename(
                columns={"path": "file", "length": "size"}
            )

    return listing.mapInPandas(footers, "file string, columns array<string>, size long")
