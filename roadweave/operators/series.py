"""Row-frame window functions over long series, cut into ranges of rows.

A plain ``Window.partitionBy(key)`` puts the whole history of a key into one task. Here the
table is first dealt by ranges of (key, order), so every part holds about as many rows as
any other, however long a single series is. The rows of a key that runs over several parts
are joined by copies ("halo") of the few rows before and behind each border that the frames
reach. The values equal those of the plain window, and the plan is the same for any size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from roadweave.session import materialize
from roadweave.streaming.history import BEFORE

_PART, _HALO = "_series_part", "_series_halo"

# --- fixed values: lags and frames of the station features -----------------
PERIODS, WINDOWS = (1, 2, 3, 6, 12), (3, 6, 12)


def _ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None) -> DataFrame:
    """``df`` by ranges of (key, order), with the number of its range; stored, so that
    the numbers stay what they are."""
    by = [*keys, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return materialize(dealt.withColumn(_PART, F.spark_partition_id()), "series")


def _halo_rows(
    lean: DataFrame, keys: list[str], order: list[str], reach: int, forward: bool
) -> DataFrame:
    """The ``reach`` rows of a key bordering each of its parts, labelled with that part.

    A part gives up to ``reach`` rows for a key, cut before the shuffle; a part takes the
    nearest ones of the parts beside it. Per key that is one row for each part.
    """
    down = [F.col(c).asc() if forward else F.col(c).desc() for c in order]
    rank = F.row_number().over(Window.partitionBy(*keys, _PART).orderBy(*down))
    edge = lean.withColumn("_rn", rank).where(F.col("_rn") <= reach)
    payload = [c for c in lean.columns if c not in (*keys, _PART)]
    # nearest row first, as seen from the part that takes them
    lists = edge.groupBy(*keys, _PART).agg(
        F.sort_array(F.collect_list(F.struct("_rn", *payload))).alias("_rows")
    )
    toward = F.col(_PART).desc() if forward else F.col(_PART).asc()
    beside = Window.partitionBy(*keys).orderBy(toward).rowsBetween(-reach, -1)
    near = F.slice(F.flatten(F.reverse(F.collect_list("_rows").over(beside))), 1, reach)
    taken = lists.withColumn("_near", near).select(*keys, _PART, F.explode("_near").alias("_r"))
    return taken.select(*keys, _PART, *[F.col(f"_r.{c}").alias(c) for c in payload])


def _with_halos(
    cut: DataFrame, keys: list[str], order: list[str], values: list[str], before: int, after: int
) -> DataFrame:
    """The dealt rows, and copies of those beyond each border that frames of a part reach."""
    # keys of more than one part: at most one for each border between two parts
    ends = cut.groupBy(*keys).agg(F.min(_PART).alias("_lo"), F.max(_PART).alias("_hi"))
    over = ends.where(F.col("_lo") < F.col("_hi")).select(*[F.col(k).alias(f"_over_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_over_{k}")) for k in keys]
    lean = cut.select(*dict.fromkeys([*keys, *order, *values]), _PART).join(
        F.broadcast(over), same, "left_semi"
    )
    full = cut.withColumn(_HALO, F.lit(False))
    for reach, forward in ((before, False), (after, True)):
        if reach:
            halo = _halo_rows(lean, keys, order, reach, forward).withColumn(_HALO, F.lit(True))
            full = full.unionByName(halo, allowMissingColumns=True)
    return full


def _framed(
    full: DataFrame, keys: list[str], order: list[str], build: Callable[[WindowSpec], dict[str, Column]]
) -> DataFrame:
    window = Window.partitionBy(*keys, _PART).orderBy(*order)
    return full.withColumns(build(window)).where(~F.col(_HALO)).drop(_PART, _HALO)


@dataclass(frozen=True)
class SeriesTable:
    """A table that is stored for frames: dealt by ranges of (key, order), a bucket for each range,
    sorted, with the copies that frames of up to ``before`` rows back and ``after`` ahead need.

    Every row function of this module takes one in place of a DataFrame. Its windows then need
    no exchange: a range's rows lie in one bucket, and no range is longer than any other.
    """

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    before: int
    after: int

    @staticmethod
    def store(
        df: DataFrame,
        name: str,
        path: str,
        keys: list[str],
        order: list[str],
        before: int,
        after: int = 0,
        parts: int | None = None,
    ) -> SeriesTable:
        """Write ``df`` below ``path`` as the external table ``name``; one shuffle for all later uses."""
        spark = df.sparkSession
        cut = _ranged(df, keys, order, parts)
        count = (cut.agg(F.max(_PART)).first()[0] or 0) + 1
        full = _with_halos(cut, keys, order, [c for c in df.columns if c not in (*keys, *order)], before, after)
        # a number for each range whose bucket is its own: the least that falls there
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(count))
        labels = spark.range(count * 40).groupBy(bucket.alias("_b")).agg(F.min("id").cast("int").alias("_label"))
        labels = materialize(labels, "series-labels")  # one row a range
        placed = full.join(F.broadcast(labels), F.col(_PART) == F.col("_b"), "left")
        placed = placed.withColumn(_PART, F.coalesce("_label", _PART)).drop("_b", "_label")
        (
            placed.repartition(count, _PART)
            .write.mode("overwrite")
            .format("parquet")
            .bucketBy(count, _PART)
            .sortBy(_PART, *keys, *order)
            .option("path", path)
            .saveAsTable(name)
        )
        return SeriesTable(spark.table(name), tuple(keys), tuple(order), before, after)

    def over(
        self, keys: list[str], order: list[str], build: Callable[[WindowSpec], dict[str, Column]], before: int, after: int
    ) -> DataFrame:
        if (tuple(keys), tuple(order)) != (self.keys, self.order):
            raise ValueError(f"the table is stored by {self.keys} and {self.order}")
        if before > self.before or after > self.after:
            raise ValueError(f"the table holds {self.before} rows before and {self.after} behind a border")
        return _framed(self.frame, keys, order, build)


def over_rows(
    df: DataFrame | SeriesTable,
    keys: list[str],
    order: list[str],
    values: list[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Add the columns of ``build(window)`` to ``df``.

    ``order[0]`` is the time; ``order`` must be a total order within a key. ``values`` are
    the columns the frames read. Frames may reach ``before`` rows back and ``after`` rows
    ahead. ``parts`` is the number of ranges, Spark's usual number if none is given.
    """
    if isinstance(df, SeriesTable):
        return df.over(keys, order, build, before, after)
    cut = _ranged(df, keys, order, parts)
    return _framed(_with_halos(cut, keys, order, values, before, after), keys, order, build)


def _statistics(w: WindowSpec, targets: list[str], periods: tuple[int, ...], windows: tuple[int, ...]) -> dict[str, Column]:
    """Lags and rolling mean, sample sd, min and max of each target."""
    out = {}
    for t in targets:
        for p in periods:
            out[f"{t}_lag_{p}"] = F.lag(t, p).over(w)
        for n in windows:
            frame = w.rowsBetween(-(n - 1), 0)
            out[f"{t}_rolling_mean_{n}"] = F.avg(t).over(frame)
            out[f"{t}_rolling_std_{n}"] = F.stddev_samp(t).over(frame)
            out[f"{t}_rolling_min_{n}"] = F.min(t).over(frame)
            out[f"{t}_rolling_max_{n}"] = F.max(t).over(frame)
    return out


def lags(
    df: DataFrame | SeriesTable,
    keys: list[str],
    order: list[str],
    targets: list[str],
    periods: tuple[int, ...] = PERIODS,
    fill: float | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``<target>_lag_<p>`` columns per key; ``fill`` replaces missing values."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out = _statistics(w, targets, periods, ())
        return out if fill is None else {k: F.coalesce(v, F.lit(fill)) for k, v in out.items()}

    return over_rows(df, keys, order, targets, build, before=max(periods), parts=parts)


def rolling(
    df: DataFrame | SeriesTable,
    keys: list[str],
    order: list[str],
    targets: list[str],
    windows: tuple[int, ...] = WINDOWS,
    parts: int | None = None,
) -> DataFrame:
    """Mean, sample sd, min and max over the last ``w`` rows, the current one included."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return _statistics(w, targets, (), windows)

    return over_rows(df, keys, order, targets, build, before=max(windows) - 1, parts=parts)


def lags_and_rolling(
    df: DataFrame | SeriesTable,
    keys: list[str],
    order: list[str],
    targets: list[str],
    periods: tuple[int, ...] = PERIODS,
    windows: tuple[int, ...] = WINDOWS,
    horizon: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Lags, rolling statistics and (``horizon`` > 0) the label, in one window."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out = _statistics(w, targets, periods, windows)
        if horizon:
            out |= {f"{t}_ahead_{horizon}": F.lead(t, horizon).over(w) for t in targets}
        return out

    reach = max(max(periods), max(windows) - 1)
    return over_rows(df, keys, order, targets, build, before=reach, after=horizon, parts=parts)


def from_history(
    df: DataFrame,
    targets: list[str],
    periods: tuple[int, ...] = PERIODS,
    windows: tuple[int, ...] = WINDOWS,
) -> DataFrame:
    """The columns of ``lags_and_rolling`` from the arrays of earlier values (``_before_<target>``, nearest last)."""
    out: dict[str, Column] = {}
    for t in targets:
        past = F.col(BEFORE.format(t))
        for p in periods:
            out[f"{t}_lag_{p}"] = F.get(past, F.size(past) - p)
        for n in windows:
            have = F.least(F.size(past), F.lit(n - 1))
            frame = F.concat(F.slice(past, F.size(past) - have + 1, have), F.array(F.col(t).cast("double")))
            for name, value in _array_statistics(frame).items():
                out[f"{t}_rolling_{name}_{n}"] = value
    return df.withColumns(out).drop(*[BEFORE.format(t) for t in targets])


def _array_statistics(values: Column) -> dict[str, Column]:
    """Mean, sample sd, min and max of an array's values that are not null; each null without any."""
    there = F.filter(values, lambda x: x.isNotNull())
    n = F.size(there)
    total = F.aggregate(there, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(n > 0, total / n)
    # the one-element array names the mean, so it is not computed again for each value
    apart = F.get(
        F.transform(
            F.array(mean), lambda m: F.aggregate(there, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
        ),
        F.lit(0),
    )
    return {
        "mean": mean,
        "std": F.when(n > 1, F.sqrt(apart / (n - 1))),
        "min": F.array_min(there),
        "max": F.array_max(there),
    }


def later(
    df: DataFrame,
    keys: list[str],
    time: str,
    target: str,
    minutes: int,
    first: list[str] | None = None,
    into: str | None = None,
) -> DataFrame:
    """``df`` with the value of ``target`` of the same key exactly ``minutes`` later.

    Joined on time, so it does not depend on how many rows lie between; days do not end
    it. Of several rows of a key at one time the least by ``first`` gives the value. Rows
    without such a later one get null, rows without time too.
    """
    name = into or f"{target}_in_{minutes}_min"
    decides = F.struct(*(first or [target]))
    there = (
        df.where(F.col(time).isNotNull())
        .groupBy(*keys, time)
        .agg(F.min_by(target, decides).alias("_later"))
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.timestamp_add("MINUTE", F.lit(-minutes), F.col(time)).alias("_time"),
            "_later",
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(there, [*same, F.col(time) == F.col("_time")], "left")
    return joined.withColumn(name, F.col("_later")).drop("_later", "_time", *[f"_k{i}" for i in range(len(keys))])


def ahead(
    df: DataFrame | SeriesTable,
    keys: list[str],
    order: list[str],
    target: str,
    horizon: int = 3,
    step_minutes: float | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Forecast label: ``target`` ``horizon`` rows ahead.

    With ``step_minutes`` the label is kept only when that row really lies
    ``horizon`` steps later in time.
    """
    name = f"{target}_ahead_{horizon}"

    def build(w: WindowSpec) -> dict[str, Column]:
        value = F.lead(target, horizon).over(w)
        if step_minutes is not None:
            gap = F.unix_seconds(F.lead(order[0], horizon).over(w).cast("timestamp")) - F.unix_seconds(
                F.col(order[0]).cast("timestamp")
            )
            value = F.when(gap == F.lit(int(step_minutes * 60 * horizon)), value)
        return {name: value}

    return over_rows(df, keys, order, [target], build, after=horizon, parts=parts)


def sequences(
    df: DataFrame | SeriesTable,
    keys: list[str],
    order: list[str],
    features: list[str],
    target: str,
    length: int = 12,
    horizon: int = 3,
    parts: int | None = None,
) -> DataFrame:
    """One row per complete window: ``length`` input rows and the next ``horizon`` targets."""

    def build(w: WindowSpec) -> dict[str, Column]:
        point = F.array(*[F.col(c).cast("double") for c in features])
        return {
            "x": F.collect_list(point).over(w.rowsBetween(-(length - 1), 0)),
            "y": F.collect_list(F.struct(F.col(target).cast("double").alias("v"))).over(
                w.rowsBetween(1, horizon)
            ),
        }

    built = over_rows(
        df,
        keys,
        order,
        [*features, target],
        build,
        before=length - 1,
        after=horizon,
        parts=parts,
    )
    return (
        built.where((F.size("x") == length) & (F.size("y") == horizon))
        .withColumn("y", F.transform("y", lambda s: s["v"]))
        .select(*keys, *order, "x", "y")
    )


def latest(df: DataFrame, keys: list[str], order: list[str], rows: int = 1) -> DataFrame:
    """The newest ``rows`` rows of every key (limited per map task before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (
        df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= rows)
    )
