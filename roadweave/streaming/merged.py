"""Aggregates that batches of a stream add to, kept as partial states by date.

The state of a date is one folded base and the deltas of the batches since. A batch reads the
states of the dates it touches, never the rows behind them, and writes one small delta. Its
name is the number of the batch, so a batch that runs again replaces its own delta.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.session import scratch_path
from roadweave.sources import tables

#: Deltas of a date before they are folded into a new base.
FOLD = 16


@dataclass(frozen=True)
class MergedTable:
    """``keys`` name a row of a date's state; the other columns merge by their function.

    ``merge`` maps each of them to "sum", "min" or "max".
    """

    path: str
    keys: tuple[str, ...]
    merge: dict[str, str]
    fold: int = FOLD

    def _done(self, batch: int) -> str:
        return f"{self.path}/_batches/{batch}"

    def has(self, spark: SparkSession, batch: int) -> bool:
        """Whether a batch is wholly in the state."""
        return tables.exists(spark, self._done(batch))

    def combined(self, partials: DataFrame) -> DataFrame:
        how = {"sum": F.sum, "min": F.min, "max": F.max}
        return partials.groupBy("date", *self.keys).agg(*[how[f](c).alias(c) for c, f in self.merge.items()])

    def _states(self, spark: SparkSession, dates: list) -> DataFrame | None:
        """Bases and deltas of the dates, with kind and batch."""
        folders = [p for d in dates if tables.exists(spark, p := f"{self.path}/date={d}")]
        if not folders:
            return None
        return spark.read.option("basePath", self.path).parquet(*folders)

    def _heads(self, states: DataFrame) -> dict:
        """For each date its newest base and the number of deltas since (a row a date)."""
        parts = states.select("date", "kind", "batch").distinct()  # partition values only
        base = F.max(F.when(F.col("kind") == "base", F.col("batch")))
        bases = parts.groupBy("date").agg(F.coalesce(base, F.lit(-1)).alias("base"))
        since = parts.join(bases, "date").where("kind = 'delta' and batch > base")
        deltas = since.groupBy("date").agg(F.count(F.lit(1)).alias("deltas"))
        rows = bases.join(deltas, "date", "left").collect()
        return {r.date: (r.base, r.deltas or 0) for r in rows}

    def read(self, spark: SparkSession, dates: list) -> DataFrame | None:
        """The merged state of the dates, or None where there is none. Folded deltas are pruned."""
        states = self._states(spark, dates)
        if states is None:
            return None
        live = F.lit(False)
        for date, (base, _) in self._heads(states).items():
            newest = ((F.col("kind") == "base") & (F.col("batch") == base)) | (
                (F.col("kind") == "delta") & (F.col("batch") > base)
            )
            live = live | ((F.col("date") == F.lit(date)) & newest)
        return self.combined(states.where(live))

    def add(self, partials: DataFrame, batch: int) -> list:
        """Add a batch's partial rows (date, keys, merged columns) once; return its dates.

        A batch that is marked as added is left alone. Without the mark its delta is
        replaced, so a crash at any point neither loses nor repeats rows.
        """
        spark = partials.sparkSession
        copy = scratch_path(spark, "partials")
        try:
            self.combined(partials).write.parquet(copy)
            small = spark.read.parquet(copy)
            dates = tables.dates_in(small)
            if not self.has(spark, batch):
                for d in dates:  # what an earlier run of this batch may have folded
                    tables.remove(spark, f"{self.path}/date={d}/kind=base/batch={batch}")
                self._write(small, "delta", batch)
                self._fold(spark, dates, batch)
                small.limit(0).select("date").write.mode("overwrite").parquet(self._done(batch))
            return dates
        finally:
            tables.remove(spark, copy)

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        tagged = rows.withColumns({"kind": F.lit(kind), "batch": F.lit(batch).cast("long")})
        tables.write_days(tagged, self.path, ("date", "kind", "batch"))

    def _fold(self, spark: SparkSession, dates: list, batch: int) -> None:
        """A new base for dates with many deltas; what an older, finished base replaced goes."""
        states = self._states(spark, dates)
        if states is None:
            return
        heads = self._heads(states)
        for date, (base, _) in heads.items():
            if 0 <= base < batch:  # that batch was finished, so its base is whole
                for r in states.where((F.col("date") == F.lit(date)) & (F.col("batch") <= base)).select("kind", "batch").distinct().collect():
                    if (r.kind, r.batch) != ("base", base):
                        tables.remove(spark, f"{self.path}/date={date}/kind={r.kind}/batch={r.batch}")
        full = [d for d, (_, deltas) in heads.items() if deltas >= self.fold]
        if full:
            self._write(self.read(spark, full), "base", batch)
