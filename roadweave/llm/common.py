"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import shingles
from roadweave.session import materialize, scratch_path

#: Ids are broadcast up to this many (8 MB); longer lists are joined by a shuffle.
SMALL_IDS = 1_000_000

#: Rows of a batch that goes to Python.
BATCH = 1_000
#: Batches of short rows that are treated as one, and rows of them.
GATHER, GATHERED = 30, 30_000

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A given table, only the named columns."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, so that later steps and lost tasks reread it."""
    return materialize(df, name)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, start: str) -> str:
    """``start``, with underscores in front until no column of ``df`` begins with it."""
    while any(c.lower().startswith(start.lower()) for c in df.columns):
        start = "_" + start
    return start


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 that any engine can repeat."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def slices(batches: Iterator[pa.RecordBatch], most: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what a worker makes of whole texts stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most)


def byte_slices(
    batches: Iterator[pa.RecordBatch], column: str, most: int, rows: int = 1_000
) -> Iterator[pa.RecordBatch]:
    """Batches whose texts in ``column`` hold at most ``most`` bytes and ``rows`` rows; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).tolist()
        a, held = 0, 0
        for b, size in enumerate(sizes):
            if b > a and (held + size > most or b - a >= rows):
                yield batch.slice(a, b - a)
                a, held = b, 0
            held += size
        yield batch.slice(a)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GATHER batches as one (fewer, if they hold GATHERED rows), for short rows that numpy treats at once."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if len(held) == GATHER or rows >= GATHERED:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand rows to Python in batches of BATCH rows, so that neither side holds many whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker, which Spark keeps, forgets words and gives unused memory back."""
    try:
        yield from batches
    finally:
        shingles.forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def runs(
    batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = 1
) -> Iterator[list[dict[str, np.ndarray]]]:
    """Consecutive rows of equal keys, column by column, the runs that end in a batch at a time.

    The rows must be sorted by the keys within the partition; a run may go over batch
    borders. Runs of fewer than ``least`` rows are left out.
    """
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        data = {n: batch[n].to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if rest is not None:
            data = {n: np.concatenate([rest[n], v]) for n, v in data.items()}
        change = np.zeros(len(data[keys[0]]), dtype=bool)
        for k in keys:
            change[1:] |= data[k][1:] != data[k][:-1]
        starts = np.concatenate([[0], np.nonzero(change)[0]])
        long = np.nonzero(np.diff(starts) >= least)[0]
        yield [{n: v[starts[i] : starts[i + 1]] for n, v in data.items()} for i in long]
        rest = {n: v[starts[-1] :].copy() for n, v in data.items()}
    if rest is not None and len(rest[keys[0]]) >= least:
        yield [rest]


__all__ = ["SMALL_IDS", "WORD", "bounded", "byte_slices", "gathered", "released", "runs", "scratch_path", "slices", "small_batches", "stored", "table", "unit_hash", "unused"]
