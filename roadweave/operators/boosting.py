"""Second-order boosted trees with L1 and L2 terms, grown from histograms that Spark aggregates.

Features are binned once. Each level of a tree is one pass: every task sums gradients and
counts by (node, feature, bin), Spark adds the sums of the tasks and picks each node's best
split; only the splits, at most 2^depth of them, reach the driver. Gradients are whole
multiples of 2^-20, so sums are exact: the trees do not depend on the order of rows, on
partitions, or on tasks that ran twice.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.operators import split
from roadweave.session import materialize

#: Gradients and leaf values are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Rows are sampled by a hash modulo this prime.
PRIME = (1 << 31) - 1
#: Values of a feature are counted in so many cells of its range before cuts are chosen.
CELLS = 65_536
#: Scores are stored after so many rounds; in between they follow from the newer trees.
STORED = 10


@dataclass(frozen=True)
class Settings:
    """``least``: rows of a child; ``gamma``: gain of a split; ``alpha``, ``lam``: L1 and L2 terms of leaf values."""

    rounds: int
    depth: int = 8
    rate: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    least: int = 1
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    bins: int = 255
    seed: int = 42


# --- fixed values: settings of the station and of the fused model ----------------
STATION = Settings(rounds=300, least=3, gamma=0.1, alpha=0.1, lam=0.1)
FUSED = Settings(rounds=200)


@dataclass
class Tree:
    """Nodes numbered as in a heap (children of i: 2 i + 1 and 2 i + 2); feature -1 marks a leaf or no node."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    count: np.ndarray = field(init=False)

    def __post_init__(self):
        n = (2 << self.depth) - 1
        self.feature = np.full(n, -1, dtype=np.int32)
        self.bin = np.zeros(n, dtype=np.int32)
        self.value = np.zeros(n, dtype=np.int64)
        self.gain = np.zeros(n)
        self.count = np.zeros(n, dtype=np.int64)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row of bins ends in."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[rows, np.maximum(f, 0)] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


@dataclass
class Boosted:
    """A fitted model: cuts of each feature, the first score and the trees (leaf values in units)."""

    features: list[str]
    target: str
    cuts: list[list[float]]
    first: int
    trees: list[Tree]
    settings: Settings

    def transform(self, df: DataFrame, out: str = "boosted") -> DataFrame:
        """``df`` with the score in the column ``out``; a null or NaN counts as less than every number."""
        cuts, trees, first, names = self.cuts, self.trees, self.first, self.features
        kept = [c for c in df.columns if c != out]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binned(batch, names, cuts, "_f")
                score = np.full(batch.num_rows, first, dtype=np.int64)
                for t in trees:
                    score += t.value[t.nodes(bins)]
                arrays = [*(batch[c] for c in kept), pa.array(score / UNIT)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, out])

        rows = df.select(*[F.col(f"`{c}`") for c in kept])
        schema = rows.withColumn(out, F.lit(0.0)).schema
        return rows.select("*", *_doubles(names, "_f")).mapInArrow(work, schema)

    def splits(self, spark: SparkSession) -> DataFrame:
        """One row for each node: round, node, feature (null: leaf), cut, gain, rows, value (of leaves)."""
        rows = []
        for k, t in enumerate(self.trees):
            for i in np.flatnonzero(t.count).tolist():
                f = int(t.feature[i])
                if f < 0:
                    rows.append((k, i, None, None, None, int(t.count[i]), int(t.value[i]) / UNIT))
                else:
                    b = int(t.bin[i])
                    cut = self.cuts[f][b - 1] if b else None
                    rows.append((k, i, self.features[f], cut, float(t.gain[i]), int(t.count[i]), None))
        return spark.createDataFrame(
            rows, "round int, node int, feature string, cut double, gain double, rows long, value double"
        )

    def importances(self, spark: SparkSession, name: str = "boosted") -> DataFrame:
        """Mean gain of each feature's splits, as a share of all."""
        total = np.zeros(len(self.features))
        times = np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
            np.add.at(times, t.feature[inner], 1)
        mean = np.divide(total, times, out=np.zeros_like(total), where=times > 0)
        share = mean / mean.sum() if mean.sum() else mean
        rows = [(name, f, float(v)) for f, v in zip(self.features, share, strict=True)]
        return spark.createDataFrame(rows, "model string, feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        trees = [
            (k, t.depth, t.feature.tolist(), t.bin.tolist(), t.value.tolist(), t.gain.tolist(), t.count.tolist())
            for k, t in enumerate(self.trees)
        ]
        schema = "k int, depth int, feature array<int>, bin array<int>, value array<long>, gain array<double>, count array<long>"
        spark.createDataFrame(trees, schema).write.mode("overwrite").parquet(f"{path}/trees")
        about = {"features": self.features, "target": self.target, "first": self.first, "settings": asdict(self.settings)}
        head = [(json.dumps(about), self.cuts)]
        spark.createDataFrame(head, "about string, cuts array<array<double>>").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        head = spark.read.parquet(f"{path}/about").first()
        about = json.loads(head.about)
        trees = []
        for r in spark.read.parquet(f"{path}/trees").orderBy("k").collect():  # one row a round
            t = Tree(r.depth)
            t.feature, t.bin = np.array(r.feature, dtype=np.int32), np.array(r.bin, dtype=np.int32)
            t.value, t.gain, t.count = np.array(r.value), np.array(r.gain), np.array(r["count"])
            trees.append(t)
        return Boosted(
            about["features"], about["target"], [list(c) for c in head.cuts], about["first"], trees, Settings(**about["settings"])
        )


def _doubles(names: list[str], prefix: str) -> list[Column]:
    """The features as doubles, NaN as null."""
    return [
        F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"{prefix}{i}")
        for i, c in enumerate(names)
    ]


def binned(batch: pa.RecordBatch, names: list[str], cuts: list[list[float]], prefix: str) -> np.ndarray:
    """Bin of each value: 0 for null, else one more than the cuts that it reaches."""
    out = np.zeros((batch.num_rows, len(names)), dtype=np.uint8)
    for i in range(len(names)):
        values = batch[f"{prefix}{i}"].to_numpy(zero_copy_only=False).astype(float)
        there = ~np.isnan(values)
        out[there, i] = 1 + np.searchsorted(cuts[i], values[there], side="right")
    return out


def _unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """The column bins as (row, feature), read where Arrow keeps it."""
    packed = batch["bins"]
    _, places, values = packed.buffers()
    ends = np.frombuffer(places, dtype=np.int64 if pa.types.is_large_binary(packed.type) else np.int32)
    ends = ends[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(values, dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(packed), -1)


def find_cuts(rows: DataFrame, count: int, bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 cuts for each of the columns _f0, _f1, ...

    Each range is divided into CELLS equal cells; every task counts its rows by cell, and a
    cell becomes a cut, by the least value in it, where the share of the rows below reaches the
    next of ``bins`` quantiles. A feature of at most ``bins`` cells is cut at all of them.
    """
    names = [f"_f{i}" for i in range(count)]
    ends = rows.agg(*[f(n).alias(f"{k}{n}") for n in names for k, f in (("a", F.min), ("b", F.max))]).first()
    spans = [(ends[f"a{n}"], ends[f"b{n}"]) for n in names]
    ranges = [(i, a, b) for i, (a, b) in enumerate(spans) if a is not None and a < b]
    out: list[list[float]] = [[] for _ in names]
    if not ranges:
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ranges), CELLS), dtype=np.int64)
        least = np.full((len(ranges), CELLS), np.inf)
        for batch in batches:
            for k, (i, a, b) in enumerate(ranges):
                v = batch[names[i]].to_numpy(zero_copy_only=False).astype(float)
                v = np.sort(v[~np.isnan(v)])
                if not len(v):
                    continue
                with np.errstate(all="ignore"):  # infinite values lie in the first cell, as in SQL
                    cell = np.floor(np.nan_to_num((v - a) / (b - a) * CELLS, nan=0.0))
                cell = np.minimum(cell, CELLS - 1).astype(np.int64)
                starts = np.flatnonzero(np.diff(cell, prepend=-1))
                here = cell[starts]
                np.add.at(counts[k], here, np.diff(starts, append=len(cell)))
                np.minimum.at(least[k], here, v[starts])
        for k, (i, _, _) in enumerate(ranges):
            there = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_pydict(
                {"f": np.full(len(there), i, dtype=np.int32), "cell": there, "n": counts[k][there], "v": least[k][there]}
            )

    counted = (
        rows.select(*names)
        .mapInArrow(work, "f int, cell long, n long, v double")
        .groupBy("f", "cell")
        .agg(F.sum("n").alias("n"), F.min("v").alias("v"))
    )
    w = Window.partitionBy("f")  # at most CELLS rows each
    below = F.coalesce(F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = counted.withColumn("quantile", F.floor(below * bins / F.sum("n").over(w))).withColumn(
        "cells", F.count(F.lit(1)).over(w)
    )
    last = F.lag("quantile").over(w.orderBy("cell"))
    chosen = share.withColumn("last", last).where(
        F.col("last").isNotNull() & ((F.col("cells") <= bins) | (F.col("quantile") > F.col("last")))
    )
    for r in chosen.groupBy("f").agg(F.sort_array(F.collect_list("v")).alias("cuts")).collect():
        out[r.f] = list(r.cuts)
    return out


def round_sample(settings: Settings, k: int, count: int) -> tuple[int, int, list[int]]:
    """Factor and offset of round ``k``'s row sample, and its columns."""
    rng = random.Random(settings.seed * 1_000_003 + k)
    factor, offset = rng.randrange(1, PRIME), rng.randrange(PRIME)
    return factor, offset, sorted(rng.sample(range(count), max(1, round(settings.columns * count))))


def row_hash(keys: list[str] | tuple[str, ...]) -> Column:
    """A number below PRIME from the first 44 bits of the keys' md5, which SQL can repeat."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 11), 16, 10).cast("long") % PRIME


def gain_of(g: Column, n: Column, settings: Settings) -> Column:
    """The score of a node: its gradient sum, shrunk by alpha, squared over rows plus lam."""
    shrunk = F.greatest(F.abs(g / F.lit(float(UNIT))) - settings.alpha, F.lit(0.0))
    return shrunk * shrunk / (n + F.lit(settings.lam))


def leaf_value(g: int, n: int, settings: Settings) -> int:
    """The value of a leaf in units: minus its shrunk gradient sum over rows plus lam, times the rate."""
    shrunk = max(abs(g / UNIT) - settings.alpha, 0.0)
    value = math.copysign(shrunk, -g) / (n + settings.lam) * settings.rate
    return math.floor(value * UNIT + 0.5)


def _histograms(rows: DataFrame, trees: list[Tree], tree: Tree, level: int, sample: tuple, settings: Settings) -> DataFrame:
    """(node, f, bin, g, n): sums of gradients and rows of the level's nodes, one row a task and cell that holds any."""
    factor, offset, columns = sample
    border = int(settings.rows * PRIME)
    start, width = (1 << level) - 1, 1 << level

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width * 256
        g_sums = np.zeros((len(columns), size), dtype=np.int64)
        n_sums = np.zeros((len(columns), size), dtype=np.int64)
        for batch in batches:
            bins = _unpacked(batch)
            score = batch["score"].to_numpy().copy()
            for t in trees:
                score += t.value[t.nodes(bins)]
            at = tree.nodes(bins) - start
            taken = (batch["u"].to_numpy() * factor + offset) % PRIME < border
            mine = np.flatnonzero(taken & (at >= 0))
            g = (score - batch["y"].to_numpy())[mine].astype(float)  # whole numbers, exact in sums of a batch
            slot = at[mine] * 256
            lines = np.ascontiguousarray(bins.T)
            for j, f in enumerate(columns):
                cell = slot + lines[f][mine]
                g_sums[j] += np.bincount(cell, weights=g, minlength=size).astype(np.int64)
                n_sums[j] += np.bincount(cell, minlength=size)
        for j, f in enumerate(columns):
            cells = np.flatnonzero(n_sums[j])
            yield pa.RecordBatch.from_pydict(
                {
                    "node": (start + cells // 256).astype(np.int32),
                    "f": np.full(len(cells), f, dtype=np.int32),
                    "bin": (cells % 256).astype(np.int32),
                    "g": g_sums[j][cells],
                    "n": n_sums[j][cells],
                }
            )

    return rows.mapInArrow(work, "node int, f int, bin int, g long, n long")


def best_splits(histograms: DataFrame, settings: Settings) -> DataFrame:
    """For each node g, n and best: the split of the largest gain, ties to the first feature and bin.

    best is null where no split leaves ``least`` rows on both sides.
    """
    cells = histograms.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    line = Window.partitionBy("node", "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "f")  # at most 256 rows
    sides = cells.select(
        "node", "f", "bin",
        F.sum("g").over(line).alias("gl"), F.sum("n").over(line).alias("nl"),
        F.sum("g").over(whole).alias("g"), F.sum("n").over(whole).alias("n"),
    )
    gr, nr = F.col("g") - F.col("gl"), F.col("n") - F.col("nl")
    gain = gain_of(F.col("gl"), F.col("nl"), settings) + gain_of(gr, nr, settings) - gain_of(F.col("g"), F.col("n"), settings)
    allowed = (F.col("nl") >= settings.least) & (nr >= settings.least)
    split = F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), F.col("gl"), F.col("nl"))
    return sides.groupBy("node").agg(
        F.max("g").alias("g"), F.max("n").alias("n"), F.max(F.when(allowed, split)).alias("best")
    )


@dataclass(frozen=True)
class Binned:
    """Rows as bins (u, y, score, bins, part), written once; every fit and fold reads them."""

    rows: DataFrame
    features: list[str]
    target: str
    cuts: list[list[float]]


_BINNED = "u long, y long, score long, bins binary, part int"


def prepare(
    df: DataFrame,
    features: list[str] | tuple[str, ...],
    target: str,
    keys: list[str] | tuple[str, ...],
    bins: int = 255,
    part: Column | None = None,
) -> Binned:
    """Bin the features of all rows that have a target.

    ``keys`` name a row; their hash decides which rounds it takes part in. ``part`` is a whole
    number that fits can be limited by.
    """
    features = list(features)
    whole = materialize(
        df.where(F.col(f"`{target}`").isNotNull() & ~F.isnan(F.col(f"`{target}`").cast("double"))).select(
            row_hash(keys).alias("u"),
            F.floor(F.col(f"`{target}`").cast("double") * UNIT + 0.5).alias("y"),
            (F.lit(0) if part is None else part).cast("int").alias("part"),
            *_doubles(features, "_f"),
        ),
        "boosting-rows",
    )
    cuts = find_cuts(whole, len(features), bins)

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            binned_rows = binned(batch, features, cuts, "_f")
            score = pa.array(np.zeros(batch.num_rows, dtype=np.int64))
            packed = pa.array([row.tobytes() for row in binned_rows], pa.binary())
            arrays = [batch["u"], batch["y"], score, packed, batch["part"]]
            yield pa.RecordBatch.from_arrays(arrays, names=["u", "y", "score", "bins", "part"])

    return Binned(materialize(whole.mapInArrow(bin_rows, _BINNED), "boosting-bins"), features, target, cuts)


def grow(data: Binned, settings: Settings = STATION, where: Column | None = None) -> Boosted:
    """Boosted trees for squared error from binned rows, of those that meet ``where``.

    A split must gain ``gamma``: the scores of both children less that of the node. The first
    score is the mean of the target.
    """
    rows = data.rows if where is None else data.rows.where(where)
    found = rows.agg(F.sum(F.col("y").cast("decimal(38,0)")).alias("y"), F.count(F.lit(1)).alias("n")).first()
    if not found.n:
        raise ValueError("no rows to learn from")
    first = int(found.y) // found.n
    rows = rows.withColumn("score", F.lit(first).cast("long"))
    model = Boosted(data.features, data.target, data.cuts, first, [], settings)
    newer: list[Tree] = []
    for k in range(settings.rounds):
        sample = round_sample(settings, k, len(data.features))
        tree = Tree(settings.depth)
        sums: dict[int, tuple[int, int]] = {}
        for level in range(settings.depth):
            splits = best_splits(_histograms(rows, newer, tree, level, sample, settings), settings).collect()
            more = False
            for r in splits:  # at most 2^level
                if not level:
                    sums[0] = (r.g, r.n)
                if r.best is None or not (r.best.gain > 0 and r.best.gain >= settings.gamma):
                    continue
                more = True
                tree.feature[r.node], tree.bin[r.node], tree.gain[r.node] = -r.best.f, -r.best.bin, r.best.gain
                sums[2 * r.node + 1] = (r.best.gl, r.best.nl)
                sums[2 * r.node + 2] = (r.g - r.best.gl, r.n - r.best.nl)
            if not more:
                break
        for node, (g, n) in sums.items():
            tree.count[node] = n
            if tree.feature[node] < 0:
                tree.value[node] = leaf_value(g, n, settings)
        model.trees.append(tree)
        newer.append(tree)
        if len(newer) == STORED and k + 1 < settings.rounds:
            rows, newer = materialize(_scored(rows, newer), "boosting-scores"), []
    return model


def fit(
    df: DataFrame,
    features: list[str] | tuple[str, ...],
    target: str,
    keys: list[str] | tuple[str, ...],
    settings: Settings = STATION,
) -> Boosted:
    """Bin and grow: see ``prepare`` and ``grow``. Rows without a target are left out."""
    return grow(prepare(df, features, target, keys, settings.bins), settings)


# --- fixed values: the grid of the random search ---------------------------------
GRID = {
    "rounds": [100, 200, 300],
    "depth": [6, 8, 10],
    "rate": [0.05, 0.1, 0.15],
    "rows": [0.8, 0.9, 1.0],
    "columns": [0.8, 0.9, 1.0],
}
DRAWS, FOLDS = 20, 3


def drawn(grid: dict[str, list], draws: int, base: Settings) -> list[Settings]:
    """``draws`` different random settings of the grid, all if there are no more."""
    total = math.prod(len(v) for v in grid.values())
    out = []
    for index in random.Random(base.seed).sample(range(total), min(draws, total)):
        picked = {}
        for name, values in grid.items():
            index, at = divmod(index, len(values))
            picked[name] = values[at]
        out.append(replace(base, **picked))
    return out


def time_folds(df: DataFrame, time: str, tie: str, folds: int = FOLDS) -> Column:
    """The part of each row: 0 .. folds, of equal sizes in (time, tie) order; null without time."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    lean = df.where(F.col(time).isNotNull()).select(micros.alias("t"), F.col(tie).cast("long").alias("k"))
    part = F.lit(0)
    for i in range(1, folds + 1):
        cut = split.cut_row(lean, i / (folds + 1))
        if cut is not None:
            behind = (micros > cut[0]) | ((micros == cut[0]) & (F.col(tie) > cut[1]))
            part = part + behind.cast("int")
    return F.when(F.col(time).isNotNull(), part)


def r2_of(data: Binned, model: Boosted, where: Column) -> tuple[int, float | None]:
    """Rows and R2 of the model on binned rows; None where the target is constant."""
    trees, first = model.trees, model.first

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _unpacked(batch)
            score = np.full(batch.num_rows, first, dtype=np.int64)
            for t in trees:
                score += t.value[t.nodes(bins)]
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(score)], names=["y", "p"])

    y, p = F.col("y") / float(UNIT), F.col("p") / float(UNIT)
    found = data.rows.where(where).mapInArrow(work, "y long, p long").agg(
        F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("e"), F.var_pop(y).alias("v")
    ).first()
    return found.n, 1 - found.e / (found.n * found.v) if found.n and found.v else None


def search(
    df: DataFrame,
    features: list[str] | tuple[str, ...],
    target: str,
    keys: list[str] | tuple[str, ...],
    time: str,
    tie: str,
    grid: dict[str, list] | None = None,
    draws: int = DRAWS,
    folds: int = FOLDS,
    base: Settings = FUSED,
) -> DataFrame:
    """Random search by folds in time order, every fit from one binned table.

    Rows are cut into ``folds`` + 1 parts by time; fold i learns from the parts in front of
    part i and is tested on part i, so nothing later is learned from. One row for each setting
    and fold: setting (JSON), fold, train_rows, test_rows, r2, mean_r2 of the setting, is_best.
    """
    parts = materialize(df.withColumn("_part", time_folds(df, time, tie, folds)), "search-rows")
    data = prepare(parts.where(F.col("_part").isNotNull()), features, target, keys, base.bins, F.col("_part"))
    sizes = {r.part: r.n for r in data.rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for settings in drawn(grid or GRID, draws, base):
        name = json.dumps(asdict(settings), sort_keys=True)
        for i in range(1, folds + 1):
            model = grow(data, settings, F.col("part") < i)
            n, r2 = r2_of(data, model, F.col("part") == i)
            out.append((name, i, sum(sizes.get(j, 0) for j in range(i)), n, r2))
    schema = "setting string, fold int, train_rows long, test_rows long, r2 double"
    table = df.sparkSession.createDataFrame(out, schema)
    mean = F.avg("r2").over(Window.partitionBy("setting"))
    best = F.first("setting").over(Window.partitionBy(F.lit(1)).orderBy(F.col("mean_r2").desc(), "setting"))
    return table.withColumn("mean_r2", mean).withColumn("is_best", (F.col("setting") == best).cast("int"))


def _scored(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """The rows with the newer trees in their scores."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _unpacked(batch)
            score = batch["score"].to_numpy().copy()
            for t in trees:
                score += t.value[t.nodes(bins)]
            arrays = [batch["u"], batch["y"], pa.array(score), batch["bins"], batch["part"]]
            yield pa.RecordBatch.from_arrays(arrays, names=["u", "y", "score", "bins", "part"])

    return rows.mapInArrow(work, _BINNED)


def oracle_sql(source: str, keys: list[str], features: list[str], target: str, settings: Settings) -> str:
    """The trees of ``fit`` as SQL over the table ``source``: a chain of levels, histograms by plain grouping.

    Gives the rows of ``Boosted.splits``.
    """
    s, n = settings, len(features)
    key = " || '|' || ".join(f"coalesce({k}::varchar, '')" for k in keys)
    values = ", ".join(f"({f})::double" for f in features)
    names = ", ".join(f"'{f}'" for f in features)

    def score(g: str, rows: str) -> str:
        shrunk = f"greatest(abs({g} / {float(UNIT)}::double) - {s.alpha!r}::double, 0)"
        return f"({shrunk}) * ({shrunk}) / ({rows} + {s.lam!r}::double)"

    parts = [
        f"""bo_rows as materialized (select row_number() over () as r, ('0x' || md5({key})[1:11])::bigint % {PRIME} as u,
          floor({target}::double * {UNIT} + 0.5)::bigint as y, [{values}] as fs from {source} where {target} is not null)""",
        "bo_first as materialized (select (sum(y) // count(*))::bigint as first from bo_rows)",
        f"""bo_long as materialized (select r, f, fs[f + 1] as v from bo_rows, range({n}) t(f))""",
        "bo_span as (select f, min(v) as a, max(v) as b from bo_long group by f having min(v) < max(v))",
        f"""bo_cell as (select f, least(floor((v - a) / (b - a) * {CELLS}), {CELLS - 1}) as cell, count(*) as n, min(v) as v
          from bo_long join bo_span using (f) where v is not null group by all)""",
        f"""bo_share as (select *, floor(coalesce(sum(n) over (partition by f order by cell rows between unbounded preceding
          and 1 preceding), 0) * {s.bins} / sum(n) over (partition by f)) as q, count(*) over (partition by f) as cells
          from bo_cell)""",
        "bo_step as (select *, lag(q) over (partition by f order by cell) as last from bo_share)",
        f"""bo_cuts as materialized (select f, list(v order by v) as cuts from bo_step
          where last is not null and (cells <= {s.bins} or q > last) group by f)""",
        """bo_bins as materialized (select r, f, case when v is null then 0
          else 1 + coalesce(len(list_filter(cuts, lambda x: x <= v)), 0) end as bin
          from bo_long left join bo_cuts using (f))""",
        "bo_score0 as materialized (select r, first as score from bo_rows, bo_first)",
    ]
    out = []
    for k in range(s.rounds):
        factor, offset, columns = round_sample(s, k, n)
        border = int(s.rows * PRIME)
        parts.append(f"""bo_{k}_0 as materialized (select r, 0 as node, score - y as g, (u * {factor} + {offset}) % {PRIME} < {border} as taken
          from bo_rows join bo_score{k} using (r))""")
        listed = ", ".join(map(str, columns))
        for level in range(s.depth):
            t = f"bo_{k}_{level}"
            first = (1 << level) - 1
            parts += [
                f"""{t}_c as (select node, f, bin, sum(g)::bigint as g, count(*) as n from {t} join bo_bins using (r)
                  where taken and node >= {first} and f in ({listed}) group by all)""",
                f"""{t}_s as (select node, f, bin, sum(g) over line as gl, sum(n) over line as nl, sum(g) over (partition by node, f) as g,
                  sum(n) over (partition by node, f) as n from {t}_c
                  window line as (partition by node, f order by bin rows between unbounded preceding and current row))""",
                f"""{t}_g as (select *, {score('gl', 'nl')} + {score('(g - gl)', '(n - nl)')} - {score('g', 'n')} as gain
                  from {t}_s where nl >= {s.least} and n - nl >= {s.least})""",
                f"""{t}_b as materialized (select node, f, bin, gain, gl, nl, g, n from {t}_g
                  where gain > 0 and gain >= {s.gamma!r} qualify row_number() over (partition by node order by gain desc, f, bin) = 1)""",
                f"""bo_{k}_{level + 1} as materialized (select t.r, case when b.node is null then t.node
                  else 2 * t.node + 1 + (x.bin > b.bin)::int end as node, t.g, taken
                  from {t} t left join {t}_b b using (node) left join bo_bins x on x.r = t.r and x.f = b.f)""",
            ]
        end = f"bo_{k}_{s.depth}"
        inner = " union all ".join(f"select node, f, bin, gain, n from bo_{k}_{level}_b" for level in range(s.depth))
        parts += [
            f"bo_inner{k} as materialized ({inner})",
            f"bo_sums{k} as (select node, sum(g) filter (taken) as g, count(*) filter (taken) as n from {end} group by node)",
            f"""bo_leaf{k} as materialized (select node, n, floor(-sign(g) * greatest(abs(g / {float(UNIT)}::double) - {s.alpha!r}::double, 0)
              / (n + {s.lam!r}::double) * {s.rate!r}::double * {UNIT} + 0.5)::bigint as value from bo_sums{k} where n > 0)""",
            f"""bo_score{k + 1} as materialized (select r, score + coalesce(value, 0) as score from bo_score{k}
              join {end} using (r) left join bo_leaf{k} using (node))""",
        ]
        out += [
            f"""select {k} as round, node, ([{names}])[f + 1] as feature, case when bin > 0 then cuts[bin] end as cut, gain, n as rows,
              null::double as value from bo_inner{k} left join bo_cuts using (f)""",
            f"""select {k}, node, null, null, null, n, value / {float(UNIT)}::double from bo_leaf{k}""",
        ]
    return ", ".join(parts) + " , bo_nodes as (" + " union all ".join(out) + ")"
