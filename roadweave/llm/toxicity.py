"""Toxic spans by a linear-chain conditional random field, and document scores from them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import bounded, byte_slices, released, stored

#: The model is learned from about this many labelled rows that are not toxic and that are,
#: taken by the hash of their keys, and from at most WINDOWS stretches of REACH words on both
#: sides of a word with features in each of them.
SAMPLE, WINDOWS, REACH = (12_000, 6_000), 20, 4
#: A feature is tried if it occurs in LEAST toxic rows. It is used if its counts are likelier
#: under its own share of toxic rows than under that of all rows by a factor of e^EVIDENCE
#: times the number of features tried, so chance gives less than one in ten models a feature;
#: of these the FEATURES most telling.
LEAST, EVIDENCE, FEATURES = 4, 2.5, 4_000
#: A word of a toxic row is labelled toxic if rows with one of its features are toxic with
#: this smoothed probability, both classes weighing the same.
SURE = 0.95
#: A score from which a document is rejected.
THRESHOLD = 0.3
#: Bytes of the texts that a worker treats at once (a longer text alone).
BYTES = 4_000_000
#: Words whose score a worker remembers.
REMEMBERED = 100_000

WORDS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A word itself and its beginnings."""
    return [f"w:{word}", *(f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n)]


@dataclass
class Model:
    """weights: of features for the state toxic; bias: of that state; change[a][b]: of the
    step from state a to b; scale: of the document score (intercept first)."""

    weights: dict[str, float]
    bias: float
    change: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        self.known: dict[str, float | None] = {}
        self.powers: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "powers")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def emission(self, word: str) -> float:
        """What a word's features add to the state toxic; 0 for a word without any."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def plain(self, n: int) -> np.ndarray:
        """The product of the steps over n words without features, scaled to sum 1."""
        found = self.powers.get(n)
        if found is None:
            step = np.exp(self.change) * np.exp([0.0, self.bias])[None, :]
            found, base, m = np.eye(2), step / step.sum(), n
            while m:
                if m & 1:
                    found = found @ base
                    found /= found.sum()
                base = base @ base
                base /= base.sum()
                m >>= 1
            if len(self.powers) < 10_000:
                self.powers[n] = found
        return found

    def marginals(self, places: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Probability of the state toxic at the words with features of a text of n words.

        Forward and backward messages pass the words between them, which all score alike,
        by one matrix product, so the result is that of the recursion over all words.
        """
        step = np.exp(self.change)
        own = np.exp(np.stack([np.zeros(len(scores)), np.minimum(self.bias + scores, 50)], axis=1))
        start = np.exp([0.0, self.bias]) if places[0] else None
        forward = np.empty((len(places), 2))
        for i, p in enumerate(places):
            if i == 0:
                into = np.ones(2) if start is None else (start / start.sum()) @ self.plain(int(p) - 1) @ step
            else:
                into = forward[i - 1] @ self.plain(int(p - places[i - 1]) - 1) @ step
            forward[i] = into * own[i]
            forward[i] /= forward[i].sum()
        backward = np.ones((len(places), 2))
        behind = self.plain(n - 1 - int(places[-1])) @ np.ones(2)
        for i in range(len(places) - 1, -1, -1):
            backward[i] = behind / behind.sum()
            if i:
                gap = int(places[i] - places[i - 1]) - 1
                behind = self.plain(gap) @ step @ (own[i] * backward[i])
        both = forward * backward
        return both[:, 1] / both.sum(axis=1)

    def tagged(self, text: str | None) -> tuple[np.ndarray, list[tuple[int, int]], list[float]]:
        """Document features, offsets of words with features, and their marginals."""
        if not text:
            return np.zeros(3), [], []
        low = text.lower()
        words = WORDS.findall(low)
        scores = np.fromiter(map(self.emission, words), dtype=float, count=len(words))
        places = np.nonzero(scores)[0]
        if not len(places):
            return np.zeros(3), [], []
        m = self.marginals(places, scores[places], len(words))
        none = np.log1p(-np.minimum(m, 1 - 1e-9)).sum()
        values = np.array([1 - np.exp(none), m.max(), np.log1p(m.sum())])
        found = np.nonzero(m >= 0.5)[0]
        spans: list[tuple[int, int]] = []
        if len(found):
            # lower case may change lengths; the words are then found in the text as it is
            spots = [x.span() for x in WORDS.finditer(low if len(low) == len(text) else text)]
            if len(spots) == len(words):
                spans = [spots[places[i]] for i in found]
        return values, spans, [float(m[i]) for i in found[: len(spans)]]

    def score(self, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1:] @ values, -50, 50))))


def training(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: tuple[int, int]) -> DataFrame:
    """About ``sample`` labelled rows (text, toxic, weight) of each class, of rows that are not held out."""
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(label).cast("int").alias("toxic"))
        .filter(~held_out(F.col("_key")) & F.col("toxic").isin(0, 1))
    )
    sizes = dict(known.groupBy("toxic").count().collect())
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("toxic") == value, min(1.0, sample[value] / n)).otherwise(share)
    part = F.pmod(F.xxhash64("_key", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    chosen = known.filter(part < share).withColumn("weight", F.try_divide(F.lit(1.0), share))
    # at most about twice the sample, so small enough to send along
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return stored(
        rows.join(bounded(chosen, 2 * sum(sample) + 1_000), "_key").select("text", "toxic", "weight"), "toxic-sample"
    )


def held_out(key):
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def telling(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """Features that tell toxic rows from others: the smoothed probability of toxic."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", BYTES):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for t, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                words = {w for w in WORDS.findall(t.lower()) if len(w) > 2}
                counts[toxic].update({f for w in words for f in features(w)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)],
                names=["feature", "clean", "toxic"],
            )

    n = dict(rows.groupBy("toxic").count().collect())
    if not n.get(1):
        return {}
    share = (F.col("toxic") + 0.5) / (n[1] + 1)
    other = (F.col("clean") + 0.5) / (n.get(0, 0) + 1)
    q = n[1] / (n[1] + n.get(0, 0) + 1)
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(rate / q) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - q))
    ).otherwise(0.0)
    tried = stored(
        rows.select("text", "toxic")
        .mapInArrow(work, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= LEAST),
        "toxic-features",
    )
    enough = EVIDENCE + np.log(max(tried.count(), 1))
    found = (
        tried.withColumn("p", share / (share + other))
        .withColumn("z", F.sqrt("toxic") * F.log(share / other))
        .filter((F.col("p") > 0.6) & (gain >= float(enough)))
        .orderBy(F.desc("z"), "feature")
        .limit(FEATURES)
        .collect()
    )
    return {r.feature: (r.p, r.z) for r in found}


def windows(rows: DataFrame, lexicon: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled stretches of the sample: (entries (window, place, feature), labels, lengths)."""
    number = {f: i for i, f in enumerate(lexicon)}
    sure = {f for f, (p, _) in lexicon.items() if p >= SURE}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", BYTES):
            data, label = [], []
            for t, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                words = WORDS.findall(t.lower())
                found = [[number[f] for f in features(w) if f in number] if len(w) > 2 else [] for w in words]
                names = [toxic and any(f in sure for f in features(w)) for w in words]
                active = [i for i, f in enumerate(found) if f]
                if len(active) > WINDOWS:
                    active = active[:: len(active) // WINDOWS + 1]
                for i in active:
                    span = range(max(0, i - REACH), min(len(words), i + REACH + 1))
                    data.append([found[j] for j in span])
                    label.append([int(names[j]) for j in span])
            yield pa.RecordBatch.from_arrays(
                [pa.array(data, pa.list_(pa.list_(pa.int32()))), pa.array(label, pa.list_(pa.int32()))],
                names=["found", "label"],
            )

    made = rows.select("text", "toxic").mapInArrow(work, "found array<array<int>>, label array<int>").collect()
    width = 2 * REACH + 1
    labels, entries = np.full((len(made), width), -1), []
    for w, r in enumerate(made):
        labels[w, : len(r.label)] = r.label
        entries += [(w, t, f) for t, fs in enumerate(r.found) for f in fs]
    return np.array(entries, dtype=np.int64).reshape(-1, 3), labels, (labels >= 0).sum(axis=1)


def fit_field(entries: np.ndarray, labels: np.ndarray, count: int, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and steps of the field that maximise the likelihood of the labels, with a
    small penalty, by gradient steps with moments over all windows."""
    n, width = labels.shape
    there = labels >= 0
    truth = (labels == 1).astype(float)
    theta = np.zeros(count + 1 + 4)
    theta[count] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    flat = entries[:, 0] * width + entries[:, 1]
    pair = there[:, 1:] & there[:, :-1]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((labels[:, :-1] == a) & (labels[:, 1:] == b) & pair).sum()
    for step in range(1, rounds + 1):
        emit = np.bincount(flat, weights=theta[entries[:, 2]], minlength=n * width).reshape(n, width) + theta[count]
        own = np.exp(np.stack([np.zeros_like(emit), np.clip(emit, -30, 30)], axis=2))
        change = np.exp(theta[count + 1 :].reshape(2, 2))
        forward, backward = np.ones((n, width, 2)), np.ones((n, width, 2))
        forward[:, 0] = own[:, 0]
        forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, width):
            f = (forward[:, t - 1] @ change) * own[:, t]
            f /= f.sum(axis=1, keepdims=True)
            forward[:, t] = np.where(there[:, t, None], f, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            b = (own[:, t + 1] * backward[:, t + 1]) @ change.T
            b /= b.sum(axis=1, keepdims=True)
            backward[:, t] = np.where(there[:, t + 1, None], b, 1.0)
        both = forward * backward
        marginal = both[..., 1] / both.sum(axis=2)
        error = np.where(there, truth - marginal, 0.0)
        joint = forward[:, :-1, :, None] * change[None, None] * (own[:, 1:] * backward[:, 1:])[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        expected = (joint * pair[..., None, None]).sum(axis=(0, 1))
        gradient = np.concatenate(
            [
                np.bincount(entries[:, 2], weights=error.ravel()[flat], minlength=count),
                [error.sum()],
                (seen - expected).ravel(),
            ]
        )
        gradient = gradient / max(n, 1) - 1e-5 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:count], float(theta[count]), theta[count + 1 :].reshape(2, 2)


def calibrated(values: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of the document features, by Newton steps with a small penalty."""
    x = np.column_stack([np.ones(len(values)), values])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (toxic - p)) - 0.5 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: tuple[int, int] = SAMPLE,
) -> Model:
    """The field of a bounded sample of labelled rows whose crc32(key as text) mod 4 is not 2.

    Labels are given to documents; words get theirs by the features that tell toxic
    documents apart. Null labels and texts teach nothing; of several labels of a key the
    largest counts. Without toxic rows every score is that of no finding.
    """
    rows = training(docs, labels, key, text, label, sample)
    lexicon = telling(rows)
    names = list(lexicon)
    model = Model({}, -5.0, np.zeros((2, 2)), np.array([-5.0, 0.0, 0.0, 0.0]))
    if not names:
        return model
    entries, marked, _ = windows(rows, lexicon)
    if not len(entries) or not (marked == 1).any():
        return model
    weights, bias, change = fit_field(entries, marked, len(names))
    model = Model(
        {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-3}, bias, change, model.scale
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", BYTES):
            found = np.array([model.tagged(t)[0] for t in batch["text"].to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(found[:, i], pa.float64()) for i in range(3)), batch["toxic"], batch["weight"]],
                names=["a", "b", "c", "toxic", "weight"],
            )

    # about two samples of rows of five numbers
    seen = rows.mapInArrow(work, "a double, b double, c double, toxic int, weight double").toPandas()
    model.scale = calibrated(
        seen[["a", "b", "c"]].to_numpy(), seen["toxic"].to_numpy(float), seen["weight"].to_numpy(float)
    )
    return model


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "tox_") -> DataFrame:
    """``docs`` with tox_score (0 to 1), tox_starts, tox_ends (offsets in code points of words
    that are toxic with a marginal of a half or more) and tox_marginals.

    Only the text is looked at. Null and empty texts get the score of no finding and no
    offsets. Repeated rows get equal scores; an empty table stays empty. Columns that have
    one of the new names are replaced.
    """
    new = {"score": "double", "starts": "array<int>", "ends": "array<int>", "marginals": "array<double>"}
    kept = [c for c in docs.columns if c not in {prefix + n for n in new}]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text, BYTES):
            scores, starts, ends, marginals = [], [], [], []
            for t in batch[text].to_pylist():
                values, spans, found = model.tagged(t)
                scores.append(model.score(values))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                marginals.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in kept),
                    pa.array(scores, pa.float64()),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array(marginals, pa.list_(pa.float64())),
                ],
                names=[*kept, *(prefix + n for n in new)],
            )

    data = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = data
    for n, kind in new.items():
        schema = schema.withColumn(prefix + n, F.lit(None).cast(kind))
    return data.mapInArrow(lambda batches: released(work(batches)), schema.schema)
