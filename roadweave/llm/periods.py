"""Periodic runs of words by string synchronising sets at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import byte_slices, released
from roadweave.llm.shingles import mixed

#: Periods up to this are found by comparing all words with those so many places on.
SMALL = 10
#: The first scale: with contexts of 2 * t words, scale t finds the periods 3 t - 1 to 6 t - 2.
FIRST = 4
#: Bytes of the texts that a worker treats at once (a longer text alone).
BYTES = 4_000_000
#: Words of a reported run at least.
LEAST = 12

NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


class Numbers(dict):
    """A number for each different word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Finder:
    """The runs of a row of texts, whose words are numbers, each text with a number of its own behind it.

    ``runs`` maps (start, end) to the smallest period found. A stretch has the period q from
    its first place s on as long as word x equals word x + q, so it is known by any such x.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.words, self.starts, self.lengths = words, starts, lengths
        self.runs: dict[tuple[int, int], int] = {}
        self.fresh: list[tuple[int, int, int]] = []

    def add(self, start: int, end: int, period: int) -> None:
        old = self.runs.get((start, end))
        if old is None or period < old:
            self.runs[start, end] = period
            self.fresh.append((period, start, end))

    def small(self) -> None:
        """All runs of the periods 1 to SMALL."""
        words = self.words
        for q in range(1, min(SMALL, len(words) - 1) + 1):
            same = np.flatnonzero(words[q:] == words[:-q])
            if len(same) < q:
                continue
            cuts = np.flatnonzero(np.diff(same) > 1)
            first = same[np.concatenate([[0], cuts + 1])]
            last = same[np.concatenate([cuts, [len(same) - 1]])]
            for k in np.flatnonzero(last - first + 1 >= q):
                self.add(int(first[k]), int(last[k]) + 1 + q, q)

    def reach(self, x: int, q: int, step: int) -> int:
        """The last place from x on (step 1) or back (-1) where words q apart are still equal."""
        words, wide = self.words, 64
        while True:
            if step > 0:
                b = min(x + wide, len(words) - q)
                differ = np.flatnonzero(words[x:b] != words[x + q : b + q])
                if len(differ):
                    return x + int(differ[0]) - 1
                if b == len(words) - q:
                    return b - 1
                x = b
            else:
                a = max(x - wide + 1, 0)
                differ = np.flatnonzero(words[a : x + 1] != words[a + q : x + 1 + q])
                if len(differ):
                    return a + int(differ[-1]) + 1
                if a == 0:
                    return 0
                x = a - 1
            wide *= 2

    def verify(self, places: np.ndarray, periods: np.ndarray) -> None:
        """The whole run around each proposal: word x equals word x + q. Proposals in a stretch already seen go."""
        order = np.lexsort((places, periods))
        seen, past = 0, -1
        for x, q in zip(places[order].tolist(), periods[order].tolist(), strict=True):
            if q == seen and x < past:
                continue
            if self.words[x] != self.words[x + q]:
                continue
            a, b = self.reach(x, q, -1), self.reach(x, q, 1)
            seen, past = q, b + 1
            if b - a + 1 >= q:
                self.add(a, b + 1 + q, q)

    def touching(self, scale: int) -> None:
        """Runs over the seam of two highly periodic regions.

        Where a run's first period q lies whole in a region of a period p <= scale / 3, it has
        no synchronising position. Its second period lies in a region of the same p that
        begins within p words of the end of the first. All q of the one remainder by p that
        brings both in step are proposed.
        """
        ready = sorted({f for f in self.fresh if 3 * f[0] <= scale and f[2] - f[1] >= 9 * f[0] - 1})
        self.fresh = [f for f in self.fresh if 3 * f[0] > scale]
        words = self.words
        for (p, a, b), (p2, a2, b2) in zip(ready[:-1], ready[1:], strict=True):
            if p != p2 or not a2 <= b < a2 + p:
                continue
            root = words[a2 : a2 + p]
            for j in (a + np.flatnonzero(words[a : a + p] == root[0])).tolist():
                if np.array_equal(words[j : j + p], root):
                    least = 9 * p - 1
                    q = np.arange(least + (a2 - j - least) % p, min(a2 - a, b2 - b) + p, p)
                    self.verify(np.maximum(a2 - q, a), q)
                    break

    def scales(self) -> None:
        """The runs of longer periods.

        A place belongs to the synchronising set of scale t if of the hashes of the t words
        from it on and from each of the t next places on, its own or that of the last is the
        least; substrings of a period up to t / 3 take no part. So equal contexts of 2 t words
        belong to it together, and every stretch of t places has one unless the 3 t - 1 words
        from its first on have a period up to t / 3. Of a run of period q >= 3 t - 1 the first
        q words hold a place of the set whose context returns q words on, or are periodic
        themselves, which ``touching`` serves. Runs of smaller periods are all known before.
        """
        words = self.words
        numbers = np.arange(len(words))
        hashes = mixed(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        scale = 1
        while 2 * (3 * scale - 1) <= int(self.lengths.max(initial=0)):
            if scale >= FIRST:
                self.touching(scale)
                long = self.lengths >= 2 * (3 * scale - 1)
                held = int(self.lengths[long].sum()) + int(long.sum())
                if 2 * held < len(hashes):  # the texts that can hold such a period
                    stay = np.zeros(len(words) + 1, dtype=np.int64)
                    stay[self.starts[long]] += 1
                    stay[self.starts[long] + self.lengths[long] + 1] -= 1
                    inside = np.cumsum(stay)[numbers] > 0
                    numbers, hashes = numbers[inside], hashes[inside]
                wide = self.doubled(hashes, scale)
                self.proposals(numbers, hashes, wide, scale)
                hashes = wide
            else:
                hashes = self.doubled(hashes, scale)
            scale *= 2

    @staticmethod
    def doubled(hashes: np.ndarray, scale: int) -> np.ndarray:
        """Hashes of twice as many words; those past the end hold the last text's own number."""
        out = hashes * np.uint64(3)
        out[: len(out) - scale] += hashes[scale:]
        return mixed(out)

    def proposals(self, numbers: np.ndarray, hashes: np.ndarray, wide: np.ndarray, scale: int) -> None:
        """Places of the set with equal contexts at the distances of this scale."""
        n = len(hashes)
        if n <= 2 * scale:
            return
        own = hashes.copy()
        cover = np.zeros(n + 1, dtype=np.int64)
        flat = [(a, b) for (a, b), p in self.runs.items() if 3 * p <= scale <= b - a]
        if flat:
            a, b = np.array(flat).T
            at = np.searchsorted(numbers, a)
            here = (at < n) & (numbers[np.minimum(at, n - 1)] == a)  # the run's text is among the long ones
            np.add.at(cover, at[here], 1)
            np.add.at(cover, at[here] + (b - a)[here] - scale + 1, -1)
            own[np.cumsum(cover)[:n] > 0] = NEVER
        least, w = own, 1
        while w < scale:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        least = np.minimum(least[: n - scale], own[scale:])
        at = np.flatnonzero((least != NEVER) & ((least == own[: n - scale]) | (least == own[scale:])))
        context, low, high = wide[at], 3 * scale - 1, 6 * scale - 2
        places, periods = [], []
        for d in range(1, len(at)):
            apart = at[d:] - at[:-d]
            if apart.min() > high:
                break
            hit = np.flatnonzero((apart >= low) & (apart <= high) & (context[d:] == context[:-d]))
            places.append(numbers[at[hit]])
            periods.append(apart[hit])
        if places:
            self.verify(np.concatenate(places), np.concatenate(periods))


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each row of words, by start, then period."""
    number = Numbers()
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    words = np.full(int(lengths.sum()) + len(texts), -1, dtype=np.int64)
    for a, t in zip(starts.tolist(), texts, strict=True):
        words[a : a + len(t)] = np.fromiter(map(number.__getitem__, t), dtype=np.int64, count=len(t))
    words[starts + lengths] = len(number) + np.arange(len(texts))
    finder = Finder(words, starts, lengths)
    finder.small()
    finder.scales()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = [(a, b - a, q) for (a, b), q in finder.runs.items() if b - a >= max(least, 2 * q)]
    found.sort(key=lambda r: (r[0], r[2]))
    owners = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
    for (a, n, q), k in zip(found, owners.tolist(), strict=True):
        out[k].append((a - int(starts[k]), n, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for a, n, q in runs:
        change[a + q] += 1
        change[a + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


#: Types of the new columns.
OUT = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` without ``text``, with n_words, runs and collapsed (columns of these names are replaced).

    Words lie between ASCII white space. A run is a longest stretch of consecutive words with
    smallest period q, of ``least`` words and 2 q at least; runs are in order of start, then
    period. collapsed holds the words, joined by one space, that no run holds behind its first
    q words. Null and empty texts have no words, no runs and an empty collapsed text; repeated
    rows give a row each; an empty table gives none. Texts of any length are treated whole, a
    long one alone in memory; the work is near linear in the words.
    """
    kept = [c for c in docs.columns if c != text and c not in OUT]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in OUT.items()]).schema
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text, BYTES):
            words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch[text].to_pylist()]
            found = runs_of(words, least)
            left = [b" ".join(collapsed(w, r)) for w, r in zip(words, found, strict=True)]
            runs = [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in found]
            columns = [
                pa.array([len(w) for w in words], pa.int64()),
                pa.array(runs, kind),
                pa.array(left, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns], names=[*kept, *OUT])

    data = docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in kept])
    return data.mapInArrow(lambda batches: released(work(batches)), schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of runs and collapsed text."""
    runs = F.col("runs")
    longest = F.array_min(
        F.transform(
            runs,
            lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")),
        )
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("_longest")["less"]
    return found.withColumn("_longest", longest).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("_longest")["start"].alias("start"),
        length.alias("length"),
        F.col("_longest")["period"].alias("period"),
        F.floor(1000 * length / F.col("_longest")["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document repeats a stretch of words up to its end.

    With h the crc32 of the decimal id and g = floor(h / 10), word i >= a of a text of n words
    becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(
            n > 0,
            F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " "),
        ).otherwise(F.col("text"))

    # the one-element array gives the words a name, so they are split once
    changed = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull() & (h % 10 == 0), changed).otherwise(F.col("text")).alias("text"))
