"""Byte-level BPE by recursive queries on each partition."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import byte_slices, released, slices

#: Bytes of the texts whose words are looked up together (a longer text alone), words that go
#: into one recursive query, and tokens into one decoding query.
BYTES, WORDS, TOKENS = 500_000, 5_000, 200_000
#: A worker remembers the tokens of so many different words, then only of the half met most often.
REMEMBERED = 200_000
#: The recursive query takes a round for each merge of its longest word. Words of more bytes
#: are merged by the same rule with a heap.
LONG = 200

# A word is one list: its tokens (above ID) and between two of them, and at both ends, the rank
# of their merge (NONE: no merge). In each round the least rank of each word, the leftmost one
# of equals, becomes the token of that rank in place of its two parts, and the ranks of the
# merges with both neighbours are looked up. Words without a merge leave the recursion.
ID, NONE = 1 << 24, 1 << 28
ENCODE = f"""
with recursive state(w, l) as (
  select w, l from start
  union all
  (with least as (select w, l, list_min(l) as m from state),
   best as (select w, l, m, list_position(l, m) as i from least where m < {ID})
   select w, l[:i-3] || [coalesce(a.m, {NONE}), best.m + {ID}, coalesce(b.m, {NONE})] || l[i+3:]
   from best
   left join merges a on a.ab = (l[i-3] - {ID})::bigint * 1048576 + best.m
   left join merges b on b.ab = best.m::bigint * 1048576 + l[i+3] - {ID}))
select w, l from state where list_min(l) >= {ID} order by w
"""

# The aggregation runs over each row's list in its order.
DECODE = """
select d, unhex(coalesce(list_aggregate(
    list_transform(ids, lambda x: case when x >= 0 then pieces[x + 1] end), 'string_agg', ''), '')) as bytes
from rows, vocabulary order by d
"""


def ranks_of(path: str) -> dict[bytes, int]:
    """A file of ranks: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def name_of(ranks: dict[bytes, int], pattern: str) -> str:
    """A digest of a vocabulary and its pattern."""
    digest = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        digest.update(b"%d %d " % (rank, len(token)) + token)
    return digest.hexdigest()


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tables: set[str] = set()
        self.byte = np.zeros(256, dtype=np.int32)
        self.pair = np.full(1 << 16, NONE, dtype=np.int32)  # the rank of two bytes
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
            elif len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = rank
        self.duck = duckdb.connect()
        self.duck.execute("set threads = 1")
        self.duck.execute("set memory_limit = '200MB'")
        self.forget()

    def given(self, name: str, data: Callable[[], pa.Table]) -> None:
        """A table of the connection, made when it is first needed."""
        if name not in self.tables:
            self.duck.register("given", data())
            self.duck.execute(f"create table {name} as select * from given")
            self.duck.unregister("given")
            self.tables.add(name)

    def merges(self) -> pa.Table:
        """Pairs of tokens whose bytes together are a token, and its rank."""
        ranks = self.ranks
        pairs = [
            (ranks[t[:i]] * 1048576 + ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        return pa.table({"ab": pa.array([p for p, _ in pairs], pa.int64()), "m": pa.array([m for _, m in pairs], pa.int32())})

    def vocabulary(self) -> pa.Table:
        """One row: the bytes of every id, in hex, by place in a list."""
        pieces: list[str | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token.hex()
        return pa.table({"pieces": [pieces]})

    def forget(self) -> None:
        """Remembers no word."""
        self.number: dict[str, int] = {}
        self.starts = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def thin(self, most: int) -> None:
        """Remembers only the ``most`` words met most often (of equals the later ones)."""
        if len(self.number) <= most:
            return
        keep = np.sort(np.argsort(self.met, kind="stable")[len(self.met) - most :])
        words = list(self.number)
        self.number = {words[i]: n for n, i in enumerate(keep.tolist())}
        self.flat = self.tokens(keep)
        self.counts, self.met = self.counts[keep], self.met[keep] // 2
        self.starts = np.cumsum(self.counts) - self.counts

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The tokens of remembered words, one word after the other."""
        n = self.counts[at]
        return self.flat[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def heaped(self, word: bytes) -> list[int]:
        """The tokens of a long word: the least rank first, the leftmost of equals."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        rank = self.ranks.get
        heap = [(r, i, 1, 1) for i in range(len(word) - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else len(word)
            if j >= len(word) or len(parts[i]) != a or len(parts[j]) != b:
                continue  # one of the parts has been merged since
            parts[i], parts[j] = parts[i] + parts[j], None
            right[i] = right[j]
            if right[i] < len(word):
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < len(word) and (r := rank(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, len(parts[x]), len(parts[y])))
        return [self.ranks[p] for p in parts if p is not None]

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of words by the recursive query."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(2 * lengths + 1)])
        place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        spot = np.repeat(bounds[:-1], lengths) + 2 * place + 1
        state = np.full(bounds[-1], NONE, dtype=np.int32)
        state[spot] = self.byte[raw] + ID
        inner = place[1:] > 0  # both bytes belong to one word
        state[spot[1:][inner] - 1] = self.pair[raw[:-1] << 8 | raw[1:]][inner]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(state))
        self.given("merges", self.merges)
        self.duck.register("start", pa.table({"w": np.arange(len(words), dtype=np.int32), "l": lists}))
        found = self.duck.sql(ENCODE).to_arrow_table()["l"].combine_chunks()
        self.duck.unregister("start")
        offsets = found.offsets.to_numpy()
        values = found.values.to_numpy() - ID
        return [values[a + 1 : b : 2] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def learn(self, words: list[str]) -> None:
        """Remembers the tokens of words not met so far."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found: list = [None] * len(raw)
        query = []
        for i, w in enumerate(raw):
            whole = self.ranks.get(w)  # a word that is a token needs no merges
            if whole is not None:
                found[i] = (whole,)
            elif len(w) > LONG:
                found[i] = self.heaped(w)
            else:
                query.append(i)
        for a in range(0, len(query), WORDS):
            part = query[a : a + WORDS]
            for i, ids in zip(part, self.merged([raw[i] for i in part]), strict=True):
                found[i] = ids
        counts = np.array([len(f) for f in found], dtype=np.int64)
        flat = np.concatenate([np.asarray(f, dtype=np.int32) for f in found])
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.met = np.concatenate([self.met, np.zeros_like(counts)])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The token ids of each text."""
        if len(self.number) > REMEMBERED:
            self.thin(REMEMBERED // 2)
        words = [self.find(t) if t else [] for t in texts]
        new = set()
        for w in words:
            new.update(w)
        new = [w for w in new if w not in self.number]
        if new:
            self.learn(new)
        ends = np.cumsum([0, *map(len, words)])
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=ends[-1])
        self.met += np.bincount(at, minlength=len(self.met))
        lengths = np.concatenate([[0], np.cumsum(self.counts[at])])[ends]
        return pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(self.tokens(at), pa.int32()))

    def decode(self, ids: pa.Array) -> list[bytes]:
        """The bytes of each row of ids, in slices of bounded size."""
        self.given("vocabulary", self.vocabulary)
        lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out = [b""] * len(ids)
        a = 0
        while a < len(ids):
            b, held = a + 1, lengths[a]
            while b < len(ids) and held + lengths[b] <= TOKENS:
                held += lengths[b]
                b += 1
            self.duck.register("rows", pa.table({"d": np.arange(a, b), "ids": ids.slice(a, b - a)}))
            found = self.duck.sql(DECODE).to_arrow_table()
            self.duck.unregister("rows")
            for d, raw in zip(found["d"].to_pylist(), found["bytes"].to_pylist(), strict=True):
                out[d] = raw
            a = b
        return out


_codecs: dict[str, Codec] = {}


def codec(name: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    """This worker's codec of the vocabulary called ``name``; it is kept over partitions, so words are merged once."""
    if name not in _codecs:
        for old in _codecs.values():
            old.duck.close()
        _codecs.clear()
        _codecs[name] = Codec(ranks, pattern)
    return _codecs[name]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text in the column ``ids`` (replaced if there).

    Each match of ``pattern`` is a word of its own; a word that is a token is taken whole,
    any other is merged by rank. Null and empty texts have no ids. Special tokens in a text
    are ordinary text. Repeated rows and an empty table need no rule. The file of ranks is
    read on the driver and sent along (about 1 MB).
    """
    ranks = ranks_of(ranks_path)
    name = name_of(ranks, pattern)
    kept = [c for c in docs.columns if c != ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, ranks, pattern)
        for batch in byte_slices(batches, text, BYTES):
            found = own.encode(batch[text].to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), found], names=[*kept, ids])

    data = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = data.withColumn(ids, F.array().cast("array<int>")).schema
    return data.mapInArrow(lambda batches: released(work(batches)), schema)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their token ids in the column ``out`` (replaced if there).

    Null and empty ids give no bytes; ids outside the vocabulary stand for nothing.
    """
    ranks = ranks_of(ranks_path)
    name = name_of(ranks, pattern)
    kept = [c for c in rows.columns if c != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, ranks, pattern)
        for batch in slices(batches):
            raw = own.decode(batch[ids].cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(raw, pa.binary())], names=[*kept, out]
            )

    data = rows.select(*[F.col(f"`{c}`") for c in kept])
    schema = data.withColumn(out, F.lit(None).cast("binary")).schema
    return data.mapInArrow(lambda batches: released(work(batches)), schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` (with a column text) with n_tokens, ids_sha256 and decoded_sha256, without the text.

    Encoding and decoding share a pass, so a task needs one worker and ids are not sent to and fro.
    """
    ranks = ranks_of(ranks_path)
    name = name_of(ranks, pattern)
    kept = [c for c in docs.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, ranks, pattern)
        for batch in byte_slices(batches, "text", BYTES):
            ids = own.encode(batch["text"].to_pylist())
            decoded = pa.array(own.decode(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), ids, decoded], names=[*kept, "ids", "decoded"])

    data = docs.select("text", *[F.col(f"`{c}`") for c in kept])
    empty = F.array().cast("array<int>")
    schema = data.drop("text").withColumn("ids", empty).withColumn("decoded", F.lit(None).cast("binary")).schema
    coded = data.mapInArrow(lambda batches: released(work(batches)), schema)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        *[F.col(f"`{c}`") for c in kept],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
