"""Words and word shingles of texts as 64-bit hashes, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words whose hashes a worker remembers (about 20 MB); the memory is emptied when it is full.
REMEMBERED = 100_000


class Hashes(dict):
    """Number of a word in the list of hashes."""

    def __init__(self):
        super().__init__()
        self.values64 = np.empty(1 << 10, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.values64):
            self.values64 = np.concatenate([self.values64, np.empty(at, dtype=np.uint64)])
        self.values64[at] = xxhash.xxh64_intdigest(word)
        self[word] = at
        return at


_hashes = Hashes()


def forget() -> None:
    """Empties the worker's memory of words."""
    global _hashes
    _hashes = Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words between white space, A-Z in lower case; none for null."""
    global _hashes
    if not text:
        return np.empty(0, dtype=np.uint64)
    if len(_hashes) > REMEMBERED:
        _hashes = Hashes()
    # bytes: only A-Z change their case, only ASCII white space divides
    words = text.encode("utf-8", "surrogatepass").lower().split()
    at = np.fromiter(map(_hashes.__getitem__, words), dtype=np.int64, count=len(words))
    return _hashes.values64[at]


def batch_hashes(texts: pa.Array) -> list[np.ndarray]:
    """``word_hashes`` of each text of a column; each different word of it is hashed once, none is remembered."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = parts.flatten().dictionary_encode()
    different = words.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, different), dtype=np.uint64, count=len(different))
    at = words.indices.to_numpy()
    # white space at an end of a text makes an empty word
    real = at != (different.index(b"") if b"" in different else -1)
    ends = np.concatenate([[0], np.cumsum(real)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    found = hashes[at[real]]
    return [found[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = min(k, len(words))
    out = mixed(words[: len(words) - n + 1] + np.uint64(n))
    for i in range(1, n):
        out = mixed(out * np.uint64(3) + words[i : len(words) - n + 1 + i])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The different shingles of a text in rising order."""
    found = rolled(word_hashes(text), k)
    found.sort()
    if len(found) > 1:
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    return found
