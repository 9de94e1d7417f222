"""Vectorised hashing of the words of Arrow string columns, for operators on word shingles and windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random 64-bit value per byte, an odd base and its inverse modulo 2^64.
BYTE = _rng.integers(0, 1 << 64, 256, U64)
BASE = int(_rng.integers(0, 1 << 63, dtype=U64)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Another one, for a second hash that is independent of the first.
SECOND = _rng.integers(0, 1 << 64, 256, U64)
#: Bytes of text that are hashed at a time, so that memory is bounded whatever the batch holds.
CHUNK = 1 << 17


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    y ^= y >> U64(27)
    y *= U64(0x94D049BB133111EB)
    y ^= y >> U64(31)
    return y


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 and so on, n of them, modulo 2^64."""
    return usual_powers(base)[:n] if n <= CHUNK else _powers(base, n)


def _powers(base: int, n: int) -> np.ndarray:
    if n <= 1 << 10:  # one depends on the other, which is slow
        out = np.full(n, base, U64)
        out[:1] = 1
        return np.multiply.accumulate(out)
    few = 1 << (n.bit_length() + 1) // 2
    return np.multiply.outer(_powers(pow(base, few, 1 << 64), -(-n // few)), _powers(base, few)).ravel()[:n]


@lru_cache(maxsize=2)
def usual_powers(base: int) -> np.ndarray:
    """As many as `parts` needs, but for longer texts."""
    out = _powers(base, CHUNK)
    out.flags.writeable = False
    return out


def parts(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes of text; a longer text is a range of its own."""
    size = np.array([0 if n is None else n for n in pc.binary_length(batch.column(text)).to_pylist()], np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > CHUNK:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield start, len(size)


class Words:
    """Words of the texts of a string array: `start`, `end` (byte places in `data`), `hash`, and `first`,
    where first[i] : first[i + 1] are the words of text i. Null texts have none."""

    def __init__(self, texts: pa.Array, lower: bool = False, table: np.ndarray = BYTE):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        n = len(raw)
        word = (raw != 32) & ((raw < 9) | (raw > 13))
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < n)]  # a text's edge also parts words
        opens[inner] = word[inner]
        closes[inner - 1] = word[inner - 1]
        self.data, self.start, self.end = raw, np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.lower = lower
        self.hash = self.hashed(table)

    def hashed(self, table: np.ndarray) -> np.ndarray:
        """Hash of each word, by one random value per byte."""
        raw, n = self.data, len(self.data)
        if self.lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        values = table.take(raw.astype(np.intp))
        values *= powers(BASE, n)
        sums = np.zeros(n + 1, U64)
        np.cumsum(values, out=sums[1:])
        out = sums[self.end]
        out -= sums[self.start]
        out *= powers(INVERSE, n)[self.start]
        out += (self.end - self.start).astype(U64) * U64(0x9E3779B97F4A7C15)
        return mixed(out)

    def __len__(self) -> int:
        return len(self.first) - 1

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; windows that leave their text are not valid, see `whole`."""
        h, n = self.hash, len(self.hash)
        out = np.zeros(n, U64)
        if n >= k:
            for i in range(k):
                out[: n - k + 1] += mixed(h[i : n - k + 1 + i] + U64((i + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        return mixed(out)

    def windows_at(self, k: int, at: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """`windows` of the places `at` alone, which must be valid; `words`: other hashes of the words."""
        h, out = self.hash if words is None else words, np.zeros(len(at), U64)
        for i in range(k):
            out += mixed(h[at + i] + U64((i + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        return mixed(out)

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.hash)) + k <= last


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, lower-cased A-Z; a shorter text is one shingle."""
    w = Words(texts, lower=True)
    hashes, first, out = w.windows(k), w.first, []
    for i in range(len(w)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        elif b > a:
            short = mixed(np.bitwise_xor.reduce(mixed(w.hash[a:b] * U64(2) + np.arange(1, b - a + 1, dtype=U64) * U64(0xD1342543DE82EF95)))[None] + U64(b - a))
            out.append(short)
        else:
            out.append(np.zeros(0, U64))
    return out
