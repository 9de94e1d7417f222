"""Operator 3: byte-level BPE encoding and decoding by two-tier lookup.

Tier one resolves a whole pre-token that is in the vocabulary by a minimal perfect hash (hash and displace:
one slot per vocabulary entry, one probe, one comparison). Tier two merges the bytes of the others with a
heap over a linked list, O(n log n) in the pre-token's length. Texts are cut by the public pattern first.

Null texts count as empty: no ids, empty bytes. Repeated texts give repeated results. Extra columns pass
through; an input column with the name of an output gives way to it. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from triplespan.llm import common

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of pre-tokens and their written ids that a worker remembers; beyond it the memory is emptied, results stay
#: the same. Each entry counts for ENTRY characters more.
REMEMBERED, ENTRY = 64 << 20, 160
#: The public pattern with its classes written out for texts without characters above U+024F, where Python's
#: own `re` is twice as fast.
LATIN = re.compile(r"[^\0-\u024f]")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\x09-\x0d\x20\x85\xa0"
LATIN_PATTERN = rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: `slot(key)` is their place in `keys`, -1 for others.

    Keys fall into as many buckets. From the fullest bucket down, each takes the first displacement
    that sends its keys to free slots; buckets of one key take the free slots that are left, written as -1 - slot.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys))
        grouped: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            grouped.setdefault(h % self.buckets, []).append((h >> 20, i))
        self.displaced, self.at, self.keys = [0] * self.buckets, [-1] * self.n, keys
        single = []
        for bucket, members in sorted(grouped.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                single.append((bucket, members[0][1]))
                continue
            d = 0
            while True:
                slots = [self._mixed(h, d) for h, _ in members]
                if len(set(slots)) == len(slots) and all(self.at[s] < 0 for s in slots):
                    break
                d += 1
            self.displaced[bucket] = d
            for s, (_, i) in zip(slots, members, strict=True):
                self.at[s] = i
        free = (s for s in range(self.n) if self.at[s] < 0)
        for (bucket, i), s in zip(single, list(free), strict=True):
            self.displaced[bucket], self.at[s] = -1 - s, i

    def _mixed(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 29 & 0xFFFFFFFF) % self.n

    def slot(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displaced[h % self.buckets]
        i = self.at[self._mixed(h >> 20, d) if d >= 0 else -1 - d]
        return i if self.keys[i] == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by lowest-rank merges, leftmost first: a heap of pairs over linked pieces.

    A heap entry is rank and start of a pair in one integer; it counts while that pair still has that rank.
    """
    n = len(piece)
    shift, get = n.bit_length(), ranks.get
    at, before, after = (1 << shift) - 1, list(range(-1, n)), list(range(1, n + 2))
    rank_at = [get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1, -1]
    heap = [r << shift | i for i, r in enumerate(rank_at) if r >= 0]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & at
        if rank_at[i] != top >> shift:
            continue  # one of its two pieces has changed since
        j = after[i]
        k = after[i] = after[j]
        rank_at[j] = rank_at[i] = -1
        if k < n:
            before[k] = i
            if (r := get(piece[i : after[k]], -1)) >= 0:
                rank_at[i] = r
                heappush(heap, r << shift | i)
        b = before[i]
        if b >= 0:
            rank_at[b] = r = get(piece[b:k], -1)
            if r >= 0:
                heappush(heap, r << shift | b)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec(dict):
    """Encodes and decodes by one rank file. As a dict it maps a pre-token to its ids, written in decimal."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        super().__init__()
        self.held = 0
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.any_pieces = regex.compile(pattern).findall
        self.latin_pieces = re.compile(LATIN_PATTERN).findall if pattern == public_tokenizers.PATTERN else None
        tokens = list(self.ranks)
        self.whole, self.id_at = PerfectHash(tokens), [self.ranks[t] for t in tokens]
        self.bytes_of = {str(r): t for t, r in self.ranks.items()}

    def __missing__(self, piece: str) -> str:
        raw = piece.encode()
        at = self.whole.slot(raw)
        ids = str(self.id_at[at]) if at >= 0 else " ".join(map(str, merged(raw, self.ranks)))
        self.held += len(piece) + len(ids) + ENTRY
        if self.held > REMEMBERED:
            self.clear()
            self.held = len(piece) + len(ids) + ENTRY
        if self.held <= REMEMBERED:
            self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        if self.latin_pieces and not LATIN.search(text):
            return self.latin_pieces(text)
        return self.any_pieces(text)

    def written_ids(self, text: str | None) -> str:
        """The ids in decimal, one space between them."""
        return " ".join(map(self.__getitem__, self.pieces(text or "")))

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.written_ids(text).split()))

    def decode_written(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))

    def decode(self, ids: list[int] | None) -> bytes:
        return b"".join(self.bytes_of[str(i)] for i in ids or ())


_codecs: dict[str, Codec] = {}


def codec(path: str = VOCABULARY) -> Codec:
    """One codec per worker and rank file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _extended(df: DataFrame, new: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in new)])


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", path: str = VOCABULARY) -> DataFrame:
    """Adds the token ids of column `text` as array<int>."""
    df = common.giving_way(df, [ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = pa.array([c.encode(t) for t in b.column(text).to_pylist()], pa.list_(pa.int32()))
            yield b.append_column(ids, got)

    return df.transform(common.in_arrow, run, _extended(df, [(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """Adds the bytes that the ids in column `ids` stand for (null: empty). An unknown id fails the job."""
    df = common.giving_way(df, [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield b.append_column(out, pa.array(map(c.decode, b.column(ids).to_pylist()), pa.binary()))

    return df.transform(common.in_arrow, run, _extended(df, [(out, T.BinaryType())]))


def encoded_with_digest(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Adds n_tokens, token_ids and decoded_sha256, the SHA-256 of the bytes that the ids stand for."""
    df = common.giving_way(df, ["n_tokens", "token_ids", "decoded_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids, digest = [], []
            for t in b.column(text):
                s = c.written_ids(t.as_py())
                ids.append(np.fromstring(s, np.int32, sep=" "))
                digest.append(hashlib.sha256(c.decode_written(s)).hexdigest())
            b = b.append_column("n_tokens", pa.array(map(len, ids), pa.int64()))
            yield b.append_column("token_ids", pa.array(ids, pa.list_(pa.int32()))).append_column("decoded_sha256", pa.array(digest, pa.string()))

    return df.transform(common.in_arrow, run, _extended(df, [("n_tokens", T.LongType()), ("token_ids", T.ArrayType(T.IntegerType())), ("decoded_sha256", T.StringType())]))


def digests(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the written ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for b in batches:
            counts, ids, decoded = [], [], []
            for t in b.column("text"):
                s = c.written_ids(t.as_py())
                counts.append(s.count(" ") + 1 if s else 0)
                ids.append(sha(s.encode()).hexdigest())
                decoded.append(sha(c.decode_written(s)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").transform(common.in_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
