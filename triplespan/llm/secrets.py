r"""Operator 7: secret scans by base patterns and dictionary-primed zstandard novelty.

Base kinds: assign (a sensitive name, `=` or `:`, a value of 6 or more characters; the span is the value), access
(AKIA and 16 or more of A-Z0-9), hex (24 or more of 0-9a-f). The method adds kind novel: a token of 16 or more
characters with letters and digits, no part of a base span, with a sensitive word within `NEAR` characters before it,
whose marginal compressed size (zstandard of its surroundings with it, less without it, primed by a dictionary of
common identifiers) is at least `NOVEL` bytes a character. Tokens that the dictionary or the surrounding code already
hold cost little and are left alone. In an assignment without spaces (`private_key=Zx81k...`) the name before an inner
`=` is context, and the value after it is the token. Tried in turn are the values after the first and the last sensitive name,
the token as a whole, and the values after the first and the last other name: five at most, so that work stays linear in the
length of a token, however many `=` it holds.

Spans are (kind, start, end) in code points, end exclusive, by start and then kind in the order above. With `matches`, as the
query has them, the base span of an assignment is its whole match, name included, as its contract counts spans of
matches; `redacted` blanks values only. Null and empty texts have none. Extra columns pass through `redacted`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from triplespan.llm import common

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{16})(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]+")
INNER = re.compile(r"=+(?=[^=])")
SENSITIVE = re.compile(r"(?ai:passw|secret|token|api.?key|auth|credential|bearer|private|signature|access)")
NEAR, AROUND, NOVEL = 48, 256, 0.7
#: Common identifiers of source code and configuration.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key client_id client_secret authorization bearer "
    "credentials username user_id session_id request_id response status message content_type application json charset utf-8 "
    "http https localhost example.com config settings environment variable default timeout retries connection database "
    "host port protocol version class function return import export const static public private protected string integer "
    "boolean float double null true false none self this new delete update insert select from where group order limit "
    "index table column value key name type size length width height color border margin padding font-family background "
    "onclick addEventListener getElementById document window console logger debug info warning error exception traceback "
    "test_case assertEquals assertTrue 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0000000000 1111111111 "
    "1234567890 xxxxxxxxxxxxxxxx deadbeefdeadbeef your_api_key_here changeme lorem ipsum dolor sit amet "
)


class Scanner:
    """Finds spans in one text; made once a task."""

    def __init__(self):
        words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False).compress

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place of the kind, end) of the base kinds, sorted."""
        return sorted(self.assigned(text, 1) + self.keys(text))

    def assigned(self, text: str, group: int) -> list[tuple[int, int, int]]:
        """Spans of assignments: of whole matches (group 0) or of values (1)."""
        return [(m.start(group), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]

    def keys(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]

    def novelty(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes a character of text[start:end] against its surroundings."""
        before, after = text[max(0, start - AROUND) : start].encode(), text[end : end + AROUND].encode()
        token = text[start:end].encode()
        return (len(self.compress(before + after + token)) - len(self.compress(before + after))) / len(token)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, k, reach = [], 0, 0  # base spans before k start before the candidate; the furthest of them ends at reach
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            while k < len(base) and base[k][0] < end:
                reach = max(reach, base[k][2])
                k += 1
            if reach > start:
                continue
            places, before = {True: [], False: []}, start  # the first and the last value, after sensitive and after other names
            for cut in INNER.finditer(text, start, end):
                found = places[bool(SENSITIVE.search(text, before, cut.end()))]
                found[1:], before = [cut.end()], cut.end()
            for at in [*places[True], start, *places[False]]:
                if self.is_novel(text, at, end):
                    out.append((start if self.is_novel(text, start, at) else at, 3, end))
                    break
        return out

    def is_novel(self, text: str, start: int, end: int) -> bool:
        """Whether text[start:end] is long and mixed enough, near a sensitive word before it, and novel."""
        if end - start < 16 or not re.search("[0-9]", text[start:end]) or not re.search("[A-Za-z]", text[start:end]):
            return False
        return bool(SENSITIVE.search(text, max(0, start - NEAR), start)) and self.novelty(text, start, end) >= NOVEL

    def spans(self, text: str | None, matches: bool = False) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans); with `matches` an assignment's span is its whole match."""
        text = text or ""
        base = self.base(text)
        added = self.added(text, base)
        if matches and any(x[1] == 0 for x in base):
            base = sorted(self.assigned(text, 0) + [x for x in base if x[1]])
        return base, sorted(base + added)


def written_spans(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame, matches: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of (doc_id, text); of whole matches or, by default, of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            counts, sha, spans = [[], [], []], [], []
            for t in b.column("text"):
                base, every = scanner.spans(t.as_py(), matches)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(written_spans(base).encode()).hexdigest())
                spans.append(written_spans(every))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").transform(common.in_arrow, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span replaced by [SECRET]; overlapping spans are one. Null texts stay null."""

    def clean(scanner: Scanner, t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        for a, _, b in scanner.spans(t)[1]:
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(out) + t[at:] if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array([clean(scanner, t.as_py()) for t in b.column(i)], b.schema.field(i).type))

    return docs.transform(common.in_arrow, run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.documents(spark, sf_dir), matches=True)
