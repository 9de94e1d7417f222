r"""Operator 9: personal data by base patterns and bootstrapped contextual extraction.

Base kinds are email, ip, card and phone. The method starts from base spans as seed entities. A candidate is a token
with a digit, an @ or a bracketed at, a run of such numbers, or an address spelled over several tokens; its pattern is
the two words before it, lower-cased and stripped of punctuation (of the word that it is a part of, what follows the span
before). It may be of every kind whose loose test it passes
(`may_be`), in whatever notation. Spark scores the bipartite graph of patterns and instances for each kind: a pattern's
score is the smoothed share of known entities of that kind among its instances that may be of it. Patterns with a score
of `SURE` and at least `SUPPORT` distinct known instances make their other instances known for the next of `ROUNDS`
rounds, and at the end add their unseen instances as spans of kind <kind>_ctx.

Spans are (kind, start, end) in code points, by start and then kind. Null and empty texts have none. Repeated rows count
once a distinct instance. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespan.llm import common

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits starts, so others are not tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNS = re.compile(r"[0-9@]|[\[({<](?i:at)[\])}>]")
#: An address whose at or dots are spelled, or apart from the rest.
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({<]\x20?(?i:at)\x20?[\])}>]\x20?|\x20@\x20|\x20(?i:at)\x20(?=[A-Za-z0-9-]+\x20(?i:dot)\x20))"
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({<]\x20?(?i:dot)\x20?[\])}>]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)*"
)
NUMBER = re.compile(r"[(+]{0,3}+[0-9](?:[0-9()+/-]|\.(?=[0-9]))*+(?![\w@])")
NUMBERS = re.compile(rf"(?<![\w.+@/-]){NUMBER.pattern}(?:\x20(?:[/.-]\x20)?{NUMBER.pattern})++")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
ROUNDS, SURE, SUPPORT = 2, 0.8, 5
#: Words of more characters are known by their MD5.
LONG = 100


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[re.Match]:
    """Matches of EMAIL, found from each @ outwards: a match starts where the run of local characters before its @
    starts, or where the match before ended."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base kinds, sorted."""
    found = [(m.start(), 0, m.end()) for m in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def may_be(token: str) -> list[int]:
    """Places of the kinds whose loose test the token passes: signs and numbers of digits and letters, no notation."""
    digits, letters = len(re.findall("[0-9]", token)), len(re.findall(r"[^\W\d_]", token))
    tests = (
        SPELLED.search(token) or re.search(r"\S@\S", token),
        digits and re.fullmatch(r"[0-9A-Fa-f.:/%()\[\]-]+", token) and len(re.findall("[.:]", token)) >= 2,
        12 <= digits <= 19 and not letters,
        6 <= digits <= 15 and letters <= 4,
    )
    return [k for k, passed in enumerate(tests) if passed]


def long_candidates(text: str) -> list[tuple[int, int]]:
    """Addresses and numbers that are written as several tokens, sorted; of a run of numbers, the longest starts that may
    be a card or phone."""
    out = [m.span() for m in SPELLED.finditer(text)]
    for m in NUMBERS.finditer(text):
        tokens, i = [(x.start() + m.start(), x.end() + m.start()) for x in NUMBER.finditer(m[0])], 0
        while i < len(tokens) - 1:
            ends = range(min(len(tokens), i + 20) - 1, i, -1)  # a number of 19 digits has at most 19 tokens
            last = next((j for j in ends if may_be(text[tokens[i][0] : tokens[j][1]])), None)
            if last is not None:
                out.append((tokens[i][0], tokens[last][1]))
            i = i + 1 if last is None else last + 1
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int, int, list[int]]]:
    """(pattern, instance, kind or -1, start, end, kinds it may be of): base spans, and candidates outside of them."""
    ends = [b for _, _, b in base]
    for k in range(1, len(ends)):
        ends[k] = max(ends[k], ends[k - 1])
    starts = [a for a, _, _ in base]

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    taken = [(a, b, may_be(text[a:b])) for a, b in long_candidates(text) if free(a, b)]
    long, end, i = taken[:], 0, 0
    for m in SIGNS.finditer(text):
        p = m.start()
        if p < end:
            continue
        a = p
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        t = TOKEN.match(text, a)
        if not t or t.end() <= p:
            continue
        end = t.end()
        while i < len(long) and long[i][1] <= a:
            i += 1
        if free(a, end):
            core = t[0].strip(".,;:!?()[]{}\"'<>|")
            kinds = may_be(core)
            if i < len(long) and long[i][0] < end:  # a part of a longer candidate can still be an address of a host
                kinds = [k for k in kinds if k == 1]
            if kinds:
                at = a + t[0].index(core)
                taken.append((at, at + len(core), kinds))
    every = sorted([(a, b, k, sorted({k, *may_be(text[a:b])})) for a, k, b in base] + [(a, b, -1, kinds) for a, b, kinds in taken])
    tokens = [m.span() for m in TOKEN.finditer(text)] if every else []
    first, last, out = [a for a, _ in tokens], 0, []

    @lru_cache(maxsize=4)
    def word(start: int, end: int) -> str:
        w = text[start:end].lower().strip(".,;:!?()[]{}\"'<>|=")
        return w if len(w) <= LONG else hashlib.md5(w.encode()).hexdigest()

    for a, b, k, kinds in every:
        i = bisect.bisect_left(first, a)
        before = [(s, e) if e <= a else (max(s, min(a, last)), a) for s, e in tokens[max(0, i - 2) : i]]
        out.append((" ".join(word(s, e) for s, e in before), text[a:b], k, a, b, kinds))
        last = max(last, b)
    return out


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans, and candidates with pattern, hash of the instance, shape (a kind that it may be of; one row
    for each), kind (-1: unknown), start, end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        found_type = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("shape", pa.string()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            spans, found = [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": e} for a, k, e in base])
                found.append([{"pattern": p, "instance": hashlib.md5(x.encode()).hexdigest()[:16], "shape": KINDS[may], "kind": k, "start": a, "end": e} for p, x, k, a, e, kinds in candidates(text, base) for may in kinds])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, spans_type), pa.array(found, found_type)], ["doc_id", "spans", "found"])

    schema = "doc_id long, spans array<struct<start:int,kind:int,end:int>>, found array<struct<pattern:string,instance:string,shape:string,kind:int,start:int,end:int>>"
    return docs.select("doc_id", "text").transform(common.in_arrow, run, schema)


def patterns(table: DataFrame, rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """(pattern, shape, kind) that are sure, from `extracted`.

    Edges are distinct (pattern, shape, instance), so copies of a document count once. Counts merge map-side, so a
    pattern that a third of all rows shares stays in proportion."""
    edges = common.written(table.select(F.explode("found").alias("f")).select("f.*").groupBy("pattern", "shape", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    for k in range(rounds):
        as_kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("shape")).cast("int") - 1
        by_pattern = edges.withColumn("as_kind", as_kind).groupBy("pattern", "shape", "as_kind").agg(
            F.count("*").alias("n"), F.count(F.when(F.col("kind") == F.col("as_kind"), 1)).alias("hits")
        )
        sure_ones = by_pattern.where((F.col("hits") >= support) & (F.col("hits") / (F.col("n") + 1) >= sure)).select("pattern", "shape", "as_kind")
        if k < rounds - 1:
            instances = edges.where("kind < 0").join(sure_ones, ["pattern", "shape"]).groupBy("instance").agg(F.min("as_kind").alias("new"))
            edges = common.written(edges.join(instances, "instance", "left").select("pattern", "shape", "instance", F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("new", "kind")).alias("kind")), "pii-edges")
    return sure_ones


def found(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of (doc_id, text)."""
    table = common.written(extracted(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    written = lambda spans, names: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, names)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    unseen = table.select("row", F.explode("found").alias("f")).where("f.kind < 0").select("row", "f.pattern", "f.shape", "f.start", "f.end")
    more = unseen.join(patterns(table), ["pattern", "shape"]).groupBy("row").agg(F.collect_set(F.struct("start", (F.col("as_kind") + len(KINDS)).alias("kind"), "end")).alias("more"))
    names = (*KINDS, *(f"{k}_ctx" for k in KINDS))
    of_kind = lambda i: lambda s: s["kind"] == i
    counts = (F.size(F.filter("spans", of_kind(i))).cast("long").alias(f"n_{name}") for i, name in enumerate(KINDS))
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return table.select("row", "doc_id", "spans").join(more, "row", "left").select("doc_id", *counts, F.sha2(written(F.col("spans"), KINDS).cast("binary"), 256).alias("base_sha256"), written(every, names).alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(common.documents(spark, sf_dir))
