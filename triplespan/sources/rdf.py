"""Reading graphs from text files, one file per document, and writing them.

N-Triples files are cut by Spark's own regular expressions, line by line. Small Turtle files are read whole, large ones by
many tasks (`large_turtle_files`), and their statements by a small reader (`turtle.py`) in an Arrow batch function; a statement
that cannot be read gives one row with `error` and no triple, and does not fail the job. Blank nodes are named by document,
so those of different files never meet.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplespan.plans.tables import written
from triplespan.sources.turtle import CLOSING, DIRECTIVE, ESCAPES, Reader, after, chunks, depth_after, turtle, unescaped  # noqa: F401

SCHEMA = "doc string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, error string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
LINE = r'^\s*(<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(<([^>]*)>|_:([^\s.]\S*)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(#.*)?$'
def parsed(files: DataFrame, retry: Callable[[str], str] | None = None) -> DataFrame:
    """Rows of SCHEMA from (doc, text) with Turtle texts; a null text has none. A text with errors is read once more as
    `retry` gives it, and the reading with fewer errors stays, the first one if equal. One text is the most that a task holds
    at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                rows = list(turtle(text or "", doc))
                errors = sum(r[-1] is not None for r in rows)
                if errors and retry:
                    again = list(turtle(retry(text), doc))
                    rows = again if sum(r[-1] is not None for r in again) < errors else rows
                yield pd.DataFrame([(doc, *r) for r in rows], columns=NAMES, dtype=object)

    return files.select("doc", "text").mapInPandas(run, SCHEMA)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    path = F.col("_metadata.file_path")
    return read.select(F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1).alias("doc"), F.col("value").alias("text"), path.alias("path"))


def turtle_files(spark: SparkSession, folder: str, skip: str | None = r"(_grounded|link)\.ttl$") -> DataFrame:
    """Triples and error rows of all .ttl files below a folder but those whose path matches `skip`."""
    files = _files(spark, folder, "*.ttl")
    return parsed(files.where(~F.col("path").rlike(skip)) if skip else files)


STATES = "path string, block long, quote string, depth int, prefixes string"
PIECES = f"{SCHEMA}, path string, block long, part int, text string, prefixes string"
BROADCAST = 16 << 20


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each split does to the state in which it begins: one row for no open quote and one for each kind of long quote.
    A depth of formulas d becomes max(d + plus, least)."""
    lines = chain.from_iterable(zip(b["path"], b["block"], b["line"], strict=True) for b in batches)
    for (path, block), group in groupby(lines, key=lambda r: r[:2]):
        states = {q: [q, 0, 0, {}] for q in ("", *CLOSING)}
        for _, _, line in group:
            seen = {}
            for state in states.values():
                if not state[0] and (m := DIRECTIVE.match(line)):
                    state[3]["@base" if m[2] is None else m[2]] = m[3]
                if state[0] not in seen:
                    seen[state[0]] = after(line, state[0])
                state[0], braces, _ = seen[state[0]]
                for b in braces:
                    state[1] += 1 if b == "{" else -1
                    state[2] = depth_after(state[2], b)
        yield pd.DataFrame([(path, block, q, s[0], s[1], s[2], json.dumps(s[3])) for q, s in states.items()], columns=["path", "block", "enters", "leaves", "plus", "least", "declared"])


def _composed(outlines: pd.DataFrame) -> pd.DataFrame:
    """The state in which each split of one file begins, three rows a split."""
    quote, depth, prefixes, out = "", 0, {}, []
    for block, rows in outlines.sort_values("block").groupby("block"):
        out.append((rows["path"].iloc[0], block, quote, depth, json.dumps(prefixes)))
        row = rows[rows["enters"] == quote].iloc[0]
        quote, depth, prefixes = row["leaves"], max(depth + int(row["plus"]), int(row["least"])), prefixes | json.loads(row["declared"])
    return pd.DataFrame(out, columns=["path", "block", "quote", "depth", "prefixes"])


def _statements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the statements that lie within a split, and the pieces (0: until the first end, or all of a split without one;
    1: after the last end) of those that do not."""
    columns = ["path", "block", "doc", "quote", "depth", "prefixes", "line"]
    rows = chain.from_iterable(zip(*(b[c] for c in columns), strict=True) for b in batches)
    for (path, block), group in groupby(rows, key=lambda r: r[:2]):
        first = next(group)
        _, _, doc, quote, depth, prefixes, _ = first
        reader, out = Reader(doc, json.loads(prefixes), f"b{block}." if block else "b"), []
        for n, (text, whole) in enumerate(chunks((r[-1] for r in chain([first], group)), quote, int(depth))):
            if n == 0 and block:
                out.append((doc, *[None] * 8, path, block, 0 if whole else 2, text, prefixes))
                for line in text.split("\n"):
                    if not quote:
                        reader.declare(line)
                    quote = after(line, quote)[0]
            elif whole:
                out += [(doc, *r, path, block, None, None, None) for r in reader.rows(text)]
            else:
                out.append((doc, *[None] * 8, path, block, 1, text, json.dumps(reader.prefixes)))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=[*NAMES, "path", "block", "part", "text", "prefixes"], dtype=object)
                out = []
        yield pd.DataFrame(out, columns=[*NAMES, "path", "block", "part", "text", "prefixes"], dtype=object)


def _stitched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for doc, number, prefixes, text in zip(batch["doc"], batch["number"], batch["prefixes"], batch["text"], strict=True):
            reader = Reader(doc, json.loads(prefixes), f"p{number}.")
            yield pd.DataFrame([(doc, *r) for chunk, _ in chunks(text.split("\n")) for r in reader.rows(chunk)], columns=NAMES, dtype=object)


def large_turtle_files(spark: SparkSession, folder: str, skip: str | None = r"(_grounded|link)\.ttl$") -> DataFrame:
    """The rows of `turtle_files`, with each file read by as many tasks as it has splits of spark.sql.files.maxPartitionBytes;
    only nodes without a name are called differently.

    A first pass finds what each split does to open quotes, formulas and prefixes; these are composed along each file, so
    that a second pass knows the state in which its split begins. Statements that cross splits are put together from their
    pieces. Directives stand on lines of their own. States are broadcast below 16 MB; above, lines are shuffled by split. The
    rows are written to the shared folder."""
    path = F.col("_metadata.file_path")
    lines = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter="*.ttl").select(
        path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1).alias("doc"), F.col("value").alias("line")
    )
    lines = lines.where(~F.col("path").rlike(skip)) if skip else lines
    outlines = lines.select("path", "block", "line").mapInPandas(_outlines, "path string, block long, enters string, leaves string, plus int, least int, declared string")
    states = written(outlines.groupBy("path").applyInPandas(_composed, STATES), "states")
    size = states.agg(F.sum(F.length("prefixes") + F.length("path") + 40)).first()[0] or 0
    if size <= BROADCAST:
        placed = lines.join(F.broadcast(states), ["path", "block"])
    else:  # lines of a split come together again, in their order
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        placed = numbered.join(states.hint("shuffle_merge"), ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "at")
    read = written(placed.select("path", "block", "doc", "quote", "depth", "prefixes", "line").mapInPandas(_statements, PIECES), "statements")
    order = Window.partitionBy("path").orderBy("block", F.col("part") == 1)
    ends = F.coalesce(F.sum((F.col("part") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = read.where("part is not null").withColumn("number", ends).groupBy("path", "doc", "number")
    joined = pieces.agg(F.sort_array(F.collect_list(F.struct("block", "part", "text"))).alias("t"), F.min_by("prefixes", F.struct("block", "part")).alias("prefixes"))
    text = F.array_join(F.transform("t", lambda t: t["text"]), "\n")
    return read.where("part is null").select(*NAMES).unionByName(joined.select("doc", "number", "prefixes", text.alias("text")).mapInPandas(_stitched, SCHEMA))


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """Only <doc>/<doc>.ttl files, the merged graph of each document."""
    files = _files(spark, folder, "*.ttl")
    return parsed(files.where(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) == F.col("doc")))


def graph(rows: DataFrame) -> DataFrame:
    """The set of triples of parsed rows, error rows left out."""
    return rows.where("error is null").select("s", "p", "o", "o_kind").distinct()


def _unescaped(c: Column) -> Column:
    """Escapes are read in one pass from the left, so an escaped backslash never starts another one."""
    chars = F.create_map(*(F.lit(x) for pair in ESCAPES.items() for x in pair))
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))

    def read(x: Column) -> Column:
        sign, rest = F.substring(x, 2, 1), F.substring(x, 3, 8)
        coded = F.when(sign == "u", F.decode(F.unhex(rest), "UTF-16BE")).otherwise(F.decode(F.unhex(rest), "UTF-32"))
        return F.when(~x.startswith("\\"), x).when(sign.isin("u", "U") & (F.length(x) > 2), coded).otherwise(F.coalesce(F.element_at(chars, sign), sign))

    return F.array_join(F.transform(parts, read), "")


def ntriples(lines: DataFrame, value: str = "value", doc: Column | None = None) -> DataFrame:
    """Rows of SCHEMA from lines of N-Triples, by Spark expressions alone; a line that is none gets an error."""
    doc = F.lit("") if doc is None else doc
    part = lambda i: F.nullif(F.regexp_extract(value, LINE, i), F.lit(""))
    whole = F.col(value).rlike(LINE)
    node = lambda i: F.concat(doc, F.lit(":"), part(i))
    real = lines.where(~F.col(value).rlike(r"^\s*(#.*)?$"))
    return real.select(
        doc.alias("doc"),
        F.when(whole, F.coalesce(part(2), node(3))).alias("s"),
        F.when(whole, F.when(part(2).isNotNull(), "iri").otherwise("bnode")).alias("s_kind"),
        F.when(whole, part(4)).alias("p"),
        F.when(whole, F.coalesce(part(6), node(7), _unescaped(F.regexp_extract(value, LINE, 8)))).alias("o"),
        F.when(whole, F.when(part(6).isNotNull(), "iri").when(part(7).isNotNull(), "bnode").otherwise("lit")).alias("o_kind"),
        part(9).alias("o_dt"),
        part(10).alias("o_lang"),
        F.when(~whole, F.concat(F.lit("not a triple: "), F.substring(value, 1, 80))).alias("error"),
    )


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple, for `write.text`; blank nodes are those whose kind says so."""
    text = F.col("o")
    for char, seq in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(char), F.lit(seq))
    node = lambda c: F.concat(F.lit("_:b"), F.lower(F.hex(c.cast("binary"))))  # noqa: E731  - different nodes keep different names
    s_kind = F.col("s_kind") if "s_kind" in triples.columns else F.lit("iri")
    s = F.when(s_kind == "bnode", node(F.col("s"))).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    typed = F.concat(F.lit('"'), text, F.lit('"'))
    if {"o_dt", "o_lang"} <= set(triples.columns):
        typed = F.concat(typed, F.coalesce(F.concat(F.lit("^^<"), "o_dt", F.lit(">")), F.concat(F.lit("@"), "o_lang"), F.lit("")))
    o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("o_kind") == "bnode", node(F.col("o"))).otherwise(typed)
    return triples.select(F.concat_ws(" ", s, F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value"))


def labels_by_line(files: DataFrame) -> DataFrame:
    """(doc, label) of rdfs:label lines, without reading the rest of the syntax; (doc, text) go in."""
    lines = files.select("doc", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains("rdfs:label"))
    return lines.select("doc", F.regexp_extract("line", r'rdfs:label\s+"((?:[^"\\]|\\.)*)"', 1).alias("label")).where("label <> ''")
