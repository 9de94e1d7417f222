"""Turtle: lists, formulas, recovery from bad statements, and large files read by many tasks."""

import random

import pytest
from pyspark.sql import functions as F
from triplespan.sources import files, rdf
from triplespan.sources.turtle import RDF, turtle

HEAD = "@prefix e: <http://e/> .\n"


def read(text):
    rows = list(turtle(HEAD + text, "d"))
    short = lambda v: v if v is None else v.replace(RDF, "rdf:").replace("http://e/", "")
    return [(short(r[0]), short(r[2]), short(r[3])) for r in rows if r[-1] is None], [r[-1] for r in rows if r[-1] is not None]


def test_lists():
    triples, errors = read("e:s e:p ( e:a ( 1 ) [ e:q () ] ) .\n( e:x ) e:p e:y .")
    assert not errors and len(triples) == 13
    nexts, firsts = ({s: o for s, p, o in triples if p == q} for q in ("rdf:rest", "rdf:first"))

    def items(node):
        return [] if node == "rdf:nil" else [items(o) if (o := firsts[node]) in firsts else o, *items(nexts[node])]

    by = {(s, p): o for s, p, o in triples}
    a, one, blank = items(by["s", "p"])
    assert (a, one) == ("a", ["1"]) and by[blank, "q"] == "rdf:nil"
    assert [items(s) for (s, p), o in by.items() if p == "p" and o == "y"] == [["x"]]
    assert read("[ e:p 1 ] .")[0] == [("d:b1.", "p", "1")] and read("e:s e:p [] , [ ] .")[1] == []


@pytest.mark.parametrize(
    "bad",
    [
        "e:a e:p .", "e:a e:p e:b e:c .", '"x" e:p e:b .', "e:a e:p ( e:b .", "e:a ~ e:b .", "e:a none:p e:b .", "e:a e:p { e:x e:p e:y . } .", "{ e:x e:p e:y .\n e:u e:p e:v .\n e:z e:p e:w .\n} e:q e:r .",
        'e:a e:p "open .', "e:a e:p e:b\n", "e:a e:p " + "[ e:p " * 3000 + " .", "@prefix e <http://f/> .", "e:a e:p ; .", "e:a 5 e:b .",
    ],
)
def test_one_bad_statement_costs_one_row(bad):
    triples, errors = read(f"e:s e:p e:one .\n{bad}\ne:s e:p '''two .\n}} \" .\n''' ; e:q 1.5 . e:s e:p 3 .")
    assert triples == [("s", "p", "one"), ("s", "p", 'two .\n} " .\n'), ("s", "q", "1.5"), ("s", "p", "3")] and len(errors) == 1


def test_braces_and_quotes_within_texts():
    triples, errors = read('e:s e:p "a { b", \'"""\' ; e:q <http://e/{x}#y> . # a { and a """\ne:t e:p """x\n{ y""" .')
    assert not errors and [t[2] for t in triples] == ["a { b", '"""', "{x}#y", "x\n{ y"]


def test_repair_of_statements(spark):
    """Only the bad statement of a document needs a repair; nothing of the others is lost or doubled."""
    texts = spark.createDataFrame([("a", HEAD + 'e:s e:p "x" .\ne:s e:q "a "b" c" .\ne:t e:q [ e:r "z" ]'), ("b", None), ("c", "")], "doc string, text string")
    got = files.lenient(texts).collect()
    assert sorted((r["o"], r["error"]) for r in got if r["o_kind"] == "lit") == [('a "b" c', None), ("x", None), ("z", None)] and len(got) == 4


def large(seed, n):
    """A graph with statements over many lines, long texts with dots and braces, prefixes declared anew, and bad statements."""
    rng, out = random.Random(seed), [HEAD]
    for i in range(n):
        kind = rng.randrange(9)
        out.append(
            [
                f"e:s{i} e:p e:o{i} ;\n  e:q \"\"\"line {i} .\n@prefix e: <http://wrong/> .\n{{ 'x' }} #\n  end .\n\"\"\" .",
                f"e:s{i} e:p _:n{i % 7}, {i} .",
                f"@prefix e: <http://e{i % 5}/> .\n",
                f"e:s{i} e:p [ e:q 'don''t', (e:a {i}) ] .",
                f"{{ e:x e:p e:y .\ne:x e:p e:y{i} .\n }} e:p e:z .",
                f"# a comment . with ''' {i}",
                f"e:s{i} none:p e:b .",
                f"e:s{i}\n" + ";\n".join(f" e:p{j}\n '{i}.{j} {'w' * rng.randrange(60)}'" for j in range(rng.randrange(1, 40))) + " .",
                f"e:s{i} e:p '''a\n\"\"\" .\n''' . e:s{i} e:r {i} .",
            ][kind]
        )
    return "\n".join(out)


def test_large_files(spark, tmp_path, monkeypatch):
    """Splits of 2 KB, most of them within statements, texts and formulas, give the rows of whole files; states broadcast or shuffled."""
    for i in range(3):
        (tmp_path / f"g{i}.ttl").write_text(large(i, 450 if i else 5))
    (tmp_path / "g_link.ttl").write_text("bad")
    (tmp_path / "empty.ttl").write_text("")
    (tmp_path / "open.ttl").write_text(HEAD + "e:a e:p '''" + "long . \n" * 2000)
    named = lambda c: F.when(F.col(f"{c}_kind") == "bnode", F.regexp_replace(c, r":[bp][\d.]*\.$", ":node")).otherwise(F.col(c)).alias(c)
    plain = lambda df: sorted(map(repr, df.select("doc", named("s"), "p", named("o"), "o_kind", "o_dt", F.substring("error", 1, 60)).collect()))
    want = plain(rdf.turtle_files(spark, str(tmp_path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert plain(rdf.large_turtle_files(spark, str(tmp_path))) == want
        monkeypatch.setattr(rdf, "BROADCAST", 0)
        assert plain(rdf.large_turtle_files(spark, str(tmp_path))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(want) > 5000 and sum("none:p" in w for w in want) > 50
