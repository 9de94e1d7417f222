"""Rules on steps, records of loose texts, and tables that follow a folder."""

import json

import pytest
from pyspark.sql import functions as F
from triplespan.operators import listing, steps
from triplespan.sources import changes

STEP = "struct<type: string, addedChemical: array<string>, solvent: array<string>, comment: string, isLayered: boolean>"


def test_rules(spark):
    rows = [
        ("a", [("Dissolve", None, ["x", "y"], "c", None), ("Stir", None, None, None, True), ("Add", ["z"], None, "d", None), ("Add", ["u", "v"], None, None, True), ("Dissolve", None, None, None, None)]),
        ("b", []), ("c", None),
    ]
    df = spark.createDataFrame(rows, f"k string, s array<{STEP}>")
    run = lambda *rules: {r["k"]: r["s"] and [(x["type"], x["addedChemical"], x["comment"], x["isLayered"]) for x in r["s"]] for r in df.select("k", steps.rewritten(F.col("s"), *rules).alias("s")).collect()}
    both = run(steps.converted(values={"isLayered": F.lit(False)}), steps.split())
    assert both["a"] == [
        ("Add", ["x"], "split 1/2: converted from dissolve: c", False), ("Add", ["y"], "split 2/2: converted from dissolve: c", False), ("Stir", None, None, True), ("Add", ["z"], "d", None),
        ("Add", ["u"], "split 1/2: ", True), ("Add", ["v"], "split 2/2: ", True), ("Add", [], "converted from dissolve: n/a", False),
    ]
    assert both["b"] == [] and both["c"] is None
    other = run(steps.split(), steps.converted())["a"]  # in the other order what was dissolved stays together
    assert [x[1] for x in other] == [["x", "y"], None, ["z"], ["u"], ["v"], []]
    assert [x[0] for x in run(steps.dropped(lambda s: s["isLayered"]))["a"]] == ["Dissolve", "Add", "Dissolve"]
    assert [x[2] for x in run(steps.replaced("comment", "C", "n/a"))["a"]] == ["n/a", None, "d", None, None]
    made = spark.createDataFrame([("a", ["H4PBPTA salt"]), ("b", ["x", None]), ("c", None), ("d", [])], "k string, productNames array<string>")
    assert sorted(r["k"] for r in steps.without_product(made, "h4pbpta").collect()) == ["b", "c", "d"]


def test_whole_objects():
    assert listing.whole_objects('{"a": "}{"}{"b": {"c": "\\"}"}} text {"d": 1') == ['{"a": "}{"}', '{"b": {"c": "\\"}"}}']
    assert listing.whole_objects('{"a": "cut\n{"b": 1}\n} {') == ['{"a": "cut\n{"b": 1}\n}']
    assert listing.whole_objects('{"a": {"b": 1}, {"c": 2}') == ['{"b": 1}', '{"c": 2}'] and listing.whole_objects(None) == listing.whole_objects("}} {") == []
    many = [{"k": "{" * (i % 3) + '"' * (i % 2), "n": [{"m": i}]} for i in range(500)]
    assert list(map(json.loads, listing.whole_objects("\n".join(map(json.dumps, many))))) == many
    assert len(listing.whole_objects('{"a":' * 200_000)) == 0  # one pass, whatever stays open


def test_recovered_records(spark):
    texts = {
        "joined": '{"name": "a{", "role": "r"}\n{"name": " b "}{"role": "no name"}', "cut": '{"name": "a", "ro\n{"name": "b", "role": "s"}', "loose": '"name": "a", "name": "b", "role": "t"',
        "fenced": 'x {"name": "no"}\n```json\n[{"name": "a"},\n{"name": 5}]\n```', "none": "nothing", "null": None, "bad": '{"name": "a",}',
    }
    df = spark.createDataFrame(list(texts.items()), "k string, t string").select("k", listing.recovered_records(F.col("t")).alias("r"))
    got = {r["k"]: r["r"] and [tuple(x) for x in r["r"]] for r in df.collect()}
    assert got == {"joined": [("a{", "r"), ("b", "")], "cut": [("b", "s")], "loose": [("a", "t"), ("b", "")], "fenced": [("a", ""), ("5", "")], "none": [], "null": [], "bad": [("a", "")]}


def test_only_changed_documents(spark, tmp_path):
    folder, target = tmp_path / "docs", str(tmp_path / "table")
    folder.mkdir()
    for i in range(1000):
        (folder / f"d{i}.txt").write_text(f"text {i}")
    (folder / "deep").mkdir()
    for n in "ab":
        (folder / "deep" / f"{n}.txt").write_text(n)
    seen = []

    def parse(files):
        seen.append(sorted(r["doc"] for r in files.select("doc").distinct().collect()))
        return files.select("doc", "path", F.col("content").cast("string").alias("text"))

    run = lambda p=parse: changes.refresh(spark, str(folder), target, p)
    texts = lambda: {r["path"]: r["text"] for r in changes.current(spark, target).collect()}
    folders = lambda: {(p.parent.name, p.name) for p in (tmp_path / "table" / "rows").glob("bucket=*/run=*")}
    assert changes.current(spark, target) is None
    assert run() == {"new": 1001, "changed": 0, "gone": 0} and len(texts()) == 1002
    first = folders()
    assert run() == {"new": 0, "changed": 0, "gone": 0} and len(seen) == 1 and folders() == first
    (folder / "d7.txt").write_text("text changed")
    assert run() == {"new": 0, "changed": 1, "gone": 0} and seen[-1] == ["d7.txt"]
    assert len(folders() - first) == 1 and len(texts()) == 1002 and texts()["d7.txt"] == "text changed"  # one bucket
    (folder / "deep" / "b.txt").unlink()
    (folder / "d8.txt").unlink()
    (folder / "new.txt").write_text("n")

    def failing(files):
        return parse(files).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))

    before = texts()
    with pytest.raises(Exception, match="lost"):
        run(failing)
    assert texts() == before
    assert run() == {"new": 1, "changed": 1, "gone": 1} and seen[-1] == ["deep", "new.txt"]
    assert texts() == {k: v for k, v in before.items() if k not in ("d8.txt", "deep/b.txt")} | {"new.txt": "n"}
    for f in folder.glob("d*.txt"):
        f.unlink()
    assert run()["gone"] == 999 and set(texts()) == {"deep/a.txt", "new.txt"}  # buckets without documents leave the table
