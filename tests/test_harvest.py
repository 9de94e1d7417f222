"""A harvest that stops on the way goes on without repeats."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from triplespan.streaming import harvest


def test_stops_after_two_pages(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_brand", F.upper("p_name").alias("label"))
    want = {tuple(r) for r in rows.distinct().collect()}
    target, page = str(tmp_path / "h"), -(-len(want) // 6)
    calls = []

    def each(df):
        seen = {tuple(r) for r in df.collect()}
        calls.append(seen)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return df.withColumn("n", F.length("label"))

    run = lambda f=each, source=rows: harvest.harvest(source.union(source), ["p_brand", "label"], target, f, page)
    assert harvest.progress(spark, target) == (0, 0)
    with pytest.raises(Exception, match="stopped"):
        run()
    assert harvest.progress(spark, target) == (len(want), sum(map(len, calls[:2])))
    got = run(source=rows.limit(0))  # the rows are not read again
    assert sorted(map(tuple, got.select("p_brand", "label").collect())) == sorted(want) and got.where("n <> length(label)").isEmpty()
    assert harvest.progress(spark, target) == (len(want), len(want))
    assert calls[2] == calls[3] and max(map(len, calls)) <= page and len(calls) >= 7  # only the page that had failed came twice
    assert max(Counter(r for c in calls[:2] + calls[3:] for r in c).values()) == 1
    n = len(calls)
    assert run().count() == len(want) and len(calls) == n  # nothing is left to do
    ranges = sorted((min(c), max(c)) for c in calls[:2] + calls[3:])
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_no_rows(spark, tmp_path):
    target = str(tmp_path / "e")
    assert harvest.harvest(spark.createDataFrame([], "k string"), ["k"], target).count() == 0 and harvest.progress(spark, target) == (0, 0)
