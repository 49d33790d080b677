"""Reports in order, and batches with what is missing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from episodica.operators import reporting
from episodica.sources import files


def test_files_read_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("g", i, f"a<{i}> & \n b|") for i in range(300)] + [("h", 0, None)], "grp string, k int, t string").repartition(7)
    facts = spark.createDataFrame([("g", "all 300")], "grp string, facts string")
    for style in reporting.STYLES:
        report = reporting.lines(rows, "grp", "k", {"key": F.col("k"), "text": F.col("t")}, facts, style)
        reporting.save(report, str(tmp_path / style), "grp")
    read = lambda style, g: "".join(p.read_text() for p in sorted(Path(tmp_path / style / f"grp={g}").glob("part-*"))).splitlines()
    html = read("html", "g")
    assert html[:3] == ["<h1>g</h1>", "<p>all 300</p>", "<table><tr><td>key</td><td>text</td></tr>"] and html[-1] == "</table>"
    assert html[3:-1] == [f"<tr><td>{i}</td><td>a&lt;{i}&gt; &amp; <br> b|</td></tr>" for i in range(300)]
    marked = read("markdown", "g")
    assert marked[:4] == ["# g", "all 300", "| key | text |", "| --- | --- |"] and marked[4] == "| 0 | a&lt;0&gt; &amp; <br> b\\| |"
    assert read("html", "h") == ["<h1>h</h1>", "<p></p>", "<table><tr><td>key</td><td>text</td></tr>", "<tr><td>0</td><td></td></tr>", "</table>"]
    with pytest.raises(ValueError):
        reporting.lines(rows, "grp", "k", {}, facts, "pdf")


def test_pending(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "gone"), (None, "a")], "k int, frame string")
    frames = spark.createDataFrame([("a",), ("b",), ("b",)], "frame string")
    done = spark.createDataFrame([(1,), (3,), (3,)], "k int")
    got = files.pending(requests, done, frames, ["k"], "frame").collect()
    assert sorted(map(tuple, got), key=str) == [(2, "b"), (None, "a")]
    with pytest.raises(Exception, match="frame not found: gone for 3"):
        files.pending(requests, done, frames, ["k"], "frame", force=True).collect()
    assert files.pending(requests.limit(0), done, frames, ["k"], "frame").collect() == []
