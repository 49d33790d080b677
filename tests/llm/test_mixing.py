import re

import duckdb
import pytest
from pyspark.sql import functions as F

from episodica.llm import mixing

from .helpers import docs, rows_of

DATA = "/root/testdata/sf0.001"


def mixed(df):
    sized = mixing.sized_rows(df)
    return mixing.with_copies(sized, mixing.source_plan(sized))


def waterfill(sizes):
    """Targets by repeated sharing, straight from the definition; sizes in source order."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    left, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * level > 3 * sizes[i] + 1e-9]
        if not over:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
            open_.remove(i)
    return target


def test_targets_and_copies(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 200 + ["b"] * 10 + ["c"] * 3 + [None] * 40)]
    got = rows_of(mixed(docs(spark, rows)))
    sizes = {s: sum(r["size"] for r in got if r["source"] == s) for s in ("a", "b", "c", None)}
    want = dict(zip(sizes, waterfill(list(sizes.values())), strict=True))
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 3
    for s in sizes:
        taken = sum(r["size"] * r["copies"] for r in got if r["source"] == s)
        assert abs(taken - want[s]) <= 8  # within a document's size
    assert got == rows_of(mixed(docs(spark, rows))) or sorted(map(str, got)) == sorted(map(str, rows_of(mixed(docs(spark, rows)))))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_meet_their_targets(spark, sf):
    """Each source's words come within one in a hundred, or half of its longest document, of the target."""
    sums = {}
    for r in rows_of(mixing.op3_source_mix(spark, f"/root/testdata/{sf}")):
        taken, _, longest = sums.get(r["source"], (0, 0, 0))
        sums[r["source"]] = taken + r["taken"], r["target"], max(longest, r["size"])
    assert all(abs(taken - target) <= max(0.01 * target, longest / 2) for taken, target, longest in sums.values()), sums


def test_draws(spark):
    """A copy's chance is the fraction: over many sources of one document each, the copies are as many as the fractions' sum."""
    from pyspark.sql.types import StringType

    h = spark.range(20_000).select(mixing.draw(F.col("id"), F.lit("x").cast(StringType())).alias("h"))
    arc = int(0.3 * (1 << mixing.BITS))
    for seed in (0, 7, 1000):
        n = h.where(F.pmod(F.col("h") - (seed << mixing.STEP_BITS), F.lit(1 << mixing.BITS)) < arc).count()
        assert abs(n - 6000) < 4 * (20_000 * 0.21) ** 0.5
    # null ids are told apart by their texts
    rows = [(None, f"text {i}", "s") for i in range(50)] + [(i, "w " * 60, "t") for i in range(50)]
    copies = {r["copies"] for r in rows_of(mixed(docs(spark, rows))) if r["doc_id"] is None}
    assert len(copies) >= 1 and len({r["h"] for r in rows_of(mixed(docs(spark, rows)))}) == 100


def test_words(spark):
    texts = [None, "", "a", " a\tb\x0bc\n", "x y z"]
    got = [r.n for r in docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).orderBy("doc_id").select(mixing.word_count(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_edges(spark):
    assert rows_of(mixed(docs(spark, []))) == []
    only_empty = rows_of(mixed(docs(spark, [(1, None, "a"), (None, "", None)])))
    assert [r["copies"] for r in only_empty] == [0, 0]
    clash = docs(spark, [(1, "a b", "s"), (1, "a b", "s")]).withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("h", F.lit(9)).withColumn("seed", F.lit(1)).withColumn("arc", F.lit("a")).withColumn("copies", F.lit(2))
    out = mixing.mix_sources(clash)
    assert out.columns == clash.columns and out.count() == 2


@pytest.mark.parametrize("n", [1])
def test_sql_agrees(spark, n):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = {r[0]: r[4] for r in con.sql(mixing.OP3_SQL).fetchall()}
    got = {r["doc_id"]: r["taken"] for r in rows_of(mixing.op3_source_mix(spark, DATA))}
    assert got == want


def test_repeated_rows_meet_the_targets(spark):
    """Copies of a third of the rows under one id, and under null ids: each draws for itself."""
    rows = [(i, "w " * 10, s) for s, k in (("a", 0), ("b", 1000), ("c", 2000)) for i in range(k, k + 300)]
    rows += [(7, "w " * 10, "b")] * 300 + [(None, "w " * 10, "c")] * 300
    df = docs(spark, rows)
    for got in (rows_of(mixed(df)), [{**r, "copies": 1, "size": 10} for r in rows_of(mixing.mix_sources(df))]):
        taken = {s: sum(r["size"] * r["copies"] for r in got if r["source"] == s) for s in "abc"}
        assert all(abs(taken[s] - 15_000 * w / 6) <= 50 for s, w in (("a", 1), ("b", 2), ("c", 3))), taken
    per_row = [r["copies"] for r in rows_of(mixed(df)) if r["doc_id"] == 7 and r["source"] == "b"]
    assert len(per_row) == 300 and max(per_row) <= 3
    alike = [r for r in rows_of(mixing.mix_sources(df)) if r["doc_id"] == 7 and r["source"] == "b"]
    assert len(alike) == sum(per_row)


def test_rows_that_share_an_id_alone(spark):
    """Rows of one id and text that differ elsewhere keep their own columns."""
    df = docs(spark, [(1, "a b", "s")]).withColumn("k", F.explode(F.array(*map(F.lit, (0, 0, 1, 1)))))
    assert sorted(r["k"] for r in rows_of(mixing.mix_sources(df))) == [0, 0, 1, 1]


def test_equal_rows_are_counted_out_in_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 8)
    df = docs(spark, [(1, "a b", "s")] * 50 + [(2, "c", "t")])
    got = rows_of(mixed(df))
    assert len(got) == 51 and len({r["h"] for r in got}) == 51
    assert len(rows_of(mixing.mix_sources(df))) == sum(r["copies"] for r in got)
