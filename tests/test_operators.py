"""Small cases with known answers."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from episodica.functions import geometry, text
from episodica.operators import aggregates as agg
from episodica.operators import joins, ledger, rules
from episodica.operators import selection as sel
from episodica.operators import sequence as seq


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()] if cols else [tuple(r) for r in df.collect()]


def test_bisection_spread_of_ten(spark):
    df = spark.range(10).withColumn("g", F.lit(1))
    got = sel.spread(df, ["g"], [F.col("id")]).orderBy("spread_rank")
    assert [r[0] for r in one(got, "id")] == [0, 5, 2, 4, 6, 8, 1, 3, 7, 9]


def test_tri_state(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "f boolean, u boolean")
    assert one(df.select(rules.tri_state(F.col("f"), F.col("u")))) == [(False,), (None,), (True,)]


def test_exclusive_quartiles_follow_the_published_method(spark):
    draw = random.Random(3)
    for n in (2, 3, 8, 9, 10, 31):
        values = [draw.uniform(0, 100) for _ in range(n)]
        df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
        got = agg.tukey_fences(df, ["k"], "v", 2).first()
        want = statistics.quantiles(values, n=4)
        assert abs(got["q1"] - want[0]) < 1e-9 and abs(got["q3"] - want[2]) < 1e-9


def test_exposure_percentile(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (5,)], "n int")
    assert abs(df.agg(F.percentile("n", F.lit(0.95))).first()[0] - 4.55) < 1e-9


def test_upper_median(spark):
    df = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("g", 4), ("h", 5), (None, 7), ("h", None)], "k string, n int")
    assert sorted(one(agg.upper_median(df, ["k"], "n", "m")), key=str) == [("g", 3), ("h", 5), (None, 7)]


@pytest.mark.parametrize("sorted_rows", [0, 100, 1 << 20])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_of_large_groups_match_percentile(spark, monkeypatch, keys, sorted_rows):
    """Places found by brackets, down to single values or with few rows sorted, against the built-in that gathers a group."""
    monkeypatch.setattr(seq, "SORTED", sorted_rows)
    monkeypatch.setattr(seq, "CELLS", 16)
    draw = random.Random(6)
    rows = [(draw.choice("aab"), draw.choice([1.5, 2.0, draw.uniform(-5, 5)]), draw.choice([None, 1.0])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    wanted = {"x": 0.0, "y": 0.3, "z": 0.995}
    got = sorted(one(seq.quantiles(df, keys, "v", wanted).drop("n")))
    want = sorted(one(df.groupBy(*keys).agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in wanted.items()])))
    for a, b in zip(got, want, strict=True):
        assert a[: len(keys)] == b[: len(keys)] and all(abs(x - y) < 1e-9 for x, y in zip(a[len(keys) :], b[len(keys) :], strict=True))


def test_running_sum(spark):
    rows = [(i, (i * 7) % 4) for i in range(300)]
    got = sorted(one(seq.running_sum(spark.createDataFrame(rows, "i long, n long").repartition(6), ["i"], "n", "s")))
    total = 0
    for (i, n), row in zip(rows, got, strict=True):
        total += n
        assert row == (i, n, total)


def test_text_forms(spark):
    df = spark.createDataFrame([("Straße \ufb01x \u00b2 \u212bngstr\u00f6m, A_b",), (None,), ("",)], "t string")
    assert [r[0] for r in one(df.select(text.normalised(F.col("t"))))] == ["strasse fix 2 ångström a_b", None, ""]


def test_runs_and_merging_match_a_scan(spark):
    draw = random.Random(5)
    flags = [draw.random() < 0.5 for _ in range(300)]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "k int, frame_index long, f boolean")
    want, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            want.append((start, i))
            start = None
    found = seq.runs(df, F.col("f"), ["k"])
    assert sorted(one(found, "start", "end")) == want
    merged = []
    for s, e in want:
        if merged and s - merged[-1][1] < 3:
            merged[-1] = (merged[-1][0], e)
        else:
            merged.append((s, e))
    assert sorted(one(seq.merge_runs(found, ["k"], 3), "start", "end")) == merged


def test_hysteresis_matches_a_loop(spark):
    draw = random.Random(8)
    x = [draw.uniform(0, 10) for _ in range(120)]
    pad = [0, 0, *x, 0, 0]
    a = [sum(pad[i : i + 5]) / 5 for i in range(len(x))]
    span, peak, start, low, want = (max(a) - min(a)) * 0.25, float("-inf"), None, None, []
    for i, v in enumerate(a):
        if start is None:
            peak = max(peak, v)
            if peak - v > span:
                start, low = i, v
        elif v > low + span:
            want.append((start, i))
            start, peak = None, v
        else:
            peak = max(peak, v)
    if start is not None:
        want.append((start, None))
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, frame_index long, v double")
    assert sorted(one(seq.hysteresis_cycles(df, "v", ["k"]), "start", "end"), key=lambda r: r[0]) == want


def test_trailing_suffix(spark):
    df = spark.createDataFrame([(1, i, i >= 8) for i in range(38)], "k int, frame_index long, ok boolean")
    assert one(seq.trailing_suffix(df, F.col("ok"), ["k"])) == [(1, 30, 38)]


def test_greedy_admission_names_the_first_cap(spark):
    df = spark.createDataFrame([(1, 1, 6.0, False), (1, 2, 5.0, False), (1, 3, 3.0, True), (1, 4, 2.0, True), (1, 5, 1.0, True)], "k int, id int, cost double, r boolean")
    got = sel.greedy_admit(df, ["k"], ["id"], "cost", {"hard": 10.0, "retry": 3.0}, {"hard": F.lit(True), "retry": F.col("r")})
    assert sorted(one(got, "id", "verdict")) == [(1, "admitted"), (2, "hard"), (3, "admitted"), (4, "hard"), (5, "retry")]


def test_nearest_takes_the_earlier_on_a_tie(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 1)], "k int, at int")
    right = spark.createDataFrame([(1, 3, "a"), (1, 7, "b")], "k int, at int, v string")
    got = joins.nearest(left, right, ["k"], "at", "v")
    assert sorted(one(got, "k", "at", "v"), key=str) == [(1, 0, "a"), (1, 5, "a"), (2, 1, None)]


def test_iou(spark):
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 3.0, 3.0]), (None, None), ([0.0, 0.0, 1.0, 1.0], None)], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in one(df.select(geometry.iou(F.col("a"), F.col("b"))))] == [round(1 / 7, 6), 1.0, 0.0]


def test_quaternions(spark):
    df = spark.createDataFrame([([0.5, 0.5, -0.5, 0.5],)], "q array<double>")
    got = df.select(geometry.quat_mul(F.col("q"), geometry.quat_inv(F.col("q"))).alias("i")).first()[0]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, (1, 0, 0, 0), strict=True))


def test_markers(spark):
    df = spark.createDataFrame([("a <b> x </b>",), ("</b> <b>",), ("<b></b>",), (None,)], "t string")
    assert one(df.select(text.between_markers(F.col("t"), "<b>", "</b>"))) == [("x",), (None,), (None,), (None,)]


def test_offset_is_required(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00+02:00",), ("2024-01-01T00:00:00",)], "t string")
    assert [r[0] for r in one(df.select(text.has_offset(F.col("t"))))] == [True, True, False]


def test_reservation_rounds_up_to_cents(spark):
    df = spark.createDataFrame([(1.0,), (1.001,), (0.29,)], "p double")
    assert [r[0] for r in one(df.select(ledger.reservation_price(F.col("p"))))] == [1.0, 1.01, 0.29]


def test_cycles(spark):
    long = [("l", i, (i + 1) % 23) for i in range(23)]
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("g", 3, 4), ("h", 1, 2), ("h", 2, 3), *long], "graph string, a int, b int")
    assert sorted(one(rules.cyclic_nodes(edges))) == [("g", 1), ("g", 2), ("g", 3), *[("l", i) for i in range(23)]]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, frame_index long, f boolean, v double")
    assert one(seq.runs(empty, F.col("f"), ["k"])) == []
    assert one(seq.hysteresis_cycles(empty, "v", ["k"])) == []
    assert one(agg.tukey_fences(empty, ["k"], "v")) == []


@pytest.mark.parametrize("rounds,broadcast", [(1, 0), (2, 10), (8, 10)])
def test_brackets_of_odd_values(spark, monkeypatch, rounds, broadcast):
    """Infinite, huge, tiny and equal values, NaN, null groups and whole numbers, however far the brackets get."""
    monkeypatch.setattr(seq, "SORTED", 0)
    monkeypatch.setattr(seq, "CELLS", 4)
    monkeypatch.setattr(seq, "ROUNDS", rounds)
    monkeypatch.setattr(seq, "BROADCAST_BRACKETS", broadcast)
    draw, inf, nan = random.Random(2), float("inf"), float("nan")
    groups = {"a": [1e308, -1e308, 5e-324, 0.0, -0.0, 1.0], "b": [inf, -inf, 1.0, 2.0, nan], "c": [7.0] * 9, None: [draw.expovariate(1) ** 9 for _ in range(200)], "d": [nan, nan]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double").repartition(3)
    got = {r["k"]: r for r in seq.values_at(df, ["k"], "v", {"low": lambda n: F.lit(2), "mid": lambda n: F.floor(n / 2) + 1, "top": lambda n: n}).collect()}
    for k, vs in groups.items():
        want = sorted(vs, key=lambda x: (x != x, x))
        for name, place in (("low", 2), ("mid", len(vs) // 2 + 1), ("top", len(vs))):
            assert got[k][name] == want[place - 1] or (got[k][name] != got[k][name] and want[place - 1] != want[place - 1]), (k, name)
        assert got[k]["n"] == len(vs)


def test_brackets_sort_no_more_than_they_hold(spark, monkeypatch):
    """Of 40,000 different values only those of the last brackets are ever written to be sorted."""
    monkeypatch.setattr(seq, "SORTED", 500)
    seen, real = [], seq._values_by_sort
    monkeypatch.setattr(seq, "_values_by_sort", lambda df, keys: seen.append(df) or real(df, keys))
    df = spark.range(40_000).selectExpr("id % 2 as k", "sin(id) * 1000 as v")
    got = {r["k"]: r["m"] for r in seq.quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in (0, 1))
    assert all(t.count() <= 500 for t in seen)


def test_placed_rows_keep_their_distance(spark):
    draw = random.Random(11)
    rows = [(draw.choice("ab"), i, draw.choice([None, draw.uniform(-1, 1)]), draw.uniform(-1, 1)) for i in range(400)]
    got = {(r["g"], r["i"]): r["place"] for r in sel.placed(spark.createDataFrame(rows, "g string, i long, x double, y double").repartition(3), ["g"], ["i"], "x", "y", 0.3, 9).collect()}
    for g in "ab":
        taken = []
        for _, i, x, y in (r for r in rows if r[0] == g):
            ok = x is not None and len(taken) < 9 and all((x - a) ** 2 + (y - b) ** 2 >= 0.09 for a, b in taken)
            taken += [(x, y)] * ok
            assert got[g, i] == (len(taken) if ok else None)


def test_prior_masks(spark):
    rows = [("a", [True, True, False]), ("a", [True, False, False]), ("b", [True, True, True]), ("c", [False, False, False]), ("a", [True, True, True])]
    df = spark.createDataFrame(rows, "k string, m array<boolean>")
    assert sorted(one(agg.cell_counts(df, ["k"], "m", 3))) == [("a", 3, [3, 2, 1]), ("b", 1, [1, 1, 1]), ("c", 1, [0, 0, 0])]
    got = sorted((r["k"], r["m"], round(r["iou"], 3)) for r in agg.prior_iou(df, ["k"], "m", 3, 0.1).collect())
    assert got == [("a", [True, False, False], 0.5), ("a", [True, True, False], 1.0), ("a", [True, True, True], 0.667), ("b", [True, True, True], 1.0)]


def test_registered_functions(spark):
    import episodica

    episodica.register(spark)
    got = spark.sql("""SELECT iou(array(0D, 0D, 2D, 2D), array(1D, 1D, 3D, 3D)) AS a, iou(array(0D, 0D, 0D, 0D), array(0D, 0D, 0D, 0D)) AS b,
        quat_mul(array(0D, 1D, 0D, 0D), array(0D, 0D, 1D, 0D)) AS c, quat_inv(array(0D, 2D, 0D, 0D)) AS d, upper_median(array(3D, NULL, 1D, 2D)) AS e, upper_median(array()) AS f""").first()
    assert abs(got["a"] - 1 / 7) < 1e-12 and got["b"] is None
    assert got["c"] == [0, 0, 0, 1] and got["d"] == [0, -0.5, 0, 0] and got["e"] == 2 and got["f"] is None
    merged = spark.sql("SELECT * FROM merge_runs(TABLE(SELECT * FROM VALUES ('g', 0L, 2L, 3L), ('g', 4L, 6L, 3L), ('g', 9L, 10L, 3L), ('h', 1L, 2L, 3L) AS t(g, a, b, gap)) PARTITION BY g ORDER BY a)")
    assert sorted(one(merged)) == [("g", 0, 6), ("g", 9, 10), ("h", 1, 2)]
    runs = spark.sql("SELECT * FROM hysteresis_runs(TABLE(SELECT 'g' AS g, id AS i, v, 1D AS span FROM (SELECT posexplode(array(0D, 5D, 3D, 3.5D, 4.5D, 0D)) AS (id, v)) ) PARTITION BY g ORDER BY i)")
    assert sorted(one(runs), key=str) == [("g", 2, 4), ("g", 5, None)]


def test_normalised_takes_few_texts_at_once(spark, monkeypatch):
    monkeypatch.setattr(text, "FOLD_ROWS", 2)
    df = spark.createDataFrame([("A",), (None,), ("B  c",), ("",), ("D",)], "t string").coalesce(1)
    assert [r[0] for r in one(df.select(text.normalised(F.col("t"))))] == ["a", None, "b c", "", "d"]
