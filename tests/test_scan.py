"""Blocked scans against plain folds, for one group that all ranges share and for many."""

import random

import pytest

from episodica.operators import ledger, rules
from episodica.operators import sequence as seq
from episodica.operators.scan import Affine, Hysteresis, Table, hysteresis_step, scan


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def fold(state, step, rows):
    for row in rows:
        state = step(state, *row)[0]
    return state


@pytest.mark.parametrize("seed", range(40))
def test_hysteresis_summary_is_the_fold_for_every_entry(seed):
    draw = random.Random(seed)
    span = draw.choice([0.5, 2.0, 5.0])
    walk, x = [], 0.0
    for _ in range(draw.choice([1, 3, 40, 200])):
        x = round(x + draw.uniform(-1, 1), draw.choice([0, 3]))
        walk.append((x, span))
    block = Hysteresis()
    for row in walk:
        block.absorb(*row)
    levels = [float("-inf"), *[draw.uniform(-20, 20) for _ in range(40)], *[v for v, _ in walk[:20]], *[v + span for v, _ in walk[:20]]]
    for entry in [("above", v) for v in levels] + [("below", v) for v in levels]:
        assert block.apply(entry) == fold(entry, hysteresis_step, walk)


def test_table_summary_is_the_fold_for_every_state():
    draw = random.Random(1)
    step = lambda s, k: ((s * 3 + k) % 7 if k < 5 else 0, ())
    for n in (0, 1, 5, 60):
        rows = [(draw.randrange(6),) for _ in range(n)]
        block = Table(list(range(7)), step)
        for row in rows:
            block.absorb(*row)
        assert all(block.apply(s) == fold(s, step, rows) for s in range(7))


def test_affine_summary():
    block = Affine(0.3)
    for x in (1.0, -2.0, 5.0):
        block.absorb(x)
    step = lambda s, x: (x if s is None else s + 0.3 * (x - s), ())
    for entry in (None, 0.0, 40.0):
        assert abs(block.apply(entry) - fold(entry, step, [(1.0,), (-2.0,), (5.0,)])) < 1e-12


def episodes(spark, one, n=3_000, seed=5):
    draw, x, rows = random.Random(seed), 0.0, []
    for i in range(n):
        x = 0.95 * x + draw.uniform(-1, 1)
        rows.append(("all" if one else draw.choice("abcde") if draw.random() < 0.5 else "hot", i, round(x, 3), draw.choice(["view", "click", "buy"])))
    return rows, spark.createDataFrame(rows, "k string, frame_index long, v double, kind string").repartition(7)


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("one", [True, False])
def test_ema_over_ranges(many_ranges, one):
    rows, df = episodes(many_ranges, one)
    got = {(r["k"], r["frame_index"]): r["ema"] for r in seq.ema(df, "v", ["k"], 0.3).collect()}
    assert len(got) == len(rows)
    for k, own in by_key(rows).items():
        e = None
        for _, i, v, _ in own:
            e = v if e is None else e + 0.3 * (v - e)
            assert abs(got[k, i] - e) < 1e-9


@pytest.mark.parametrize("one", [True, False])
def test_hysteresis_over_ranges(many_ranges, one):
    rows, df = episodes(many_ranges, one)
    got = sorted((r["k"], r["start"], r["end"]) for r in seq.hysteresis_cycles(df, "v", ["k"]).collect())
    want = []
    for k, own in by_key(rows).items():
        v = [0.0, 0.0, *[r[2] for r in own], 0.0, 0.0]
        taps = [sum(v[i : i + 5]) / 5 for i in range(len(own))]
        span = (max(taps) - min(taps)) * 0.25
        state, start = ("above", float("-inf")), None
        for (_, i, _, _), x in zip(own, taps, strict=True):
            state, (event,) = hysteresis_step(state, x, span)
            if event == "close":
                start = i
            elif event == "open":
                want.append((k, start, i))
                start = None
        if start is not None:
            want.append((k, start, None))
    assert len(got) > 3 and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("one", [True, False])
def test_automata_over_ranges(many_ranges, one):
    rows, df = episodes(many_ranges, one)
    edges = [("new", "view"), ("view", "click"), ("click", "buy"), ("buy", "view"), ("view", "view")]
    log = df.selectExpr("k", "frame_index as i", "coalesce(lag(kind) over (partition by k order by frame_index), 'new') as expected", "kind as new")
    got = {(r["k"], r["i"]): (r["outcome"], r["state"]) for r in ledger.transitions(log, "k", "i", "expected", "new", edges, "new").collect()}
    ok = {(r["k"], r["frame_index"]): r["ok"] for r in rules.in_order(df, ["k"], "frame_index", "kind").collect()}
    for k, own in by_key(rows).items():
        now, old, before, broken = "new", "new", "new", False
        last = ""
        for _, i, _, kind in own:
            if kind == now and before == old:
                outcome = "replayed"
            elif before != now:
                outcome = "mismatch"
            elif (now, kind) in edges:
                outcome, now, old = "applied", kind, now
            else:
                outcome = "illegal"
            assert got[k, i] == (outcome, now)
            before = kind
            broken, last = broken or last == kind, kind
            assert ok[k, i] == int(not broken)


def test_empty_table_and_one_row(many_ranges):
    df = many_ranges.createDataFrame([], "k string, frame_index long, v double")
    assert seq.ema(df, "v", ["k"], 0.5).count() == 0
    one = many_ranges.createDataFrame([(None, 0, 2.0)], "k string, frame_index long, v double")
    assert [tuple(r) for r in scan(one, ["k"], ["frame_index"], ["v"], 0.0, lambda s, v: (s + v, (s + v,)), lambda: None, {"sum": "double"}).collect()] == [(None, 0, 2.0)]
