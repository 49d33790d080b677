"""Images in array columns against plain loops, and bootstraps against sums by hand."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from episodica.functions import grids
from episodica.operators import resample


def around(x, y, w, h):
    return [(a, b) for a, b in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)) if 0 <= a < w and 0 <= b < h]


def plain(cells, w, h):
    """Statistics of a mask by flood filling."""
    held = {(i % w, i // w) for i, v in enumerate(cells) if v}
    sizes, left = [], set(held)
    while left:
        todo, size = [left.pop()], 0
        while todo:
            x, y = todo.pop()
            size += 1
            for p in around(x, y, w, h):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        sizes.append(size)
    xs, ys = [x for x, _ in held], [y for _, y in held]
    box = (min(xs), min(ys), max(xs) + 1, max(ys) + 1) if held else (None,) * 4
    return (len(held), *box, len(sizes), max(sizes, default=0), any(x in (0, w - 1) or y in (0, h - 1) for x, y in held))


def test_mask_statistics(spark):
    rng = random.Random(5)
    w, h = 7, 5
    masks = [[rng.random() < p for _ in range(w * h)] for p in (0.1, 0.4, 0.6, 0.9) for _ in range(40)]
    masks += [[False] * 35, [True] * 35, [(i // 7) % 2 == 0 or i in (13, 21) for i in range(35)]]  # empty, full, a snake
    odd = [None, [], [True] * 34, [True] * 34 + [None]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks + odd)], "i int, m array<boolean>")
    got = {r.i: r.s for r in df.select("i", grids.mask_statistics(F.col("m"), h, w).alias("s")).collect()}
    for i, m in enumerate(masks):
        assert tuple(got[i]) == plain(m, w, h)
    assert all(got[len(masks) + i] is None for i in range(len(odd)))
    assert df.limit(0).select(grids.mask_statistics(F.col("m"), h, w).alias("s")).count() == 0


def test_grown_and_shrunk():
    mask = np.random.default_rng(1).random((20, 6, 9)) < 0.3
    for m, grown, shrunk in zip(mask, grids.dilate(mask), grids.erode(mask), strict=True):
        for y in range(6):
            for x in range(9):
                near = [m[b, a] for a, b in around(x, y, 9, 6)]
                assert grown[y, x] == (m[y, x] or any(near))
                assert shrunk[y, x] == (m[y, x] and all(near) and len(near) == 4)
    assert (grids.dilate(mask, 3) == grids.dilate(grids.dilate(grids.dilate(mask)))).all()


def test_fill(spark):
    w = h = 12
    flat = [10.0 if 4 <= i % w < 8 and 4 <= i // w < 8 else float(i * 7 % 5) for i in range(w * h)]
    mask = [4 <= i % w < 8 and 4 <= i // w < 8 for i in range(w * h)]
    rows = [(0, flat, mask), (1, flat, [False] * 144), (2, flat, [True] * 144), (3, flat[:-1], mask), (4, None, mask)]
    df = spark.createDataFrame(rows, "i int, v array<double>, m array<boolean>")
    got = {r.i: r.f for r in df.select("i", grids.fill_naturalness(F.col("v"), F.col("m"), h, w, 1, 3).alias("f")).collect()}
    ring = [i for i in range(144) if 1 < min(abs(i % w - x) + abs(i // w - y) for x in range(4, 8) for y in range(4, 8)) <= 3]
    assert math.isclose(got[0].lum_step, 10 - sum(flat[i] for i in ring) / len(ring))
    image = np.array(flat).reshape(h, w)
    steep = (np.abs(np.gradient(image, axis=0)) + np.abs(np.gradient(image, axis=1))).ravel()
    assert math.isclose(got[0].texture_ratio, np.mean([steep[i] for i in range(144) if mask[i]]) / np.mean([steep[i] for i in ring]))
    assert tuple(got[1]) == (0.0, 1.0) and tuple(got[2]) == (None, None) and got[3] is None and got[4] is None


def test_bootstrap_sums(spark):
    """Sums equal those by hand whatever the partitions, and weights are Poisson draws."""
    rows = [(i, float((i * 37) % 101)) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, x double")
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % (resample.PRIME - 1) + 1
    want = {}
    for b in range(30):
        w = [sum(number(str(k)) * number(f"b|{b}") % resample.PRIME >= s for s in resample.STEPS) for k, _ in rows]
        want[b] = (sum(u * x for u, (_, x) in zip(w, rows, strict=True)), sum(w))
    for parts in (1, 5):
        got = {r.b: (r.weighted, r.weight) for r in resample.bootstrap_sums(df.repartition(parts), "k", "x", 30).collect()}
        assert got == want
    out = resample.paired_bootstrap(df, "k", "x", 5_000).first()
    mean, error = np.mean([x for _, x in rows]), np.std([x for _, x in rows]) / 700**0.5
    assert abs(out.mid - mean) < 0.1 * error and abs((out.high - out.low) / (2 * 1.96 * error) - 1) < 0.1 and out.above == 1.0


def test_pairs_need_both_conditions(spark):
    df = spark.createDataFrame([(1, "a", 4.0), (1, "b", 1.0), (1, "a", 2.0), (2, "a", 9.0), (3, "b", None), (3, "a", 1.0)], "k long, c string, x double")
    assert [tuple(r) for r in resample.paired_differences(df, "k", F.col("c") == "a", F.col("c") == "b", "x").collect()] == [(1, 2.0)]
    assert resample.paired_bootstrap(df.limit(0).select("k", "x"), "k", "x", 10).first().mid is None


def test_weights_by_cached_blocks_are_those_of_the_remainder():
    a = np.array([1, 2, resample.PRIME - 1, resample.PRIME - 2, 12_345, 1 << 30], dtype=np.int64)
    c = np.array([1, resample.PRIME - 1, resample.PRIME - 2, 1 << 30, 987_654_321], dtype=np.int64)
    place = a[:, None] * c % resample.PRIME
    assert (resample._weights(a, c) == sum((place >= s).astype(float) for s in resample.STEPS)).all()


def test_episodes_are_dealt_over_tasks_that_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(resample, "EPISODES", 50)
    df = spark.createDataFrame([(i, float(i)) for i in range(2_000)], "k long, x double")
    assert "REPARTITION_BY_NUM" in (plan := resample.bootstrap_sums(df, "k", "x", 20)._jdf.queryExecution().executedPlan().toString()) and ", 40)" in plan
