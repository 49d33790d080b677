import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import topk

from .helpers import rows_of


def brute(rows, k=20):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    quantised = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in good]
    out = []
    for at, (q, a) in enumerate(quantised):
        if q % 20:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for n, (i, b) in enumerate(quantised) if n != at)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(topk.top_k(df, F.pmod("id", F.lit(20)) == 0)))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("block,stretch,sample", [(16, 64, 32), (256, 4096, 8192)])
def test_against_brute_force(spark, monkeypatch, block, stretch, sample):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "STRETCH", stretch)
    monkeypatch.setattr(topk, "CHUNK", 8)
    monkeypatch.setattr(topk, "SAMPLE", sample)
    rows = [(i, rng.normal(0, 0.3, 12).tolist()) for i in range(400)] + [(400 + i, [0.25] * 12) for i in range(60)]
    assert found(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("parts", [1, 5, 61])
def test_whole_however_rows_are_dealt(spark, monkeypatch, parts):
    """Stretches and chunks take their names from what is written, not from the partitions asked for."""
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(500)]
    real, plain = type(frame(spark, rows)).repartitionByRange, type(frame(spark, rows)).repartition
    assert issubclass(type(frame(spark, rows)), DataFrame)
    monkeypatch.setattr(type(frame(spark, rows)), "repartitionByRange", lambda self, n, *cols: real(self, parts, *cols))
    monkeypatch.setattr(type(frame(spark, rows)), "repartition", lambda self, n, *cols: plain(self, parts, *cols))
    monkeypatch.setattr(topk, "STRETCH", 64)
    monkeypatch.setattr(topk, "BLOCK", 16)
    assert found(frame(spark, rows)) == brute(rows)


def test_payload_moves_only_where_a_bound_reaches(spark, monkeypatch):
    """Queries meet the rows of those stretches only that can hold one of their k best."""
    written = {}
    real = topk.common.materialize
    monkeypatch.setattr(topk.common, "materialize", lambda df, tag: written.setdefault(tag, real(df, tag)))
    monkeypatch.setattr(topk.common, "discard", lambda *tables: None)
    monkeypatch.setattr(topk, "STRETCH", 32)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rows = [(i, [float(i % 2), float(1 - i % 2)]) for i in range(640)]
    assert found(frame(spark, rows)) == brute(rows)
    assert written["topk-reached"].count() < written["topk-index"].count() * written["topk-queries"].count()


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (20, [0.5]), (21, []), (40, [-1.0, 0.01]), (None, [1.0, 1.0])]
    assert found(frame(spark, rows)) == brute(rows)


def test_rows_that_share_an_id(spark):
    """Each has a list of its own, and a third of the rows repeat one id."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(80)] + [(20, [0.5] * 6)] * 40 + [(7, [0.1] * 6), (40, [0.2] * 6)]
    assert found(frame(spark, rows)) == brute(rows)


def test_empty_and_alone(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(0, [1.0])])) == []
    assert found(frame(spark, [(1, [1.0]), (3, [1.0])])) == []


def test_pruning_skips_blocks():
    """Blocks whose bound lies below the floor are not scored: rows far from the query never enter."""
    x = np.concatenate([np.full((64, 4), -50), np.full((64, 4), 50)]).astype(np.int64)
    calls = []
    real = topk._scores
    try:
        topk._scores = lambda q, b: calls.append(len(b)) or real(q, b)
        topk.search(np.full((1, 4), 7), np.array([999]), x, np.arange(128), np.array([-(1 << 62)]), k=5, block=32)
    finally:
        topk._scores = real
    assert sum(calls) == 64  # ties at the bound are scored, the far half is not
