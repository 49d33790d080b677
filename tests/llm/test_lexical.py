"""Ranked search against plain loops over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from episodica.llm import lexical

from .helpers import rows_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10, once=True):
    kept = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n, total = len(kept), sum(x for _, _, x in kept)
    df = Counter(t for _, c, _ in kept for t in c)
    out = []
    for item, text in items:
        times = Counter(split(text))
        scored = []
        for i, c, size in kept:
            m = 100 - 90 + (90 * size * n) // total
            s = sum((1 if once else q) * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in times.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in rows_of(lexical.lexical_search(d, b, **how))), key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    words = ["The", "the", "é", "ÉÉ", "x1", "rare-word", "a_b", "don't", "q"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 40)))) for i in range(n)]
    return docs, [(i, " ".join(draw.choices(words + ["unseen"], k=draw.randint(0, 12)))) for i in range(12)]


@pytest.mark.parametrize("block,pairs,terms,once", [(300, 1 << 21, 1 << 20, True), (260, 50, 60, False)])
def test_against_brute_force(spark, monkeypatch, block, pairs, terms, once):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(lexical, "ITEM_TERMS", terms)
    docs, items = corpus(block, 700)
    docs += [(None, "rare word"), (5, "w1 w1 w1"), (5, "w1 w1 w1"), (9_000, None), (9_001, ""), (9_002, "w2 " * 50_000)] + [(20_000 + i, "the same text w3") for i in range(40)]
    items += [(3, "w1"), (None, "w2 same"), (77, None), (78, "")]
    assert found(spark, docs, items, once=once) == brute(docs, items, once=once)


def test_equal_scores_by_id(spark):
    docs = [(i, "one two") for i in range(50, 0, -1)] + [(None, "one two")]
    assert [r[2] for r in sorted(found(spark, docs, [(1, "two")]), key=lambda r: r[1])] == list(range(1, 11))


def test_null_ids_stay_null(spark):
    assert found(spark, [(None, "one"), (2, "other thing")], [(1, "one")]) == brute([(None, "one"), (2, "other thing")], [(1, "one")])


def test_product_is_that_of_dense_matrices():
    rng = np.random.default_rng(3)
    q, a = rng.integers(0, 3, (7, 11)), rng.integers(0, 5, (11, 13)) * rng.integers(0, 1 << 40, (11, 13))
    starts = np.concatenate([[0], np.cumsum((q > 0).sum(axis=1))])
    term, doc = np.nonzero(a)
    rows = list(lexical.product(starts, np.nonzero(q)[1], q[q > 0], np.searchsorted(term, np.arange(12)), doc, a[term, doc], 13))
    assert (np.array(rows) == q @ a).all()


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, "..")], [(1, "a")]) == []
    d = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, score int")
    b = spark.createDataFrame([(9, "a", 4)], "item_id long, text string, rank int")
    assert [(r["item_id"], r["doc_id"]) for r in rows_of(lexical.lexical_search(d, b))] == [(9, 1)]
