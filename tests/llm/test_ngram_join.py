import random
import re

import numpy as np
import pytest

from episodica.llm import ngram_join

from .helpers import docs, rows_of


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[0-9a-z_\x80-\xff]+", (t or "").lower().encode())
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(ids, texts):
    sets = sets_of(texts)
    n, parent, links = len(ids), list(range(len(ids))), [0] * len(ids)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[root(j)] = root(i)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: (least[root(i)], links[i]) for i in range(n)}


def corpus(seed, bases, copies, words=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for k in range(rng.choice(copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            texts.append((" ".join(text) if k % 2 else " ".join(text).title() + ".") + (" " + shared if rng.random() < 0.2 else ""))
    return texts


def found(spark, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows_of(ngram_join.near_duplicates(docs(spark, rows).repartition(3)))}


def test_against_brute_force(spark):
    texts = corpus(1, 60, [1, 1, 2, 3, 6]) + ["", None, "one", "One!", "two words", "a b c d e", "A b. c d e", "x " * 30, "x " * 50]
    assert found(spark, texts) == brute(list(range(len(texts))), texts)


def test_a_large_group_is_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 24)
    texts = corpus(2, 1, [150]) + corpus(3, 20, [1, 2])
    got, want = found(spark, texts), brute(list(range(len(texts))), texts)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert sum(n for _, n in got.values()) >= 0.98 * sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)


def test_blocks_meet_a_bounded_number_of_times(spark, monkeypatch):
    """A group's members go to each of its blocks once, however many buckets and runs they share."""
    monkeypatch.setattr(ngram_join, "BUCKET", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    shipped = []
    real = ngram_join._block_tasks
    monkeypatch.setattr(ngram_join, "_block_tasks", lambda *a: shipped.append(real(*a)) or shipped[-1])
    monkeypatch.setattr(ngram_join.common, "discard", lambda *tables: None)
    found(spark, corpus(5, 1, [160]))
    blocks, tasks = shipped[0]
    count = blocks.select("block").distinct().count()
    assert count <= 12 and tasks.count() <= count * count
    assert blocks.groupBy("set").count().where("count > 1").count() == 0


def test_a_tight_group_needs_no_comparison(spark, monkeypatch):
    """Near copies within the radius of a leader count their links from the ball's size: no two of its blocks meet."""
    monkeypatch.setattr(ngram_join, "BUCKET", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    shipped = []
    real = ngram_join._block_tasks
    monkeypatch.setattr(ngram_join, "_block_tasks", lambda *a: shipped.append(real(*a)) or shipped[-1])
    monkeypatch.setattr(ngram_join.common, "discard", lambda *tables: None)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for k in range(120):
        text = list(base)
        text[rng.randrange(300)] = f"own{k}"
        texts += [" ".join(text)] * (2 if k % 10 == 0 else 1)
    got, want = found(spark, texts), brute(list(range(len(texts))), texts)
    assert got == want
    blocks, tasks = shipped[0]
    assert blocks.where("ball is not null").count() >= 100 and blocks.select("block").distinct().count() >= 6
    inside = blocks.where("ball is not null").groupBy("ball").count().agg({"count": "max"}).first()[0]
    assert inside >= 100 and tasks.count() == 0


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_recall_at_the_threshold(depth):
    """Sketches of sets at Jaccard 0.8 meet in at least one bucket of each depth as often as the target says."""
    rng = np.random.default_rng(4)
    met, tries = 0, 400
    for _ in range(tries):
        common, a, b = (rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        pair = ngram_join._sketches([np.unique(np.concatenate([common, x])) for x in (a, b)])
        of, path = ngram_join.paths_of(np.stack([np.frombuffer(x, np.uint16) for x in pair]), depth)
        met += bool(set(path[of == 0].tolist()) & set(path[of == 1].tolist()))
    want = ngram_join.meeting(ngram_join.runs_for(ngram_join.RECALL), depth)
    assert want >= ngram_join.RECALL and met / tries >= want - 3 * (want * (1 - want) / tries) ** 0.5


def test_runs_follow_the_target_recall():
    assert [ngram_join.runs_for(r) for r in (0.5, 0.9, 0.99)] == sorted(ngram_join.runs_for(r) for r in (0.5, 0.9, 0.99))
    assert ngram_join.meeting(ngram_join.runs_for(0.9) - 1, ngram_join.DEEPEST) < 0.9 <= ngram_join.meeting(ngram_join.runs_for(0.9), ngram_join.DEEPEST)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(1, 2), (3, 4), (4, 5), (9, 9)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in rows_of(ngram_join.components(df))}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, [None, ""]) == {0: (0, 1), 1: (0, 1)}
    long = " ".join(f"t{i}" for i in range(30_000))
    assert found(spark, [long, long + " end", "other"]) == {0: (0, 1), 1: (0, 1), 2: (2, 0)}
    rows = [(7, "a b c d e f", "s"), (7, "a b c d e f", "s"), (None, "x y", "s"), (None, "x y", "s")]
    df = docs(spark, rows).selectExpr("*", "1 AS set", "2 AS class_id", "3 AS key")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in rows_of(kept)) == ["7", "None"]


def test_texts_under_null_and_repeated_ids_are_kept(spark):
    """One row of each class is left, whatever the ids: null ones of different texts, and an id of two texts."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a, "s"), (None, b, "s"), (None, c, "s"), (3, c + " end", "s"), (5, d, "s"), (5, e, "s"), (4, d + " end", "s"), (None, a, "s")]
    kept = rows_of(ngram_join.one_of_each(docs(spark, rows)))
    want = [(None, a), (None, b), (3, c + " end"), (4, d + " end"), (5, e)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(want, key=str)
