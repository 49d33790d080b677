"""The quality and toxicity models: estimates against planted truth, held-out accuracy, edges."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import quality, textvec, toxicity

from .helpers import docs, rows_of

DATA = "/root/testdata/sf0.1"


def test_word_hashes():
    words = next(textvec.Hasher().spans(["Ab ab, cd", "cd", None, "é_1"]))[2]
    h = words.hash
    assert list(words.text) == [0, 0, 0, 1, 3] and h[0] == h[1] != h[2] and h[2] == h[3]
    run, text = words.shingles(2)
    assert list(text) == [0, 0, 1, 3]
    one = next(textvec.Hasher().spans(["zz cd"]))[2]
    assert one.hash[1] == h[2] and one.prefix(1)[1] == words.prefix(1)[2]


def test_estimate_recovers_planted_labellers():
    rng = np.random.default_rng(0)
    n, k = 20_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    bad_rate = np.full(k, 0.45)
    votes = np.where(good[:, None], np.where(rng.random((n, k)) < 0.005, quality.BAD, quality.GOOD), np.where(rng.random((n, k)) < bad_rate, quality.BAD, quality.GOOD))
    votes[rng.random((n, k)) < 0.1] = quality.ABSTAIN
    patterns, inverse, counts = np.unique(votes @ quality._POWERS, return_inverse=True, return_counts=True)
    posterior, chance, prior = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - good.mean()) < 0.02
    assert np.abs(chance[0, :, quality.BAD] / (1 - chance[0, :, quality.ABSTAIN]) - 0.45).max() < 0.05
    assert ((posterior[inverse] > 0.5) == good).mean() > 0.98


def test_quality_against_labels(spark):
    got = quality.op1_quality_classifier(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet").withColumnRenamed("quality", "truth"), "doc_id")
    n = {(r["truth"], r["keep"]): r["count"] for r in rows_of(got.groupBy("truth", "keep").count())}
    assert n.get((1, False), 0) <= 0.002 * n[(1, True)]
    assert n[(0, False)] >= 0.95 * (n[(0, False)] + n.get((0, True), 0))


def test_toxicity_on_held_out_labels(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    got = toxicity.with_severity(table, seen, column="s").join(labels.where("doc_id % 2 = 1 AND quality = 1").withColumnRenamed("toxic", "truth"), "doc_id")
    n = {(r["truth"], r["t"]): r["count"] for r in rows_of(got.groupBy("truth", (F.col("s.toxic") >= toxicity.TOXIC).alias("t")).count())}
    assert n[(1, True)] >= 0.93 * (n[(1, True)] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.005 * n[(0, False)]


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, toxicity.GRADES, 3000)
    text = np.repeat(np.arange(3000), grade)
    weights, cuts = toxicity.fit_cumulative(text, np.zeros(len(text), np.int64), grade, 1)
    assert weights[0] > 0 and (np.diff(cuts) > 0).all()
    curve = 1 / (1 + np.exp(cuts[None, :] - weights[0] * np.arange(toxicity.GRADES)[:, None]))
    assert (np.diff(curve.sum(axis=1)) > 0).all() and np.abs(curve.sum(axis=1) - np.arange(toxicity.GRADES)).max() < 0.3


EDGES = [(1, None, "a"), (2, "", "a"), (3, "x", None), (None, "plain words here, as any text has them.", "b"), (5, "w " * 300_000, "b"), (5, "w " * 300_000, "b")]


def test_edges(spark):
    df = docs(spark, EDGES).selectExpr("*", "1 AS quality", "2 AS severity", "3 AS h", "4 AS toxic", "5 AS _quality", "6 AS _severity", "7 AS pattern", "8 AS key")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in rows_of(kept)} >= {3, None} and not {1, 2} & {r["doc_id"] for r in rows_of(kept)}
    assert quality.keep_good(df.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (9, None), (77, 1)], "doc_id long, toxic int")
    assert toxicity.keep_clean(df, labels).columns == df.columns
    assert toxicity.keep_clean(df, labels.limit(0)).count() == len(EDGES)
    assert toxicity.keep_clean(df.limit(0), labels).count() == 0


ODD = ["", None, "a", "Ab, cd! The end.", "x\ty\n\nz | q | r", "WOW!!! BUY NOW!!! " * 9, "the cat and the dog sat. " * 12, "zz " * 40, "é ü %%% 12 34", "q" * 60, "a b c d e f g"]


def plain_statistics(text):
    """The statistics of one text, by hand."""
    raw = (text or "").encode()
    table = {ord(c): k for k, members in enumerate(quality.CLASSES) for c in members}
    kinds = [table.get(b, quality.SYMBOL if b < 32 else quality.BEYOND) for b in raw]
    n = [kinds.count(k) for k in range(len(quality.CLASSES))]
    spaced = len([w for w in re.split(rb"[\t\n\x0b\x0c\r ]+", raw) if w])
    words = re.findall(rb"[0-9a-z_\x80-\xff]+", (text or "").lower().encode())
    filled = len(raw) - n[quality.SPACE] - n[quality.LINE]
    share = lambda a, b: a / b if b else 0.0
    known = {w.encode() for w in quality.FUNCTION_WORDS}
    plain = sum(n[k] for k in (quality.LOWER, quality.UPPER, quality.BEYOND, quality.STOP, quality.COMMA, quality.DIGIT, quality.MILD))
    return {
        "words": spaced, "symbols": share(n[quality.SYMBOL], filled), "capitals": share(n[quality.UPPER], n[quality.UPPER] + n[quality.LOWER]),
        "cries": share(n[quality.CRY], spaced), "bars": share(n[quality.BAR], spaced), "distinct": share(len(set(words)), len(words)),
        "top": share(max([0, *(words.count(w) for w in set(words))]), len(words)), "function": share(sum(w in known for w in words), len(words)),
        "sentence": spaced / max(n[quality.STOP] + n[quality.CRY] + n[quality.ASK], 0.5), "length": share(filled, spaced), "plain": share(plain, filled),
        "wordless": share(max(spaced - len(words), 0), spaced), "repeats": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),
    }, kinds


def plain_pattern(stats):
    out = 0
    for i, (name, least, bad, good) in enumerate(quality.LABELLERS):
        if stats["words"] >= least:
            out += 3**i * (quality.BAD if bad(stats[name]) else quality.GOOD if good(stats[name]) else quality.ABSTAIN)
    return out


def plain_score(text, weights, bias):
    stats, kinds = plain_statistics(text)
    kinds, k = [*kinds, quality.LINE], len(quality.CLASSES)  # a text ends with a line
    grams = Counter(a * k * k + b * k + c for a, b, c in zip(kinds, kinds[1:], kinds[2:]))
    features = [(g, (n / (len((text or "").encode()) + 1)) ** 0.5) for g, n in grams.items()]
    for i, (name, least, *_) in enumerate(quality.LABELLERS):
        if stats["words"] >= least:
            features.append(((i + 1) * 100_000 + int(min(60, max(0, np.floor(np.log2(max(stats[name], 2.0**-10)) * 2) + 20))), 0.5))
    score = bias
    for f, v in features:
        h = np.array([f], np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        score += v * weights[int(textvec.mix(h)[0] % np.uint64(quality.BUCKETS))]
    return 1 / (1 + np.exp(-score)) if stats["words"] else 0.0


def test_quality_against_brute_force():
    texts = ODD * 25  # both ways of counting
    reader, at = quality.Reader(), 0
    for stats, *_ in reader.chunks(texts):
        patterns = quality.votes_of(stats)
        for i in range(len(patterns)):
            want, _ = plain_statistics(texts[at + i])
            for name, v in want.items():
                assert abs(stats[name][i] - v) < 1e-9, (name, texts[at + i])
            assert patterns[i] == plain_pattern(want)
        at += len(patterns)
    assert at == len(texts)
    weights = np.random.default_rng(3).normal(0, 1, quality.BUCKETS)
    for some in (ODD, texts):
        got = quality.score_of(some, reader, weights, 0.3)
        assert np.abs(got - [plain_score(t, weights, 0.3) for t in some]).max() < 1e-9


def plain_estimate(votes, counts, rounds):
    """The expectation-maximisation, by loops."""
    rows = range(len(votes))
    p = [0.05 if quality.BAD in v else 0.95 if quality.GOOD in v else 0.5 for v in votes]
    for _ in range(rounds):
        chance = {}
        for c in (0, 1):
            for k in range(len(votes[0])):
                got = [0.1 + sum(counts[i] * (p[i] if c else 1 - p[i]) for i in rows if votes[i][k] == x) for x in range(3)]
                for x in range(3):
                    chance[c, k, x] = got[x] / sum(got)
        prior = (sum(counts[i] * p[i] for i in rows) + 1) / (sum(counts) + 2)
        new = []
        for i in rows:
            logit = np.log(prior / (1 - prior)) + sum(np.log(chance[1, k, x] / chance[0, k, x]) for k, x in enumerate(votes[i]) if x != quality.ABSTAIN)
            new.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        p = new
    return p


def test_estimate_against_loops():
    rng = np.random.default_rng(5)
    patterns = np.unique(rng.integers(0, 3 ** len(quality.LABELLERS), 30))
    counts = rng.integers(1, 500, len(patterns)).astype(float)
    votes = [[int(p) // 3**k % 3 for k in range(len(quality.LABELLERS))] for p in patterns]
    got, _, _ = quality.estimate(patterns, counts, rounds=6)
    assert np.abs(got - plain_estimate(votes, counts.tolist(), 6)).max() < 1e-9


def test_samples_are_bounded_however_rows_repeat(spark, monkeypatch):
    """A third of all rows may be one row under a null id; neither sample grows by it, and rare junk is still met."""
    good = [(i, f"The text of number {i} and what it is for. It was read by the staff in the town.", "s") for i in range(600)]
    junk = [(None, "@@@ ### $$$ %%% ^^^ &&& ||| ||| ||| {{{ }}} ~~~", "s")] * 400 + [(None, None, "s")] * 50
    df = docs(spark, good + junk).repartition(7)
    taken = []
    real = quality._sample
    monkeypatch.setattr(quality, "_sample", lambda slim, rows, of, patterns: taken.append((rows, real(slim, rows, of, patterns))) or taken[-1][1])
    weights, bias = quality.train(df, rows=100)
    assert taken and all(t.num_rows <= rows and len(set(t.column("h").to_pylist())) == t.num_rows for rows, t in taken)
    score = quality.score_of([good[0][1], junk[0][1]], quality.Reader(), weights, bias)
    assert score[0] >= quality.KEEP > score[1]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] * 2 + [(5, None), (None, 1)], "doc_id long, toxic int")
    many = df.unionByName(docs(spark, [(9, "the same row again", "s")] * 500))
    sample = toxicity._sample(many, labels, "doc_id", "text", "toxic", 100)
    assert sample.count() == 100
    assert toxicity._sample(many, labels, "doc_id", "text", "toxic", 10_000).count() == 601  # an id of two texts counts twice


def test_toxicity_against_brute_force(spark):
    """Counts of features, and scores, by plain loops over words and their beginnings."""
    texts = ["Bad badly! word", "bad bad badger", "", None, "clean words only here", "é word_1 badness x"]
    toxic = [1, 1, 0, 0, 0, 1]
    shift = 64 - toxicity.BUCKET_BITS

    def buckets(text):
        kinds = [set() for _ in range(1 + len(toxicity.PREFIXES))]
        words = re.findall(rb"[0-9a-z_\x80-\xff]+", (text or "").lower().encode())
        own = next(textvec.Hasher().spans([text or ""]))[2]
        for w, h in zip(words, own.hash, strict=True):
            kinds[0].add(int((int(h) * (toxicity._SALT[0] | 1)) % (1 << 64) >> int(shift)))
            for k, n in enumerate(toxicity.PREFIXES):
                if len(w) > n:
                    part = next(textvec.Hasher().spans([w[:n].decode("latin-1")]))[2] if w[:n].isascii() else None
                    h2 = part.hash[0] if part is not None else own.prefix(n)[words.index(w)]
                    kinds[k + 1].add(int((int(h2) * (toxicity._SALT[k + 1] | 1)) % (1 << 64) >> int(shift)))
        return kinds

    bucket, seen, clean, dirty = toxicity._feature_counts(spark.createDataFrame(list(zip(texts, toxic, strict=True)), "text string, toxic int").repartition(3))
    assert (clean, dirty) == (3, 3)
    want = Counter((b, y) for t, y in zip(texts, toxic, strict=True) for b in set().union(*buckets(t)))
    for b, (c, d) in zip(bucket.tolist(), seen.T.tolist(), strict=True):
        assert (want[b, 0], want[b, 1]) == (c, d)
    assert {b for (b, y), n in want.items() if y and n >= 3} <= set(bucket.tolist())
    table = np.random.default_rng(6).normal(0, 1, 1 << toxicity.BUCKET_BITS)
    cuts = np.array([0.5, 1.0, 2.0])
    severity, chance = toxicity.severity_of(texts, textvec.Hasher(), table, cuts)
    for i, text in enumerate(texts):
        score = sum(table[b] for kind in buckets(text) for b in kind)
        curve = 1 / (1 + np.exp(cuts - score))
        assert abs(severity[i] - curve.sum()) < 1e-9 and abs(chance[i] - curve[0]) < 1e-9


@pytest.mark.parametrize("n", [5])
def test_equal_texts_score_equal(spark, n):
    df = docs(spark, [(i, "THIS!! IS!! ALL!! CAPITALS!! HERE!! AND!! LOUD!!" if i % 2 else "a calm line of the text, and some more of it.", "s") for i in range(4 * n)])
    got = quality.with_quality(df).groupBy("text").agg(F.countDistinct("quality").alias("n"))
    assert all(r["n"] == 1 for r in rows_of(got))
