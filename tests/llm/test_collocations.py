"""The automaton against plain enumeration, and the ranked phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from episodica.llm import collocations as col

from .helpers import rows_of


def substrings(sequence, depth):
    out = Counter()
    for i in range(len(sequence)):
        for j in range(i + 1, min(i + depth, len(sequence)) + 1):
            if 0 in sequence[i:j]:
                break
            out[tuple(sequence[i:j])] += 1
    return out


@pytest.mark.parametrize("seed,depth", [(0, 1), (1, 2), (2, 3), (3, 5), (4, 4)])
def test_automaton_holds_every_substring_once(seed, depth):
    draw = random.Random(seed)
    sequence = [draw.choice([0, 1, 1, 2, 3]) for _ in range(300)]
    a = col.SuffixAutomaton(np.array(sequence), depth)
    ends, lengths, counts = a.substrings()
    got = {tuple(sequence[e - n + 1 : e + 1]): c for e, n, c in zip(ends.tolist(), lengths.tolist(), counts.tolist(), strict=True)}
    assert len(got) == len(ends) and got == substrings(sequence, depth)


def test_states_are_classes_of_equal_ends():
    draw = random.Random(9)
    sequence = [draw.choice([0, 1, 2, 2]) for _ in range(200)]
    a = col.SuffixAutomaton(np.array(sequence), 4)
    ends = defaultdict(set)
    for i in range(len(sequence)):
        for n in range(1, 5):
            s = tuple(sequence[max(0, i - n + 1) : i + 1])
            if len(s) == n and 0 not in s:
                ends[s].add(i)
    classes = {frozenset(e) for e in ends.values()}
    assert len(a.count) == len(classes)
    spell = lambda s, n: tuple(sequence[a.end[s] - n + 1 : a.end[s] + 1])
    for s in range(len(a.count)):
        own = ends[spell(s, a.longest[s])]
        assert all(ends[spell(s, n)] == own for n in range(a.shortest[s], a.longest[s] + 1)) and len(own) == a.count[s]
        if a.shortest[s] > 1:
            assert ends[spell(s, a.shortest[s] - 1)] == ends[spell(a.link[s], a.longest[a.link[s]])] > own
        else:
            assert a.link[s] == -1


def brute(rows, longest=3, least=10, share=50, top=2_000):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in phrases.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in phrases.items()):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows_of(col.collocations(df, **how)))


def texts(seed, n, words):
    draw = random.Random(seed)
    return [("".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(draw.randint(0, 60))), draw.choice(["en", "fr", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("longest,least,top", [(2, 10, 2_000), (3, 10, 2_000), (3, 3, 7), (5, 4, 50)])
def test_against_brute_force(spark, longest, least, top):
    rows = texts(longest, 60, ["New", "york", "CITY", "é", "of", "of", "|", "\x00"]) + [(None, "en"), ("", "de"), ("ha " * 40, "en"), ("a b c d e. " * 12, "en")]
    assert found(spark, rows, longest=longest, least=least, top=top) == brute(rows, longest, least, top=top)


def test_small_shards_and_a_full_filter(spark, monkeypatch):
    """Shards of a few words, and a filter so small that it lets nearly all pass, change nothing."""
    monkeypatch.setattr(col, "SHARD_WORDS", 20)
    monkeypatch.setattr(col, "FILTER_BITS", 64)
    rows = texts(8, 80, ["a", "b", "c", "dd", "ee", "ff"])
    assert found(spark, rows) == brute(rows)


def test_common_words_and_ties(spark):
    rows = [("x y", "en")] * 12 + [("y x", "en")] * 12 + [(f"the w{i % 3}", "en") for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_counts_beyond_64_bits(spark):
    """a * a * 1000000 passes 64 bits; the exact quotient is not that of doubles."""
    from pyspark.sql import functions as F

    a, l, r = 3_000_000_000_019, 3_000_000_000_021, 3_000_000_000_023
    got = spark.range(1).select(*[F.lit(v).cast("decimal(15,0)").alias(n) for n, v in (("a", a), ("l", l), ("r", r))])
    score = got.withColumn("over", F.col("a") * F.col("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", F.col("l") * F.col("r"))
    assert score.select(F.expr("over div under")).first()[0] == 1_000_000 * a * a // (l * r)


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([("a b " * 20, "en", 1, "p")], "text string, lang string, n int, phrase string")
    assert len(rows_of(col.collocations(df))) == len(brute([("a b " * 20, "en")]))
