"""Phrase collocation mining over generalised suffix automata.

Each task numbers the words of its documents, a shard of at most ``SHARD_WORDS`` at a time, and builds one automaton of all
substrings of bounded depth: states are substrings that end at the same places, with the number of these places and a
suffix link. Their substrings and counts are summed over the shards. A phrase can be frequent only if the phrase of its
suffix link and the one without its last word are, so passes over the hashes of phrases of 2, 3, ... words fill a filter of
``FILTER_BITS`` bits, whatever the corpus, that spares the next one all others. It lets pass a few more than it should and
never fewer; the last pass counts what it passed exactly, by its words. A phrase hands its count to its suffix link, where
the shorter phrase learns that it hardly stands alone.

Defined cases: null text is empty; null languages are ``und``; texts are read whole, whatever their length; repeated rows
count each; ties in score and count go by the bytes of the phrase; a language without a frequent phrase has no rows, an
empty table none at all; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .textvec import mix

#: Words of a shard; one text more may pass it.
SHARD_WORDS = 1 << 20
FILTER_BITS = 1 << 26
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ends of pieces become a byte that no text holds.
_BYTES = bytes.maketrans(_UPPER + b".,;:!?\n\x0b\x0c\r\t", _UPPER.lower() + b"\xff" * 10 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """word -> its number in the shard, from 1; 0 is the end of a piece."""

    def __init__(self, words: list[bytes], langs: list[str], lang: str):
        super().__init__({b"\xff": 0})
        self._words, self._langs, self._lang = words, langs, lang

    def __missing__(self, word: bytes) -> int:
        self._words.append(word)
        self._langs.append(self._lang)
        self[word] = n = len(self._words)
        return n


class Shard:
    """The words of some documents as numbers; equal words of two languages are two."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self._numbers: dict[str, _Numbers] = {}
        self._parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes | None, lang: str | None) -> None:
        lang = "und" if lang is None else lang
        if lang not in self._numbers:
            self._numbers[lang] = _Numbers(self.words, self.langs, lang)
        found = (text or b"").translate(_BYTES).replace(b"\xff", b" \xff ").split()
        found.append(b"\xff")
        self._parts.append(np.fromiter(map(self._numbers[lang].__getitem__, found), np.int64, len(found)))
        self.size += len(found)

    def sequence(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), *self._parts])

    def hashes(self) -> np.ndarray:
        """64 bits of each number's language and word."""
        import xxhash

        seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in self._numbers}
        return np.array([0, *(xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in zip(self.words, self.langs, strict=True))], np.uint64)


class SuffixAutomaton:
    """States of all substrings of at most ``depth`` numbers of a sequence whose zeros part the strings.

    A node is one substring: the transition by its last number from the node of those before, so each level is made of
    the one below in one pass. Its suffix link is the node without the first number. Nodes that end at as many places as
    the node they link to end at the same ones: they are one state, which holds its longest and shortest length, an end,
    and the count. ``passes(length, ends)`` may keep substrings, and so all that hold them, out.
    """

    def __init__(self, sequence: np.ndarray, depth: int, passes=None):
        base = int(sequence.max(initial=0)) + 1
        node = np.full(len(sequence), -1)  # at each place, of the substring of the last level that ends there
        places, levels = np.flatnonzero(sequence), []
        for length in range(1, depth + 1):
            if length > 1:
                places = places[(places > 0) & (node[places - 1] >= 0) & (node[places] >= 0)]
            if passes is not None and len(places):
                places = places[passes(length, places)]
            source = node[places - 1] if length > 1 else np.zeros(len(places), np.int64)
            _, first, of, count = np.unique(source * base + sequence[places], return_index=True, return_inverse=True, return_counts=True)
            ends = places[first]
            levels.append((ends, node[ends] if length > 1 else np.full(len(ends), -1), count))
            node = np.full(len(sequence), -1)
            node[places] = of
        self._states(levels)

    def _states(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        starts = np.concatenate([[0], np.cumsum([len(e) for e, _, _ in levels])]).astype(np.int64)
        end, count = np.concatenate([e for e, _, _ in levels]), np.concatenate([c for _, _, c in levels])
        link = np.concatenate([np.where(up >= 0, up + starts[max(i - 1, 0)], -1) for i, (_, up, _) in enumerate(levels)])
        length = np.repeat(np.arange(1, len(levels) + 1), np.diff(starts))
        longest = np.arange(len(end))  # the node that stands for the state of each
        joined = np.zeros(len(end), bool)
        for i in range(len(levels) - 1, 0, -1):
            own = np.arange(starts[i], starts[i + 1])
            joined[own] = count[own] == count[link[own]]
            same = own[joined[own]]
            longest[link[same]] = longest[same]
        kept = np.flatnonzero(longest == np.arange(len(end)))
        number = np.zeros(len(end), np.int64)
        number[kept] = np.arange(len(kept))
        shortest = np.flatnonzero(~joined)  # one node of each state, the last that links out of it
        out = number[longest[shortest]]
        self.end, self.count, self.longest = end[kept], count[kept], length[kept]
        self.shortest, self.link = np.zeros(len(kept), np.int64), np.full(len(kept), -1)
        self.shortest[out] = length[shortest]
        self.link[out] = np.where(link[shortest] >= 0, number[longest[link[shortest]]], -1)

    def substrings(self, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An end, the length and the count of each substring of at least ``least`` numbers, state by state."""
        low = np.maximum(self.shortest, least)
        times = np.maximum(self.longest - low + 1, 0)
        state = np.repeat(np.arange(len(times)), times)
        step = np.arange(len(state)) - np.repeat(np.cumsum(times) - times, times)
        return self.end[state], low[state] + step, self.count[state]


def _rolled(sequence: np.ndarray, hashes: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each length the hash of the substring that ends at each place (over ends of pieces too, where none is read)."""
    word = hashes[sequence]
    out = [word]
    for _ in range(1, depth):
        before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        out.append(mix(before * _ODD + word))
    return out


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter, from its last 40 bits."""
    low = hashes & np.uint64((1 << 40) - 1)
    last = np.uint64(FILTER_BITS - 1)
    return mix(low) & last, mix(low + _ODD) & last


def _filter(bits: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits with those of the column ``bit`` set."""
    words = bits.groupBy(F.shiftright("bit", 6).alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for place in _places(hashes):
        out &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            for text, lang in zip(rows.column(0).cast(pa.binary()).to_pylist(), rows.column(1).to_pylist(), strict=True):
                shard.add(text, lang)
                if shard.size >= SHARD_WORDS:
                    yield shard
                    shard = Shard()
    yield shard


def _substrings(shard: Shard, depth: int, bits: np.ndarray | None, known: int):
    """The shard's sequence, hashes by length and end, and its substrings whose parts the filter holds.

    The filter knows all lengths up to ``known``.
    """
    sequence = shard.sequence()
    rolled = _rolled(sequence, shard.hashes(), depth)
    passes = None if bits is None else lambda length, places: _holds(bits, rolled[length - 1][places]) if length <= known else np.ones(len(places), bool)
    return sequence, rolled, SuffixAutomaton(sequence, depth, passes).substrings()


def _packed(hashes: np.ndarray, counts: np.ndarray, least: int, shift: int) -> pa.RecordBatch:
    """A row for each run of equal first bits: the last 40 bits of its hashes and, up to ``least``, their counts."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], np.minimum(counts[order], least).astype(_small(least))
    group = (hashes >> np.uint64(shift)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    ends = np.concatenate([at, [len(group)]]).tolist()
    low = hashes.view(np.uint8).reshape(-1, 8)[:, :5]
    pairs = list(zip(ends[:-1], ends[1:], strict=True))
    columns = [np.ascontiguousarray(low[a:b]).tobytes() for a, b in pairs], [counts[a:b].tobytes() for a, b in pairs]
    return pa.RecordBatch.from_arrays([pa.array(group[at]), *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "low", "n"])


def _small(least: int) -> type:
    return np.uint8 if least < 256 else np.uint32


def _frequent_bits(docs: DataFrame, depth: int, least: int, bits) -> DataFrame:
    """bit: the places in a filter of phrases of ``depth`` words that may occur ``least`` times; at first, of shorter ones too.

    Hashes travel packed, in rows by their first bits: as many buckets as shuffle partitions or somewhat more. Those of a
    bucket that agree in their last 40 bits count as one, which lets pass more.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shift = 64 - min(24, max(parts - 1, 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            _, rolled, (ends, lengths, counts) = _substrings(shard, depth, bits and bits.value, depth - 1)
            of = [np.flatnonzero(lengths == size) for size in range(1 if bits is None else depth, depth + 1)]
            hashes = np.concatenate([rolled[lengths[some[0]] - 1][ends[some]] for some in of if len(some)] or [np.zeros(0, np.uint64)])
            yield _packed(hashes, np.concatenate([counts[some] for some in of]), least, shift)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def frequent() -> pa.RecordBatch:
            low = np.frombuffer(b"".join(h[0] for h in held), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(low), 8), np.uint8)
            wide[:, :5] = low
            keys = wide.view(np.uint64)[:, 0]
            order = np.argsort(keys)
            keys, n = keys[order], np.frombuffer(b"".join(h[1] for h in held), _small(least))[order].astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            often = keys[at][np.add.reduceat(n, at) >= least]
            return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_places(often))).astype(np.int64))], ["bit"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if row[0] != bucket and held:
                    yield frequent()
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield frequent()

    packed = docs.mapInArrow(count, "bucket long, low binary, n binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "bit long")


def _spelled(docs: DataFrame, longest: int, bits) -> DataFrame:
    """lang, phrase, size, n by shard: substrings whose parts pass, and all words of each language as size 0."""
    names = ["lang", "phrase", "size", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            sequence, _, (ends, lengths, counts) = _substrings(shard, longest, bits.value, longest)
            spell, tongue = pa.array([None, *shard.words], pa.string()), pa.array(["", *shard.langs], pa.string()).dictionary_encode()
            sums = np.bincount(tongue.indices.to_numpy()[sequence[sequence > 0]], minlength=len(tongue.dictionary))
            full = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([tongue.dictionary.take(pa.array(full)), pa.nulls(len(full), pa.string()), pa.array(np.zeros(len(full), np.int32)), pa.array(sums[full])], names)
            for size in range(1, longest + 1):
                of = np.flatnonzero(lengths == size)
                for first in range(0, len(of), 1 << 18):
                    some = of[first : first + (1 << 18)]
                    at = ends[some]
                    phrase = pc.binary_join_element_wise(*[spell.take(pa.array(sequence[at - j])) for j in range(size - 1, -1, -1)], " ")
                    yield pa.RecordBatch.from_arrays([tongue.take(pa.array(sequence[at])).cast(pa.string()), phrase, pa.array(np.full(len(some), size, np.int32)), pa.array(counts[some])], names)

    return docs.mapInArrow(count, "lang string, phrase string, size int, n long")


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int) -> DataFrame:
    """lang, phrase, size, n: phrases of 1 to ``longest`` words with ``least`` occurrences or more.

    Rows of size 0 hold the number of all words of a language.
    """
    slim = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    share = docs.sparkSession.sparkContext.broadcast
    bits = None
    for depth in range(2, longest + 1):
        found = _filter(_frequent_bits(slim, depth, least, bits))
        bits = share(found if bits is None else bits.value | found)
    counts = _spelled(slim, longest, bits).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return common.materialize(counts.where((F.col("size") == 0) | (F.col("n") >= least)), "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int = 2_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best scored phrases of two words or more of each language.

    A phrase of which a longer one makes up ``share`` per cent or more is left out; as a longer phrase is never more
    frequent than one within it, the phrases of one word more decide.
    """
    found = frequent_phrases(docs, text_col, lang_col, longest, least)
    phrases, totals = found.where("size >= 2"), found.where("size = 0").select("lang", F.col("n").alias("n"))
    link, head = F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', size - 1)")
    longer = phrases.where("size > 2").select("lang", F.explode(F.array(link, head)).alias("phrase"), "n")
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))
    cuts = alone.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    sides = found.where((F.col("size") >= 1) & (F.col("size") < longest))
    rows = sides.count()
    for part, name in (("first", "l"), ("rest", "r")):
        side = sides.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        cuts = cuts.join(common.maybe_broadcast(side, rows), ["lang", part])
    # exact: counts below 10^15, products below 10^38
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("_over", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("_under", wide("l") * wide("r"))
    scored = cuts.withColumn("score", F.expr("_over div _under"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (VALUES (1), (2), (3)) v(size)),
counts AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE size = 3) GROUP BY ALL),
alone AS (
  SELECT c.* FROM candidates c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase
  WHERE o.most IS NULL OR 100 * o.most < 50 * c.a),
cuts AS (SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM alone),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
