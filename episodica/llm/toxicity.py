"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text and their beginnings of 4, 5 and 6 bytes, hashed. From at most ``TRAIN_ROWS``
distinct labelled documents (those of least hash of id and text), the documents with and without the label are counted
for each bucket, and the buckets that stand out are kept. Toxic documents are graded by how much of such evidence they
hold, in thirds: 1, 2 or 3; the others have grade 0. P(grade > k) = 1 / (1 + exp(cut_k - w x)) shares the weights w
across the ordered cuts, and the expected severity is the sum of these probabilities. Whole texts are read.

Defined cases: null text is empty; a text without words has only the cuts' severity; repeated words count once, equal
texts score equal; very long texts are read whole; labels that are null or of no document are left out, and rows of equal
id, text and label count once in the sample, however many they are; without a toxic label nothing is toxic; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

TRAIN_ROWS = 20_000
BUCKET_BITS = 20
PREFIXES = (4, 5, 6)
#: A bucket stands out at such a z-score of its toxic documents, and so many times the usual share of them.
LEAST_Z, LEAST_LIFT = 4.0, 3.0
MAX_FEATURES = 8_192
GRADES = 4
#: Probability of a grade above 0 from which a document is toxic.
TOXIC = 0.5
_SALT = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)


def buckets_of(words: textvec.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each kind of feature: whole words, then their beginnings."""
    shift = np.uint64(64 - BUCKET_BITS)
    yield words.text, ((words.hash * np.uint64(_SALT[0] | 1)) >> shift).astype(np.int64)
    for k, n in enumerate(PREFIXES):
        long = words.size > n
        sums, start = words.sums, words.start[long]
        h = textvec.mix((sums[start + n] - sums[start]) * words.hasher.inverse[start])
        yield words.text[long], ((h * np.uint64(_SALT[k + 1] | 1)) >> shift).astype(np.int64)


def _found(texts: list[str | None], hasher: textvec.Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct (text, bucket) of consecutive texts [first, last)."""
    for first, last, words in hasher.spans([t or "" for t in texts]):
        parts = list(buckets_of(words))
        code = np.concatenate([t.astype(np.int64) << BUCKET_BITS | b for t, b in parts])
        code = np.unique(code)
        yield first, last, code >> BUCKET_BITS, code & ((1 << BUCKET_BITS) - 1)


def _feature_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Buckets, and the documents that have each, toxic and clean, over ``sample`` (text, toxic); and both totals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, total = textvec.Hasher(), np.zeros((2, 1 << BUCKET_BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column(1).to_pylist(), np.int64)
            total += np.bincount(toxic, minlength=2)
            for first, _, text, bucket in _found(batch.column(0).to_pylist(), hasher):
                for y in (0, 1):
                    seen[y] += np.bincount(bucket[toxic[first + text] == y], minlength=1 << BUCKET_BITS).astype(np.int32)
        at = np.flatnonzero(seen.any(axis=0))
        columns = [np.append(at, -1), np.append(seen[1, at], total[1]), np.append(seen[0, at], total[0])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bucket", "toxic", "clean"])

    found = sample.mapInArrow(count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # what can stand out at all; a row for each bucket at most, whatever the corpus
    table = found.where("bucket < 0 OR toxic >= 3").orderBy("bucket").toArrow()
    if table.num_rows == 0:
        return np.zeros(0, np.int64), np.zeros((2, 0)), 0, 0
    bucket, toxic, clean = (table.column(c).to_numpy() for c in ("bucket", "toxic", "clean"))
    return bucket[1:], np.stack([clean[1:], toxic[1:]]).astype(float), int(clean[0]), int(toxic[0])


def _standing_out(bucket: np.ndarray, seen: np.ndarray, clean: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that stand out, and their log-odds."""
    share = toxic / (clean + toxic)
    total = seen.sum(axis=0)
    z = (seen[1] - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
    lift = (seen[1] / toxic) / np.maximum(seen[0] / clean, 0.5 / clean)
    odds = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (clean + 1))
    at = np.flatnonzero((z >= LEAST_Z) & (lift >= LEAST_LIFT))
    at = at[np.lexsort((bucket[at], -z[at]))][:MAX_FEATURES]
    at = np.sort(at)
    return bucket[at], odds[at]


def fit_cumulative(text: np.ndarray, feature: np.ndarray, grade: np.ndarray, features: int, rounds: int = 400, rate: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts of the cumulative-link model, by Adam over the whole sample."""
    n = len(grade)
    weights, first, gaps = np.zeros(features), 1.0, np.zeros(GRADES - 2)  # cut_k = first + sums of exp(gaps)
    m, v = np.zeros(features + GRADES - 1), np.zeros(features + GRADES - 1)
    for k in range(1, rounds + 1):
        cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(text, weights=weights[feature], minlength=n)
        # the chance of a grade is the difference of two neighbouring curves
        curve = 1 / (1 + np.exp(np.clip(cuts - score[:, None], -30, 30)))
        upper = np.concatenate([np.ones((n, 1)), curve], axis=1)
        lower = np.concatenate([curve, np.zeros((n, 1))], axis=1)
        rows = np.arange(n)
        chance = np.maximum(upper[rows, grade] - lower[rows, grade], 1e-9)
        slope_of = np.concatenate([np.zeros((n, 1)), curve * (1 - curve), np.zeros((n, 1))], axis=1)
        by_score = -(slope_of[rows, grade] - slope_of[rows, grade + 1]) / chance / n
        by_cut = np.zeros(GRADES - 1)
        for j in range(GRADES - 1):
            d = curve[:, j] * (1 - curve[:, j]) / chance / n
            by_cut[j] = (d[grade == j + 1]).sum() - (d[grade == j]).sum()
        tail = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([np.bincount(feature, weights=by_score[text], minlength=features) + penalty * weights, tail[:1], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        weights, first, gaps = weights - move[:features], first - move[features], gaps - move[features + 1 :]
    return weights, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """text and toxic of at most ``rows`` distinct labelled documents, written.

    Labels and documents meet by id as hashes first; the texts are read for the chosen ones only, whose number is bounded.
    """
    marked = labels.select(labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)").distinct()
    marked = common.materialize(marked, "toxic-labels")
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    keys = slim.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"))
    met = keys.join(common.maybe_broadcast(marked, marked.count()), F.col("doc_id") == F.col("label_id"))
    met = met.groupBy("doc_id", "key").agg(F.max("toxic").alias("toxic"))  # a document labelled both ways is toxic
    chosen = met.orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(rows)
    chosen = common.materialize(chosen.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "toxic"), "toxic-chosen")
    match = (F.col("doc_id") == F.col("own_id")) & (F.xxhash64("text") == F.col("own_key"))
    sample = slim.join(F.broadcast(chosen), match)  # ``rows`` rows at most
    return common.materialize(sample.dropDuplicates(["doc_id", "own_key"]).select("text", "toxic"), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS):
    """Buckets, their weights and the cuts, from a bounded sample of the labelled rows of ``docs``."""
    sample = _sample(docs, labels, id_col, text_col, label_col, rows)
    bucket, seen, clean, toxic = _feature_counts(sample)
    nothing = np.zeros(0, np.int64), np.zeros(0), np.array([5.0, 6.0, 7.0])
    if not toxic or not clean:
        return nothing
    bucket, odds = _standing_out(bucket, seen, clean, toxic)
    if not len(bucket):
        return nothing
    known = docs.sparkSession.sparkContext.broadcast(bucket)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = textvec.Hasher()
        for batch in batches:
            at = 0
            for first, last, text, found in _found(batch.column(0).to_pylist(), hasher):
                place = np.minimum(np.searchsorted(known.value, found), len(known.value) - 1)
                hit = known.value[place] == found
                text, place = text[hit], place[hit]
                offsets = pa.array(np.searchsorted(text, np.arange(last - first + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, last - first), pa.ListArray.from_arrays(offsets, pa.array(place))], ["toxic", "features"])
                at = last

    table = sample.mapInArrow(select, "toxic int, features array<long>").toArrow()
    # sums of slopes must not hang on the order of partitions
    rows = sorted(zip(table.column("toxic").to_pylist(), table.column("features").to_pylist(), strict=True))
    y = np.array([t for t, _ in rows])
    text = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    feature = np.array([x for _, f in rows for x in f], np.int64)
    evidence = np.bincount(text, weights=odds[feature], minlength=len(rows))
    edges = np.quantile(evidence[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (evidence[:, None] > edges).sum(axis=1), 0)
    weights, cuts = fit_cumulative(text, feature, grade, len(bucket))
    return bucket, weights, cuts


def severity_of(texts: list[str | None], hasher: textvec.Hasher, table: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity, and the probability of a grade above 0. ``table`` has the weight of each bucket."""
    score = np.zeros(len(texts))
    for first, last, words in hasher.spans([t or "" for t in texts]):
        for text, bucket in buckets_of(words):
            weight = table[bucket]
            hit = np.flatnonzero(weight)
            if len(hit):  # each bucket of a kind counts once a text
                code = np.unique(text[hit].astype(np.int64) << BUCKET_BITS | bucket[hit])
                score[first:last] += np.bincount(code >> BUCKET_BITS, weights=table[code & ((1 << BUCKET_BITS) - 1)], minlength=last - first)
    curve = 1 / (1 + np.exp(np.clip(cuts - score[:, None], -30, 30)))
    return curve.sum(axis=1), curve[:, 0]


def with_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", column: str = "severity") -> DataFrame:
    """``docs`` with a struct of severity and toxic (the probability of a grade above 0) in ``column``."""
    bucket, weights, cuts = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((bucket, weights, cuts))

    @F.arrow_udf("severity double, toxic double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places, own, cuts = shared.value
        table, hasher = np.zeros(1 << BUCKET_BITS), textvec.Hasher()
        table[places] = own
        for texts in batches:
            severity, toxic = severity_of(texts.to_pylist(), hasher, table, cuts)
            yield pa.StructArray.from_arrays([pa.array(severity), pa.array(toxic)], ["severity", "toxic"])

    return docs.withColumn(column, judge(docs[text_col]))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, columns unchanged."""
    own = common.free_name(docs, "severity")
    return with_severity(docs, labels, id_col, text_col, own).where(F.col(own)["toxic"] < TOXIC).drop(own)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_severity(docs, common.read(spark, sf_dir, "labels"), column="s")
    return out.select("doc_id", F.round("s.severity", 6).alias("severity"), (F.col("s.toxic") >= TOXIC).alias("toxic"))
