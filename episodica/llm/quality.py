"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each text. The counts of vote patterns over all documents
(at most 3 to the number of labellers, whatever the corpus) go to an expectation-maximisation that estimates how often
each labeller gives each vote on good and on bad documents, and so the posterior of each pattern. The posteriors label a
sample of at most ``TRAIN_ROWS`` distinct documents, those of least hash of id and text, and train a linear scorer on
hashed features: runs of character classes and stepped statistics. Where good or bad documents are so rare that the
sample has few of them, at most ``RARE_ROWS`` more are drawn from all documents of that kind. The scorer judges every
document from its whole text.

Defined cases: null text is empty; an empty text has no votes and is rejected; short texts get fewer votes, and are kept
unless what is there speaks against them; very long texts are read whole; equal texts get equal scores, and rows of equal
id and text stand once in the sample, however many they are; with no votes at all, or posteriors of one kind only over
all documents, every text that is not empty is kept; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textvec

TRAIN_ROWS = 8_000
#: Documents of a kind that the sample has fewer of are drawn from all documents, so many at most.
RARE_ROWS = 500
BUCKETS = 4_096
#: Least probability of being good of a document that is kept.
KEEP = 0.5
CHUNK = 1 << 19
#: Classes of bytes: all others are letters beyond ASCII.
CLASSES = ("\t\x0b\x0c\r ", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "", ".", ",", "!", "?", "|", "#$%&*@^~<>{}[]\\/=+_`", "'\"():;-")
SPACE, LINE, LOWER, UPPER, DIGIT, BEYOND, STOP, COMMA, CRY, ASK, BAR, SYMBOL, MILD = range(len(CLASSES))
#: Frequent function words of the corpus's languages.
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on be at by this are or from an have not "
    "der die das und ist nicht ein eine zu den mit von auf für im sich dem des "
    "le la les de des et un une du en est que dans pour par sur pas au "
    "el los las del y que se por con una su para lo como"
).split()
#: Statistic, least words, bad beyond, good within; a labeller reads one statistic.
LABELLERS = (
    ("symbols", 5, lambda v: v > 0.03, lambda v: v < 0.005),
    ("capitals", 5, lambda v: v > 0.5, lambda v: v < 0.2),
    ("cries", 5, lambda v: v > 0.3, lambda v: v < 0.05),
    ("bars", 5, lambda v: v > 0.1, lambda v: v < 0.01),
    ("distinct", 20, lambda v: v < 0.15, lambda v: v > 0.25),
    ("top", 20, lambda v: v > 0.3, lambda v: v < 0.15),
    ("function", 30, lambda v: v < 0.01, lambda v: v > 0.05),
    ("sentence", 40, lambda v: v > 150, lambda v: v < 60),
    ("length", 5, lambda v: (v > 20) | (v < 1.5), lambda v: (v > 2) & (v < 12)),
    ("plain", 5, lambda v: v < 0.9, lambda v: v > 0.97),
    ("wordless", 5, lambda v: v > 0.15, lambda v: v < 0.05),
    ("repeats", 20, lambda v: v > 0.25, lambda v: v < 0.08),
)
ABSTAIN, BAD, GOOD = 0, 1, 2
_POWERS = 3 ** np.arange(len(LABELLERS))


class Reader:
    """Statistics and hashed features of texts; one lives in each task."""

    def __init__(self) -> None:
        table = np.full(256, BEYOND, np.uint8)
        for k, members in enumerate(CLASSES):
            table[[ord(c) for c in members]] = k
        table[:32][table[:32] == BEYOND] = SYMBOL
        self.table, self.hasher = table, textvec.Hasher()
        known = next(self.hasher.spans([" ".join(FUNCTION_WORDS)]))[2].hash
        self.known = np.unique(known)

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """For consecutive texts: statistics, and the features as (text, bucket, value)."""
        for first, last, words in self.hasher.spans([t or "" for t in texts]):
            raws = [(t or "").encode() for t in texts[first:last]]
            yield self._read(raws, words)

    def _read(self, raws: list[bytes], words: textvec.Words):
        n, k = len(raws), len(CLASSES)
        kinds = self.table[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
        lengths = np.array([len(r) + 1 for r in raws])
        doc = np.repeat(np.arange(n), lengths)
        of = np.bincount(doc * k + kinds, minlength=n * k).reshape(n, k).astype(float)
        of[:, LINE] -= 1
        with np.errstate(divide="ignore", invalid="ignore"):
            share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
            inner = np.diff(np.concatenate([[0], (kinds > LINE).astype(np.int8)]))
            spaced = np.bincount(doc[inner == 1], minlength=n).astype(float)  # words between white space
            filled = of.sum(axis=1) - of[:, SPACE] - of[:, LINE]
            count = (words.last - words.first).astype(float)
            order = np.lexsort((words.hash, words.text))
            h, t = words.hash[order], words.text[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            times = np.diff(np.concatenate([at, [len(h)]]))
            distinct = np.bincount(t[at], minlength=n)
            top = np.zeros(n)
            np.maximum.at(top, t[at], times)
            place = np.minimum(np.searchsorted(self.known, words.hash), len(self.known) - 1)
            function = np.bincount(words.text[self.known[place] == words.hash], minlength=n)
            same = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
            repeats = np.bincount(words.text[1:][same], minlength=n)
            stats = {
                "words": spaced, "symbols": share(of[:, SYMBOL], filled), "capitals": share(of[:, UPPER], of[:, UPPER] + of[:, LOWER]),
                "cries": share(of[:, CRY], spaced), "bars": share(of[:, BAR], spaced), "distinct": share(distinct, count),
                "top": share(top, count), "function": share(function, count), "sentence": spaced / np.maximum(of[:, [STOP, CRY, ASK]].sum(axis=1), 0.5),
                "length": share(filled, spaced), "plain": share(of[:, [LOWER, UPPER, BEYOND, STOP, COMMA, DIGIT, MILD]].sum(axis=1), filled),
                "wordless": share(np.maximum(spaced - count, 0), spaced), "repeats": share(repeats, count),
            }
        grams = kinds[:-2].astype(np.int64) * (k * k) + kinds[1:-1].astype(np.int64) * k + kinds[2:]
        inside = doc[:-2] == doc[2:]
        code = doc[:-2][inside] * (k**3) + grams[inside]
        cells, counts = np.unique(code, return_counts=True) if n > 200 else _counted(code, n * k**3)
        text, gram = cells // k**3, cells % k**3
        value = np.sqrt(counts / np.maximum(lengths[text], 1))
        steps = []
        for i, (name, least, *_) in enumerate(LABELLERS):
            level = np.clip(np.floor(np.log2(np.maximum(stats[name], 2.0**-10)) * 2) + 20, 0, 60).astype(np.int64)
            ok = np.flatnonzero(stats["words"] >= least)
            steps.append((ok, (i + 1) * 100_000 + level[ok], np.full(len(ok), 0.5)))
        text = np.concatenate([text, *[s[0] for s in steps]])
        feature = np.concatenate([gram, *[s[1] for s in steps]])
        value = np.concatenate([value, *[s[2] for s in steps]])
        bucket = (textvec.mix(feature.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BUCKETS)).astype(np.int64)
        return stats, text, bucket, value


def _counted(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(code, minlength=size)
    cells = np.flatnonzero(counts)
    return cells, counts[cells]


def votes_of(stats: dict[str, np.ndarray]) -> np.ndarray:
    """The vote pattern of each text as one number, a ternary place for each labeller."""
    out = np.zeros(len(stats["words"]), np.int64)
    for power, (name, least, bad, good) in zip(_POWERS, LABELLERS, strict=True):
        v = stats[name]
        vote = np.where(bad(v), BAD, np.where(good(v), GOOD, ABSTAIN))
        out += power * np.where(stats["words"] >= least, vote, ABSTAIN)
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of being good for each pattern, P(vote | bad or good) for each labeller, and the share of good."""
    votes = (patterns[:, None] // _POWERS) % 3
    for_good, against = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    # a document is doubtful to begin with if any labeller objects; each kind of junk meets few of them
    posterior = np.where(against > 0, 0.05, np.where(for_good > 0, 0.95, 0.5))
    chance = np.zeros((2, len(LABELLERS), 3))
    prior = 0.5
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            for k in range(len(LABELLERS)):
                chance[c, k] = np.bincount(votes[:, k], weights=weight, minlength=3) + 0.1
            chance[c] /= chance[c].sum(axis=1, keepdims=True)
        prior = float((counts * posterior).sum() + 1) / (counts.sum() + 2)
        # an abstention tells of a text's length more than of its kind, so it carries no weight
        ratio = np.log(chance[1]) - np.log(chance[0])
        ratio[:, ABSTAIN] = 0
        logit = np.log(prior / (1 - prior)) + ratio[np.arange(len(LABELLERS)), votes].sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - posterior).max() < 1e-6:
            posterior = new
            break
        posterior = new
    return posterior, chance, prior


def fit_linear(text: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.5, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Adam over the whole sample."""
    weights, bias = np.zeros(BUCKETS), 0.0
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for k in range(1, rounds + 1):
        score = np.bincount(text, weights=value * weights[bucket], minlength=len(target)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) / len(target)
        slope = np.append(np.bincount(bucket, weights=value * error[text], minlength=BUCKETS) + penalty * weights, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8) / (1 + k / 100)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer, from the votes on all of ``docs`` and a sample of ``rows`` of them."""
    slim = docs.select(F.xxhash64(docs[id_col].cast("string"), docs[text_col]).alias("h"), docs[text_col].alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found = [votes_of(stats) for stats, *_ in reader.chunks(batch.column(0).to_pylist())]
            patterns, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(counts)], ["pattern", "n"])

    seen = slim.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r["pattern"] for r in seen], np.int64), np.array([r["n"] for r in seen], np.float64)
    if not len(seen):
        return np.zeros(BUCKETS), 1.0
    posterior, _, _ = estimate(patterns, counts)
    good = posterior >= 0.5
    if good.all() or not good.any():  # one kind only, over all documents
        return np.zeros(BUCKETS), 1.0
    table = _sample(slim, rows, counts.sum(), None)
    target = posterior[np.searchsorted(patterns, table.column("pattern").to_numpy())]
    for kind in (True, False):
        if ((target >= 0.5) == kind).sum() < min(RARE_ROWS, counts[good == kind].sum()):
            more = _sample(slim, RARE_ROWS, counts[good == kind].sum(), patterns[good == kind])
            new = ~np.isin(more.column("h").to_numpy(), table.column("h").to_numpy())
            table = pa.concat_tables([table, more.filter(pa.array(new))])
            target = posterior[np.searchsorted(patterns, table.column("pattern").to_numpy())]
    order = np.argsort(table.column("h").to_numpy(), kind="stable")
    table, target = table.take(pa.array(order)).combine_chunks(), target[order]
    bucket, value = table.column("bucket").combine_chunks(), table.column("value").combine_chunks()
    text = np.repeat(np.arange(table.num_rows), np.diff(bucket.offsets.to_numpy()))
    return fit_linear(text, bucket.flatten().to_numpy(), value.flatten().to_numpy(), target)


def _sample(slim: DataFrame, rows: int, of: float, patterns: np.ndarray | None) -> pa.Table:
    """h, pattern and features of at most ``rows`` distinct rows of ``slim`` (h, text), of ``patterns`` only if given.

    A share of the hashes leaves about twice as many of the ``of`` rows; of these, those of least hash are taken, so that
    neither the driver nor a task gets more however often a row is repeated.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, met = Reader(), set()
        for batch in batches:
            fresh = [i for i, h in enumerate(batch.column(0).to_pylist()) if not (h in met or met.add(h))]
            batch, at = batch.take(pa.array(fresh, pa.int64())), 0
            for stats, text, bucket, value in reader.chunks(batch.column(1).to_pylist()):
                order = np.argsort(text, kind="stable")
                n = len(stats["words"])
                offsets = pa.array(np.searchsorted(text[order], np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (bucket, value)]
                votes = votes_of(stats)
                own = pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(votes), *lists], ["h", "pattern", "bucket", "value"])
                yield own if patterns is None else own.filter(pa.array(np.isin(votes, patterns)))
                at += n

    share = min(1.0, 2 * rows / of)
    chosen = slim.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(np.ceil(share * (1 << 30)))))
    found = chosen.mapInArrow(features, "h long, pattern long, bucket array<long>, value array<double>").dropDuplicates(["h"])
    return found.orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(rows).toArrow()


def score_of(texts: list[str | None], reader: Reader, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of being good; 0 for a text without any sign that is not white space."""
    out = [np.zeros(0)]
    for stats, text, bucket, value in reader.chunks(texts):
        score = np.bincount(text, weights=value * weights[bucket], minlength=len(stats["words"])) + bias
        out.append(np.where(stats["words"] > 0, 1 / (1 + np.exp(-np.clip(score, -30, 30))), 0.0))
    return np.concatenate(out)


def with_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", column: str = "quality") -> DataFrame:
    """``docs`` with the probability of being good in ``column``, by a scorer trained on ``docs`` themselves."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, (weights, bias) = Reader(), shared.value
        for texts in batches:
            yield pa.array(score_of(texts.to_pylist(), reader, weights, bias))

    return docs.withColumn(column, judge(docs[text_col]))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, columns unchanged."""
    own = common.free_name(docs, "quality")
    return with_quality(docs, id_col, text_col, own).where(F.col(own) >= KEEP).drop(own)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs).select("doc_id", F.round("quality", 6).alias("quality"), (F.col("quality") >= KEEP).alias("keep"))
