"""Ranked lexical search as a blocked product of sparse matrices.

Items times terms times documents: the terms of a block of items (``ITEM_TERMS`` pairs, or one item of more) are numbered
and broadcast; every task writes its documents as blocks of at most ``BLOCK_DOCS`` rows, with the term numbers and counts
of each. When the document frequencies of these terms are known, a block's counts become int64 impacts, turned to rows by
term; the row of an item is the merge of the rows of its terms into one accumulator (Gustavson's product). A task keeps
the best k of each item over its blocks and hands up these only.

Defined cases: null and empty texts have no terms, such documents take no part, such items have no rows; texts are read
whole; rows that share an item_id are items of their own, each with its list; repeated documents take part each; equal
scores go by ascending doc_id, null ids last; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_DOCS = 8_192
#: A block of documents ends with the row that brings so many (document, term) pairs.
BLOCK_PAIRS = 1 << 21
#: (item, term) pairs of a block of items; what a task gets to know of the items is bounded by it.
ITEM_TERMS = 1 << 20
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: What parts terms becomes a space, A-Z lower case, all else stays.
_BYTES = bytes.maketrans(_PARTS + _UPPER, b" " * len(_PARTS) + _UPPER.lower())
_BLOCK = "docs array<long>, total array<long>, pairs array<int>, term array<int>, tf array<int>"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or "").encode().translate(_BYTES).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """row, item_id, term, times: distinct terms of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found, times = np.unique(np.array(terms(text), object), return_counts=True)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(found.tolist(), pa.string()), pa.array(times, pa.int64())], ["row", "term", "times"])

    return items.mapInArrow(split, "row long, term string, times long")


def _blocks_of_items(pairs: DataFrame) -> tuple[DataFrame, list[int]]:
    """``pairs`` with a block for each item, and the blocks: none of two items or more passes twice ``ITEM_TERMS``."""
    few = max(1, math.ceil(pairs.count() / ITEM_TERMS))
    while True:
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(few)))
        sizes = dealt.groupBy("block", "row").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
        if not sizes.where((F.col("n") > 2 * ITEM_TERMS) & (F.col("items") > 1)).head(1):
            return dealt, [r["block"] for r in sizes.select("block").collect()]  # some for each ITEM_TERMS pairs
        few *= 2


def _document_blocks(docs: DataFrame, vocabulary) -> DataFrame:
    """Documents in rows of blocks: ids, numbers of all their terms, of pairs, and term numbers and counts of the pairs."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = vocabulary.value, [], [0, 0]

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            lists = [ids, *(pa.array(np.concatenate([h[i] for h in held])) for i in range(1, 5))]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["docs", "total", "pairs", "term", "tf"])

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                totals, found = [], []
                for text in part.column(1).to_pylist():
                    words = terms(text)
                    totals.append(len(words))
                    found.append(np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words)))
                total, places = np.array(totals, np.int64), np.concatenate(found)
                row = np.repeat(np.arange(len(total)), total)[places >= 0]
                cells, tf = np.unique(row * (len(known) + 1) + places[places >= 0], return_counts=True)
                row, term = cells // (len(known) + 1), cells % (len(known) + 1)
                kept = np.flatnonzero(total)
                pairs = np.bincount(row, minlength=len(total))[kept]
                held.append((part.column(0).take(pa.array(kept)), total[kept], pairs.astype(np.int32), term.astype(np.int32), tf.astype(np.int32)))
                size = [size[0] + len(kept), size[1] + len(term)]
                if size[0] >= BLOCK_DOCS - 256 or size[1] >= BLOCK_PAIRS:
                    yield block()
                    held, size = [], [0, 0]
        if held:
            yield block()

    return docs.mapInArrow(split, _BLOCK)


def _frequencies(blocks: DataFrame, n: int) -> np.ndarray:
    """The number of documents that hold each of ``n`` terms, summed by task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "df"])

    found = blocks.select("term").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n, np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def product(starts: np.ndarray, columns: np.ndarray, times: np.ndarray, by_term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[np.ndarray]:
    """The rows of (items x terms) x (terms x documents): Gustavson's merge of the rows that an item's terms name.

    ``by_term`` holds the bounds of each term's row in ``doc`` and ``impact``; a document is in a row once at most.
    """
    for i in range(len(starts) - 1):
        merged = np.zeros(n_docs, np.int64)
        for t, k in zip(columns[starts[i] : starts[i + 1]].tolist(), times[starts[i] : starts[i + 1]].tolist(), strict=True):
            a, b = by_term[t], by_term[t + 1]
            if a < b:
                merged[doc[a:b]] += impact[a:b] if k == 1 else k * impact[a:b]
        yield merged


def _best(blocks: DataFrame, query, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of each item among a task's blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, columns, times, weight, count, length = query.value
        items = len(starts) - 1
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items  # score, id; null ids come as the greatest number
        for batch in batches:
            for b in range(batch.num_rows):
                row = lambda name, batch=batch, b=b: batch.column(batch.schema.get_field_index(name))[b].values
                ids = row("docs").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                total, pairs, term, tf = (row(c).to_numpy() for c in ("total", "pairs", "term", "tf"))
                doc = np.repeat(np.arange(len(ids)), pairs)
                m = 100 - 90 + (90 * total * count) // max(length, 1)
                tf = tf.astype(np.int64)
                impact = weight[term] * ((1_000_000_000 * tf) // (1_000 * tf + 8 * m[doc]))
                order = np.argsort(term, kind="stable")
                by_term = np.searchsorted(term[order], np.arange(n_terms + 1))
                for i, scores in enumerate(product(starts, columns, times, by_term, doc[order], impact[order], len(ids))):
                    old, names = top[i]
                    floor = old[-1] if len(old) == k else 1
                    if len(scores) > k:
                        floor = max(floor, np.partition(scores, -k)[-k])
                    at = np.flatnonzero(scores >= max(floor, 1))
                    if len(at):
                        s, d = np.concatenate([old, scores[at]]), np.concatenate([names, ids[at]])
                        first = np.lexsort((d, -s))[:k]
                        top[i] = s[first], d[first]
        found = np.repeat(np.arange(items), [len(s) for s, _ in top])
        ids = np.concatenate([d for _, d in top]) if items else np.zeros(0, np.int64)
        scores = np.concatenate([s for s, _ in top]) if items else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(ids, mask=ids == np.iinfo(np.int64).max), pa.array(scores)], ["item", "doc_id", "score"])

    return blocks.mapInArrow(search, "item long, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for every row of ``items``.

    An item's terms count ``once`` each, or as often as it repeats them.
    """
    spark = docs.sparkSession
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = items.select(F.monotonically_increasing_id().alias("row"), items[item_col].alias("item_id"), items["text"].alias("text"))
    rows = common.materialize(rows, "search-items")
    pairs = common.materialize(_item_terms(rows), "search-terms")
    dealt, numbers = _blocks_of_items(pairs)
    results, spent = [], [pairs]
    for number in numbers or [0]:
        mine = dealt.where(F.col("block") == number).select("row", "term", "times").toArrow()
        spelled = sorted(set(mine["term"].to_pylist()))
        known = {t.encode(): i for i, t in enumerate(spelled)}
        names, of = np.unique(mine["row"].to_numpy(), return_inverse=True)
        column = np.array([known[t.encode()] for t in mine["term"].to_pylist()], np.int64)
        order = np.lexsort((column, of))
        starts = np.searchsorted(of[order], np.arange(len(names) + 1))
        times = np.ones(len(order), np.int64) if once else mine["times"].to_numpy()[order]
        blocks = common.materialize(_document_blocks(slim, spark.sparkContext.broadcast(known)), "search-blocks")
        sums = F.sum(F.size("total").cast("long")).alias("n"), F.sum(F.expr("aggregate(total, 0L, (a, x) -> a + x)")).alias("l")
        count, length = (x or 0 for x in blocks.agg(*sums).first())
        df = _frequencies(blocks, len(spelled))
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        query = spark.sparkContext.broadcast((starts, column[order], times, weight, count, length))
        best = _best(blocks, query, len(spelled), k)
        named = spark.createDataFrame(list(enumerate(names.tolist())), "item long, row long")
        results.append(common.materialize(best.join(F.broadcast(named), "item").select("row", "doc_id", "score"), "search-best"))
        spent.append(blocks)
    common.discard(*spent)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(rows.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
sizes AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sizes GROUP BY term, n_docs),
scores AS (
  SELECT i, item_id, r, doc_id, sum(weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.w) * n_docs) // l))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (r), sizes GROUP BY i, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""
