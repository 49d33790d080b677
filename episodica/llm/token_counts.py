"""Token counts by a two-tier lookup.

The pieces of the vocabulary hold the space mark only in front, so no merge crosses from a character to a following
space: a text's tokens are those of its pre-tokens (a run of spaces and the characters after it), and their counts add
up. Tier one is a broadcast table of the token counts of frequent pre-tokens, of at most ``TABLE_ROWS`` rows, taken from
a sample of ``SAMPLE_DOCS`` documents; it only saves time, so the sample changes no result. Tier two is a bounded cache in each worker; what neither
holds is encoded by the library. No pre-token of the corpus is shuffled.

Defined cases: null text is empty and has 0 tokens; any length of text is counted whole; repeated rows are counted each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 8_192
TABLE_ROWS = 32_768
CACHE_ROWS = 300_000
TOKEN_LIMIT = 4_096
MARK = "▁"


class _Counts(dict):
    """pre-token -> number of tokens; encodes what it lacks, and starts anew when full."""

    def __init__(self, frequent: dict[str, int], model: str, limit: int):
        import sentencepiece

        super().__init__(frequent)
        self._frequent, self._limit = frequent, limit + len(frequent)
        self._encode = sentencepiece.SentencePieceProcessor(model_file=model).encode

    def __missing__(self, unit: str) -> int:
        n = len(self._encode(unit)) if unit else 1  # the library gives no token for an empty text, the lone mark is one
        if len(self) >= self._limit:
            self.clear()
            self.update(self._frequent)
        self[unit] = n
        return n


def units(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space mark."""
    if not text:
        return []
    plain = text.replace(MARK, " ")
    found = plain.split(" ")
    if "" not in found:
        return found
    out, spaces = [], 0
    for i, word in enumerate(found):
        if word:
            out.append(" " * spaces + word)
            spaces = 0
        elif i < len(found) - 1:
            spaces += 1
        else:
            out.append(" " * spaces)
    return out


def frequent_table(docs: DataFrame, model: str, sample_docs: int = SAMPLE_DOCS, rows: int = TABLE_ROWS) -> dict[str, int]:
    """Token counts of the pre-tokens most frequent in a bounded sample: ``SAMPLE_CHARS`` of each of some documents.

    A limit that is collected reads the first partitions only and shuffles nothing.
    """
    import sentencepiece

    seen: Counter[str] = Counter()
    for row in docs.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(sample_docs).collect():
        seen.update(u for u in units(row["text"] or "") if u and len(u) <= 64)
    top = [u for u, _ in seen.most_common(rows)]
    encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
    return {u: len(ids) for u, ids in zip(top, encode(top), strict=True)} if top else {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    table = slim.sparkSession.sparkContext.broadcast(frequent_table(slim, model))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(table.value, model, CACHE_ROWS)
        of = counts.__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(sum(map(of, units(text))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return slim.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.read(spark, sf_dir, "documents"))
