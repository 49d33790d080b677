import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from episodica.llm import packing, token_counts

from .helpers import docs, rows_of

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
PIECES, TOKENS = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(WORDS)
ODD = [None, "", " ", "  ", "a ", " a  b ", "▁", "▁▁a", "x\x1cy", "\x85 q", "it's <|endoftext|> I'LL", "<s>", "Σας ΣΑΣ.", "İx", "a\xa0b", "汉字　x", "🙂🙂", "\x00", "é é", "x" * 3000, "a\n\n b"]
COUNTS, IDS = token_counts._Counts({}, MODEL, 50), packing._Ids(WORDS, 50)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_units_add_up(text):
    assert sum(map(COUNTS.__getitem__, token_counts.units(text))) == len(PIECES.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_words_stand_alone(text):
    got = b"".join(map(IDS.__getitem__, packing._WORDS(text)))
    assert got == np.asarray(TOKENS.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_counts(spark):
    got = rows_of(token_counts.count_tokens(docs(spark, [(i, t, "s") for i, t in enumerate(ODD)]), limit=10))
    for r in got:
        text = ODD[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(PIECES.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 10)
    assert len(got) == len(ODD)
    assert rows_of(token_counts.count_tokens(docs(spark, []))) == []


@pytest.fixture(scope="module")
def packed(spark):
    texts = ODD + ["word " * n for n in (1, 5, 100, 700, 2047, 2048, 5000)] * 3
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return texts, rows_of(packing.pack_documents(docs(spark, rows), capacity=256))


def test_pieces(packed):
    texts, got = packed
    for i, text in enumerate(texts):
        ids = [*TOKENS.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 256))
        for r in own:
            part = ids[r["start"] : r["start"] + 256]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())


def test_sequences_are_gapless_and_few(packed):
    _, got = packed
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r["length"] for r in got) // 256) + 2


def test_tree_of_parts(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(n)) for i, n in enumerate(rng.integers(1, 100, 3000))]
    pieces = spark.createDataFrame(rows, "doc_id long, length long").repartition(40)
    got = rows_of(packing.pack(pieces, capacity=128, fan_in=4))
    assert sorted((r["doc_id"], r["length"]) for r in got) == rows
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 128
    assert len(fill) <= 1.1 * sum(n for _, n in rows) / 128


def test_what_a_node_closes_cannot_be_filled(spark):
    """Long pieces that no two fit together, and short ones elsewhere: every short one that fits goes in, and nodes stay small."""
    rng = np.random.default_rng(2)
    long = [int(n) for n in rng.integers(66, 110, 1200)]
    rows = [(i, n) for i, n in enumerate(long)] + [(2000 + i, 12) for i in range(12)]
    schema = "doc_id long, length long"
    # each of the first parts holds long pieces only, each of the last a short one only
    parts = [rows[k : k + 300] for k in range(0, 1200, 300)] + [[r] for r in rows[1200:]]
    pieces = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda part: part), schema)
    got = rows_of(packing.pack(pieces, capacity=128, fan_in=4))
    assert len(got) == len(rows) and len({r["sequence_id"] for r in got}) == 1200


@pytest.mark.parametrize("sizes", [[1400, 1100, 1300] * 50, [700, 600, 1, 2, 2000] * 40])
def test_two_bins_never_fit_together(sizes):
    _, _, fill = packing.best_fit(np.asarray(sizes), 2048)
    low = np.sort(fill)
    assert len(low) < 2 or low[0] + low[1] > 2048
    assert packing._up(fill, 2048, 8).sum() <= 9


def test_nothing_to_pack(spark):
    assert rows_of(packing.pack_documents(docs(spark, []))) == []
    twice = rows_of(packing.pack_documents(docs(spark, [(None, "a b", "s"), (None, "a b", "s")])))
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2
