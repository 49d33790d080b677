"""Best-fit packing by hierarchical residual packing.

Documents are tokenised where they lie and cut only beyond ``capacity``. Each partition packs its pieces by best fit,
longest first, and closes the bins that are nearly full. The underfull bins go up a tree: nodes of ``FAN_IN`` groups
take them as items, fit them again and close what is nearly full, until one node is left. Only (bin, fill) rows move;
pieces are joined to their sequence once.

What a node closes can never be filled further, so nothing is lost by it. Of two bins of one best fit, the fills sum to
more than ``capacity`` (the first item of the later one did not fit the earlier one), so at most one is filled to a half
or less, and any later union has such a bin in it. A node above takes ``FAN_IN`` groups and so at most that many of these;
if one of them fits any bin of a group, it fits one of the ``FAN_IN`` emptiest. So a node hands up its ``FAN_IN + 1``
emptiest bins with room and closes the others, and a node holds at most ``FAN_IN * (FAN_IN + 1)`` bins whatever the
input; a bin of it has at most ``capacity`` leaves, as each holds a token.

Defined cases: null text is empty, and an empty document is the end id alone; ties keep the order of the input; repeated
rows are packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2_048
END_ID = 0
FAN_IN = 8
CACHE_ROWS = 800_000
#: Pieces that a partition of the first round packs together, about.
LOCAL_PIECES = 50_000

PIECE_SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes: printable ones for themselves, the others from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in own else next(rest) for b in range(256)}


class _Ids(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes; encodes what it lacks, and starts anew when full.

    A printable word of Latin letters is split and lower-cased here, and the library's merges are asked for each part,
    which is all that its whole chain does to such a word; any other word goes through the whole chain.
    """

    def __init__(self, tokenizer: str, limit: int):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer, self._limit = Tokenizer.from_file(tokenizer), limit
        self._merge, self._letters = self._tokenizer.model.tokenize, _byte_letters()
        self._bytes = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self._parts.get(part)
        if found is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(self._letters)
            found = self._parts[part] = b"".join([self._bytes[t.id] for t in self._merge(letters)])
        return found

    def ids(self, word: str) -> bytes:
        if word.isprintable() and "<|" not in word and (word.isascii() or max(word) < "\u0180" and "\u0130" not in word):
            low = word.lower()
            if low.isalpha():
                return self._part(low)
            if low[:-1].isalpha():  # one sign behind letters is a part of its own
                return self._part(low[:-1]) + self._part(low[-1])
            return b"".join(map(self._part, _PARTS(low)))
        return b"".join([self._bytes[i] for i in self._tokenizer.encode(word, add_special_tokens=False).ids])

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(word)
        if len(self) >= self._limit:
            self.clear()
        if len(self._parts) >= self._limit:
            self._parts.clear()
        self[word] = ids
        return ids


#: How the tokenizer splits a word (fixed by its file).
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
#: The tokenizer drops white space and no normal form reaches across it, so words between ASCII white space stand alone.
_WORDS = re.compile(r"[^ \t\n\r\x0b\x0c]+").findall


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    end, size = np.asarray([END_ID], dtype="<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _Ids(tokenizer, CACHE_ROWS).__getitem__
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = b"".join(map(ids_of, _WORDS(text or ""))) + end
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return slim.mapInArrow(cut, PIECE_SCHEMA.format(id=slim.schema["doc_id"].dataType.simpleString()))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: the bin and the place of each item, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    have = 0  # bit r is set while some bin has room r
    fill: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = have >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = room_of[room].pop()
            if not room_of[room]:
                have &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            room_of[left].append(b)
            have |= 1 << left
    return bins, places, np.asarray(fill, np.int64)


def _up(fill: np.ndarray, capacity: int, fan_in: int) -> np.ndarray:
    """Which bins go up: the emptiest ``fan_in + 1`` of those with room."""
    emptiest = np.argsort(fill, kind="stable")[: fan_in + 1]
    return (fill < capacity) & np.isin(np.arange(len(fill)), emptiest)


def _node(level: int, root: bool, capacity: int, fan_in: int):
    """The function that fits the bins of one node again."""

    def node(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["top", "at"], kind="stable", ignore_index=True)
        _, index = np.unique(rows["top"].to_numpy(), return_inverse=True)
        sizes = np.bincount(index, weights=rows["fill"].to_numpy()).astype(np.int64)
        bins, places, fill = best_fit(sizes, capacity)
        up = np.zeros(len(fill), bool) if root else _up(fill, capacity, fan_in)
        group = int(rows["group"].iloc[0])
        return rows.assign(top=(level << 56) + (group << 32) + bins[index], at=rows["at"].to_numpy() + places[index], up=up[bins[index]])

    return node


def pack(pieces: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """``pieces`` (length and any other columns) with sequence_id and offset."""
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        rows = pd.concat([*batches, pd.DataFrame(columns=columns)], ignore_index=True)
        if not len(rows):
            return
        bins, places, fill = best_fit(rows["length"].to_numpy(np.int64), capacity)
        up = _up(fill, capacity, fan_in)
        yield rows.assign(bin=(task << 32) + bins, place=places, up=up[bins], part=task)

    first = common.materialize(pieces.mapInPandas(local, f"{schema}, bin long, place long, up boolean, part long"), "pack-local")
    names = [F.col(c) for c in columns]
    closed = first.where("not up").select(*names, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    leaves = first.where("up").groupBy("bin", "part").agg(F.sum("length").alias("fill"))
    # top: the bin of the tree that holds a leaf's bin now; at: the leaf's place in it
    state = leaves.select("bin", "fill", F.col("bin").alias("top"), F.lit(0).cast("long").alias("at"), F.col("part").alias("group"))
    state = common.materialize(state, "pack-leaves")
    settled, level = [], 0
    groups = state.agg(F.max("group")).first()[0] or 0
    while True:
        level, groups = level + 1, groups // fan_in
        root = groups == 0

        moved = state.withColumn("group", F.floor(F.col("group") / fan_in).cast("long"))
        moved = moved.groupBy("group").applyInPandas(_node(level, root, capacity, fan_in), "bin long, fill long, top long, at long, group long, up boolean")
        moved = common.materialize(moved, f"pack-level{level}")
        settled.append(moved.where("not up").select("bin", "top", "at"))
        if root:
            break
        state = moved.where("up").drop("up")
    places = settled[0]
    for more in settled[1:]:
        places = places.unionByName(more)
    places = places.withColumnRenamed("bin", "leaf")
    rest = first.where("up").join(common.maybe_broadcast(places, places.count()), F.col("bin") == F.col("leaf"))
    return closed.unionByName(rest.select(*names, F.col("top").alias("sequence_id"), (F.col("at") + F.col("place")).alias("offset")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs`` (doc_id, text)."""
    pieces = common.materialize(tokenized_pieces(docs, tokenizer=tokenizer, capacity=capacity), "pack-pieces")
    parts = max(1, round(pieces.count() / LOCAL_PIECES))
    return pack(pieces.repartition(parts), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents"))
