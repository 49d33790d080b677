"""Media columns: payloads stored as lossless WebP and read back.

``store`` turns a text into its payload (UTF-8, padded with bytes 0 to a positive multiple of 64) and writes it as grey
8-bit samples, 64 to a row, in WebP files of at most ``MAX_SIDE`` rows laid end to end. ``load`` decodes any lossless
WebP to pixel arrays. The stored table is written before it is read back.

Defined cases: null text is empty, and an empty payload is 64 bytes 0; a text of any length is stored whole; equal texts
give equal values; repeated rows are stored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, webp

ROW = 64
#: Rows of the hash in the feature, and samples in each.
CELLS = 8


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the unpadded length."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def to_media(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return b"".join(webp.encode_grey(rows[k : k + webp.MAX_SIDE]) for k in range(0, len(rows), webp.MAX_SIDE))


def from_media(media: bytes) -> np.ndarray:
    """The samples of a grey file as rows of ``ROW``."""
    images = webp.decode(media)
    for image in images:
        if not (image[..., 0] == image[..., 1]).all() or not (image[..., 1] == image[..., 2]).all():
            raise webp.WebpError("the image is not grey")
    return np.concatenate([image[..., 1] for image in images])


def feature_of(samples: np.ndarray) -> str:
    """Size, mean and an average hash: a bit for each cell of a grid, set where the cell is brighter than the image."""
    rows = np.linspace(0, len(samples), CELLS + 1).astype(int)
    sums = np.concatenate([[[0] * CELLS], np.cumsum(samples.reshape(len(samples), CELLS, -1).sum(-1, dtype=np.int64), axis=0)])
    area = np.maximum(np.diff(rows), 1)[:, None] * (ROW // CELLS)
    cells = (sums[rows[1:]] - sums[rows[:-1]]) / area
    mean = float(sums[-1].sum()) / samples.size
    bits = "".join("1" if c > mean else "0" for c in cells.reshape(-1))
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} hash={int(bits, 2):016x}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media for every row."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for text in batch.column(1).to_pylist():
                payload, n = payload_of(text)
                media.append(to_media(payload))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return slim.mapInArrow(write, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def load(stored: DataFrame) -> DataFrame:
    """Decode every ``media`` and describe what was read."""
    own = stored.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                samples = from_media(media)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(read, f"doc_id {own}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pixels(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """doc_id, image (from 0), width, height and pixels (red, green, blue, alpha, row by row) of every image in ``media_col``.

    Any lossless WebP is read: all prefix codes, back-references, colour caches and transforms. A null or empty value has
    no image.
    """
    slim = stored.select("doc_id", F.col(media_col).alias("media"))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, media in enumerate(batch.column(1).to_pylist()):
                images = webp.decode(media or b"")
                rows = [(k, image.shape[1], image.shape[0], image.astype(np.uint8).tobytes()) for k, image in enumerate(images)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at] * len(rows), pa.int64())), *arrays], ["doc_id", "image", "width", "height", "pixels"])

    return slim.mapInArrow(read, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, image int, width int, height int, pixels binary")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.materialize(store(common.read(spark, sf_dir, "documents")), "media")
    return load(stored)
