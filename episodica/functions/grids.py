"""Images in array columns, row by row of cells: masks grown and shrunk, components, rings and gradients.

The neighbours of a cell are the four beside it; what lies outside an image is unset. A batch of images is one numpy
block, so that a stencil costs a few passes over the block, and blocks hold at most ``CELLS`` cells. An image that is
null, has a null cell or another number of cells than height times width has a null result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1 << 22


def dilate(mask: np.ndarray, steps: int = 1) -> np.ndarray:
    """Masks (image, row, cell) grown by ``steps`` cells."""
    out = mask
    for _ in range(steps):
        grown = out.copy()
        grown[:, 1:] |= out[:, :-1]
        grown[:, :-1] |= out[:, 1:]
        grown[:, :, 1:] |= out[:, :, :-1]
        grown[:, :, :-1] |= out[:, :, 1:]
        out = grown
    return out


def erode(mask: np.ndarray, steps: int = 1) -> np.ndarray:
    """Masks shrunk by ``steps`` cells; the border of an image counts as an edge."""
    padded = np.pad(mask, ((0, 0), (1, 1), (1, 1)))
    for _ in range(steps):
        grown = dilate(~padded)
        padded = ~grown
        padded[:, [0, -1]] = False
        padded[:, :, [0, -1]] = False
    return padded[:, 1:-1, 1:-1]


def slope(image: np.ndarray) -> np.ndarray:
    """The sum of the absolute gradients down and across: central differences, one-sided ones at the border."""
    return np.abs(np.gradient(image, axis=1)) + np.abs(np.gradient(image, axis=2))


def components(mask: np.ndarray) -> np.ndarray:
    """For each cell of a mask the least place (in the block) of its component, -1 elsewhere.

    Runs across and runs down take their least label in turn until nothing changes, so rounds are as many as a
    component has turns, not cells.
    """
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), -1)
    while True:
        before = label
        for axes in ((0, 1, 2), (0, 2, 1)):
            label = _least_of_runs(label.transpose(axes)).transpose(axes)
        if np.array_equal(before, label):
            return label


def _least_of_runs(label: np.ndarray) -> np.ndarray:
    held = label >= 0
    first = held.copy()
    first[:, :, 1:] &= ~held[:, :, :-1]
    out, places = np.full(label.shape, -1, dtype=label.dtype), np.flatnonzero(held)
    if places.size:
        starts = np.flatnonzero(first.ravel()[places])
        least = np.minimum.reduceat(label.ravel()[places], starts)
        out.ravel()[places] = np.repeat(least, np.diff(np.append(starts, places.size)))
    return out


def _blocks(array: pa.Array, height: int, width: int):
    """Which rows hold whole images, and these as blocks (rows, images)."""
    lengths = array.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == height * width)
    if array.flatten().null_count:
        rows = np.array([i for i in rows if array[int(i)].values.null_count == 0], dtype=np.int64)
    step = max(1, CELLS // (height * width))
    for at in range(0, rows.size, step):
        part = rows[at : at + step]
        yield part, array.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width)


def _by_image(types: dict[str, pa.DataType], height: int, width: int, reads):
    """An Arrow function of ``reads(images) -> {field: values}`` over blocks; values that are masked become null."""
    if height < 2 or width < 2:
        raise ValueError("an image has two rows and two columns at least")
    kind = pa.struct(list(types.items()))
    names = {pa.int32(): "int", pa.bool_(): "boolean", pa.float64(): "double"}

    @F.arrow_udf("struct<" + ",".join(f"{n}:{names[t]}" for n, t in types.items()) + ">")
    def run(images: pa.Array) -> pa.Array:
        order, parts = [], []
        for rows, block in _blocks(images, height, width):
            found = reads(block)
            columns = [pa.array(np.ma.getdata(found[n]), t, mask=np.ma.getmaskarray(found[n])) for n, t in types.items()]
            order.append(rows)
            parts.append(pa.StructArray.from_arrays(columns, names=list(types)))
        if not parts:
            return pa.nulls(len(images), kind)
        place = np.full(len(images), -1)
        place[np.concatenate(order)] = np.arange(sum(map(len, order)))
        return pa.concat_arrays(parts).take(pa.array(place, mask=place < 0))

    return run


def mask_statistics(mask: Column, height: int, width: int) -> Column:
    """cells, the box (x0, y0, x1, y1; ends exclusive), components, largest (cells of the largest one), at_edge.

    An empty mask has no box.
    """
    number = pa.int32()
    types = {n: number for n in ("cells", "x0", "y0", "x1", "y1", "components", "largest")} | {"at_edge": pa.bool_()}

    def reads(m):
        down, across, cells = m.any(2), m.any(1), m.sum((1, 2))
        none = cells == 0
        box = {"x0": across.argmax(1), "y0": down.argmax(1), "x1": width - across[:, ::-1].argmax(1), "y1": height - down[:, ::-1].argmax(1)}
        label = components(m)
        counts = np.bincount(label[label >= 0], minlength=m.size).reshape(len(m), -1)
        return {
            "cells": cells, **{n: np.ma.masked_array(v, none) for n, v in box.items()}, "components": (counts > 0).sum(1), "largest": counts.max(1),
            "at_edge": down[:, 0] | down[:, -1] | across[:, 0] | across[:, -1],
        }

    return _by_image(types, height, width, reads)(mask)


def fill_naturalness(image: Column, mask: Column, height: int, width: int, inner: int = 3, outer: int = 10) -> Column:
    """How a filled region differs from what surrounds it: lum_step, the distance of the means in the mask and in a ring
    around it, and texture_ratio, the mean slope in the mask over that in the ring.

    The ring lies between ``inner`` and ``outer`` cells from the mask. An empty mask gives 0 and 1, one without a ring
    nulls; a ring without texture counts as 1e-6.
    """
    types = {"lum_step": pa.float64(), "texture_ratio": pa.float64()}

    def reads(both):
        lum, m = both[:, :height].astype(np.float64), both[:, height:] > 0
        ring = dilate(m, outer) & ~dilate(m, inner)
        inside, around, steep = m.sum((1, 2)), ring.sum((1, 2)), slope(lum)
        none, bare = inside == 0, (around == 0) & (inside > 0)
        mean = lambda v, at, n: np.where(at, v, 0.0).sum((1, 2)) / np.maximum(n, 1)
        step = np.abs(mean(lum, m, inside) - mean(lum, ring, around))
        ratio = mean(steep, m, inside) / np.maximum(mean(steep, ring, around), 1e-6)
        return {"lum_step": np.ma.masked_array(np.where(none, 0.0, step), bare), "texture_ratio": np.ma.masked_array(np.where(none, 1.0, ratio), bare)}

    # image and mask travel as one array, the mask's rows below the image's
    fits = (F.size(image) == height * width) & (F.size(mask) == height * width)
    both = F.when(fits, F.concat(F.transform(image, lambda v: v.cast("double")), F.transform(mask, lambda v: v.cast("double"))))
    return _by_image(types, 2 * height, width, reads)(both)
