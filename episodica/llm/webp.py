"""Lossless WebP (VP8L in a RIFF container): a full decoder and a literal-only grey encoder, both on numpy.

The decoder handles prefix codes (simple and coded, with several groups), back-references, the colour cache and all four
transforms (predictor, cross-colour, subtract-green, palette with packed pixels). Where only the green channel has more
than one symbol and nothing refers back, code lengths are looked up for every bit at once and one walk over the bits
finds the codes; any other stream is read symbol by symbol.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

MAX_SIDE = 1 << 14
MAX_CODE = 15
#: Order in which the lengths of the code-length code are stored (fixed by the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Near places of a back-reference by distance code: by distance, then by |x|, right before left.
NEAR = sorted(
    [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0],
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)
NEAR = [p for p in NEAR if not (p[0] < 0 and p[1] == 0)]
_REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << MAX_CODE)], dtype=np.int64)


class WebpError(ValueError):
    """The stream breaks the format."""


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, limit: int = MAX_CODE) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits; a lone symbol gets length 1."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(symbols) == 1:
        lengths[symbols] = 1
        return lengths
    weights = counts[symbols].astype(np.int64)
    while True:
        parent = [0] * (2 * len(symbols) - 1)
        heap = [(w, i) for i, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        for k in range(len(symbols), 2 * len(symbols) - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = k
            heapq.heapreplace(heap, (a + b, k))
        depth = [0] * len(parent)
        for k in range(len(parent) - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        got = depth[: len(symbols)]
        if max(got) <= limit:
            lengths[symbols] = got
            return lengths
        weights = (weights + 1) // 2


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their first bit lowest, as the stream is read."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[used]
    steps = np.int64(1) << (MAX_CODE - n)  # canonical codes are consecutive when padded to 15 bits
    starts = np.concatenate([[0], np.cumsum(steps)[:-1]])
    codes[used] = _REVERSED[starts]
    return codes


class _Code:
    """A prefix code by table: for the next ``width`` bits, the symbol and the bits it takes."""

    __slots__ = ("symbols", "lengths", "single", "mask")

    def __init__(self, lengths: np.ndarray | None, single: int = -1):
        self.single, self.symbols, self.lengths, self.mask = single, None, None, 0
        if lengths is None:
            return
        used = np.flatnonzero(lengths)
        if not len(used):
            raise WebpError("a prefix code has no symbol")
        if len(used) == 1:
            self.single = int(used[0])
            return
        n = lengths[used]
        order = np.argsort(n, kind="stable")
        used, n = used[order], n[order]
        width = int(n[-1])
        steps = np.int64(1) << (width - n)
        if steps.sum() != 1 << width:
            raise WebpError("a prefix code is not complete")
        turned = _REVERSED[: 1 << width] >> (MAX_CODE - width)
        self.mask = (1 << width) - 1
        self.symbols = np.repeat(used.astype(np.int16), steps)[turned]
        self.lengths = np.repeat(n.astype(np.uint8), steps)[turned]


# ---------------------------------------------------------------- reading


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0
        self.end = 8 * len(data)

    def peek(self) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 4], "little") >> (self.at & 7)) & 0x7FFF

    def read(self, n: int) -> int:
        if not n:
            return 0
        byte = self.at >> 3
        value = (int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise WebpError("the stream ends early")
        return value

    def symbol(self, code: _Code) -> int:
        if code.single >= 0:
            return code.single
        window = self.peek() & code.mask
        self.at += int(code.lengths[window])
        if self.at > self.end:
            raise WebpError("the stream ends early")
        return int(code.symbols[window])


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    if bits.read(1):  # simple
        two, wide = bits.read(1), bits.read(1)
        chosen = [bits.read(8 if wide else 1)]
        if two:
            chosen.append(bits.read(8))
        if max(chosen) >= alphabet:
            raise WebpError("a symbol lies outside its alphabet")
        if len(chosen) == 1:
            return _Code(None, chosen[0])
        lengths = np.zeros(alphabet, np.int64)
        lengths[chosen] = 1
        return _Code(lengths)
    first = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        first[LENGTH_ORDER[k]] = bits.read(3)
    code = _Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    out: list[int] = []
    last = 8
    if code.single >= 0:
        symbols, sizes, mask = [code.single], [0], 0
    else:
        symbols, sizes, mask = code.symbols.tolist(), code.lengths.tolist(), code.mask
    data, byte = bits.data, bits.at >> 3  # the loop keeps at least 14 bits at hand
    have, n = int.from_bytes(data[byte : byte + 8], "little") >> (bits.at & 7), 64 - (bits.at & 7)
    byte += 8
    while len(out) < alphabet and left > 0:
        left -= 1
        if n < 14:
            have |= int.from_bytes(data[byte : byte + 8], "little") << n
            byte += 8
            n += 64
        window = have & mask
        s = symbols[window]
        have >>= sizes[window]
        n -= sizes[window]
        if s < 16:
            out.append(s)
            last = s or last
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            out += [last if s == 16 else 0] * (least + (have & ((1 << extra) - 1)))
            have >>= extra
            n -= extra
    bits.at = 8 * byte - n
    if bits.at > bits.end:
        raise WebpError("the stream ends early")
    if len(out) > alphabet:
        raise WebpError("too many code lengths")
    return _Code(np.asarray(out, np.int64))


def _prefix_value(bits: _Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


_EIGHT = np.arange(8, dtype=np.uint32)


def _literal_greens(bits: _Bits, code: _Code, n: int) -> np.ndarray:
    """``n`` symbols of one code in a row.

    The length of a code is looked up at every bit, then that of four codes in a row, and one walk finds every fourth.
    """
    start, offset = bits.at >> 3, bits.at & 7
    raw = np.frombuffer(bits.data, np.uint8)
    out = []
    mask, widest = np.uint32(code.mask), code.mask.bit_length()
    chunk = 1 << 18  # symbols a pass, so that tables stay small for long images
    while n:
        some = min(n, chunk)
        span = raw[start : start + (some * widest + offset) // 8 + 8].astype(np.uint32)
        window = span[:-2] | span[1:-1] << np.uint32(8) | span[2:] << np.uint32(16)
        one = np.zeros(8 * len(window) + 4 * MAX_CODE, np.uint8)
        at = np.arange(8 * len(window), dtype=np.int32)
        one[: len(at)] = code.lengths[(window[:, None] >> _EIGHT) & mask].reshape(-1)
        two = one.copy()
        two[: len(at)] += one[at + one[: len(at)]]
        four = two.copy()
        four[: len(at)] += two[at + two[: len(at)]]
        step, p, places = four.tobytes(), offset, []
        put, more = places.append, -(-some // 4)
        try:
            for _ in range(more):
                put(p)
                p += step[p]
        except IndexError:
            raise WebpError("the stream ends early") from None
        at = np.empty((more, 4), np.int32)
        at[:, 0] = places
        for k in (1, 2, 3):
            at[:, k] = at[:, k - 1] + one[np.minimum(at[:, k - 1], len(one) - 1)]
        at = at.reshape(-1)[:some]
        if at[-1] >= 8 * len(window):
            raise WebpError("the stream ends early")
        found = (window[at >> 3] >> (at & 7).astype(np.uint32)) & mask
        out.append(code.symbols[found])
        p = int(at[-1]) + int(code.lengths[found[-1]])
        start, offset, n = start + (p >> 3), p & 7, n - some
    bits.at = 8 * start + offset
    if bits.at > bits.end:
        raise WebpError("the stream ends early")
    return np.concatenate(out)


def _read_pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise WebpError("colour cache of a wrong size")
    groups, group_of, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width // (1 << block))
        meta = _read_pixels(bits, across, -(-height // (1 << block)), False)
        group_of = ((meta >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64).reshape(-1, across)
        groups = int(group_of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, a) for a in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    green, red, blue, alpha, _ = codes[0]
    if groups == 1 and not cache_bits and min(red.single, blue.single, alpha.single) >= 0:
        rest = np.uint32(alpha.single << 24 | red.single << 16 | blue.single)
        if green.single >= 0 and green.single < 256:
            return np.full(n, rest | np.uint32(green.single << 8), np.uint32)
        if green.single < 0 and int(green.symbols.max()) < 256:
            return rest | _literal_greens(bits, green, n).astype(np.uint32) << np.uint32(8)
    out = [0] * n
    cache = [0] * cache_size
    shift, at, fresh = 32 - cache_bits, 0, 0
    symbol = bits.symbol
    while at < n:
        if group_of is not None:
            green, red, blue, alpha, distance = codes[group_of[(at // width) >> block, (at % width) >> block]]
        else:
            distance = codes[0][4]
        s = symbol(green)
        if s < 256:
            r, b = symbol(red), symbol(blue)
            out[at] = symbol(alpha) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = _prefix_value(bits, s - 256)
            code = _prefix_value(bits, symbol(distance))
            if code > 120:
                back = code - 120
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * width)
            if back > at or at + length > n:
                raise WebpError("a back-reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - back]
            at += length
        else:
            while fresh < at:  # the cache takes pixels up to here first
                cache[(out[fresh] * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = out[fresh]
                fresh += 1
            if s - 280 >= cache_size:
                raise WebpError("no such colour in the cache")
            out[at] = cache[s - 280]
            at += 1
    return np.asarray(out, dtype=np.uint32)


# ---------------------------------------------------------------- transforms


def _channels(pixels: np.ndarray) -> np.ndarray:
    """uint32 ARGB -> uint8 with a last axis of blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _predict(mode: int, left, top, corner, right) -> list[int]:
    def half(a, b):
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    def clamp(v):
        return 0 if v < 0 else 255 if v > 255 else v

    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode <= 9:
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    mean = half(left, top)
    # the quotient is rounded towards zero
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]


def undo_predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, block: int) -> np.ndarray:
    rows = _channels(pixels.reshape(height, width)).astype(np.int64)
    rows[0, 0] = (rows[0, 0] + [0, 0, 0, 255]) & 255
    rows[0] = np.cumsum(rows[0], axis=0) & 255
    rows[:, 0] = np.cumsum(rows[:, 0], axis=0) & 255
    if width == 1:
        return _pixels(rows)
    for y in range(1, height):
        kinds = modes[y >> block]
        of = np.repeat(kinds, 1 << block)[:width]
        up = rows[y - 1]
        if (kinds == kinds[0]).all() and kinds[0] in (0, 2, 4):  # these need the row above at most
            base = (np.array([0, 0, 0, 255]), None, up[1:], None, up[:-1])[kinds[0]]
            rows[y, 1:] = (rows[y, 1:] + base) & 255
            continue
        if (kinds == 1).all():
            rows[y] = np.cumsum(rows[y], axis=0) & 255
            continue
        above, row = up.tolist(), rows[y].tolist()
        above.append(row[0])  # right of the last pixel comes the first of this row
        for x in range(1, width):
            got = _predict(int(of[x]), row[x - 1], above[x], above[x - 1], above[x + 1])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], got, strict=True)]
        rows[y] = row
    return _pixels(rows)


def _pixels(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).reshape(-1, 4).view("<u4").reshape(-1).astype(np.uint32)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, table: np.ndarray, block: int) -> np.ndarray:
    parts = _channels(pixels.reshape(height, width)).astype(np.int64)
    of = np.repeat(np.repeat(table, 1 << block, axis=0)[:height], 1 << block, axis=1)[:, :width]
    multipliers = _channels(of).view(np.int8).astype(np.int64)  # green to red, green to blue, red to blue
    green = parts[..., 1].astype(np.uint8).view(np.int8).astype(np.int64)
    red = (parts[..., 2] + ((multipliers[..., 0] * green) >> 5)) & 255
    signed_red = red.astype(np.uint8).view(np.int8).astype(np.int64)
    parts[..., 0] = (parts[..., 0] + ((multipliers[..., 1] * green) >> 5) + ((multipliers[..., 2] * signed_red) >> 5)) & 255
    parts[..., 2] = red
    return _pixels(parts)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(0xFF)
    low = (pixels & np.uint32(0x00FF00FF)) + green + (green << np.uint32(16))
    return (pixels & np.uint32(0xFF00FF00)) | (low & np.uint32(0x00FF00FF))


def undo_palette(pixels: np.ndarray, packed: int, width: int, height: int, palette: np.ndarray, bits: int) -> np.ndarray:
    index = ((pixels >> np.uint32(8)) & np.uint32(0xFF)).reshape(height, packed)
    if bits:
        each = 8 >> bits
        shifts = np.arange(1 << bits, dtype=np.uint32) * np.uint32(each)
        index = ((index[..., None] >> shifts) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)  # an index beyond the palette is transparent black
    full[: len(palette)] = palette
    return full[index].reshape(-1)


# ---------------------------------------------------------------- images


def decode_vp8l(data: bytes) -> np.ndarray:
    """A VP8L stream as uint8 pixels of height x width x (red, green, blue, alpha)."""
    bits = _Bits(data)
    if bits.read(8) != 0x2F:
        raise WebpError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha_used, version = bits.read(1), bits.read(3)
    if version:
        raise WebpError("unknown version")
    undo, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            across = -(-inner // (1 << block))
            table = _read_pixels(bits, across, -(-height // (1 << block)), False).reshape(-1, across)
            if kind == 0:
                modes = ((table >> np.uint32(8)) & np.uint32(15)).astype(np.int64)
                undo.append(lambda p, w=inner, m=modes, b=block: undo_predictor(p, w, height, m, b))
            else:
                undo.append(lambda p, w=inner, t=table, b=block: undo_cross_colour(p, w, height, t, b))
        elif kind == 2:
            undo.append(undo_subtract_green)
        else:
            size = bits.read(8) + 1
            steps = _channels(_read_pixels(bits, size, 1, False))
            palette = _pixels(np.cumsum(steps.astype(np.int64), axis=0) & 255)
            packing = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            outer, inner = inner, -(-inner // (1 << packing))
            undo.append(lambda p, i=inner, w=outer, t=palette, b=packing: undo_palette(p, i, w, height, t, b))
    pixels = _read_pixels(bits, inner, height, True)
    for step in reversed(undo):
        pixels = step(pixels)
    channels = _channels(pixels.reshape(height, width))[..., [2, 1, 0, 3]]
    if not alpha_used:
        channels[..., 3] = 255
    return channels


def decode(data: bytes) -> list[np.ndarray]:
    """The pixels of each image in one or more WebP files laid end to end."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise WebpError("not a WebP file")
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        if end > len(data):
            raise WebpError("the file ends early")
        at += 12
        while at < end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"VP8L":
                out.append(decode_vp8l(data[at + 8 : at + 8 + size]))
            at += 8 + size + (size & 1)
        at = end
    return out


# ---------------------------------------------------------------- writing


class BitWriter:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def put_code(self, lengths: np.ndarray) -> None:
        """A prefix code in its coded form, or the simple one for a lone symbol."""
        used = np.flatnonzero(lengths)
        if len(used) == 1 and used[0] < 256:
            self.put(0b101 | int(used[0]) << 3, 11)
            return
        self.put(0, 1)
        items: list[tuple[int, int, int]] = []  # symbol, extra, bits of extra
        last = -1
        for symbol, n in zip(used.tolist(), lengths[used].tolist(), strict=True):
            gap, last = symbol - last - 1, symbol
            while gap >= 3:
                run = min(gap, 138)
                items.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
                gap -= run
            items += [(0, 0, 0)] * gap
            items.append((n, 0, 0))
        if len(items) == 1:
            items.append((0, 0, 0))
        counts = np.bincount([s for s, _, _ in items], minlength=19)
        first = code_lengths(counts, 7)
        stored = first[list(LENGTH_ORDER)].tolist()
        n = max(4, max(k for k, v in enumerate(stored) if v) + 1)
        self.put(n - 4, 4)
        for v in stored[:n]:
            self.put(v, 3)
        if len(items) == len(lengths):
            self.put(0, 1)
        else:
            self.put(1, 1)
            width = max(1, (len(items) - 2).bit_length())
            half = -(-(width - 2) // 2) if width > 2 else 0
            self.put(half, 3)
            self.put(len(items) - 2, 2 + 2 * half)
        codes, sizes = canonical(first).tolist(), first.tolist()
        if np.count_nonzero(first) == 1:
            codes = sizes = [0] * 19
        value, size = 0, 0
        for s, extra, width in items:
            value |= (codes[s] | extra << sizes[s]) << size
            size += sizes[s] + width
        self.put(value, size)

    def tobytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


def _packed(codes: np.ndarray, lengths: np.ndarray, offset: int) -> np.ndarray:
    """Codes laid bit after bit from bit ``offset``, as bytes."""
    ends = np.cumsum(lengths) + offset
    starts = ends - lengths
    shifted = codes << (starts & 7)
    byte, size = starts >> 3, int(ends[-1] + 7 >> 3)
    out = np.bincount(byte, weights=shifted & 255, minlength=size + 2)
    out[1:] += np.bincount(byte, weights=(shifted >> 8) & 255, minlength=size + 1)[: size + 1]
    out[2:] += np.bincount(byte, weights=shifted >> 16, minlength=size)[:size]
    return out[:size].astype(np.uint8)


def riff(vp8l: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(vp8l)) + vp8l + b"\0" * (len(vp8l) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode_grey(samples: np.ndarray) -> bytes:
    """8-bit samples (height x width) as a lossless grey WebP: subtract-green leaves one channel, coded by its counts."""
    height, width = samples.shape
    if max(height, width) > MAX_SIDE:
        raise WebpError("the image is too large")
    flat = samples.reshape(-1)
    lengths = np.zeros(280, np.int64)
    lengths[:256] = code_lengths(np.bincount(flat, minlength=256))
    bits = BitWriter()
    bits.put(0x2F, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(0, 4)  # no alpha, version 0
    bits.put(1, 1)
    bits.put(2, 2)  # subtract-green
    bits.put(0, 1)  # no further transform
    bits.put(0, 2)  # no colour cache, one group
    bits.put_code(lengths)
    for symbol in (0, 0, 255, 0):  # red, blue, alpha, distance: one symbol each
        bits.put(0b101 | symbol << 3, 11)
    if np.count_nonzero(lengths) == 1:
        return riff(bits.tobytes())
    head = np.frombuffer(bits.tobytes(), np.uint8)
    body = _packed(canonical(lengths)[flat], lengths[flat], bits.size & 7)
    if bits.size & 7:
        body[0] |= head[-1]
        head = head[:-1]
    return riff(head.tobytes() + body.tobytes())
