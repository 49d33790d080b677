"""The codec, by exact round trips; a small writer here uses every feature that the decoder must undo."""

import numpy as np
import pytest

from episodica.llm import media, webp

from .helpers import docs, rows_of


def codes_of(counts, limit=15):
    lengths = webp.code_lengths(np.asarray(counts), limit)
    return lengths, webp.canonical(lengths)


class Writer(webp.BitWriter):
    """Entropy-coded images from a list of tokens: ('lit', argb), ('copy', length, distance code) or ('cache', index)."""

    def prefixed(self, value, lengths, codes, base):
        symbol, extra, bits = self.prefix(value)
        self.symbol(base + symbol, lengths, codes)
        self.put(extra, bits)

    @staticmethod
    def prefix(value):
        v = value - 1
        if v < 4:
            return v, 0, 0
        high = v.bit_length() - 1
        second = v >> (high - 1) & 1
        return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1

    def symbol(self, s, lengths, codes):
        if np.count_nonzero(lengths) > 1:
            self.put(int(codes[s]), int(lengths[s]))

    def image(self, tokens, cache_bits=0, main=True, groups=None, width=None):
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        pick = lambda at: 0
        n_groups = 1
        if main:
            self.put(1 if groups else 0, 1)
        if groups:
            block, table = groups
            self.put(block - 2, 3)
            self.image([("lit", g << 8) for g in table.reshape(-1).tolist()], main=False)
            pick = lambda at: int(table[(at // width) >> block, (at % width) >> block])
            n_groups = int(table.max()) + 1
        size = (1 << cache_bits) if cache_bits else 0
        counts = [[np.zeros(280 + size, int), *[np.zeros(256, int) for _ in range(3)], np.zeros(40, int)] for _ in range(n_groups)]
        plan, at = [], 0
        for t in tokens:
            c = counts[pick(at)]
            if t[0] == "lit":
                a, r, g, b = t[1] >> 24, t[1] >> 16 & 255, t[1] >> 8 & 255, t[1] & 255
                for k, s in ((0, g), (1, r), (2, b), (3, a)):
                    c[k][s] += 1
                plan.append((at, "lit", (g, r, b, a)))
                at += 1
            elif t[0] == "copy":
                c[0][256 + self.prefix(t[1])[0]] += 1
                c[4][self.prefix(t[2])[0]] += 1
                plan.append((at, "copy", t[1:]))
                at += t[1]
            else:
                c[0][280 + t[1]] += 1
                plan.append((at, "cache", t[1]))
                at += 1
        tables = []
        for c in counts:
            row = []
            for k in c:
                if not k.any():
                    k[0] = 1
                pair = codes_of(k)
                self.put_code(pair[0])
                row.append(pair)
            tables.append(row)
        for at, kind, value in plan:
            t = tables[pick(at)]
            if kind == "lit":
                for k, s in enumerate(value):
                    self.symbol(s, *t[k])
            elif kind == "copy":
                self.prefixed(value[0], *t[0], 256)
                self.prefixed(value[1], *t[4], 0)
            else:
                self.symbol(280 + value, *t[0])


def start(width, height, alpha=1):
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(alpha, 1)
    w.put(0, 3)
    return w


def argb(pixels):
    p = pixels.astype(np.int64)
    return (p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]).reshape(-1)


def random_image(h, w, seed, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        table = rng.integers(0, 256, (colours, 4))
        return table[rng.integers(0, colours, (h, w))].astype(np.uint8)
    smooth = np.cumsum(rng.integers(-3, 4, (h, w, 4)), axis=1) + 128
    return np.clip(smooth, 0, 255).astype(np.uint8)


def test_literals_and_groups():
    img = random_image(9, 13, 1)
    w = start(13, 9)
    w.put(0, 1)
    groups = np.array([[0, 1, 1, 0], [1, 0, 2, 2], [2, 0, 1, 0]])
    w.image([("lit", int(v)) for v in argb(img)], groups=(2, groups), width=13)
    assert (webp.decode(webp.riff(w.tobytes()))[0] == img).all()


def test_back_references_and_colour_cache():
    rng = np.random.default_rng(2)
    width, height, bits = 17, 20, 3
    flat, tokens, cache = [], [], [0] * (1 << bits)

    def push(v):
        flat.append(v)
        cache[(v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - bits)] = v

    while len(flat) < width * height:
        kind, left = rng.integers(0, 4), width * height - len(flat)
        if kind == 0 and len(flat) > 20:
            near = int(rng.integers(1, 121))
            x, y = webp.NEAR[near - 1]
            back = max(1, x + y * width)
            code = near
            if back > len(flat) or rng.random() < 0.5:
                back = int(rng.integers(1, len(flat) + 1))
                code = back + 120
            n = int(min(left, rng.integers(1, 40)))
            tokens.append(("copy", n, code))
            for _ in range(n):
                push(flat[len(flat) - back])
        elif kind == 1 and flat:
            slot = int(rng.integers(0, 1 << bits))
            tokens.append(("cache", slot))
            push(cache[slot])
        else:
            v = int(rng.integers(0, 1 << 32))
            tokens.append(("lit", v))
            push(v)
    w = start(width, height)
    w.put(0, 1)
    w.image(tokens, cache_bits=bits)
    got = webp.decode(webp.riff(w.tobytes()))[0]
    assert argb(got).tolist() == flat


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    img = random_image(11, 10, 30 + mode)
    h, width = img.shape[:2]
    p = img.astype(int)[..., [2, 1, 0, 3]]
    res = np.zeros_like(p)
    for y in range(h):
        for x in range(width):
            if y == 0 and x == 0:
                want = [0, 0, 0, 255]
            elif y == 0:
                want = p[y, x - 1]
            elif x == 0:
                want = p[y - 1, x]
            else:
                left, top, corner = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
                right = p[y - 1, x + 1] if x + 1 < width else p[y, 0]
                half = lambda a, b: (a + b) // 2
                if mode == 11:
                    guess = left + top - corner
                    want = left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
                elif mode == 13:
                    mean = half(left, top)
                    want = np.clip(mean + np.trunc((mean - corner) / 2).astype(int), 0, 255)
                else:
                    want = {
                        0: np.array([0, 0, 0, 255]), 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top),
                        8: half(corner, top), 9: half(top, right), 10: half(half(left, corner), half(top, right)), 12: np.clip(left + top - corner, 0, 255),
                    }[mode]
            res[y, x] = (p[y, x] - want) & 255
    w = start(width, h)
    w.put(1, 1)
    w.put(0, 2)
    w.put(0, 3)
    w.image([("lit", mode << 8)] * (-(-width // 4) * -(-h // 4)), main=False)
    w.put(0, 1)
    w.image([("lit", int(v)) for v in argb(res[..., [2, 1, 0, 3]])])
    assert (webp.decode(webp.riff(w.tobytes()))[0] == img).all()


def test_cross_colour_and_subtract_green():
    img = random_image(10, 9, 5)
    h, width = img.shape[:2]
    rng = np.random.default_rng(6)
    table = rng.integers(0, 256, (3, 3, 3))  # red to blue, green to blue, green to red
    signed = lambda v: (int(v) + 128) % 256 - 128
    out = img.astype(int).copy()
    out[..., 0] = (out[..., 0] - out[..., 1]) & 255
    out[..., 2] = (out[..., 2] - out[..., 1]) & 255
    coded = out.copy()
    for y in range(h):
        for x in range(width):
            rb, gb, gr = table[y >> 2, x >> 2]
            r, g, b = out[y, x, :3]
            coded[y, x, 0] = (r - (signed(gr) * signed(g) >> 5)) & 255
            coded[y, x, 2] = (b - (signed(gb) * signed(g) >> 5) - (signed(rb) * signed(r) >> 5)) & 255
    w = start(width, h)
    w.put(1, 1)
    w.put(2, 2)
    w.put(1, 1)
    w.put(1, 2)
    w.put(0, 3)
    w.image([("lit", 255 << 24 | int(a) << 16 | int(b) << 8 | int(c)) for a, b, c in table.reshape(-1, 3)], main=False)
    w.put(0, 1)
    w.image([("lit", int(v)) for v in argb(coded)])
    assert (webp.decode(webp.riff(w.tobytes()))[0] == img).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 40, 256])
def test_palette(colours):
    img = random_image(6, 11, colours, colours)
    flat = argb(img)
    palette, index = np.unique(flat, return_inverse=True)
    size = len(palette)
    bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    index = index.reshape(6, 11)
    packed = -(-11 // (1 << bits))
    wide = np.zeros((6, packed << bits), int)
    wide[:, :11] = index
    rows = (wide.reshape(6, packed, 1 << bits) << (np.arange(1 << bits) * (8 >> bits))).sum(axis=2)
    parts = np.stack([palette >> s & 255 for s in (24, 16, 8, 0)])
    steps = np.diff(np.concatenate([np.zeros((4, 1), int), parts], axis=1), axis=1) & 255
    w = start(11, 6)
    w.put(1, 1)
    w.put(3, 2)
    w.put(size - 1, 8)
    w.image([("lit", int(a << 24 | r << 16 | g << 8 | b)) for a, r, g, b in steps.T], main=False)
    w.put(0, 1)
    w.image([("lit", int(v) << 8) for v in rows.reshape(-1)])
    assert (webp.decode(webp.riff(w.tobytes()))[0] == img).all()


def test_broken_streams_are_refused():
    good = media.to_media(media.payload_of("some text, long enough to be coded")[0])
    for bad in (b"RIFF", good[:-9], b"x" + good[1:], good[:20] + b"\xff" + good[21:]):
        with pytest.raises(webp.WebpError):
            media.from_media(bad)


def test_media_column(spark):
    texts = [None, "", "a", "a", "x" * 64, "é" * 50_000, "ab\n" * 500_000, "".join(chr(32 + i % 90) for i in range(5000))]
    got = sorted(rows_of(media.load(media.store(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])))), key=lambda r: r["doc_id"])
    import hashlib
    import zlib

    for r, text in zip(got, texts, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [{k: v for k, v in r.items() if k != "doc_id"} for r in got]
    assert same[0] == same[1] and same[2] == same[3]
    assert rows_of(media.load(media.store(docs(spark, [])))) == []


def test_pixel_arrays(spark):
    """What is stored comes back as pixel arrays, and so do images of colours, transforms and back-references."""
    texts = ["", "some text", "ab" * 400]
    stored = media.store(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    got = {r["doc_id"]: r for r in rows_of(media.pixels(stored))}
    for i, text in enumerate(texts):
        image = np.frombuffer(got[i]["pixels"], np.uint8).reshape(got[i]["height"], got[i]["width"], 4)
        assert image[..., 1].tobytes() == media.payload_of(text)[0] and (image[..., 3] == 255).all() and got[i]["image"] == 0
    two = media.to_media(media.payload_of("x")[0]) * 2
    rows = spark.createDataFrame([(1, two), (2, None)], "doc_id long, media binary")
    assert [(r["doc_id"], r["image"], r["width"], r["height"]) for r in rows_of(media.pixels(rows))] == [(1, 0, 64, 1), (1, 1, 64, 1)]
