"""Media columns through every tool of the format: streams spelled out by hand, texts whose cheapest way takes each tool, and reading
many images side by side."""

import base64
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparloom.llm import media, webp


class Bits:
    """A stream spelled out value by value, first bit lowest."""

    def __init__(self, width, height):
        self.value, self.n = 0, 0
        self.add((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3))

    def add(self, *pairs):
        for v, n in pairs:
            self.value |= v << self.n
            self.n += n
        return self

    def code(self, *symbols):
        """A simple code of one or two symbols of 8 bits."""
        return self.add((1, 1), (len(symbols) - 1, 1), (1, 1), *[(s, 8) for s in symbols])

    def done(self):
        return self.value.to_bytes(-(-self.n // 8), "little")


def argb(data):
    return webp.read_image(data).tolist()


def read_both(data):
    """Rows of pixels by the reader of one image and by that of many."""
    one = argb(data)
    assert [p.tolist() for p in webp.read_images([data] * 40)] == [one] * 40
    return one


def test_a_published_file():
    assert argb(webp.unwrap(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))[0]) == [[0]]


def test_literals_by_hand():
    b = Bits(2, 1).add((0, 1), (0, 1), (0, 1))  # no transform, cache or groups
    b.code(0x10, 0x90).code(0x20).code(0x30).code(0xFF).code(0)
    b.add((1, 1), (0, 1))
    assert read_both(b.done()) == [[0xFF209030, 0xFF201030]]


def lengths(b, size_symbols, tokens):
    """A code told by lengths, each of 0 to 5, whose own code has 3 bits for each of 0, 1, 2, 3, 4, 5, 17 and 18."""
    order = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
    kinds = [0, 1, 2, 3, 4, 5, 17, 18]
    b.add((0, 1), (4, 4), *[(3 if s in kinds else 0, 3) for s in order[:8]], (1, 1), (1, 3), (len(tokens) - 2, 4))
    for symbol, *extra in tokens:
        k = kinds.index(symbol)
        b.add((int(f"{k:03b}"[::-1], 2), 3))
        if extra:
            b.add((extra[0], 3 if symbol == 17 else 7))
    return b


def test_reference_by_hand():
    b = Bits(8, 1).add((0, 1), (0, 1), (0, 1))
    # Green: literals 0 and 1, and length prefixes 256 + 3 (4 pixels) and 256 + 4 (5 or 6): lengths 2 each.
    lengths(b, 280, [(2,), (2,), (18, 127), (18, 108), (2,), (2,)])
    b.code(7).code(9).code(255).code(1)  # distance prefix 1 is code 2: the pixel before
    b.add((0, 1), (0, 1))  # 0
    b.add((1, 1), (1, 1), (0, 1))  # 11: prefix 4, one extra bit: 5 pixels
    b.add((0, 1), (1, 1))  # 01: 1
    b.add((0, 1), (0, 1))
    zero, one = 0xFF070009, 0xFF070109
    assert read_both(b.done()) == [[zero] * 6 + [one, zero]]


def test_cache_by_hand():
    colour = 0xFF070309
    key = (0x1E35A7BD * colour & 0xFFFFFFFF) >> 31
    b = Bits(4, 1).add((0, 1), (1, 1), (1, 4), (0, 1))  # a cache of two colours
    # Green: symbol 3 and the key's symbol, 280 + key, lengths 1 each; 200 and some zeros between them.
    tokens = [(17, 0), (1,), (18, 89), (18, 89), (18, 280 + key - 4 - 200 - 11), (1,)]
    lengths(b, 282, tokens)
    b.code(7).code(9).code(255).code(0)
    b.add((0, 1), (1, 1), (1, 1), (0, 1))
    assert read_both(b.done()) == [[colour] * 4]


def test_transforms_by_hand():
    green = Bits(1, 1).add((1, 1), (2, 2), (0, 1), (0, 1), (0, 1)).code(0x40).code(0xF0).code(0x02).code(0xFF).code(0)
    assert read_both(green.done()) == [[0xFF304042]]
    tile = lambda b, *codes: [b.add((0, 1)), *[b.code(c) for c in codes]]
    left = Bits(3, 2).add((1, 1), (0, 2), (0, 3))  # predictor, tiles of 4
    tile(left, 1, 0, 0, 255, 0)  # mode 1
    left.add((0, 1), (0, 1), (0, 1)).code(2).code(1).code(0).code(0).code(0)
    assert read_both(left.done()) == [[0xFF010200, 0xFF020400, 0xFF030600], [0xFF020400, 0xFF030600, 0xFF040800]]
    cross = Bits(1, 1).add((1, 1), (1, 2), (0, 3))
    tile(cross, 32, 16, 64, 255, 0)  # green to blue 32, red to blue 16, green to red 64
    cross.add((0, 1), (0, 1), (0, 1)).code(10).code(5).code(1).code(255).code(0)
    assert read_both(cross.done()) == [[0xFF000000 | (5 + 20) << 16 | 10 << 8 | 1 + 10 + 12]]
    few = Bits(5, 1).add((1, 1), (3, 2), (2, 8))  # a palette of three: two bits for each pixel
    few.add((0, 1)).code(0, 1).code(9).code(0).code(0, 255).code(0)
    for g, a in ((0, 1), (1, 0), (1, 0)):
        few.add((g, 1), (a, 1))
    few.add((0, 1), (0, 1), (0, 1)).code(0b10_01_00_01, 0b10).code(0).code(0).code(255).code(0)
    few.add((1, 1), (0, 1))
    colours = [0xFF090000, 0xFF120100, 0xFF1B0200]
    assert read_both(few.done()) == [[colours[i] for i in (1, 0, 1, 2, 2)]]


def first_transform(stream):
    r = webp.Reader(stream, 40)
    return r.bits(2) if r.bits(1) else None


def walk(rng, n, step):
    """Texts whose four channels walk by small steps."""
    at, out = [64, 70, 80, 90], []
    for _ in range(n):
        at = [min(max(a + rng.randint(-step, step), 33), 126) for a in at]
        out.append("".join(map(chr, at)))
    return "".join(out)


def tied(rng, n, scale):
    """Texts whose red and blue follow green."""
    rows = []
    for _ in range(n):
        g = rng.randint(2, 120)
        rows.append("".join(chr(min(max(int(v), 1), 126)) for v in (g * scale + rng.randint(0, 1), g, g * scale + rng.randint(0, 1), 64)))
    return "".join(rows)


def test_each_tool_is_taken_where_it_is_cheapest():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(200)]
    texts = {
        webp.PREDICTOR: walk(rng, 3000, 1),
        webp.CROSS: tied(rng, 3000, 0.5),
        webp.SUBTRACT_GREEN: tied(rng, 3000, 1),
        webp.PALETTE: "".join(rng.choices(words[:12], k=600)),
        None: "the same line again and again\n" * 50,
    }
    stored = media.encode([t.encode() for t in texts.values()])
    for (kind, text), m, images in zip(texts.items(), stored, media.decode(stored)):
        streams = webp.unwrap(m)
        assert first_transform(streams[0]) == kind, kind
        assert media.samples(images) == text.encode() + bytes(-len(text) % 64)
        assert [webp.read_image(s).tolist() for s in streams] == [p.tolist() for p in images]
        plain = webp.write_image(images[0])
        assert len(streams[0]) < len(plain)


def test_references_and_caches_in_the_table():
    texts = [(t or "").encode() for (t,) in duckdb.sql("select text from read_parquet('/root/testdata/sf0.01/documents.parquet')").fetchall()]
    stored = media.encode(texts)
    found = Counter()
    for text, m, images in zip(texts, stored, media.decode(stored)):
        assert media.samples(images) == text + bytes(64 if not text else -len(text) % 64)
        for stream in webp.unwrap(m):
            kind = first_transform(stream)
            found[kind] += 1
            if kind is None:
                r = webp.Reader(stream, 41)
                found["cache"] += r.bits(1)
    refs = sum(len(webp.find_references(p.ravel())) > 0 for images in media.decode(stored) for p in images)
    assert found["cache"] > 0.3 * len(texts) and refs > 0.9 * len(texts)
    # Equal texts have equal media, whatever stands beside them.
    assert media.encode(texts[:3]) == stored[:3] and media.encode(texts[2:3]) == stored[2:3]
    assert sum(map(len, stored)) < 0.6 * sum(map(len, texts))


@pytest.mark.parametrize("seed", range(3))
def test_side_by_side_is_one_by_one(seed):
    rng = np.random.default_rng(seed)
    streams = []
    for k in range(90):
        h, w = (int(x) for x in rng.integers(1, 30, 2))
        palette = rng.integers(0, 2**32, int(rng.choice([1, 2, 5, 17, 300])), dtype=np.uint64).astype(np.uint32)
        pixels = palette[rng.integers(0, len(palette), (h, w))]
        tiles = rng.integers(0, 3, (-(-h >> 2), -(-w >> 2))) if k % 9 == 0 else None
        transforms = [(), (webp.SUBTRACT_GREEN,), (webp.PALETTE,) if len(palette) <= 256 else ()][k % 3]
        streams.append(webp.write_image(pixels, transforms=transforms, cache_bits=int(rng.integers(0, 12)), references=bool(k % 2), **({} if tiles is None or transforms else {"tiles": tiles})))
    for got, stream in zip(webp.read_images(streams), streams):
        assert (got == webp.read_image(stream)).all()
    for bad in (streams[:50] + [streams[1][: len(streams[1]) // 2]] + streams[50:], [b"\0" + streams[0][1:]] + streams):
        with pytest.raises((ValueError, IndexError)):
            webp.read_images(bad)
