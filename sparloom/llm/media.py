"""Texts as lossless WebP media columns, and back to pixel arrays.

A text's UTF-8 bytes, filled with zeros to a positive multiple of 64, are the red, green, blue and alpha samples of
consecutive images 16 pixels wide, TILE_ROWS rows at most; their RIFF files follow each other in the column.

Each image is written the way that takes fewest bits by an estimate from its own pixels, one rule for all sizes: as it is, or after
subtract-green, cross-colour, the best predictor (with or without one of these) or a palette; with back-references; without or
with a colour cache. The choice depends on the text alone: equal texts have equal media. Every stored image
is read by the general reader.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import webp
from .common import binary, map_arrow

UNIT = 64
WIDTH = 16
TILE_ROWS = 4096
#: Bits of the colour caches that are tried beside none.
CACHES = (8,)
#: Bits that the header takes for each symbol and each cache key in use, and for a transform with one tile: rough averages.
SYMBOL_BITS, KEY_BITS, TILE_BITS = 5, 8, 50
#: Predictors that are tried: left, top, the nearer of both, and the gradient.
MODES = (1, 2, 11, 12)
#: Side of the tiles of predictor and cross-colour, as a power of two: the largest of the format.
SHIFT = 9
#: Bytes of media that are read back at a time: the more, the fewer steps.
READ_BYTES = 8 << 20
#: Bytes of images whose transforms are compared at a time.
COMPARED = 1 << 20


#: n log2(n) of each number of pixels that an image can have.
_WEIGH = np.arange(WIDTH * TILE_ROWS + 1) * np.log2(np.maximum(np.arange(WIDTH * TILE_ROWS + 1), 1))


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of symbols with these counts (..., symbols) by their frequencies, and of the code's header."""
    return _WEIGH[counts.sum(axis=-1)] - _WEIGH[counts].sum(axis=-1) + SYMBOL_BITS * np.count_nonzero(counts, axis=-1)


def _literal_bits(pixels: np.ndarray) -> float:
    channels = np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(-1, 4) + 256 * np.arange(4)
    return float(_entropy(np.bincount(channels.ravel(), minlength=1024).reshape(4, 256)).sum())


class Compared:
    """Estimates for many images at once: literal bits of each as it is and after each transform."""

    def __init__(self, images: list[np.ndarray]):
        self.n = len(images)
        rows = np.array([len(p) for p in images])
        self.first = np.cumsum(rows) - rows
        self.c = np.ascontiguousarray(np.concatenate(images).astype("<u4")).view(np.uint8).reshape(-1, WIDTH, 4)
        self.cells = ((np.repeat(np.arange(self.n), rows)[:, None, None] * 4 + np.arange(4)) * 256).astype(np.int64)

    def bits(self, c: np.ndarray) -> np.ndarray:
        counts = np.bincount((self.cells + c.astype(np.uint8, copy=False)).ravel(), minlength=self.n * 1024).reshape(self.n, 4, 256)
        return _entropy(counts).sum(axis=1)

    def predicted(self) -> tuple[np.ndarray, np.ndarray]:
        """The best mode of each image and its bits."""
        c = self.c.astype(np.int16)
        before = np.concatenate([np.zeros_like(c[:1]), c[:-1]])
        left, top_left = np.zeros_like(c), np.zeros_like(c)
        left[:, 1:], top_left[:, 1:] = c[:, :-1], before[:, :-1]
        top_right = np.concatenate([before[:, 1:], c[:, :1]], axis=1)
        best, mode = np.full(self.n, np.inf), np.zeros(self.n, np.int64)
        for k in MODES:
            guess = webp.predictions(k, left, before, top_left, top_right).copy()
            guess[:, 0] = before[:, 0]
            guess[self.first] = left[self.first]
            guess[self.first, 0] = (0, 0, 0, 255)
            bits = self.bits(c - guess)
            mode[bits < best] = k
            best = np.minimum(best, bits)
        return mode, best + TILE_BITS

    def greened(self) -> np.ndarray:
        c = self.c.copy()
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
        return self.bits(c)

    def crossed(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers (images, 3) of green to red, green to blue and red to blue by least squares, and their bits."""
        signed = self.c.view(np.int8).astype(np.int32)
        sums = lambda x: np.add.reduceat(x.sum(axis=1), self.first)
        n = sums(np.ones(self.c.shape[:2]))

        def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            sx, sy = sums(x), sums(y)
            spread = sums(x * x) - sx * sx / n
            return np.clip(np.rint(32 * (sums(x * y) - sx * sy / n) / np.maximum(spread, 1)), -128, 127).astype(np.int32)

        spread = lambda t: np.repeat(t, np.diff(np.r_[self.first, len(self.c)]))[:, None]
        blue, green, red = signed[..., 0], signed[..., 1], signed[..., 2]
        to_red, to_blue = slope(green, red), slope(green, blue)
        blue = blue - (spread(to_blue) * green >> 5)
        from_red = slope(red, blue)
        c = np.stack([blue - (spread(from_red) * red >> 5), self.c[..., 1], red - (spread(to_red) * green >> 5), self.c[..., 3]], axis=-1)
        return np.stack([to_red, to_blue, from_red], axis=1), self.bits(c) + TILE_BITS


def _tile(value: int, height: int) -> np.ndarray:
    """The tiles of an image, all alike."""
    return np.full((-(-height >> SHIFT), 1), value, np.uint32)


def _cross_tile(multipliers: np.ndarray, height: int) -> np.ndarray:
    to_red, to_blue, from_red = (int(m) & 255 for m in multipliers)
    return _tile(0xFF000000 | from_red << 16 | to_blue << 8 | to_red, height)


class Way:
    """One way to write an image: its pixels after the transforms, and about the bits that those take."""

    def __init__(self, image: int, pixels: np.ndarray, transforms: tuple[int, ...] = (), modes: np.ndarray | None = None, cross: np.ndarray | None = None):
        self.image, self.size, self.how = image, pixels.shape, (transforms, modes, cross, SHIFT)
        self.pixels, self.palette = webp.transformed(pixels, *self.how)
        self.bits = TILE_BITS * sum(k in (webp.PREDICTOR, webp.CROSS) for k in transforms) + (0 if self.palette is None else _literal_bits(webp.palette_steps(self.palette)))

    def head(self, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and bits of all before the codes."""
        w = webp.Writer()
        webp.write_header(w, self.size[1], self.size[0])
        webp.write_transforms(w, *self.how, self.palette)
        w.bits(0, 1)  # no further transform
        w.bits(int(cache_bits > 0), 1)
        if cache_bits:
            w.bits(cache_bits, 4)
        w.bits(0, 1)  # one group of codes
        return w.all()


def write_ways(ways: list[Way], n_images: int) -> list[bytes]:
    """The stream of each image by the way that takes the fewest bits by an estimate, the first of equal ones."""
    flat = np.concatenate([w.pixels.ravel() for w in ways])
    size = np.array([w.pixels.size for w in ways])
    first = np.cumsum(size) - size
    way = np.repeat(np.arange(len(ways)), size)
    refs = webp.find_references(flat, first)
    at, symbols, kinds = webp.items(flat, np.array([w.pixels.shape[1] for w in ways])[way[refs[:, 0]]], refs)
    owner = way[at]
    count = lambda x, n: np.bincount(x, minlength=n * len(ways)).reshape(len(ways), n)

    literal = kinds[:, 1] == 1
    spot, of = at[literal], owner[literal]
    cells = (of[:, None] * 4 + np.arange(4)) * 256 + symbols[literal]
    plain = count(cells.ravel(), 1024).reshape(-1, 4, 256)
    lengths, far = owner[~literal] * 24 + symbols[~literal, 0] - 256, owner[~literal] * 40 + symbols[~literal, 2]
    green = np.concatenate([plain[:, 0], count(lengths, 24)], axis=1)
    same = np.bincount(owner, np.maximum(kinds - 8, 0).sum(axis=1), len(ways)) + _entropy(count(far, 40)) + [w.bits for w in ways]
    best, bits = same + _entropy(green) + _entropy(plain[:, 1:]).sum(axis=1), np.zeros(len(ways), np.int64)
    tried = {}
    for b in CACHES:
        key, hit = webp.cached(flat, b, way)
        found = hit[spot]
        missed = count(cells[found].ravel(), 1024).reshape(-1, 4, 256)
        keys = count(of[found] << b | key[spot[found]], 1 << b)
        total = same + _entropy(np.concatenate([green[:, :256] - missed[:, 0], green[:, 256:], keys], axis=1)) + _entropy(plain[:, 1:] - missed[:, 1:]).sum(axis=1)
        total += (KEY_BITS - SYMBOL_BITS) * np.count_nonzero(keys, axis=1)
        tried[b] = (key, hit)
        bits[total < best] = b
        best = np.minimum(best, total)

    images = np.array([w.image for w in ways])
    order = np.lexsort((np.arange(len(ways)), best, images))
    chosen = order[np.r_[True, np.diff(images[order]) > 0]]
    key, hit = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
    for b, (k, h) in tried.items():
        mine = bits[way] == b
        key[mine], hit[mine] = k[mine], h[mine]
    at, symbols, kinds = webp.with_cache((at, symbols, kinds), key, hit)
    number = np.full(len(ways), -1)
    number[chosen] = np.arange(n_images)
    rows = number[owner] >= 0
    image = number[owner[rows]]
    room = np.where(bits[chosen] > 0, 1 << bits[chosen], 0)
    sizes = (np.array(webp.ALPHABETS) + room[:, None] * (np.arange(5) == 0)).ravel()
    heads = [ways[c].head(int(bits[c])) for c in chosen.tolist()]
    head_of = np.repeat(np.arange(n_images), [len(h[0]) for h in heads]) * 12
    parts = webp.fields(symbols[rows], kinds[rows], image, 5 * image, sizes)
    return webp.packed([(*[np.concatenate(x) for x in zip(*heads)], head_of), *parts], 12, n_images)


def write_images(images: list[np.ndarray]) -> list[bytes]:
    """Bitstreams of images WIDTH pixels wide, each by the cheapest of the ways to write it."""
    out: list[bytes] = []
    first = 0
    while first < len(images):
        last, size = first, 0
        while last < len(images) and (last == first or size + images[last].nbytes <= COMPARED):
            size += images[last].nbytes
            last += 1
        part = images[first:last]
        seen = Compared(part)
        plain, green = seen.bits(seen.c), seen.greened()
        (mode, predicted), (multipliers, crossed) = seen.predicted(), seen.crossed()
        ways: list[Way] = []
        for i, p in enumerate(part):
            ways.append(Way(i, p))
            if green[i] < plain[i]:
                ways.append(Way(i, p, (webp.SUBTRACT_GREEN,)))
            if crossed[i] < plain[i]:
                ways.append(Way(i, p, (webp.CROSS,), cross=_cross_tile(multipliers[i], len(p))))
            if predicted[i] < plain[i]:
                modes = _tile(int(mode[i]) << 8, len(p))
                alone = Way(i, p, (webp.PREDICTOR,), modes)
                cross = _cross_tile(Compared([alone.pixels]).crossed()[0][0], len(p))
                ways += [alone, Way(i, p, (webp.PREDICTOR, webp.SUBTRACT_GREEN), modes), Way(i, p, (webp.PREDICTOR, webp.CROSS), modes, cross)]
            colours, counts = np.unique(p, return_counts=True)
            if len(colours) <= 256 and _entropy(counts) + _literal_bits(webp.palette_steps(colours)) < plain[i]:
                ways.append(Way(i, p, (webp.PALETTE,)))
        out += write_ways(ways, len(part))
        first = last
    return out


def encode(texts: list[bytes]) -> list[bytes]:
    """Each text's media: its images' files, one after the other."""
    owner: list[int] = []
    images: list[np.ndarray] = []
    for i, t in enumerate(texts):
        payload = np.frombuffer(t + bytes(UNIT if not t else -len(t) % UNIT), np.uint8).reshape(-1, WIDTH, 4)
        argb = np.ascontiguousarray(payload[..., [2, 1, 0, 3]]).view("<u4")[..., 0]
        for k in range(0, len(argb), TILE_ROWS):
            owner.append(i)
            images.append(argb[k : k + TILE_ROWS])
    out: list[list[bytes]] = [[] for _ in texts]
    for i, stream in zip(owner, write_images(images)):
        out[i].append(webp.wrap(stream))
    return [b"".join(x) for x in out]


def decode(media: list[bytes]) -> list[list[np.ndarray]]:
    """Each media's images as ARGB pixel arrays, uint32 (height, width)."""
    streams = [webp.unwrap(m) for m in media]
    images = iter(webp.read_images([x for s in streams for x in s]))
    return [[next(images) for _ in s] for s in streams]


def samples(images: list[np.ndarray]) -> bytes:
    """The red, green, blue and alpha samples of the images."""
    return b"".join(np.ascontiguousarray(p.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes() for p in images)


def feature(images: list[np.ndarray], payload: bytes) -> str:
    """Images, rows, mean red, green, blue and alpha, and entropy of all samples in bits; payload: the images' samples."""
    data = np.frombuffer(payload, np.uint8)
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / max(len(data), 1)
    means = data.reshape(-1, 4).sum(axis=0, dtype=np.int64) / max(len(data) // 4, 1)
    return f"{len(images)}x{sum(len(p) for p in images)};" + ",".join(f"{m:.3f}" for m in means) + f";{abs(-(share * np.log2(share)).sum()):.4f}"


def store(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all when None) with n_bytes long, the text's UTF-8 bytes, and media binary.

    A null text is stored like an empty one, repeated rows like each other; an empty table gives no rows. Texts of any length; columns named like a new one are replaced. No shuffle.
    """

    def add(batch: pa.RecordBatch) -> dict:
        texts = [t or b"" for t in binary(batch.column(text_col)).to_pylist()]
        return {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(encode(texts), pa.binary())}

    return map_arrow(docs, add, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], text_col, keep)


def pixels(stored: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of stored (all when None) with the pixel arrays of each image in the media column: images
    array<struct<width int, height int, argb array<long>>>. A null media has none."""
    kind = T.ArrayType(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("argb", T.ArrayType(T.LongType()))]))

    def add(batch: pa.RecordBatch) -> dict:
        from pyspark.sql.pandas.types import to_arrow_type

        found = decode([m or b"" for m in binary(batch.column(media_col)).to_pylist()])
        return {"images": pa.array([[{"width": p.shape[1], "height": p.shape[0], "argb": p.ravel().astype(np.int64)} for p in images] for images in found], to_arrow_type(kind))}

    return map_arrow(stored, add, [T.StructField("images", kind)], media_col, keep)


def read_back(stored: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of stored (all when None) with what the stored bytes hold: payload_bytes long, payload_sha256
    string, tail_crc32 long (of the last 64 bytes), media_bytes long, media_sha256 string, feature string."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]

    def add(batch: pa.RecordBatch) -> dict:
        media = [m or b"" for m in binary(batch.column(media_col)).to_pylist()]
        rows = []
        for m, images in zip(media, decode(media)):
            payload = samples(images)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(images, payload)))
        return {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_arrow(stored, add, [T.StructField(n, k) for n, k in zip(names, kinds)], media_col, keep, READ_BYTES)
