"""Lossless WebP: reading any lossless stream, and writing streams that use any of its tools.

Reading: prefix codes (simple and normal), prefix-code groups, back-references and colour cache, then the inverse of the
predictor, cross-colour, subtract-green and palette transforms. Code tables, transforms of whole rows and written bits are
made by arrays; symbols, whose places depend on those before them, are read one by one from a table of all bit positions.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
ALPHABETS = (256 + 24, 256, 256, 256, 40)  # green with lengths, red, blue, alpha, distance
PREDICTOR, CROSS, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LONGEST = 15
#: Longest code that is written: shorter tables are read faster.
LIMIT = 10
#: Near distances by code: places left of and above a pixel, by Euclidean distance.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_NEAR_X, _NEAR_Y = np.array(NEAR).T


# --- prefix codes ---------------------------------------------------------------------------------------------------


def _depths(weights: list[int]) -> list[int]:
    """Depths of the leaves of Huffman's tree over ascending weights: the two lightest of leaves and joined nodes meet."""
    n = len(weights)
    joined: list[int] = []
    parent = [0] * (2 * n - 1)
    leaf = node = 0
    for new in range(n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (node >= new or weights[leaf] <= joined[node]):
                total += weights[leaf]
                parent[leaf] = n + new
                leaf += 1
            else:
                total += joined[node]
                parent[n + node] = n + new
                node += 1
        joined.append(total)
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return depth[:n]


def code_lengths(counts: np.ndarray | list[int], limit: int = LONGEST) -> np.ndarray:
    """Huffman code lengths of at most `limit` bits, or LONGEST where over half of the codes of `limit` bits are in use; a single
    symbol gets 1."""
    counts = np.asarray(counts)
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit - 1:  # too many for short codes
        limit = LONGEST
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    # Rare symbols count as more, lest their codes pass the limit.
    floor = max(1, int(counts.sum()) >> limit - 1)
    while True:
        weights = np.maximum(counts[used], floor)
        order = np.argsort(weights, kind="stable")
        depth = _depths(weights[order].tolist())
        if max(depth) <= limit:
            lengths[used[order]] = depth
            return lengths
        floor *= 2


def many_lengths(counts: np.ndarray, bounds: np.ndarray, limit: int = LONGEST) -> np.ndarray:
    """code_lengths() of many codes at once: the counts of code i's used symbols are counts[bounds[i] : bounds[i + 1]]; a
    single symbol gets 0. Codes of like size are made side by side."""
    out = np.zeros(len(counts), np.int64)
    many = np.diff(bounds)
    by_size = np.argsort(many, kind="stable")
    by_size = by_size[many[by_size] > 1]
    while len(by_size):
        part = by_size[: int(np.searchsorted(many[by_size], 2 * many[by_size[0]] + 16, "right"))]
        by_size = by_size[len(part) :]
        if len(part) < 16:
            for start, stop in zip(bounds[part].tolist(), bounds[part + 1].tolist()):
                out[start:stop] = code_lengths(counts[start:stop], limit)
            continue
        size = many[part]
        n, rows = int(size[-1]), len(part)
        inside = np.arange(n) < size[:, None]
        at = np.where(inside, bounds[part][:, None] + np.arange(n), 0)
        limits = np.where(size > 1 << limit - 1, LONGEST, limit)[:, None]
        least = np.where(inside, counts[at], 0).sum(axis=1, keepdims=True) >> limits - 1
        weight = np.where(inside, np.maximum(counts[at], least), np.iinfo(np.int64).max)
        order = np.argsort(weight, axis=1, kind="stable")
        weight = np.take_along_axis(weight, order, axis=1)
        lengths = np.empty_like(order)
        np.put_along_axis(lengths, order, _depths_side(weight, size), axis=1)
        out[at[inside]] = lengths[inside]
        for i in np.flatnonzero(np.where(inside, lengths, 0).max(axis=1) > limits[:, 0]).tolist():
            start, stop = bounds[part[i]], bounds[part[i] + 1]
            out[start:stop] = code_lengths(counts[start:stop], limit)
    return out


def _depths_side(weight: np.ndarray, size: np.ndarray) -> np.ndarray:
    """_depths() of rows of ascending weights, sizes ascending; places beyond a row's size are to be ignored."""
    rows, n = weight.shape
    none = np.iinfo(np.int64).max
    weight = np.concatenate([weight, np.full((rows, 1), none)], axis=1)
    joined = np.full((rows, n + 1), none)
    parent = np.zeros((rows, 2 * n), np.int64)
    leaf, node = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for new in range(n - 1):
        live = slice(int(np.searchsorted(size, new + 1, "right")), rows)
        r = np.arange(live.start, rows)
        total = 0
        for _ in range(2):
            own, other = weight[r, leaf[live]], joined[r, node[live]]
            take = own <= other
            total = total + np.where(take, own, other)
            parent[r, np.where(take, leaf[live], n + node[live])] = n + new
            leaf[live] += take
            node[live] += ~take
        joined[live, new] = total
    depth = np.zeros((rows, 2 * n), np.int64)
    for new in range(n - 3, -1, -1):
        live = int(np.searchsorted(size, new + 2, "right"))
        r = np.arange(live, rows)
        depth[r, n + new] = depth[r, parent[r, n + new]] + 1
    return np.take_along_axis(depth, parent[:, :n], axis=1) + 1


#: Each number of LONGEST bits with its bits in reverse.
_REVERSED = sum(((np.arange(1 << LONGEST) >> i & 1) << (LONGEST - 1 - i) for i in range(LONGEST)), np.zeros(1 << LONGEST, np.int64))


def codes(lengths: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest, as they are written, of the symbols of alphabets with complete codes.

    alphabet: number of each symbol's alphabet, ascending. Symbols of length 0 have code 0.
    """
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((lengths[used], alphabet[used]))]
    share = 1 << (LONGEST - lengths[order])
    # Each alphabet's shares fill the range of LONGEST bits.
    out[order] = _REVERSED[(np.cumsum(share) - share) & ((1 << LONGEST) - 1)]
    return out


class Table:
    """Symbol and length of the code that each run of `bits` bits begins with, as symbol * 16 + length."""

    def __init__(self, lengths: np.ndarray | list[int]):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        if len(used) == 1:
            bits, self.array = 0, used << 4
        else:
            n = lengths[used]
            order = np.argsort(n, kind="stable")
            used, n = used[order], n[order]
            bits = int(n[-1]) if len(n) else 0
            share = 1 << bits - n
            if share.sum() != 1 << bits:
                raise ValueError("the code isn't complete")
            self.array = np.repeat(used << 4 | n, share)[_REVERSED[: 1 << bits] >> LONGEST - bits]
        self.mask = (1 << bits) - 1

    @classmethod
    def of(cls, array: np.ndarray) -> Table:
        self = cls.__new__(cls)
        self.array, self.mask = array, len(array) - 1
        return self

    @functools.cached_property
    def pairs(self) -> list[int]:
        return self.array.tolist()


def small_table(lengths: list[int]) -> tuple[list[int], int]:
    """The same for a code of few symbols of at most 7 bits: its pairs and their mask."""
    used = sorted([(n, s) for s, n in enumerate(lengths) if n])
    if len(used) == 1:
        return [used[0][1] << 4], 0
    bits = used[-1][0] if used else 0
    pairs, at = [0] * (1 << bits), 0
    for n, s in used:
        if at > 127:
            raise ValueError("the code isn't complete")
        code = _SHORT[at]
        pairs[code :: 1 << n] = [s << 4 | n] * (1 << bits - n)
        at += 128 >> n
    if at != 128:
        raise ValueError("the code isn't complete")
    return pairs, (1 << bits) - 1


_SHORT: list[int] = (_REVERSED[np.arange(128) << LONGEST - 7]).tolist()


class Reader:
    """Bits of a stream, first bit lowest."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    @functools.cached_property
    def window(self) -> memoryview:
        """25 bits or more from every bit position."""
        return memoryview((_words(self.data + bytes(12))[:, None] >> np.arange(8)).ravel())

    def bits(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << n) - 1)


def _words(data: bytes) -> np.ndarray:
    """The four bytes from each place on as a number."""
    d = np.frombuffer(data, np.uint8).astype(np.uint32)
    return d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24


Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def packed(parts: list[Part], sections: int, n_streams: int) -> list[bytes]:
    """Bytes of each stream. parts: values, their numbers of bits and sections, ascending; each section is in one part;
    stream i has sections i * sections to (i + 1) * sections - 1."""
    many = [np.bincount(section, bits, sections * n_streams).astype(np.int64) for _, bits, section in parts]
    whole = sum(many).reshape(n_streams, sections)
    size = -(-whole.sum(axis=1) // 8)
    base = np.cumsum(size) - size
    start = (8 * base[:, None] + np.cumsum(whole, axis=1) - whole).ravel()
    room = int(size.sum()) + 4
    out = np.zeros(room)
    for (values, bits, section), own in zip(parts, many):
        at = np.cumsum(bits) - bits + (start - np.cumsum(own) + own)[section]
        values, byte = values << (at & 7), at >> 3
        for k in range(-(-(int(bits.max(initial=0)) + 7) // 8)):
            out += np.bincount(byte + k, values >> (8 * k) & 255, room)
    out = out.astype(np.uint8).tobytes()
    return [out[b : b + n] for b, n in zip(base.tolist(), size.tolist())]


class Writer:
    """Values with their numbers of bits, in order; done() puts them together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def bits(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def arrays(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
        self.parts.append((values, sizes))
        self.values, self.sizes = [], []

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.arrays(np.zeros(0, np.int64), np.zeros(0, np.int64))
        return tuple(np.concatenate([p[i] for p in self.parts]) for i in (0, 1))

    def done(self) -> bytes:
        values, sizes = self.all()
        return packed([(values, sizes, np.zeros(len(values), np.int64))], 1, 1)[0]


def _code_head(r: Reader, size: int) -> tuple[list[int], int | None, tuple[list[int], int] | None]:
    """The symbols of a code that is told simply; or how many length symbols follow at most, and the table of their code."""
    # The head takes 90 bits at most.
    v = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 13], "little") >> (r.at & 7)
    if v & 1:
        wide = 8 if v & 4 else 1
        r.at += 3 + wide + (8 if v & 2 else 0)
        return [v >> 3 & (1 << wide) - 1, *([v >> 3 + wide & 255] if v & 2 else [])], None, None
    own, n, at = [0] * 19, 4 + (v >> 1 & 15), 5
    for s in LENGTH_ORDER[:n]:
        own[s] = v >> at & 7
        at += 3
    left = size
    if v >> at & 1:
        bits = 2 + 2 * (v >> at + 1 & 7)
        left = 2 + (v >> at + 4 & (1 << bits) - 1)
        at += 3 + bits
    r.at += at + 1
    return [], left, small_table(own)


def read_table(r: Reader, size: int) -> Table:
    """The code of an alphabet of so many symbols."""
    simple, left, own = _code_head(r, size)
    if r.at > r.end:
        raise ValueError("the stream ends early")
    if own is None:
        lengths = np.zeros(256, np.int64)
        lengths[simple] = 1
        return Table(lengths)
    (pairs, mask), before = own, 8
    window, at, end = r.window, r.at, r.end
    lengths: list[int] = []
    while len(lengths) < size and left and at <= end:
        left -= 1
        n = pairs[window[at] & mask]
        at += n & 15
        n >>= 4
        if n < 16:
            lengths.append(n)
            before = n or before
        elif n == 16:
            lengths += [before] * (3 + (window[at] & 3))
            at += 2
        elif n == 17:
            lengths += [0] * (3 + (window[at] & 7))
            at += 3
        else:
            lengths += [0] * (11 + (window[at] & 127))
            at += 7
    r.at = at
    if at > end:
        raise ValueError("the stream ends early")
    if len(lengths) > size:
        raise ValueError("a code has too many lengths")
    return Table(lengths if any(lengths) else [1])


# --- reading --------------------------------------------------------------------------------------------------------


def _value(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + r.bits(n) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _group(r: Reader, cache_bits: int) -> list[Table]:
    return [read_table(r, size) for size in (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])]


def read_pixels(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB of an entropy-coded image, uint32 (height, width); top: it may have groups of codes."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    tiles, shift = None, 0
    if top and r.bits(1):
        shift = r.bits(3) + 2
        tiles = (read_pixels(r, -(-width >> shift), -(-height >> shift), False) >> 8 & 0xFFFF).tolist()
    groups = [_group(r, cache_bits) for _ in range(1 + max(map(max, tiles)) if tiles else 1)]
    out: list[int] = []
    r.at = _pixels(r, groups, width, width * height, cache_bits, [0] * (1 << cache_bits), out, tiles, shift)
    return np.array(out, np.uint32).reshape(height, width)


def _pixels(r: Reader, groups: list[list[Table]], width: int, total: int, cache_bits: int, cache: list[int], out: list[int], tiles: list[list[int]] | None = None, shift: int = 0) -> int:
    """Reads the pixels after those in `out`, which are in the cache, up to `total`; returns the place after them."""
    held = len(out)  # pixels that are in the cache
    window, end, push = r.window, r.end, out.append
    # A group's tables, with the masks of their bits.
    books = [[x for t in g for x in (t.pairs, t.mask)] for g in groups]
    green, g_mask, red, r_mask, blue, b_mask, alpha, a_mask, far, f_mask = books[0]
    at, n = r.at, held
    while n < total:
        if at > end:
            raise ValueError("the stream ends early")
        if tiles:
            green, g_mask, red, r_mask, blue, b_mask, alpha, a_mask, far, f_mask = books[tiles[n // width >> shift][n % width >> shift]]
        s = green[window[at] & g_mask]
        at += s & 15
        if s < 4096:  # a symbol under 256
            x = red[window[at] & r_mask]
            at += x & 15
            y = blue[window[at] & b_mask]
            at += y & 15
            z = alpha[window[at] & a_mask]
            at += z & 15
            push((s & 4080) << 4 | (x & 4080) << 12 | y >> 4 | (z & 4080) << 20)
            n += 1
            continue
        s >>= 4
        if s < 280:
            r.at = at
            length = _value(r, s - 256)
            x = far[window[min(r.at, end)] & f_mask]
            r.at += x & 15
            back = _distance(_value(r, x >> 4), width)
            at = r.at
            if back > n or n + length > total:
                raise ValueError("a reference leaves the image")
            while length > 0:  # a source that reaches into what it makes repeats
                out += out[n - back : n - back + length]
                length -= len(out) - n
                n = len(out)
        else:
            for p in out[held:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            held = n
            push(cache[s - 280])
            n += 1
    if at > end:
        raise ValueError("the stream ends early")
    return at


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) of blue, green, red, alpha as int64."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4).astype(np.int64)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((channels & 255).astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def predict(mode: int, left: list[int], top: list[int], top_left: list[int], top_right: list[int]) -> list[int]:
    """Channel by channel prediction of a pixel from its neighbours."""
    return predictions(mode, *[np.array(x) for x in (left, top, top_left, top_right)]).tolist()


def predictions(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The same for pixels (..., 4)."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return ((left + top_right >> 1) + top) >> 1
    if mode < 10:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return a + b >> 1
    if mode == 10:
        return (left + top_left >> 1) + (top + top_right >> 1) >> 1
    if mode == 11:
        nearer = np.abs(top - top_left).sum(axis=-1, keepdims=True) < np.abs(left - top_left).sum(axis=-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = left + top >> 1
    half = mean - top_left
    return np.clip(mean + ((half + (half < 0)) >> 1), 0, 255)


def _around(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left, top, top left and top right neighbours of the pixels of all rows but the first (the last has the row's own first)."""
    left = np.concatenate([np.zeros_like(c[1:, :1]), c[1:, :-1]], axis=1)
    top_left = np.concatenate([np.zeros_like(c[1:, :1]), c[:-1, :-1]], axis=1)
    return left, c[:-1], top_left, np.concatenate([c[:-1, 1:], c[1:, :1]], axis=1)


def _guesses(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Predictions of all pixels of an image whose channels are known; modes: one for each pixel."""
    guess = np.zeros_like(c)
    guess[0, 0, 3] = 255
    guess[0, 1:] = c[0, :-1]
    if len(c) > 1:
        around = _around(c)
        for mode in np.unique(modes[1:]):
            at = modes[1:] == mode
            guess[1:][at] = predictions(int(mode), *[x[at] for x in around])
        guess[1:, 0] = c[:-1, 0]
    return guess


#: Modes that read the row above alone.
_ABOVE = frozenset((0, 2, 3, 4, 8, 9, 14, 15))


def _walk(pixels: np.ndarray, tiles: np.ndarray, shift: int, sign: int) -> np.ndarray:
    """Add (sign 1) or take off (-1) each pixel's prediction from the original pixels around it.

    Adding goes row by row: at once where every mode of the row reads the row above alone, or the left pixel alone;
    else pixel by pixel.
    """
    height, width = pixels.shape
    c = _channels(pixels)
    modes = (tiles >> 8 & 15).astype(np.int64)[np.arange(height)[:, None] >> shift, np.arange(width) >> shift]
    if sign < 0:
        return _joined(c - _guesses(c, modes))
    c[0, 0, 3] += 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    for y in range(1, height):
        row, over, kinds = c[y], c[y - 1], modes[y]
        row[0] = row[0] + over[0] & 255
        found = set(kinds[1:].tolist())
        if not found:
            continue
        if found == {1}:
            c[y] = np.cumsum(row, axis=0) & 255
        elif found <= _ABOVE:
            right = np.concatenate([over[2:], row[:1]])
            for mode in found:
                guess = predictions(mode, over[1:], over[1:], over[:-1], right)
                row[1:][kinds[1:] == mode] += guess[kinds[1:] == mode]
            row &= 255
        else:
            _walk_row(row, over, kinds.tolist())
    return _joined(c)


def _walk_row(row: np.ndarray, over: np.ndarray, kinds: list[int]) -> None:
    """The pixels of a row after its first, each from those known before it."""
    given, above = row.tolist(), over.tolist()
    left = given[0]
    for x in range(1, len(given)):
        mode, top, corner = kinds[x], above[x], above[x - 1]
        right = above[x + 1] if x + 1 < len(given) else given[0]
        if mode == 1:
            guess = left
        elif mode == 5:
            guess = [((a + b >> 1) + t) >> 1 for a, b, t in zip(left, right, top)]
        elif mode == 6:
            guess = [a + b >> 1 for a, b in zip(left, corner)]
        elif mode == 7:
            guess = [a + b >> 1 for a, b in zip(left, top)]
        elif mode == 10:
            guess = [(a + b >> 1) + (t + r >> 1) >> 1 for a, b, t, r in zip(left, corner, top, right)]
        elif mode == 11:
            to_left = sum([abs(t - k) for t, k in zip(top, corner)])
            guess = left if to_left < sum([abs(a - k) for a, k in zip(left, corner)]) else top
        elif mode == 12:
            guess = [min(max(a + t - k, 0), 255) for a, t, k in zip(left, top, corner)]
        elif mode == 13:
            guess = [min(max(m + int((m - k) / 2), 0), 255) for m, k in [(a + t >> 1, k) for a, t, k in zip(left, top, corner)]]
        else:
            guess = predict(mode, left, top, corner, right)
        left = given[x] = [g + v & 255 for g, v in zip(guess, given[x])]
    row[:] = given


def _cross(pixels: np.ndarray, tiles: np.ndarray, shift: int, sign: int) -> np.ndarray:
    height, width = pixels.shape
    c = _channels(pixels)
    t = _channels(tiles)[np.arange(height)[:, None] >> shift, np.arange(width) >> shift]
    signed = lambda v: (v ^ 128) - 128
    delta = lambda a, b: (signed(a) * signed(b & 255)) >> 5
    blue, green, red = c[..., 0], c[..., 1], c[..., 2]
    new_red = red + sign * delta(t[..., 0], green)
    c[..., 0] = blue + sign * (delta(t[..., 1], green) + delta(t[..., 2], new_red if sign > 0 else red))
    c[..., 2] = new_red
    return _joined(c)


def _greened(pixels: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(pixels)
    c[..., 0] += sign * c[..., 1]
    c[..., 2] += sign * c[..., 1]
    return _joined(c)


def _packing(colours: int) -> int:
    """Pixels that share one, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _coloured(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    packed = _packing(len(palette))
    index = (pixels >> 8 & 255).astype(np.int64)
    if packed:
        x = np.arange(width)
        each = 8 >> packed
        index = index[:, x >> packed] >> ((x & ((1 << packed) - 1)) * each) & ((1 << each) - 1)
    return np.r_[palette, np.zeros(256, np.uint32)][index].astype(np.uint32)


def read_head(r: Reader) -> tuple[int, int, list[Callable[[np.ndarray], np.ndarray]]]:
    """Width and height of the pixels that follow, and what undoes the transforms, the first one last."""
    if r.bits(8) != 0x2F:
        raise ValueError("no lossless stream")
    width, height, _, version = r.bits(14) + 1, r.bits(14) + 1, r.bits(1), r.bits(3)
    if version:
        raise ValueError("unknown version")
    undo: list[Callable[[np.ndarray], np.ndarray]] = []
    seen = set()
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            shift = r.bits(3) + 2
            tiles = read_pixels(r, -(-width >> shift), -(-height >> shift), False)
            undo.append(lambda p, f=_walk if kind == PREDICTOR else _cross, t=tiles, s=shift: f(p, t, s, 1))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda p: _greened(p, 1))
        else:
            colours = r.bits(8) + 1
            palette = _joined(np.cumsum(_channels(read_pixels(r, colours, 1, False)[0]), axis=0))
            undo.append(lambda p, c=palette, w=width: _coloured(p, c, w))
            width = -(-width >> _packing(colours))
    return width, height, undo[::-1]


def read_image(data: bytes) -> np.ndarray:
    """ARGB, uint32 (height, width), of a lossless bitstream (the VP8L chunk's contents)."""
    r = Reader(data)
    width, height, undo = read_head(r)
    pixels = read_pixels(r, width, height, True)
    for f in undo:
        pixels = f(pixels)
    return pixels


#: Images that are read side by side, their pixels together, and how many at least.
SIDE, SIDE_PIXELS, SIDE_LEAST = 8192, 1 << 22, 64


def read_images(streams: list[bytes]) -> list[np.ndarray]:
    """ARGB of each bitstream. Many are read side by side, code by code and pixel by pixel, so that a step of all of them is one
    of arrays."""
    out: list[np.ndarray | None] = [None] * len(streams)
    jobs: list[tuple] = []
    held = 0

    def flush() -> None:
        if jobs:
            for (k, undo, _, width, height, _), pixels in zip(jobs, _Side(jobs).read()):
                pixels = pixels.reshape(height, width)
                for f in undo:
                    pixels = f(pixels)
                out[k] = pixels
            jobs.clear()

    for k, data in enumerate(streams):
        r = Reader(data)
        width, height, undo = read_head(r)
        start = r.at
        cache_bits = r.bits(4) if r.bits(1) else 0
        if cache_bits > 11 or r.bits(1):  # groups of codes
            r.at = start
            pixels = read_pixels(r, width, height, True)
            for f in undo:
                pixels = f(pixels)
            out[k] = pixels
            continue
        if len(jobs) == SIDE or held + width * height > SIDE_PIXELS:
            flush()
            held = 0
        held += width * height
        jobs.append((k, undo, r, width, height, cache_bits))
    flush()
    return out


class _Side:
    """The state of images that are read side by side, from the codes of their pixels on."""

    def __init__(self, jobs: list[tuple]):
        self.readers = [j[2] for j in jobs]
        self.width = np.array([j[3] for j in jobs])
        self.total = np.array([j[3] * j[4] for j in jobs])
        self.cache_bits = np.array([j[5] for j in jobs])
        data = [r.data + bytes(12) for r in self.readers]
        self.starts = 8 * np.cumsum([0] + [len(d) for d in data])[:-1]
        self.words = _words(b"".join(data)).astype(np.int64)
        self.at = self.starts + np.array([r.at for r in self.readers])
        self.end = self.starts + np.array([r.end for r in self.readers])

    def peek(self, which: np.ndarray) -> np.ndarray:
        p = self.at[which]
        return self.words[p >> 3] >> (p & 7)

    def check(self, which: np.ndarray | slice = slice(None)) -> None:
        if (self.at[which] > self.end[which]).any():
            raise ValueError("the stream ends early")

    def tables(self) -> None:
        """The codes: `pairs` of all tables, with `book`, the first of each, and `mask` by alphabet and image."""
        n = len(self.readers)
        sizes = np.tile(ALPHABETS, (n, 1))
        sizes[:, 0] += np.where(self.cache_bits > 0, 1 << self.cache_bits, 0)
        first = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(n, 5)
        lengths = np.zeros(int(sizes.sum()), np.uint8)
        for k in range(5):
            coded, lefts, owns = [], [], []
            for i, r in enumerate(self.readers):
                r.at = int(self.at[i] - self.starts[i])
                simple, left, own = _code_head(r, int(sizes[i, k]))
                self.at[i] = self.starts[i] + r.at
                if own is None:
                    lengths[first[i, k] + np.array(simple)] = 1
                else:
                    coded.append(i)
                    lefts.append(left)
                    owns.append(own)
            if coded:
                self._lengths(np.array(coded), np.array(lefts), owns, lengths, first[coded, k], sizes[coded, k])
        self.check()
        alphabet = np.repeat(np.arange(5 * n), sizes.ravel())
        first = first.ravel()
        used = np.flatnonzero(lengths)
        many = np.bincount(alphabet[used], minlength=5 * n)
        lengths[first[many == 0]] = 1
        used = np.flatnonzero(lengths)
        of, size = alphabet[used], lengths[used].astype(np.int64)
        size[(many <= 1)[of]] = 0  # a single symbol takes no bits
        bits = np.zeros(5 * n, np.int64)
        np.maximum.at(bits, of, size)
        share = 1 << bits[of] - size
        if (np.bincount(of, share, 5 * n) != 1 << bits).any():
            raise ValueError("a code isn't complete")
        order = np.lexsort((size, of))
        room = 1 << bits
        base = np.cumsum(room) - room
        owner = np.repeat(np.arange(5 * n), room)
        turned = _REVERSED[np.arange(len(owner)) - base[owner]] >> LONGEST - bits[owner]
        self.pairs = np.repeat((used - first[of] << 4 | size)[order].astype(np.int32), share[order])[base[owner] + turned]
        self.book, self.mask = base.reshape(n, 5).T.copy(), (room - 1).reshape(n, 5).T.copy()

    def _lengths(self, who: np.ndarray, left: np.ndarray, owns: list[tuple[list[int], int]], lengths: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """The code lengths of one alphabet of these images, into `lengths` from `first` on."""
        pairs = np.zeros((len(who), 128), np.int64)
        for row, (found, _) in zip(pairs, owns):
            row[: len(found)] = found
        mask = np.array([m for _, m in owns])
        place, before = np.zeros(len(who), np.int64), np.full(len(who), 8)
        live = np.arange(len(who))
        while len(live):
            w = self.peek(who[live])
            pair = pairs[live, w & mask[live]]
            n, taken = pair >> 4, pair & 15
            w >>= taken
            run, extra = np.ones(len(live), np.int64), np.zeros(len(live), np.int64)
            if (n > 15).any():
                for kind, least, bits in ((16, 3, 2), (17, 3, 3), (18, 11, 7)):
                    found = n == kind
                    run[found], extra[found] = least + (w[found] & (1 << bits) - 1), bits
                for i in np.flatnonzero(n == 16).tolist():
                    start = first[live[i]] + place[live[i]]
                    lengths[start : min(start + run[i], first[live[i]] + size[live[i]])] = before[live[i]]
            told = (n < 16) & (n > 0)
            lengths[(first + place)[live[told]]] = n[told]
            before[live[told]] = n[told]
            self.at[who[live]] += taken + extra
            place[live] += run
            left[live] -= 1
            self.check(who[live])
            if (place[live] > size[live]).any():
                raise ValueError("a code has too many lengths")
            live = live[(left[live] > 0) & (place[live] < size[live])]

    def symbol(self, which: np.ndarray, alphabet: int) -> np.ndarray:
        pair = self.pairs[self.book[alphabet, which] + (self.peek(which) & self.mask[alphabet, which])]
        self.at[which] += pair & 15
        return pair >> 4

    def literal(self, which: np.ndarray) -> np.ndarray:
        """Red, blue and alpha."""
        p = self.at[which]
        out = 0
        for alphabet, shift in ((1, 16), (2, 0), (3, 24)):
            pair = self.pairs[self.book[alphabet][which] + (self.words[p >> 3] >> (p & 7) & self.mask[alphabet][which])]
            p = p + (pair & 15)
            out = out | (pair >> 4).astype(np.int64) << shift
        self.at[which] = p
        return out

    def value(self, which: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        bits = np.maximum(prefix - 2, 0) >> 1
        extra = self.peek(which) & ((1 << bits) - 1)
        self.at[which] += bits
        return np.where(prefix < 4, prefix, (2 + (prefix & 1) << bits) + extra) + 1

    def read(self) -> list[np.ndarray]:
        """The pixels of each image."""
        self.tables()
        turn = np.argsort(-self.total, kind="stable")  # images still being read come first
        for name in ("width", "total", "cache_bits", "at", "end", "starts"):
            setattr(self, name, getattr(self, name)[turn])
        self.book, self.mask = self.book[:, turn], self.mask[:, turn]
        width, total, cache_bits = self.width, self.total, self.cache_bits
        place = np.cumsum(total) - total  # of each image's pixels in `made`
        made = np.zeros(int(total.sum()), np.int64)
        room = np.where(cache_bits > 0, 1 << cache_bits, 0)
        shelf = np.cumsum(room) - room
        cache = np.zeros(int(room.sum()) + 1, np.int64)
        n, last = place.copy(), place + total
        left, back = np.zeros(len(total), np.int64), np.zeros(len(total), np.int64)
        caching, key_shift = np.flatnonzero(cache_bits), 32 - cache_bits
        live = len(total)
        for step in range(int(total[SIDE_LEAST - 1]) if live >= SIDE_LEAST else 0):
            while total[live - 1] <= step:
                live -= 1
            told = np.flatnonzero(left[:live] == 0)
            s = self.symbol(told, 0)
            plain = s < 256
            who = told[plain]
            if len(who):
                made[n[who]] = s[plain] << 8 | self.literal(who)
            if len(who) < len(told):
                far = (s >= 256) & (s < 280)
                who = told[far]
                if len(who):
                    left[who] = self.value(who, s[far] - 256)
                    code = self.value(who, self.symbol(who, 4))
                    near = np.minimum(code, len(NEAR)) - 1
                    back[who] = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width[who]))
                    if ((back[who] > n[who] - place[who]) | (left[who] > last[who] - n[who])).any():
                        raise ValueError("a reference leaves the image")
                who = told[s >= 280]
                if len(who):
                    made[n[who]] = cache[shelf[who] + s[s >= 280] - 280]
            copying = np.flatnonzero(left[:live])
            if len(copying):
                made[n[copying]] = made[n[copying] - back[copying]]
                left[copying] -= 1
            who = caching if len(caching) and caching[-1] < live else caching[: np.searchsorted(caching, live)]
            p = made[n[who]]
            cache[shelf[who] + ((p * CACHE_FACTOR & 0xFFFFFFFF) >> key_shift[who])] = p
            n[:live] += 1
        self.check()
        out = np.split(made.astype(np.uint32), place[1:])
        for k in np.flatnonzero(n < last).tolist():  # too few to go on side by side
            first, stop = int(place[k]), int(n[k] + left[k])
            for i in range(int(n[k]), stop):
                made[i] = made[i - back[k]]
            pixels = made[first:stop].tolist()
            held = cache[shelf[k] : shelf[k] + room[k]].tolist()
            for p in made[n[k] : stop].tolist() if cache_bits[k] else ():
                held[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - int(cache_bits[k]))] = p
            r = self.readers[turn[k]]
            r.at = int(self.at[k] - self.starts[k])
            group = [Table.of(self.pairs[self.book[a, k] : self.book[a, k] + self.mask[a, k] + 1]) for a in range(5)]
            _pixels(r, [group], int(width[k]), int(total[k]), int(cache_bits[k]), held, pixels)
            out[k] = np.array(pixels, np.uint32)
        return [out[k] for k in np.argsort(turn).tolist()]


def unwrap(data: bytes) -> list[bytes]:
    """Lossless bitstreams of the images in consecutive RIFF files."""
    out, at = [], 0
    while at < len(data):
        tag, size, form = struct.unpack_from("<4sI4s", data, at)
        if tag != b"RIFF" or form != b"WEBP":
            raise ValueError("no WebP file")
        end, chunk = at + 8 + size, at + 12
        while chunk < end:
            kind, n = struct.unpack_from("<4sI", data, chunk)
            if kind == b"VP8L":
                out.append(data[chunk + 8 : chunk + 8 + n])
            chunk += 8 + n + (n & 1)
        at = end
    return out


def wrap(stream: bytes) -> bytes:
    pad = len(stream) & 1
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(stream) + pad, b"WEBP", b"VP8L", len(stream)) + stream + bytes(pad)


# --- writing --------------------------------------------------------------------------------------------------------


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra value and its bits of length or distance codes."""
    v = np.maximum(value - 1, 0)
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    n = np.maximum(top - 1, 0)
    return np.where(v < 4, v, 2 * top + (v >> n & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), np.where(v < 4, 0, n)


#: Most pixels of one reference.
REFERENCE = 4096


def find_references(pixels: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """(start, length, distance) of references that follow each other, each to where its first two pixels last stood.

    first: where each image begins in pixels, one after the other; no reference leaves its image.
    """
    p = pixels.astype(np.int64)
    if len(p) < 3:
        return np.zeros((0, 3), np.int64)
    bounds = np.r_[[0] if first is None else first, len(p)]
    pair = (p[:-1] << 32) + p[1:]
    order = np.argsort(pair, kind="stable")
    image = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    again = np.flatnonzero((pair[order[1:]] == pair[order[:-1]]) & (image[order[1:]] == image[order[:-1]]))
    source = np.full(len(p), -1)
    source[order[again + 1]] = order[again]
    source[bounds[1:] - 1] = -1  # a pair would reach into the next image
    starts = np.flatnonzero(source >= 0)
    stops = bounds[1:][image[starts]].tolist()
    found, at = [], 0
    for i, was, stop in zip(starts.tolist(), source[starts].tolist(), stops):
        if i < at:
            continue
        length, step = 2, 16
        while i + length < stop:
            differs = (p[was + length : min(was + length + step, stop - i + was)] != p[i + length : min(i + length + step, stop)]).nonzero()[0]
            if len(differs):
                length += int(differs[0])
                break
            length = min(length + step, stop - i)
            step = min(4 * step, REFERENCE)
        at = i + length
        found += [(k, min(REFERENCE, at - k), i - was) for k in range(i, at, REFERENCE)]
    return np.array(found, np.int64).reshape(-1, 3)


def cached(pixels: np.ndarray, cache_bits: int, image: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in its image's colour cache, and whether it stands there when its turn comes."""
    key = ((pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)
    own = key + (image << cache_bits)
    order = np.argsort(own, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (own[order[1:]] == own[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return key, hit


@functools.lru_cache(16)
def near_codes(width: int) -> np.ndarray:
    """Code of each distance that a near place has; 0 for others."""
    places = [max(1, x + y * width) for x, y in NEAR]
    table = np.zeros(max(places) + 1, np.int64)
    for code in range(len(NEAR), 0, -1):
        table[places[code - 1]] = code
    return table


def items(pixels: np.ndarray, width: np.ndarray | int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the pixels are written as, without a cache: place of each item's first pixel; (n, 4) symbols of its fields, or
    extra values; (n, 4) their kinds: the alphabet of a symbol, or 8 and the bits of an extra value. width: one, or each
    reference's."""
    at = np.arange(len(pixels))
    if len(refs):
        edges = np.bincount(refs[:, 0], minlength=len(pixels) + 1) - np.bincount(refs[:, 0] + refs[:, 1], minlength=len(pixels) + 1)
        at = at[np.cumsum(edges[:-1]) == 0]
    p = pixels[at].astype(np.int64)
    symbols, kinds = np.empty((len(at), 4), np.int64), np.empty((len(at), 4), np.int64)
    symbols[:, 0], symbols[:, 1], symbols[:, 2], symbols[:, 3] = p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24
    kinds[:] = (0, 1, 2, 3)
    if len(refs):
        s, extra, n = _prefix(refs[:, 1])
        distance, code = refs[:, 2], np.zeros(len(refs), np.int64)
        for each in np.unique(width).tolist():
            near = near_codes(each)
            found = (distance < len(near)) & (width == each)
            code[found] = near[distance[found]]
        d, far, m = _prefix(np.where(code > 0, code, distance + len(NEAR)))
        at = np.concatenate([at, refs[:, 0]])
        symbols = np.concatenate([symbols, np.stack([256 + s, extra, d, far], axis=1)])
        kinds = np.concatenate([kinds, np.stack([np.zeros_like(s), 8 + n, np.full_like(s, 4), 8 + m], axis=1)])
        order = np.argsort(at, kind="stable")
        at, symbols, kinds = at[order], symbols[order], kinds[order]
    return at, symbols, kinds


def with_cache(given: tuple[np.ndarray, np.ndarray, np.ndarray], key: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items with the literals that stand in the cache as its symbols."""
    at, symbols, kinds = given
    symbols, kinds = symbols.copy(), kinds.copy()
    found = (kinds[:, 1] == 1) & hit[at]
    symbols[found] = 0
    symbols[found, 0] = ALPHABETS[0] + key[at[found]]
    kinds[found, 1:] = 8
    return at, symbols, kinds


def fields(symbols: np.ndarray, kinds: np.ndarray, image: np.ndarray, first: np.ndarray, sizes: np.ndarray, groups: int = 1) -> list[Part]:
    """All that is written for images, in sections: the codes of their alphabets, two sections each from the image's second
    section on, then their items in the last.

    symbols, kinds: of items(), with the image of each; first: number of the first of the five alphabets that an item uses;
    sizes: symbols of each alphabet, of which each image has 5 * groups.
    """
    base = np.cumsum(sizes) - sizes
    alphabet = np.repeat(np.arange(len(sizes)), sizes)
    told = kinds < 8
    place = (base[np.minimum(first[:, None] + kinds, len(base) - 1)] + symbols)[told]
    counts = np.bincount(place, minlength=len(alphabet))
    found = np.flatnonzero(counts)
    many = np.bincount(alphabet[found], minlength=len(sizes))
    bounds = np.r_[0, np.cumsum(many)]
    lengths = np.zeros(len(alphabet), np.int64)
    lengths[found] = many_lengths(counts[found], bounds, LIMIT)
    code = codes(lengths, alphabet)
    body_values, body_sizes = symbols.copy(), kinds - 8
    body_values[told], body_sizes[told] = code[place], lengths[place]

    # Codes of one or two symbols under 256 are told simply.
    last = np.zeros(len(sizes), np.int64)
    np.maximum.at(last, alphabet[found], found - base[alphabet[found]])
    simple = (many <= 2) & (last < 256)
    head_values: list[int] = []
    head_sizes: list[int] = []
    head_many = np.zeros(len(sizes), np.int64)
    coded = found[~simple[alphabet[found]]]
    # A single symbol that isn't told simply has length 1, though it takes no bits.
    token, extra, extra_size, token_of = _tokens(coded, np.where(many[alphabet[coded]] == 1, 1, lengths[coded]), alphabet[coded], base)
    seen = np.bincount(token_of * 19 + token, minlength=19 * len(sizes)).reshape(-1, 19)
    own, n_tokens = np.zeros((len(sizes), 19), np.int64), seen.sum(axis=1).tolist()
    some = seen > 0
    own[some] = many_lengths(seen[some], np.r_[0, np.cumsum(some.sum(axis=1))], 7)
    own[some.sum(axis=1) == 1] = some[some.sum(axis=1) == 1]
    ordered = own[:, list(LENGTH_ORDER)]
    mosts = np.maximum(4, 19 - (ordered[:, ::-1] > 0).argmax(axis=1)).tolist()
    ordered = ordered.tolist()
    for k in range(len(sizes)):
        at = len(head_values)
        if simple[k]:
            used = (found[bounds[k] : bounds[k + 1]] - base[k]).tolist() or [0]
            wide = used[0] > 1
            head_values += [1, len(used) - 1, int(wide), *used]
            head_sizes += [1, 1, 1, 8 if wide else 1, *[8] * (len(used) - 1)]
        else:
            most = mosts[k]
            # The number of length symbols is told, so that what follows the last used symbol takes no bits.
            n = max(0, ((n_tokens[k] - 2).bit_length() - 1) // 2)
            head_values += [0, most - 4, *ordered[k][:most], 1, n, n_tokens[k] - 2]
            head_sizes += [1, 4, *[3] * most, 1, 3, 2 + 2 * n]
        head_many[k] = len(head_values) - at
    own[(own > 0).sum(axis=1) == 1] = 0  # a single symbol takes no bits
    own_code = codes(own.ravel(), np.repeat(np.arange(len(sizes)), 19))
    at = token_of * 19 + token
    token_sizes = own.ravel()[at]
    # A length symbol takes 7 bits at most, its extra value follows it.
    steps, n = 10 * groups + 2, 5 * groups
    section = lambda k: k // n * steps + 1 + 2 * (k % n)
    head_of = section(np.repeat(np.arange(len(sizes)), head_many))
    body = np.flatnonzero(body_sizes)
    return [
        (np.array(head_values, np.int64), np.array(head_sizes, np.int64), head_of),
        (own_code[at] | extra << token_sizes, token_sizes + extra_size, section(token_of) + 1),
        (body_values.ravel()[body], body_sizes.ravel()[body], image[body >> 2] * steps + steps - 1),
    ]


def _tokens(used: np.ndarray, lengths: np.ndarray, alphabet: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Length symbols, their extra values and bits, and alphabets: each used symbol's length after the zeros before it, which
    are runs of 138, then one run, or one or two zeros by themselves."""
    before = np.r_[-1, used[:-1]]
    before = np.where(np.r_[True, alphabet[1:] != alphabet[:-1]], base[alphabet] - 1, before) if len(used) else before[:0]
    gap = used - before - 1
    whole, rest = gap // 138, gap % 138
    many = whole + np.where(rest < 3, rest, 1) + 1
    owner = np.repeat(np.arange(len(used)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    rest = np.where(place < whole[owner], 138, rest[owner])
    last = place == many[owner] - 1
    none = last | (rest < 3)
    token = np.where(last, lengths[owner], np.where(rest < 3, 0, np.where(rest < 11, 17, 18)))
    extra = np.where(none, 0, np.where(rest < 11, rest - 3, rest - 11))
    return token, extra, np.where(none, 0, np.where(rest < 11, 3, 7)), alphabet[owner]


def write_pixels(w: Writer, pixels: np.ndarray, cache_bits: int = 0, references: bool = False, tiles: np.ndarray | None = None, shift: int = 2, top: bool = False) -> None:
    """An entropy-coded image; tiles: number of the code group of each block of 2**shift pixels a side."""
    height, width = pixels.shape
    flat = pixels.ravel().astype(np.uint32)
    w.bits(int(bool(cache_bits)), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if top:
        w.bits(int(tiles is not None), 1)
        if tiles is not None:
            w.bits(shift - 2, 3)
            write_pixels(w, tiles.astype(np.uint32) << 8)
    given = items(flat, width, find_references(flat) if references else np.zeros((0, 3), np.int64))
    if cache_bits:
        given = with_cache(given, *cached(flat, cache_bits))
    at, symbols, kinds = given
    group = np.zeros(len(at), np.int64) if tiles is None else tiles[at // width >> shift, at % width >> shift].astype(np.int64)
    groups = 1 if tiles is None else 1 + int(tiles.max())
    sizes = np.tile(ALPHABETS, groups) + np.tile([1 << cache_bits if cache_bits else 0, 0, 0, 0, 0], groups)
    values, bits, section = (np.concatenate(x) for x in zip(*fields(symbols, kinds, np.zeros(len(at), np.int64), 5 * group, sizes, groups)))
    order = np.argsort(section, kind="stable")
    w.arrays(values[order], bits[order])


def write_header(w: Writer, width: int, height: int) -> None:
    w.bits(0x2F, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(1, 1)
    w.bits(0, 3)


def palette_steps(palette: np.ndarray) -> np.ndarray:
    """A palette as it is stored: one row of differences."""
    return _joined(np.diff(_channels(palette), axis=0, prepend=0))[None]


def transformed(pixels: np.ndarray, transforms: tuple[int, ...], modes: np.ndarray | None, cross: np.ndarray | None, shift: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The pixels after the transforms, in order, and the palette, where there is one."""
    palette = None
    for kind in transforms:
        if kind in (PREDICTOR, CROSS):
            pixels = (_walk if kind == PREDICTOR else _cross)(pixels, modes if kind == PREDICTOR else cross, shift, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = _greened(pixels, -1)
        else:
            palette, index = np.unique(pixels, return_inverse=True)
            packed = _packing(len(palette))
            each, together = 8 >> packed, 1 << packed
            index = index.reshape(pixels.shape)
            padded = np.pad(index, ((0, 0), (0, -index.shape[1] % together))).reshape(len(index), -1, together)
            pixels = ((padded << (np.arange(together) * each)).sum(axis=2).astype(np.uint32)) << 8
    return pixels, palette


def write_transforms(w: Writer, transforms: tuple[int, ...], modes: np.ndarray | None, cross: np.ndarray | None, shift: int, palette: np.ndarray | None) -> None:
    for kind in transforms:
        w.bits(1, 1)
        w.bits(kind, 2)
        if kind in (PREDICTOR, CROSS):
            w.bits(shift - 2, 3)
            write_pixels(w, modes if kind == PREDICTOR else cross)
        elif kind == PALETTE:
            w.bits(len(palette) - 1, 8)
            write_pixels(w, palette_steps(palette))


def write_image(pixels: np.ndarray, transforms: tuple[int, ...] = (), modes: np.ndarray | None = None, cross: np.ndarray | None = None, shift: int = 2, **how) -> bytes:
    """A lossless bitstream of ARGB pixels, by these transforms in order; modes (green channel) and cross: their tiles."""
    w = Writer()
    height, width = pixels.shape
    write_header(w, width, height)
    pixels, palette = transformed(pixels, transforms, modes, cross, shift)
    write_transforms(w, transforms, modes, cross, shift, palette)
    w.bits(0, 1)
    write_pixels(w, pixels, top=True, **how)
    return w.done()
