"""Lossless WebP (VP8L): a decoder of all its features, and an encoder.

The decoder reads prefix codes (simple and normal, grouped by a meta image), length and
distance back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. Runs of literal pixels are decoded with numpy: the
symbol and code length that would start at every bit are looked up at once, and only the chain
of pixel starts is followed one by one. Other pixels are decoded singly.

Pixels are 32-bit ARGB values, row by row.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field
from functools import cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: order of code-length code lengths, and plane offsets of short distances.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_PLANE = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
#: Bits whose symbols are looked up at a time.
WINDOW_BITS = 1 << 16
MOST_SIDE = 1 << 14


class WebpError(ValueError):
    """The bytes are not a whole lossless WebP image."""


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; one used symbol gets length 1."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used]
    while True:
        shift = (2 * len(used)).bit_length()  # a heap of weights, with the node in the low bits
        heap = [(w << shift) | i for i, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        mask, parent = (1 << shift) - 1, [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a & mask] = parent[b & mask] = node
            heapq.heapreplace(heap, (((a >> shift) + (b >> shift)) << shift) | node)
        depth = [0] * (2 * len(used) - 1)
        for node in range(2 * len(used) - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[: len(used)]) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        weights = (weights + 1) // 2


@cache
def _reversal(bits: int) -> np.ndarray:
    """Each number of ``bits`` bits with its bits in reverse order."""
    found = np.zeros(1, np.int64)
    for _ in range(bits):
        found = np.concatenate((found << 1, (found << 1) | 1))
    return found


def _in_code_order(lengths: np.ndarray) -> np.ndarray:
    """The used symbols in the order of their canonical codes."""
    used = np.flatnonzero(lengths)
    return used[np.argsort(lengths[used], kind="stable")]


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of at most 15 bits, with the bit that is read first lowest."""
    codes = np.zeros(len(lengths), np.int64)
    order = _in_code_order(lengths)
    spans = 1 << (15 - lengths[order])
    codes[order] = _reversal(15)[np.cumsum(spans) - spans]
    return codes


class PrefixCode:
    """Lookup from the next ``bits`` bits to symbol * 16 + length."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        order = _in_code_order(lengths)
        if not len(order):
            raise WebpError("a prefix code has no symbols")
        self.single, self.highest = None, int(order.max())
        if len(order) == 1:
            self._of_one(self.highest)
            return
        sizes = lengths[order]
        self.bits = int(sizes[-1])
        spans = 1 << (self.bits - sizes)
        if spans.sum() != 1 << self.bits:
            raise WebpError("a prefix code is not complete")
        self.table = np.repeat(((order << 4) | sizes).astype(np.uint32), spans)[_reversal(self.bits)]

    def _of_one(self, symbol: int) -> None:
        self.single = self.highest = symbol
        self.bits, self.table = 0, np.array([symbol << 4], np.uint32)

    @classmethod
    def of_one(cls, symbol: int) -> PrefixCode:
        """The code of one symbol, which takes no bits."""
        code = cls.__new__(cls)
        code._of_one(symbol)
        return code


class BitReader:
    def __init__(self, data: bytes):
        self.data = data + bytes(8)
        self.end, self.at = len(data) * 8, 0

    def peek(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.skip(n)
        return value

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise WebpError("the data ends early")

    def symbol(self, code: PrefixCode) -> int:
        entry = int(code.table[self.peek() & ((1 << code.bits) - 1)])
        self.skip(entry & 15)
        return entry >> 4


def _read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first, bits.read(8)] if two else [first]
        if max(symbols) >= alphabet:
            raise WebpError("a symbol is not in its alphabet")
        if len(set(symbols)) == 1:
            return PrefixCode.of_one(first)
        lengths = np.zeros(alphabet, np.int64)
        lengths[symbols] = 1
        return PrefixCode(lengths)
    first, listed = [0] * 19, 4 + bits.read(4)
    stated = bits.read(3 * listed)
    for k in CODE_LENGTH_ORDER[:listed]:
        first[k] = stated & 7
        stated >>= 3
    code = PrefixCode(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, mask, data, at = code.table.tolist(), (1 << code.bits) - 1, bits.data, bits.at
    sizes, last = [], 8
    while len(sizes) < alphabet and left:
        left -= 1
        byte = at >> 3
        ahead = int.from_bytes(data[byte : byte + 4], "little") >> (at & 7)  # 25 bits, of which 14 are needed at most
        entry = table[ahead & mask]
        size = entry >> 4
        at += entry & 15
        if size < 16:
            sizes.append(size)
            last = size or last
            continue
        more = (2, 3, 7)[size - 16]
        repeat = ((ahead >> (entry & 15)) & ((1 << more) - 1)) + (3, 3, 11)[size - 16]
        at += more
        sizes += [last if size == 16 else 0] * repeat
    bits.skip(at - bits.at)
    if len(sizes) > alphabet:
        raise WebpError("code lengths run over their alphabet")
    return PrefixCode(sizes)


# ---------------------------------------------------------------- entropy-coded images


def _prefix_value(bits: BitReader, symbol: int) -> int:
    """Value of a length or distance symbol with its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _plain_distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = DISTANCE_PLANE[code - 1]
    return max(1, dy * width + dx)


class _Literals:
    """Pixel starts of literal runs of one code group, a window of bits at a time."""

    def __init__(self, bits: BitReader, codes: list[PrefixCode]):
        self.bits, self.codes, self.lo, self.hi = bits, codes, 0, 0
        self.raw = np.frombuffer(bits.data, dtype=np.uint8)

    def _fill(self) -> None:
        self.lo = self.bits.at & ~7
        first = self.lo >> 3
        n_bytes = min(WINDOW_BITS >> 3, len(self.raw) - 8 - first)
        own = self.raw[first : first + n_bytes + 2].astype(np.int64)
        ahead = ((own[:-2] | (own[1:-1] << 8) | (own[2:] << 16))[:, None] >> np.arange(8)).ravel()  # 17 bits at least
        n = n_bytes * 8
        self.hi = self.lo + n
        self.looked = []
        follow = None
        for code in self.codes[:4]:  # green, red, blue, alpha
            if code.single is not None:
                self.looked.append(None)
                continue
            entry = code.table.take(ahead & ((1 << code.bits) - 1), mode="clip")  # all are inside; "clip" spares numpy a look
            self.looked.append(entry)
            if follow is None:
                follow = np.arange(n)
                follow += entry & np.uint32(15)
                continue
            inside = np.minimum(follow, n - 1)
            follow = np.where(follow < n, inside + (entry[inside] & np.uint32(15)), n)
        green = self.codes[0]
        if green.highest >= 256:  # a single one is a literal here, see run
            follow[self.looked[0] >= (256 << 4)] = -1
        self.next = memoryview(follow)
        self.size = n
        self.hops = None
        if green.highest < 256:  # then sixteen pixels can be stepped over at a time
            one = np.full(n + 1, n)
            np.minimum(follow, n, out=one[:n])
            hops = [one]
            while len(hops) < 5:
                hops.append(hops[-1].take(hops[-1], mode="clip"))
            self.by_sixteen, self.hops = memoryview(hops.pop()), hops[::-1]

    def run(self, most: int) -> np.ndarray:
        """Up to ``most`` literal pixels from the reader's place on, and moves it behind them."""
        if self.codes[0].single is not None and self.codes[0].single >= 256:
            return np.empty(0, np.uint32)
        if all(c.single is not None for c in self.codes[:4]):
            return np.full(most, self._pixel_of([c.single for c in self.codes[:4]]), np.uint32)
        parts = []
        while most:
            if not (self.lo <= self.bits.at and self.bits.at + 64 <= self.hi):
                self._fill()
            # starts this near the end of the window belong to the next one, unless the data ends here
            stop = self.size - 64 if self.hi < self.bits.end else self.size
            p, places, following = self.bits.at - self.lo, [], self.next
            add = places.append
            if self.hops is not None and most >= 64:
                by_sixteen, last = self.by_sixteen, min(stop, self.size - 16 * sum(c.bits for c in self.codes[:4]))
                for _ in range(most >> 4):
                    if p >= last:
                        break
                    add(p)
                    p = by_sixteen[p]
                if places:
                    starts = np.array(places)
                    for hop in self.hops:
                        starts = np.stack((starts, hop[starts]), axis=1).ravel()
                    parts.append(self._pixels(starts))
                    most -= len(starts)
                    self.bits.at = self.lo + p
                    continue
            for _ in range(most):
                if p >= stop:
                    break
                q = following[p]
                if q < 0:
                    break
                add(p)
                p = q
            if not places:
                break
            self.bits.at = self.lo + p
            if self.bits.at > self.bits.end:
                raise WebpError("the data ends early")
            parts.append(self._pixels(np.array(places)))
            most -= len(places)
            if p < stop:
                break
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    @staticmethod
    def _pixel_of(values: list) -> np.ndarray:
        green, red, blue, alpha = values
        return (alpha << 24) | (red << 16) | (green << 8) | blue

    def _pixels(self, places: np.ndarray) -> np.ndarray:
        values = []
        for code, looked in zip(self.codes, self.looked):
            if looked is None:
                values.append(np.uint32(code.single))
                continue
            entry = looked[places]
            values.append(entry >> np.uint32(4))
            places = places + (entry & np.uint32(15))
        return self._pixel_of(values).astype(np.uint32)


def _read_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    meta, meta_bits, meta_width = None, 0, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta_width = (width + (1 << meta_bits) - 1) >> meta_bits
        meta = (_read_image(bits, meta_width, (height + (1 << meta_bits) - 1) >> meta_bits, False) >> np.uint32(8)) & np.uint32(0xFFFF)
    groups = int(meta.max()) + 1 if meta is not None else 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n) for n in (256 + 24 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    pixels = np.zeros(total, np.uint32)
    cache = np.zeros(max(1, cache_size), np.uint32)
    cached = 0  # pixels that are in the cache already

    def remember(upto: int) -> None:
        nonlocal cached
        if cache_bits and upto > cached:
            some = pixels[cached:upto]
            cache[(some * np.uint32(HASH)) >> np.uint32(32 - cache_bits)] = some
        cached = upto

    literals = _Literals(bits, codes[0]) if meta is None else None
    at = 0
    while at < total:
        if literals is not None:
            run = literals.run(total - at)
            pixels[at : at + len(run)] = run
            at += len(run)
            if at == total:
                break
            own = codes[0]
        else:
            y, x = divmod(at, width)
            own = codes[int(meta[(y >> meta_bits) * meta_width + (x >> meta_bits)])]
        green = bits.symbol(own[0])
        if green < 256:
            red, blue, alpha = bits.symbol(own[1]), bits.symbol(own[2]), bits.symbol(own[3])
            pixels[at] = (alpha << 24) | (red << 16) | (green << 8) | blue
            at += 1
        elif green < 280:
            length = _prefix_value(bits, green - 256)
            distance = _plain_distance(_prefix_value(bits, bits.symbol(own[4])), width)
            if distance > at or at + length > total:
                raise WebpError("a back-reference leaves the image")
            if distance >= length:
                pixels[at : at + length] = pixels[at - distance : at - distance + length]
            else:
                pixels[at : at + length] = np.resize(pixels[at - distance : at], length)
            at += length
        else:
            remember(at)
            pixels[at] = cache[green - 280]
            at += 1
    return pixels


# ---------------------------------------------------------------- transforms


def _channels(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4").ravel()


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    to_left, to_top = np.abs(top - corner).sum(axis=-1, keepdims=True), np.abs(left - corner).sum(axis=-1, keepdims=True)
    return np.where(to_left < to_top, left, top)


def _predicted(mode: int, left, top, corner, right):
    """Prediction of the given mode; arguments are arrays of channel values, signed."""
    if mode == 0:
        return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(top))
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode < 10:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = _average(left, top)
    half = mean - corner
    return np.clip(mean + np.trunc(half / 2).astype(np.int64), 0, 255)


_NEEDS_LEFT = {1, 5, 6, 7, 10, 11, 12, 13}


def _predict(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Residuals of an image, or the image of residuals; modes by block of 2**bits pixels a side."""
    image = _channels(pixels).astype(np.int64).reshape(height, width, 4)
    out = image.copy()
    known = image if forward else out
    sign = -1 if forward else 1
    blocks = (width + (1 << bits) - 1) >> bits
    black = np.array([0, 0, 0, 255])
    out[0, 0] = (image[0, 0] + sign * black) & 255
    if forward:
        out[0, 1:] = (image[0, 1:] - image[0, :-1]) & 255
    else:
        out[0] = np.cumsum(np.concatenate((out[0, :1], image[0, 1:])), axis=0) & 255
    for y in range(1, height):
        out[y, 0] = (image[y, 0] + sign * known[y - 1, 0]) & 255
        for b in range(blocks):
            lo, hi = max(1, b << bits), min(width, (b + 1) << bits)
            if lo >= hi:
                continue
            mode = int(modes[(y >> bits) * blocks + b])
            top, corner = known[y - 1, lo:hi], known[y - 1, lo - 1 : hi - 1]
            right = known[y - 1, lo + 1 : hi + 1]
            if hi == width:  # the pixel right of a row's last is the first of the row below it
                right = np.concatenate((known[y - 1, lo + 1 : hi], known[y, :1]))
            if forward or mode not in _NEEDS_LEFT:
                left = known[y, lo - 1 : hi - 1]
                out[y, lo:hi] = (image[y, lo:hi] + sign * _predicted(mode, left, top, corner, right)) & 255
            elif mode == 1:
                out[y, lo:hi] = (np.cumsum(np.concatenate((out[y, lo - 1 : lo], image[y, lo:hi])), axis=0)[1:]) & 255
            else:
                for x in range(hi - lo):
                    p = _predicted(mode, out[y, lo + x - 1], top[x], corner[x], right[x])
                    out[y, lo + x] = (image[y, lo + x] + p) & 255
    return _packed(out.reshape(-1, 4))


def _cross_colour(pixels: np.ndarray, width: int, height: int, factors: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    blocks = (width + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(width * height), width)
    own = _channels(factors)[(y >> bits) * blocks + (x >> bits)].view(np.int8).astype(np.int64)
    to_red, to_blue, red_to_blue = own[:, 0], own[:, 1], own[:, 2]
    image = _channels(pixels).astype(np.int64)
    signed = lambda v: ((v & 255) ^ 128) - 128
    green, red, blue = signed(image[:, 1]), image[:, 2], image[:, 0]
    sign = -1 if forward else 1
    new_red = (red + sign * ((to_red * green) >> 5)) & 255
    base = signed(red if forward else new_red)
    image[:, 2] = new_red
    image[:, 0] = (blue + sign * (((to_blue * green) >> 5) + ((red_to_blue * base) >> 5))) & 255
    return _packed(image)


def _subtract_green(pixels: np.ndarray, forward: bool) -> np.ndarray:
    image = _channels(pixels).copy()
    green = image[:, 1:2]
    image[:, [0, 2]] = image[:, [0, 2]] - green if forward else image[:, [0, 2]] + green
    return _packed(image)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unbundle(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    shift = _bundle_bits(len(palette))
    per, size = 1 << shift, 8 >> shift
    packed_width = (width + per - 1) >> shift
    green = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(height, packed_width)
    index = (green[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(size))) & np.uint32((1 << size) - 1)
    index = index.reshape(height, packed_width * per)[:, :width].ravel()
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels of a lossless WebP file."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebpError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if 20 + size > len(data) or data[20] != 0x2F:
        raise WebpError("the chunk is cut or has no signature")
    bits = BitReader(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha, version = bits.read(1), bits.read(3)
    if version:
        raise WebpError("unknown version")
    pixels = decode_stream(bits, width, height)
    if not has_alpha:
        pixels = pixels | np.uint32(0xFF000000)
    return width, height, pixels


def decode_stream(bits: BitReader, width: int, height: int) -> np.ndarray:
    """Pixels of an image stream, transforms first, as it stands behind a file's header (and alone in the alpha chunk of a lossy file)."""
    undo, now_width, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            side = lambda n: (n + (1 << block) - 1) >> block  # noqa: B023, E731
            inner = _read_image(bits, side(now_width), side(height), False)
            undo.append((kind, now_width, inner, block))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, now_width, None, 0))
        else:
            colours = bits.read(8) + 1
            steps = _channels(_read_image(bits, colours, 1, False))
            palette = _packed(np.cumsum(steps.astype(np.int64), axis=0) & 255)
            undo.append((kind, now_width, palette, 0))
            shift = _bundle_bits(colours)
            now_width = (now_width + (1 << shift) - 1) >> shift
    pixels = _read_image(bits, now_width, height, True)
    for kind, own_width, inner, block in reversed(undo):
        if kind == PREDICTOR:
            modes = ((inner >> np.uint32(8)) & np.uint32(15)).astype(np.int64)
            pixels = _predict(pixels, own_width, height, np.where(modes > 13, 0, modes), block, False)
        elif kind == CROSS_COLOUR:
            pixels = _cross_colour(pixels, own_width, height, inner, block, False)
        elif kind == SUBTRACT_GREEN:
            pixels = _subtract_green(pixels, False)
        else:
            pixels = _unbundle(pixels, own_width, height, inner)
    return pixels


# ---------------------------------------------------------------- encoder


class BitWriter:
    """Values and their sizes (60 bits at most), packed at the end."""

    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.done: list[tuple[np.ndarray, np.ndarray]] = []

    def write(self, value: int, size: int) -> None:
        if size:
            self.values.append(value)
            self.sizes.append(size)

    def write_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.done.append((values, sizes))

    def _flush(self) -> None:
        if self.values:
            self.done.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self._flush()
        return _packed_bits(*(np.concatenate(x) for x in zip(*self.done))) if self.done else b""


def _packed_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bits of each value, lowest first, one behind the other."""
    ends = np.cumsum(sizes)
    at, total = ends - sizes, int(ends[-1]) if len(ends) else 0
    word, shift, low = at >> 5, at & 31, np.int64(0xFFFFFFFF)
    # values share no bit, so the bits of a word of 32 are the sum of what falls into it
    n = (total >> 5) + 4
    words = lambda first, parts: np.bincount(word + first, parts, n).astype(np.int64)
    near = (values & low) << shift
    found = words(0, near & low) + words(1, near >> 32)
    if sizes.max(initial=0) > 32:
        far = (values >> 32) << shift
        found += words(1, far & low) + words(2, far >> 32)
    return found.astype("<u4").tobytes()[: (total + 7) >> 3]


def _write_single(out: BitWriter, symbol: int) -> None:
    """The code of one symbol under 256."""
    out.write(0b101 | (symbol << 3), 11)


def _write_code(out: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = [int(s) for s in used] or [0]
        out.write(1, 1)
        out.write(len(symbols) - 1, 1)
        out.write(1, 1)
        for s in symbols:
            out.write(s, 8)
        return
    tokens, at = [], 0
    for symbol, size in [*zip(used.tolist(), lengths[used].tolist()), (len(lengths), 0)]:
        gap = symbol - at
        while gap:
            run = min(gap, 138)
            tokens += [(18, run - 11, 7)] if run >= 11 else [(17, run - 3, 3)] if run >= 3 else [(0, 0, 0)] * run
            gap -= run
        if size:
            tokens.append((size, 0, 0))
        at = symbol + 1
    inner = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    codes, single, inner = reversed_codes(inner).tolist(), np.count_nonzero(inner) == 1, inner.tolist()
    count = max(4, max(k for k, s in enumerate(CODE_LENGTH_ORDER) if inner[s]) + 1)
    out.write(0, 1)
    out.write(count - 4, 4)
    for s in CODE_LENGTH_ORDER[:count]:
        out.write(inner[s], 3)
    out.write(0, 1)
    if single:  # it takes no bits
        codes = inner = [0] * 19
    out.values += [codes[t] | (extra << inner[t]) for t, extra, _ in tokens]
    out.sizes += [inner[t] + size for t, _, size in tokens]


def _prefix_symbol(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits' value and size of a length or distance code."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = (value >> (high - 1)) & 1
    return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1


def _write_runs(out: BitWriter, channels: np.ndarray, copies: list[tuple[int, int, int]]) -> None:
    """Codes and tokens of an image of literal pixels and back-references, without a colour cache; a token is one value of at most 60 bits."""
    own = channels
    if copies:
        covered = np.zeros(len(channels), bool)
        for place, length, _ in copies:
            covered[place : place + length] = True
        literal = np.flatnonzero(~covered)
        own = channels[literal]
    pairs = [(_prefix_symbol(length), _prefix_symbol(distance + 120)) for _, length, distance in copies]
    green = np.concatenate((own[:, 1], np.array([256 + x[0] for x, _ in pairs], np.int64)))
    streams = [green, own[:, 2], own[:, 0], own[:, 3], np.array([y[0] for _, y in pairs], np.int64)]
    values, sizes, stated = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), []
    for k, (symbols, alphabet) in enumerate(zip(streams, (280, 256, 256, 256, 40))):
        only = int(symbols[0]) if len(symbols) else 0
        if only < 256 and (symbols == only).all():
            _write_single(out, only)
            stated.append(None)
            continue
        lengths = code_lengths(np.bincount(symbols, minlength=alphabet), 15)
        _write_code(out, lengths)
        stated.append((reversed_codes(lengths), lengths) if np.count_nonzero(lengths) > 1 else None)  # a single symbol takes no bits
        if k < 4 and stated[-1]:
            used = symbols[: len(own)]
            values |= stated[-1][0][used] << sizes
            sizes += lengths[used]
    if copies:
        more, wide = [], []
        coded = lambda k, symbol: (int(stated[k][0][symbol]), int(stated[k][1][symbol])) if stated[k] else (0, 0)
        for (symbol, extra, bits), (far, far_extra, far_bits) in pairs:
            value, size = 0, 0
            for v, n in (coded(0, 256 + symbol), (extra, bits), coded(4, far), (far_extra, far_bits)):
                value, size = value | (v << size if n else 0), size + n
            more.append(value)
            wide.append(size)
        order = np.argsort(np.concatenate((literal, [place for place, _, _ in copies])), kind="stable")
        values, sizes = np.concatenate((values, more))[order], np.concatenate((sizes, wide))[order]
    out.write_many(values.astype(np.int64), sizes.astype(np.int64))


def _write_image(
    out: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int = 0, copies: list[tuple[int, int, int]] = (), groups: np.ndarray | None = None, group_bits: int = 2, width: int = 0
) -> None:
    """copies: (place, length, distance) of back-references, in order; groups: the code group of each block of 2**group_bits pixels a side."""
    cache_size = 1 << cache_bits if cache_bits else 0
    out.write(1 if cache_bits else 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if main:
        out.write(0 if groups is None else 1, 1)
        if groups is not None:
            out.write(group_bits - 2, 3)
            _write_image(out, (np.asarray(groups, np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), False)
    channels = _channels(pixels)
    if not cache_bits and groups is None:
        _write_runs(out, channels, list(copies))
        return
    across = (width + (1 << group_bits) - 1) >> group_bits
    group_of = lambda at: 0 if groups is None else int(groups[(at // width >> group_bits) * across + (at % width >> group_bits)])
    tokens: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # code group, and (code, symbol, extra, size)
    cache, at = {}, 0
    starts = {p: (n, d) for p, n, d in copies}
    while at < len(pixels):
        if at in starts:
            n, d = starts[at]
            token = [(0, 256 + (s := _prefix_symbol(n))[0], s[1], s[2]), (4, (s := _prefix_symbol(d + 120))[0], s[1], s[2])]
            step = n
        else:
            value = int(pixels[at])
            slot = ((value * HASH) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache.get(slot) == value:
                token = [(0, 280 + slot, 0, 0)]
            else:
                b, g, r, a = channels[at].tolist()
                token = [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
            step = 1
        tokens.append((group_of(at), token))
        if cache_bits:
            for v in pixels[at : at + step].tolist():
                cache[((v * HASH) & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        at += step
    counts = [[np.zeros(n, np.int64) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(1 if groups is None else int(np.max(groups)) + 1)]
    for group, token in tokens:
        for code, symbol, _, _ in token:
            counts[group][code][symbol] += 1
    lengths = [[code_lengths(c, 15) for c in own] for own in counts]
    codes = [[reversed_codes(x) for x in own] for own in lengths]
    for own in lengths:
        for each in own:
            _write_code(out, each)
    for group, token in tokens:
        for code, symbol, extra, size in token:
            if np.count_nonzero(lengths[group][code]) > 1:
                out.write(int(codes[group][code][symbol]), int(lengths[group][code][symbol]))
            out.write(extra, size)


@dataclass
class Options:
    """What the encoder applies, in this order: palette alone, or cross-colour, subtract-green and predictor.

    modes and factors have a value for each block of 2**block pixels a side, groups (of prefix codes) for each of 2**group_bits.
    """

    palette: bool = False
    factors: np.ndarray | None = None
    subtract_green: bool = False
    modes: np.ndarray | None = None
    block: int = 9
    cache_bits: int = 0
    copies: list[tuple[int, int, int]] = field(default_factory=list)
    groups: np.ndarray | None = None
    group_bits: int = 2


def encode(width: int, height: int, pixels: np.ndarray, options: Options = Options()) -> bytes:  # noqa: B008
    """A lossless WebP file of ARGB pixels."""
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE) or len(pixels) != width * height:
        raise ValueError("width, height and pixels do not fit")
    pixels, out = np.asarray(pixels, np.uint32), BitWriter()
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)
    if options.palette:
        palette, index = np.unique(pixels, return_inverse=True)
        if len(palette) > 256:
            raise ValueError("more than 256 colours")
        out.write(1, 1)
        out.write(PALETTE, 2)
        out.write(len(palette) - 1, 8)
        steps = _channels(palette).astype(np.int64)
        _write_image(out, _packed(np.diff(steps, axis=0, prepend=0) & 255), False)
        shift = _bundle_bits(len(palette))
        per, size = 1 << shift, 8 >> shift
        wide = (width + per - 1) >> shift
        rows = np.zeros((height, wide * per), np.uint32)
        rows[:, :width] = index.reshape(height, width)
        green = (rows.reshape(height, wide, per) << (np.arange(per, dtype=np.uint32) * np.uint32(size))).sum(axis=2, dtype=np.uint32)
        pixels = (green.ravel() << np.uint32(8)) | np.uint32(0xFF000000)
    for kind, inner in ((CROSS_COLOUR, options.factors), (SUBTRACT_GREEN, options.subtract_green or None), (PREDICTOR, options.modes)):
        if inner is None:
            continue
        out.write(1, 1)
        out.write(kind, 2)
        if kind == SUBTRACT_GREEN:
            pixels = _subtract_green(pixels, True)
            continue
        out.write(options.block - 2, 3)
        if kind == PREDICTOR:
            _write_image(out, (np.asarray(inner, np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), False)
            pixels = _predict(pixels, width, height, inner, options.block, True)
        else:
            _write_image(out, np.asarray(inner, np.uint32) | np.uint32(0xFF000000), False)
            pixels = _cross_colour(pixels, width, height, np.asarray(inner, np.uint32), options.block, True)
    out.write(0, 1)
    _write_image(out, pixels, True, options.cache_bits, options.copies, options.groups, options.group_bits, wide if options.palette else width)
    chunk = b"\x2f" + out.bytes()
    body = b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + bytes(len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body
