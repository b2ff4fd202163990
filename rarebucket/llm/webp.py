"""Lossless WebP (RIFF container, VP8L bit stream), read and written with numpy.

The reader takes any stream of the format: prefix codes (simple and full, one group or many), back-references,
colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Pixels are read in bulk: for
every bit position of a window the code lengths of a whole pixel are looked up at once, and following the chain from pixel
to pixel then takes one step each. What the colour cache stands for is found afterwards, for all pixels at once. Images with
several groups of codes are read pixel by pixel.

Pixels are 32-bit ARGB numbers. Damaged or cut streams raise ValueError.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (x, y) of distance codes 1 to 120: x to the left, y up.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR, BLACK = 0x1E35A7BD, 0xFF000000
PREDICTOR, CROSS, SUBTRACT_GREEN, PALETTE = range(4)
LENGTHS, DISTANCES, LITERALS = 24, 40, 256
SIDE = 1 << 14

#: Coded bytes that are looked up at once.
WINDOW = 1 << 16


# --- prefix codes ---------------------------------------------------------------------------------------------------


class Code:
    """Lookup of a canonical prefix code: by the next ``width`` bits of the stream, the symbol and its length."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) < 2:  # one symbol takes no bits
            self.width, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0], np.int32), np.zeros(1, np.uint8)
            return
        n = lengths[used].astype(np.int64)
        self.width = int(n.max())
        if int((1 << (self.width - n)).sum()) != 1 << self.width:
            raise ValueError("the prefix code isn't complete")
        order = np.lexsort((used, n))
        n, used = n[order], used[order]
        # canonical codes on end are an ascending fill of the table in reversed bit order
        filled_symbol, filled_length = np.repeat(used, 1 << (self.width - n)), np.repeat(n, 1 << (self.width - n))
        turned = reversed_bits(np.arange(1 << self.width), self.width)
        self.symbol, self.length = filled_symbol[turned].astype(np.int32), filled_length[turned].astype(np.uint8)


def reversed_bits(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros_like(values)
    for k in range(width):
        out |= (values >> k & 1) << (width - 1 - k)
    return out


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of an optimal prefix code, by merging the two rarest; counts are levelled until no length is over ``most``."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = {int(s): int(counts[s]) for s in used}
    while True:
        heap = [(w, s, (s,)) for s, w in weight.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(weight, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            break
        weight = {s: w // 2 + 1 for s, w in weight.items()}
    for s, d in depth.items():
        out[s] = d
    return out


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The word of each symbol as it stands in the stream, first bit lowest."""
    out, word, last = np.zeros(len(lengths), np.int64), 0, 0
    if np.count_nonzero(lengths) < 2:
        return out
    for n, s in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        word <<= n - last
        out[s], last = int(reversed_bits(np.array([word]), n)[0]), n
        word += 1
    return out


# --- reading --------------------------------------------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + (n + 14) // 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream ends early")
        out = self.peek(n)
        self.at += n
        return out

    def symbol(self, code: Code) -> int:
        k = self.peek(code.width)
        self.at += int(code.length[k])
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return int(code.symbol[k])

    def value(self, prefix: int) -> int:
        """Length or distance of a prefix symbol and its extra bits."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.take(extra) + 1


def read_code(bits: Reader, alphabet: int) -> Code:
    lengths = np.zeros(max(alphabet, LITERALS), np.int64)
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        lengths[bits.take(8 if wide else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return Code(lengths)
    order = np.zeros(len(LENGTH_ORDER), np.int64)
    for s in LENGTH_ORDER[: 4 + bits.take(4)]:
        order[s] = bits.take(3)
    code = Code(order)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
            continue
        n = {16: 3, 17: 3, 18: 11}[s] + bits.take({16: 2, 17: 3, 18: 7}[s])
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = last if s == 16 else 0
        at += n
    return Code(lengths)


#: Groups of codes by the bits that describe them, by their number: {bits: {cache: {described: codes}}}.
_known: dict[tuple[int, int], dict[int, tuple[Code, ...]]] = {}


def read_group(bits: Reader, cache: int) -> tuple[Code, ...]:
    """The five codes. Equal descriptions give equal codes, so the latest descriptions are remembered."""
    ahead = bits.peek(8 * 768)
    for (n, size), found in _known.items():
        if size == cache and bits.at + n <= bits.end and (codes := found.get(ahead & ((1 << n) - 1))):
            bits.at += n
            return codes
    began = bits.at
    codes = tuple(read_code(bits, n) for n in (LITERALS + LENGTHS + (1 << cache if cache else 0), LITERALS, LITERALS, LITERALS, DISTANCES))
    n = bits.at - began
    if n <= 8 * 768:
        if len(_known) >= 16:
            _known.clear()
        _known.setdefault((n, cache), {})[ahead & ((1 << n) - 1)] = codes
    return codes


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def copy(out: np.ndarray, at: int, n: int, back: int) -> None:
    if back > at or at + n > len(out):
        raise ValueError("a back-reference leaves the image")
    if back >= n:
        out[at : at + n] = out[at - back : at - back + n]
    else:
        out[at : at + n] = np.resize(out[at - back : at], n)


def read_pixels(bits: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as a flat array; only the top one can have several groups of codes."""
    cache = bits.take(4) if bits.take(1) else 0
    if cache > 11:
        raise ValueError("the colour cache is too large")
    groups, which, step = 1, None, 0
    if top and bits.take(1):
        step = bits.take(3) + 2
        across = -(-width >> step)
        meta = read_pixels(bits, across, -(-height >> step), False)
        which = (meta >> 8 & 0xFFFF).astype(np.int64)
        groups = int(which.max()) + 1
    codes = [read_group(bits, cache) for _ in range(groups)]
    out = np.zeros(width * height, np.uint32)
    if which is None:
        read_bulk(bits, codes[0], out, width, cache)
        return out
    table = np.zeros(1 << cache, np.uint32) if cache else None
    at, last = 0, 0  # pixels before last are in the cache
    while at < len(out):
        group = codes[0] if which is None else codes[which[(at // width >> step) * across + (at % width >> step)]]
        s = bits.symbol(group[0])
        if s < LITERALS:
            red, blue, alpha = (bits.symbol(c) for c in group[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < LITERALS + LENGTHS:
            n = bits.value(s - LITERALS)
            copy(out, at, n, distance(bits.value(bits.symbol(group[4])), width))
            at += n
        else:
            for p in out[last:at].tolist():
                table[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache)] = p
            last = at
            out[at] = table[s - LITERALS - LENGTHS]
            at += 1
    return out


def slots(pixels: np.ndarray, cache: int) -> np.ndarray:
    """The places of pixels in a colour cache of 2^cache entries."""
    return pixels * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache)


def undo_cache(out: np.ndarray, asked: np.ndarray, copies: list[tuple[int, int, int]], cache: int) -> None:
    """Fill in the pixels that stand for an entry of the cache (``asked`` >= 0) or are copies (first, how many, distance).

    An entry is the latest pixel before with the same place, and every pixel's place is known without its
    value: a literal's from the literal, the others' from the stream. So each such pixel points to the one that it repeats.
    """
    place = np.where(asked >= 0, asked, slots(out, cache).astype(np.int64))
    source, own = np.arange(len(out)), asked < 0
    for at, n, back in copies:
        copy(place, at, n, back)
        source[at : at + n] = np.resize(np.arange(at - back, at), n) if back < n else np.arange(at - back, at - back + n)
    order = np.argsort(place, kind="stable")
    first = np.ones(len(out), bool)
    first[1:] = place[order[1:]] != place[order[:-1]]
    begins = np.maximum.accumulate(np.where(first, np.arange(len(out)), 0))
    latest = np.maximum.accumulate(np.where(own[order], np.arange(len(out)), -1))
    hit = ~own[order]
    none = hit & (latest < begins)  # an entry that nothing was put in is 0
    source[order[hit]] = order[np.maximum(latest[hit], 0)]
    empty = np.zeros(len(out), bool)
    empty[order[none]] = True
    source[empty] = np.flatnonzero(empty)
    out[empty] = 0
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    out[:] = out[source]


def read_bulk(bits: Reader, codes: tuple[Code, ...], out: np.ndarray, width: int, cache: int = 0) -> None:
    """Fill ``out`` from a stream with one group of codes."""
    green, at, n = codes[0], 0, len(out)
    entries = LITERALS + LENGTHS  # from here on, symbols are entries of the cache
    asked, copies = np.full(n if cache else 0, -1), []
    if not any(c.width for c in codes[:4]) and green.symbol[0] < LITERALS:
        out[:] = int(codes[3].symbol[0]) << 24 | int(codes[1].symbol[0]) << 16 | int(green.symbol[0]) << 8 | int(codes[2].symbol[0])
        return
    data = np.frombuffer(bits.data, np.uint8)
    alike = all(c.width == green.width and np.array_equal(c.length, green.length) for c in codes[1:4])
    while at < n:
        first = bits.at >> 3
        chunk = np.zeros(min(WINDOW, len(data) - first) + 12, np.uint32)
        have = data[first : first + len(chunk)]
        chunk[: len(have)] = have
        ahead = chunk[:-2] | chunk[1:-1] << np.uint32(8) | chunk[2:] << np.uint32(16)
        every = np.empty((len(ahead), 8), np.uint32)  # the next bits at each bit position
        for k in range(8):
            every[:, k] = ahead >> np.uint32(k)
        every = every.ravel()
        ends = len(every)
        here = np.arange(ends, dtype=np.int32)

        def steps(code: Code) -> np.ndarray:
            return np.minimum(here + code.length[every & np.uint32((1 << code.width) - 1)], np.int32(ends - 1))  # noqa: B023

        one = steps(green)
        if alike:
            two = one[one]
            after = two[two]
        else:
            after = one
            for c in codes[1:4]:
                after = steps(c)[after]
        symbol = green.symbol[every & np.uint32((1 << green.width) - 1)]
        if cache:
            after = np.where(symbol >= entries, one, after)
        after[(symbol >= LITERALS) & (symbol < entries)] = -1
        after[-8 * 10 :] = -2  # so near the end of the window a pixel may be cut
        go = memoryview(after)
        pos, begun, met = bits.at & 7, at, []
        limit = n - at
        while len(met) < limit:
            nxt = go[pos]
            if nxt < 0:
                break
            met.append(pos)
            pos = nxt
        if met:
            where = np.array(met, np.int32)
            parts = []
            if cache:
                hit = symbol[where] >= entries
                asked[begun : begun + len(met)] = np.where(hit, symbol[where] - entries, -1)
            for c in codes[:4]:
                k = every[np.minimum(where, ends - 1)] & np.uint32((1 << c.width) - 1)
                parts.append(c.symbol[k].astype(np.uint32))
                where = where + c.length[k]
            out[begun : begun + len(met)] = parts[3] << np.uint32(24) | parts[1] << np.uint32(16) | parts[0] << np.uint32(8) | parts[2]
            at += len(met)
        bits.at = 8 * first + pos
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        if at < n and go[pos] == -1:
            s = bits.symbol(green)
            length = bits.value(s - LITERALS)
            back = distance(bits.value(bits.symbol(codes[4])), width)
            copy(out, at, length, back)
            copies.append((at, length, back))
            at += length
        elif at < n and not met and bits.at >= bits.end - 1:
            raise ValueError("the stream ends early")
    if cache:
        undo_cache(out, asked, copies, cache)


def halves(a: int, b: int) -> int:
    """Mean of two pixels, channel by channel, rounded down."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def joined(parts: Sequence[int]) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def predict(mode: int, left: int, above: int, above_left: int, above_right: int) -> int:
    if mode == 5:
        return halves(halves(left, above_right), above)
    if mode == 6:
        return halves(left, above_left)
    if mode == 7:
        return halves(left, above)
    if mode == 8:
        return halves(above_left, above)
    if mode == 9:
        return halves(above, above_right)
    if mode == 10:
        return halves(halves(left, above_left), halves(above, above_right))
    if mode in (11, 12):
        l, t, c = channels(left), channels(above), channels(above_left)
        if mode == 11:
            to_left, to_above = sum(abs(y - z) for y, z in zip(t, c, strict=True)), sum(abs(x - z) for x, z in zip(l, c, strict=True))
            return left if to_left < to_above else above
        return joined([min(255, max(0, x + y - z)) for x, y, z in zip(l, t, c, strict=True)])
    if mode == 13:
        mean, c = channels(halves(left, above)), channels(above_left)
        return joined([min(255, max(0, x + int((x - z) / 2))) for x, z in zip(mean, c, strict=True)])
    return (BLACK, left, above, above_right, above_left)[mode] if mode < 5 else BLACK


def plus(a: int, b: int) -> int:
    """Sum of two pixels, each channel modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def minus(a: int, b: int) -> int:
    return joined([(x - y) & 255 for x, y in zip(channels(a), channels(b), strict=True)])


def guesses(mode_at, done, x: int, y: int, width: int) -> int:
    """What the predictor transform expects at (x, y), given all pixels before."""
    i = y * width + x
    if not i:
        return BLACK
    if not y:
        return done[i - 1]
    if not x:
        return done[i - width]
    return predict(mode_at(x, y), done[i - 1], done[i - width], done[i - width - 1], done[i - width + 1])


def undo_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, step: int) -> np.ndarray:
    mode = modes >> 8 & 15
    if (mode == mode[0]).all() and mode[0] in (1, 2):  # left or above throughout: running sums
        rest = pixels.copy()
        rest[0] = plus(int(rest[0]), BLACK)
        rest = rest.view(np.uint8).reshape(-1, width, 4)
        rest[0] = np.cumsum(rest[0], axis=0, dtype=np.uint8)
        if mode[0] == 2:
            rest = np.cumsum(rest, axis=0, dtype=np.uint8)
        else:
            rest[:, 0] = np.cumsum(rest[:, 0], axis=0, dtype=np.uint8)
            rest[1:] = np.cumsum(rest[1:], axis=1, dtype=np.uint8)
        return np.ascontiguousarray(rest).view(np.uint32).ravel()
    across, rest, mode = -(-width >> step), pixels.tolist(), mode.tolist()
    look = lambda x, y: mode[(y >> step) * across + (x >> step)]
    for i in range(len(rest)):
        rest[i] = plus(rest[i], guesses(look, rest, i % width, i // width, width))
    return np.array(rest, np.uint32)


def signed(x: np.ndarray) -> np.ndarray:
    return (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)


def cross_terms(pixels_shape: int, width: int, terms: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Per pixel the factors green to red, green to blue, red to blue."""
    i = np.arange(pixels_shape)
    t = terms[(i // width >> step) * -(-width >> step) + (i % width >> step)]
    return signed(t), signed(t >> 8), signed(t >> 16)


def undo_cross(pixels: np.ndarray, width: int, terms: np.ndarray, step: int) -> np.ndarray:
    to_red, to_blue, red_to_blue = cross_terms(len(pixels), width, terms, step)
    green = signed(pixels >> 8)
    red = ((pixels >> 16).astype(np.int32) + (to_red * green >> 5)) & 255
    blue = (pixels.astype(np.int32) + (to_blue * green >> 5) + (red_to_blue * signed(red) >> 5)) & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def undo_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return pixels & np.uint32(0xFF00FF00) | ((pixels >> 16) + green & 255) << np.uint32(16) | (pixels + green & 255)


def packing_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(pixels: np.ndarray, width: int, colours: np.ndarray) -> np.ndarray:
    """``width`` is that of the image; packed pixels hold several indexes each."""
    packed = packing_bits(len(colours))
    size = 8 >> packed
    x = np.arange(width)
    rows = pixels.reshape(-1, -(-width >> packed))
    index = (rows[:, x >> packed] >> (8 + (x & ((1 << packed) - 1)) * size)) & ((1 << size) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index].ravel()


def running_sums(deltas: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(deltas).view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).ravel().view(np.uint32)


def read_stream(data: bytes) -> np.ndarray:
    """A VP8L stream as an array of height x width pixels."""
    bits = Reader(data)
    if bits.take(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    now, undo, seen = width, [], set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            step = bits.take(3) + 2
            data_of = read_pixels(bits, -(-now >> step), -(-height >> step), False)
            undo.append((undo_predictor if kind == PREDICTOR else undo_cross, (now, data_of, step)))
        elif kind == SUBTRACT_GREEN:
            undo.append((undo_green, ()))
        else:
            colours = running_sums(read_pixels(bits, bits.take(8) + 1, 1, False))
            undo.append((undo_palette, (now, colours)))
            now = -(-now >> packing_bits(len(colours)))
    pixels = read_pixels(bits, now, height, True)
    for f, more in reversed(undo):
        pixels = f(pixels, *more)
    return pixels.reshape(height, width)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The image at the start of ``data`` and the bytes that it takes."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP")
    whole, size = int.from_bytes(data[4:8], "little") + 8, int.from_bytes(data[16:20], "little")
    if whole > len(data) or 20 + size > whole:
        raise ValueError("the file ends early")
    return read_stream(data[20 : 20 + size]), whole


# --- writing --------------------------------------------------------------------------------------------------------


class Writer:
    def __init__(self) -> None:
        self.parts: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append((int(value), n))

    def number(self) -> tuple[int, int]:
        """All bits as one number, and how many there are."""
        parts = self.parts
        while len(parts) > 1:
            parts = [(a[0] | b[0] << a[1], a[1] + b[1]) for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0] if parts else (0, 0)


def riff(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, how many) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    second = value - 1 >> top - 1 & 1
    return 2 * top + second, (value - 1) & ((1 << top - 1) - 1), top - 1


def put_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used.max() < LITERALS):
        symbols = used.tolist() or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(symbols[0] > 1, 1)
        out.put(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
        return
    tokens, i, values = [], 0, lengths.tolist()
    while i < len(values):
        n = 1
        while i + n < len(values) and values[i + n] == values[i]:
            n += 1
        if values[i] == 0 and n >= 3:
            n = min(n, 138)
            tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif n >= 4:
            n = min(n, 7)
            tokens += [(values[i], 0, 0), (16, n - 4, 2)]
        else:
            n = 1
            tokens.append((values[i], 0, 0))
        i += n
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    words = code_words(own)
    sent = max(4, 1 + max(k for k, s in enumerate(LENGTH_ORDER) if own[s]))
    out.put(0, 1)
    out.put(sent - 4, 4)
    for s in LENGTH_ORDER[:sent]:
        out.put(own[s], 3)
    out.put(0, 1)
    alone = np.count_nonzero(own) < 2
    for s, extra, n in tokens:
        out.put(words[s], 0 if alone else int(own[s]))
        out.put(extra, n)


def put_pixels(out: Writer, pixels: np.ndarray, width: int, cache: int = 0, matches: bool = True, meta: int | None = None, top: bool = False) -> None:
    """A flat image as tokens. ``meta``: log2 of the block side for two groups of codes, by the parity of the block."""
    values = pixels.tolist()
    tokens: list[tuple] = []  # (pixel index, green symbol, red, blue, alpha) or (index, symbol, extra, bits, distance code)
    table, heads, i = [None] * (1 << cache), {}, 0
    slot = lambda p: (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache)
    codes = {distance(c, width): c for c in range(len(NEAR), 0, -1)}
    while i < len(values):
        found, back = 0, 0
        if matches and i and (j := heads.get(tuple(values[i : i + 3]))) is not None:
            while i + found < len(values) and found < 4096 and values[j + found] == values[i + found]:
                found += 1
            back = i - j
        if found >= 3:
            symbol, extra, bits = prefix_of(found)
            tokens.append((i, LITERALS + symbol, extra, bits, codes.get(back, back + len(NEAR))))
        elif cache and table[slot(values[i])] == values[i]:
            found = 1
            tokens.append((i, LITERALS + LENGTHS + slot(values[i])))
        else:
            found = 1
            a, r, g, b = channels(values[i])
            tokens.append((i, g, r, b, a))
        for k in range(i, i + found):
            heads[tuple(values[k : k + 3])] = k
            if cache:
                table[slot(values[k])] = values[k]
        i += found
    out.put(cache > 0, 1)
    if cache:
        out.put(cache, 4)
    group, groups = (lambda i: 0), 1
    if top:
        out.put(meta is not None, 1)
        if meta is not None:
            across, down = -(-width >> meta), -(-(len(values) // width) >> meta)
            which = np.array([(x + y) % 2 << 8 for y in range(down) for x in range(across)], np.uint32)
            out.put(meta - 2, 3)
            put_pixels(out, which, across)
            group, groups = (lambda i: ((i % width >> meta) + (i // width >> meta)) % 2), 2 if len(which) > 1 else 1
    sizes = (LITERALS + LENGTHS + (1 << cache if cache else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    seen = [[Counter() for _ in sizes] for _ in range(groups)]
    for t in tokens:
        own = seen[group(t[0])]
        own[0][t[1]] += 1
        if t[1] < LITERALS:
            for k in (1, 2, 3):
                own[k][t[k + 1]] += 1
        elif t[1] < LITERALS + LENGTHS:
            own[4][prefix_of(t[4])[0]] += 1
    books = []
    for own in seen:
        book = []
        for n, c in zip(sizes, own, strict=True):
            counts = np.zeros(n, np.int64)
            counts[list(c)] = list(c.values())
            lengths = code_lengths(counts)
            put_code(out, lengths)
            book.append((code_words(lengths), lengths if np.count_nonzero(lengths) > 1 else np.zeros(n, np.int64)))
        books.append(book)
    for t in tokens:
        book = books[group(t[0])]
        out.put(book[0][0][t[1]], int(book[0][1][t[1]]))
        if t[1] < LITERALS:
            for k in (1, 2, 3):
                out.put(book[k][0][t[k + 1]], int(book[k][1][t[k + 1]]))
        elif t[1] < LITERALS + LENGTHS:
            out.put(t[2], t[3])
            symbol, extra, n = prefix_of(t[4])
            out.put(book[4][0][symbol], int(book[4][1][symbol]))
            out.put(extra, n)


def encode(image: np.ndarray, modes: Sequence[int] | None = None, cross: Sequence[tuple[int, int, int]] | None = None, subtract_green: bool = False, palette: bool = False, cache: int = 0, matches: bool = True, meta: int | None = None, step: int = 2) -> bytes:
    """A lossless WebP of a height x width ARGB array, with the transforms asked for; a general writer for single images.

    ``modes`` and ``cross`` (factors green to red, green to blue, red to blue) are dealt to blocks of side 2^step in turn.
    A palette is used if there are 256 colours at most.
    """
    height, width = image.shape
    if max(height, width) > SIDE:
        raise ValueError("an image has at most 16384 pixels a side")
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    pixels = image.astype(np.uint32).ravel()
    if palette and len(colours := np.unique(pixels)) <= 256:
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(colours) - 1, 8)
        deltas = np.diff(np.concatenate([[0], colours]).astype(np.uint32).view(np.uint8).reshape(-1, 4), axis=0)
        put_pixels(out, np.ascontiguousarray(deltas).ravel().view(np.uint32), len(colours))
        index, packed = np.searchsorted(colours, pixels).reshape(height, width), packing_bits(len(colours))
        full = np.zeros((height, -(-width >> packed) << packed), np.uint32)
        full[:, :width] = index
        shift = (np.arange(full.shape[1]) & ((1 << packed) - 1)) * (8 >> packed)
        pixels = np.uint32(BLACK) | (full << shift.astype(np.uint32)).reshape(height, -1, 1 << packed).sum(2).astype(np.uint32).ravel() << np.uint32(8)
        width = full.shape[1] >> packed
    across, down = -(-width >> step), -(-height >> step)
    if modes:
        kinds = [modes[k % len(modes)] for k in range(across * down)]
        done = pixels.tolist()
        look = lambda x, y: kinds[(y >> step) * across + (x >> step)]
        pixels = np.array([minus(p, guesses(look, done, i % width, i // width, width)) for i, p in enumerate(done)], np.uint32)
        for value, n in ((1, 1), (PREDICTOR, 2), (step - 2, 3)):
            out.put(value, n)
        put_pixels(out, np.array(kinds, np.uint32) << np.uint32(8), across)
    if cross:
        terms = np.array([joined((255, c & 255, b & 255, a & 255)) for a, b, c in (cross[k % len(cross)] for k in range(across * down))], np.uint32)
        to_red, to_blue, red_to_blue = cross_terms(len(pixels), width, terms, step)
        green, red = signed(pixels >> 8), signed(pixels >> 16)
        new_red = ((pixels >> 16).astype(np.int32) - (to_red * green >> 5)) & 255
        new_blue = (pixels.astype(np.int32) - (to_blue * green >> 5) - (red_to_blue * red >> 5)) & 255
        pixels = pixels & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)
        for value, n in ((1, 1), (CROSS, 2), (step - 2, 3)):
            out.put(value, n)
        put_pixels(out, terms, across)
    if subtract_green:
        green = pixels >> 8 & 255
        pixels = pixels & np.uint32(0xFF00FF00) | ((pixels >> 16) - green & 255) << np.uint32(16) | (pixels - green & 255)
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
    out.put(0, 1)
    put_pixels(out, pixels, width, cache, matches, meta, True)
    value, n = out.number()
    return riff(value.to_bytes(-(-n // 8), "little"))


# --- writing many byte payloads at once -----------------------------------------------------------------------------

#: Samples of a row: 144 pixels of four.
ROW = 576
#: Runs of equal pixels of which at least this many repeat the first become back-references.
RUN = 4


def text_weights() -> np.ndarray:
    """How often each byte is expected in UTF-8 text, by rule: frequent letters first, then capitals, digits, signs, the rest."""
    weight = np.full(256, 3, np.int64)
    for k, c in enumerate(b"etaoinrshlducmpgbfvkwyqjxz"):
        weight[c], weight[c - 32] = 9000 // (k + 3), 300 // (k + 3) + 5
    weight[[32, 10]] = 5000, 300
    weight[48:58] = 30
    weight[[ord(c) for c in ".,"]] = 500
    weight[[ord(c) for c in "|*&$#%!?;:'\"()-"]] = 60
    weight[0xC3], weight[0xA0:0xC0] = 600, 25
    weight[255] = 200
    return weight


#: How an image is written: as it is, with a colour cache, less the pixel above, red and blue less green, as indexes of a palette.
PLAIN, CACHED, ABOVE, CROSSED, INDEXED = range(5)
#: Bits of the colour cache, colours of a palette (then two or more indexes fit a pixel), one in how many pixels must be found in the cache.
CACHE, COLOURS, HITS = 9, 16, 16

_books: list[list[tuple]] = []


def books() -> list[tuple]:
    """Per way of writing: (words and lengths of green, red, blue and alpha, the bits before the pixels, how many).

    The codes follow from the way alone, so that an image's bytes depend on its own samples. A palette's bits come before those.
    """
    if _books:
        return _books[0]
    text, zeros = text_weights(), np.full(256, 20, np.int64)
    zeros[0] = 20_000
    runs, entries, nothing = np.full(LENGTHS, 20), np.full(1 << CACHE, 15), np.eye(1, 256, dtype=np.int64)[0]
    weights = {
        PLAIN: (np.concatenate([text, runs]), text, text, text), CACHED: (np.concatenate([text, runs, entries]), text, text, text),
        ABOVE: (np.concatenate([zeros, 100 * runs]), zeros, zeros, zeros), CROSSED: (np.concatenate([text, runs]), zeros, zeros, text),
        INDEXED: (np.concatenate([np.full(256, 20), 20 * runs]), nothing, nothing, nothing[::-1]),
    }
    found = []
    for way in range(len(weights)):
        out = Writer()
        if way == ABOVE:
            for value, n in ((1, 1), (PREDICTOR, 2), (7, 3)):
                out.put(value, n)
            put_pixels(out, np.array([2 << 8], np.uint32), 1)  # one mode for all blocks, in no bits
        elif way == CROSSED:
            for value, n in ((1, 1), (CROSS, 2), (7, 3)):
                out.put(value, n)
            put_pixels(out, np.array([32 << 8 | 32], np.uint32), 1)  # green to red and to blue by a factor of one
        out.put(0, 1)
        out.put(way == CACHED, 1)
        if way == CACHED:
            out.put(CACHE, 4)
        out.put(0, 1)  # one group of codes
        lengths = [code_lengths(w) for w in weights[way]]
        for one in lengths:
            put_code(out, one)
        put_code(out, np.eye(1, DISTANCES, 1, dtype=np.int64)[0])  # always the pixel to the left, in no bits
        lengths = [one if np.count_nonzero(one) > 1 else 0 * one for one in lengths]
        table = np.zeros((2, 4, LITERALS + LENGTHS + (1 << CACHE)), np.int64)
        for k, one in enumerate(lengths):
            table[0, k, : len(one)], table[1, k, : len(one)] = code_words(one), one
        found.append((table[0].astype(np.uint64), table[1], *out.number()))
    _books.append(found)
    return found


def ways(pixels: np.ndarray, starts: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(way per image, whether each pixel is in the cache). ``same``: whether a pixel repeats the one before it."""
    n, images = len(pixels), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    new = ~same
    literals = np.add.reduceat(new, starts[:-1], dtype=np.int64)
    share = lambda what: np.add.reduceat(what & new, starts[:-1], dtype=np.int64)
    below = np.arange(n) - starts[images] >= ROW // 4
    above = np.zeros(n, bool)
    above[ROW // 4 :] = pixels[ROW // 4 :] == pixels[: -(ROW // 4)]
    grey = (pixels >> np.uint32(16) & np.uint32(255) == pixels >> np.uint32(8) & np.uint32(255)) & (pixels >> np.uint32(8) & np.uint32(255) == pixels & np.uint32(255))
    key = images << CACHE | slots(pixels, CACHE)
    order = np.argsort(key, kind="stable")
    hit = np.zeros(n, bool)
    hit[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    way = np.where(HITS * share(hit) > literals, CACHED, PLAIN)
    way[2 * share(grey) > literals] = CROSSED
    way[2 * share(above & below) > literals] = ABOVE
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        if len(set(pixels[a : a + ROW // 4].tolist())) <= COLOURS and len(np.unique(pixels[a:b])) <= COLOURS:
            way[k] = INDEXED
    return way, hit


def changed(pixels: np.ndarray, way: int) -> tuple[np.ndarray, int, int]:
    """(what is written of an image's pixels, the bits that come before the way's own, how many)."""
    if way == ABOVE:
        was = pixels.view(np.uint8).reshape(-1, ROW // 4, 4)
        rest = was.copy()
        rest[1:] -= was[:-1]
        rest[0, 1:] -= was[0, :-1]
        rest = rest.reshape(-1).view(np.uint32)
        rest[0] = minus(int(rest[0]), BLACK)
        return rest, 0, 0
    if way == CROSSED:
        green = pixels >> np.uint32(8) & np.uint32(255)
        return pixels & np.uint32(0xFF00FF00) | ((pixels >> np.uint32(16)) - green & np.uint32(255)) << np.uint32(16) | (pixels - green & np.uint32(255)), 0, 0
    if way == INDEXED:
        colours, index = np.unique(pixels, return_inverse=True)
        out, packed = Writer(), packing_bits(len(colours))
        for value, n in ((1, 1), (PALETTE, 2), (len(colours) - 1, 8)):
            out.put(value, n)
        deltas = np.diff(np.concatenate([[0], colours]).astype(np.uint32).view(np.uint8).reshape(-1, 4), axis=0)
        put_pixels(out, np.ascontiguousarray(deltas).ravel().view(np.uint32), len(colours))
        shift = np.arange(1 << packed) * (8 >> packed)
        return np.uint32(BLACK) | (index.reshape(-1, 1 << packed) << shift).sum(1).astype(np.uint32) << np.uint32(8), *out.number()
    return pixels, 0, 0


def repeats(pixels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    same = np.zeros(len(pixels) + 1, bool)
    same[1:-1] = pixels[1:] == pixels[:-1]
    same[starts] = False
    return same


def encode_payloads(samples: np.ndarray, rows: Sequence[int]) -> list[bytes]:
    """Images of 144 pixels (576 samples) a row, of ``rows`` rows each, from their samples on end.

    Four samples are a pixel's alpha, red, green and blue. How an image is written follows from its own samples: as
    packed indexes of a palette if it has 16 colours at most, less the pixel above if that is equal for most, with red and
    blue less green if those are equal for most, with a colour cache if that holds one pixel in 16 or more, else as
    it is. The codes are fixed for each way, so a whole batch is written by a few array operations.
    """
    book = books()
    flat = np.ascontiguousarray(samples).view(">u4").astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.array(rows, np.int64) * (ROW // 4))])
    way, hit = ways(flat, starts, repeats(flat, starts)[:-1])
    lead = [(0, 0)] * len(rows)
    other = np.flatnonzero(way >= ABOVE).tolist()
    if other:
        cut = [flat[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        for k in other:
            cut[k], *bits = changed(cut[k], int(way[k]))
            lead[k] = tuple(bits)
        kept = np.concatenate([np.full(len(c), way[k] == CACHED) for k, c in enumerate(cut)])
        hits = np.zeros(len(kept), bool)
        hits[kept] = hit[np.repeat(way == CACHED, np.diff(starts))]
        flat, hit, starts = np.concatenate(cut), hits, np.concatenate([[0], np.cumsum([len(c) for c in cut])])
    else:
        hit &= np.repeat(way == CACHED, np.diff(starts))
    words, sizes = np.stack([b[0] for b in book]), np.stack([b[1] for b in book])
    of = np.repeat(way, np.diff(starts))
    code, size = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.int64)
    for k, shift in enumerate((8, 16, 0, 24)):
        symbol = (flat >> np.uint32(shift) & np.uint32(255)).astype(np.int64)
        code |= words[of, k, symbol] << size.astype(np.uint64)
        size += sizes[of, k, symbol]
    found = np.flatnonzero(hit)
    entry = LITERALS + LENGTHS + slots(flat[found], CACHE).astype(np.int64)
    code[found], size[found] = words[CACHED, 0, entry], sizes[CACHED, 0, entry]
    same = repeats(flat, starts)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], same]).astype(np.int8)))
    long = turns[1::2] - turns[::2] >= RUN
    for a, b in zip(turns[::2][long].tolist(), turns[1::2][long].tolist(), strict=True):
        size[a:b] = 0
        green, green_n = words[of[a], 0], sizes[of[a], 0]
        for k in range(a, b, 4096):
            symbol, extra, n = prefix_of(min(4096, b - k))
            code[k] = int(green[LITERALS + symbol]) | extra << int(green_n[LITERALS + symbol])
            size[k] = int(green_n[LITERALS + symbol]) + n
    total = np.concatenate([[0], np.cumsum(size)])
    before = np.array([40 + n + book[w][3] for (_, n), w in zip(lead, way.tolist(), strict=True)])
    bits = before + np.diff(total[starts])
    first = np.concatenate([[0], np.cumsum(bits // 64 + 2)])  # of each image's 64-bit words
    at = total[:-1] + np.repeat(64 * first[:-1] + before - total[starts[:-1]], np.diff(starts))
    put = size > 0
    at, code = at[put], code[put]
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(first[-1]) + 1, np.uint64)
    if len(word):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[heads]] = np.add.reduceat(code << shift, heads)
        over = np.where(shift > 0, code >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        out[word[heads] + 1] |= np.add.reduceat(over, heads)
    files = []
    for k, n in enumerate(rows):
        own, own_n = lead[k]
        top = 0x2F | (ROW // 4 - 1) << 8 | (n - 1) << 22 | 1 << 36 | own << 40 | book[way[k]][2] << 40 + own_n
        head = np.frombuffer(top.to_bytes(8 * -(-int(before[k]) // 64), "little"), np.uint64)
        a = int(first[k])
        out[a : a + len(head)] |= head
        files.append(riff(out[a : int(first[k + 1])].tobytes()[: -(-int(bits[k]) // 8)]))
    return files


def samples_of(image: np.ndarray) -> bytes:
    """The samples of an image, alpha, red, green and blue of each pixel."""
    return image.astype(">u4").tobytes()
