"""Lossless WebP in numpy: a decoder of the whole bit stream, and an encoder for media columns.

The decoder reads prefix codes, back-references, the colour cache and meta prefix codes,
and inverts the predictor, cross-colour, subtract-green and palette transforms. An image
with one group of codes is read in blocks of bits: for every bit of a block, tables tell
where a pixel that began there would end; one walk along these ends finds the pixels that
there are, and their values are looked up at once. References then become copies of
places, and cache hits places of the last pixel with their key. Images with several groups
of codes are read pixel by pixel.

The encoder looks for repeated runs of three pixels and more, for pixels that a colour
cache would hold, and for the transform under which its estimate of the size is least;
whatever saves nothing is left out. Its prefix codes have up to 11 bits. Images are written
side by side: sorts, histograms, codes and bits are made for all of a group at once.

Defined cases: an image has at least one pixel and at most 16,384 each way. What is no
lossless WebP image, ends too early or refers outside of itself raises ValueError. Files
of the extended format are read if their image is lossless and not animated.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
ALPHABETS = (256 + 24, 256, 256, 256, 40)  # green and lengths, red, blue, alpha, distance
MANY = ((2, 3), (3, 3), (7, 11))  # further bits and least number of code lengths from symbol 16 on
HASH = 0x1E35A7BD
SIDE = 1 << 14
#: Distance codes up to 120: neighbours by distance, then by row and column.
NEAR = sorted(((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))

LONGEST = 11  # bits of a prefix code that is written
CACHE = 6  # bits of the colour cache that is written, at most
AHEAD = 1 << 16  # bits of a stream that are looked at together
SLACK = 96  # more bits than any pixel or reference takes
PADDING = 16  # bytes after a stream that a pixel beyond its end may be read from
HIT, REFERENCE = 1 << 48, 1 << 49  # marks of table entries
LANE, LANES = 3000, 56  # pixels of an image read along with others, at most; bits of a pixel
COPY, FARTHEST = 4096, (1 << 20) - 120  # pixels of a reference, and to go back, at most
PLACE = np.uint64(21)  # bits of the place of a pixel among those that are written side by side
WIDE = 280 + (1 << CACHE)  # symbols of a code that is written, at most


@lru_cache(maxsize=16)
def _reversed(width: int) -> np.ndarray:
    """All numbers of so many bits, with the bits turned round."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        self.check()
        return got

    def check(self) -> None:
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends too early")


@dataclass
class Code:
    """A prefix code: symbols and lengths by the next `width` bits."""

    width: int
    symbols: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, lengths: list[int]) -> Code:
        used = [s for s, n in enumerate(lengths) if n]
        return cls.of_used(used, [lengths[s] for s in used])

    @classmethod
    def of_used(cls, used: list[int], sizes: list[int]) -> Code:
        """The code of the symbols used, ascending, with these lengths."""
        if len(used) < 2:
            return cls(0, np.array(used or [0], np.int32), np.zeros(1, np.int32))
        used, sizes = np.array(used), np.array(sizes)
        by, width = np.argsort(sizes, kind="stable"), int(sizes.max())
        sizes = sizes[by]
        spans = 1 << (width - sizes)
        if spans.sum() != 1 << width:
            raise ValueError("a prefix code is not complete")
        table = np.repeat(used[by] << 4 | sizes, spans).astype(np.int32)[_reversed(width)]
        return cls(width, table >> 4, table & 15)

    def next(self, bits: Bits) -> int:
        i = bits.peek(self.width)
        bits.at += int(self.lengths[i])
        bits.check()
        return int(self.symbols[i])


@lru_cache(maxsize=4096)
def _code_of_lengths(lengths: tuple[int, ...]) -> tuple[list[int], list[int], int]:
    """Symbols and lengths by the next bits, and how many bits, of a code for code lengths."""
    code = Code.of(lengths)
    return code.symbols.tolist(), code.lengths.tolist(), (1 << code.width) - 1


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        lengths = [0] * alphabet
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code.of(lengths)
    of_lengths = [0] * 19
    told = 4 + bits.read(4)
    ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 9], "little") >> (bits.at & 7)
    for s in CODE_LENGTH_ORDER[:told]:
        of_lengths[s] = ahead & 7
        ahead >>= 3
    bits.at += 3 * told
    bits.check()
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    symbols, sizes, mask = _code_of_lengths(tuple(of_lengths))
    i, before, at, data, had = 0, 8, bits.at, bits.data, 0
    used, widths = [], []
    while i < alphabet and left:
        left -= 1
        if had < 14:  # no symbol and what follows it takes more
            ahead, had = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7), 57
        s, n = symbols[ahead & mask], sizes[ahead & mask]
        if s < 16:
            if s:
                used.append(i)
                widths.append(s)
                before = s
            i += 1
        else:
            extra, least = MANY[s - 16]
            times = least + (ahead >> n & ((1 << extra) - 1))
            n += extra
            if s == 16:
                used += range(i, i + times)
                widths += [before] * times
            i += times
        ahead >>= n
        at += n
        had -= n
    bits.at = at
    bits.check()
    if i > alphabet:
        raise ValueError("too many code lengths")
    return Code.of_used(used, widths)


def _read_codes(bits: Bits, cached: int) -> list[Code]:
    """The five codes of a group. Bits that repeat those of the code before, over the same
    alphabet, give the same code and are not read again."""
    out, before, size = [], 0, 0
    for i, alphabet in enumerate(ALPHABETS):
        if 2 <= i <= 3 and size:
            first, end = bits.at >> 3, (bits.at + size + 7) >> 3
            ahead = int.from_bytes(bits.data[first:end], "little") >> (bits.at & 7) & ((1 << size) - 1)
            if ahead == before:
                bits.at += size
                bits.check()
                out.append(out[-1])
                continue
        at = bits.at
        out.append(_read_code(bits, alphabet + (cached if i == 0 else 0)))
        size = bits.at - at
        before = int.from_bytes(bits.data[at >> 3 : (bits.at + 7) >> 3], "little") >> (at & 7) & ((1 << size) - 1)
    return out


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _values(prefix: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_value() of many prefixes and the bits that follow them, and how many bits it takes."""
    extra = np.maximum(prefix - 2, 0) >> 1
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + (ahead & ((1 << extra) - 1))) + 1, extra


@lru_cache(maxsize=16)
def _near_places(w: int) -> np.ndarray:
    return np.array([0, *(max(1, dx + dy * w) for dx, dy in NEAR)])


def _back(distance: np.ndarray, w: int) -> np.ndarray:
    """Pixels to go back, from distance values."""
    near = _near_places(w)
    return np.where(distance <= 120, near[np.minimum(distance, 120)], distance - 120)


def _stream(bits: Bits, codes: list[Code], cache_bits: int, w: int, n: int, used: Counter) -> np.ndarray:
    """The n pixels of an image with one group of codes."""
    px = np.zeros(n, np.uint32)
    if not any(c.width for c in codes[:4]) and codes[0].symbols[0] < 256:
        px[:] = int(codes[3].symbols[0]) << 24 | int(codes[1].symbols[0]) << 16 | int(codes[0].symbols[0]) << 8 | int(codes[2].symbols[0])
        return px
    raw = np.frombuffer(bits.data, np.uint8)
    most = n * sum(c.width for c in codes[:4]) + SLACK
    green, red, blue, alpha, far = codes
    others, both = (red, blue, alpha), (green.symbols << 4 | green.lengths).astype(np.intp)
    copies, hits, done = [], [], 0
    while done < n:
        base = bits.at >> 3
        span = min(AHEAD, most, max(0, 8 * (len(raw) - base)) + 8)
        part = np.zeros((span + 2 * SLACK) // 8 + 8, np.uint32)
        got = raw[base : base + len(part)]
        part[: len(got)] = got
        words = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        ahead = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel().astype(np.intp) & 0x1FFFFFF  # the bits that are right
        entry = both[ahead & ((1 << green.width) - 1)]
        ends = np.arange(span + 8) + (entry[: span + 8] & 15)
        steps = [c.lengths[ahead & ((1 << c.width) - 1)] if c.width else None for c in (red, alpha)]
        steps.insert(1, steps[0] if blue is red else blue.lengths[ahead & ((1 << blue.width) - 1)] if blue.width else None)
        following = ends.copy()
        for step in steps:
            if step is not None:
                following += step[following]
        q = np.zeros(0, np.int64)
        other = np.flatnonzero(entry[: span + 8] >= 256 << 4)
        if len(other):
            following[other] = ends[other]
            q = other[entry[other] < 280 << 4]
            gain, extra = _values((entry[q] >> 4) - 256, ahead[ends[q]])
            place = ends[q] + extra
            key = ahead[place] & ((1 << far.width) - 1)
            place += far.lengths[key]
            distance, extra = _values(far.symbols[key], ahead[place])
            following[q] = place + extra
        # Steps of eight pixels are walked; tables of four, two and one tell what lies between.
        jumps, left = [np.append(np.minimum(following[:span], span), span)], n - done
        while len(jumps) < 4:
            jumps.append(jumps[-1][jumps[-1]])
        after, p, seen = memoryview(jumps.pop()), bits.at & 7, []
        for _ in range(-(-left // 8)):
            if p >= span:
                break
            seen.append(p)
            p = after[p]
        seen = np.array(seen, np.intp)
        for jump in reversed(jumps):
            seen = np.stack([seen, jump[seen]], 1).ravel()
        seen = seen[: min(left, int(np.searchsorted(seen, span)))]
        p = int(following[seen[-1]])
        kind, took = entry[seen] >> 4, np.ones(len(seen), np.int64)
        far_back = np.flatnonzero((kind >= 256) & (kind < 280))
        copied = np.searchsorted(q, seen[far_back])
        if len(copied):
            took[far_back] = gain[copied]
        upto = np.cumsum(took)
        if upto[-1] > left:  # what follows the last pixel is something else
            last = int(np.searchsorted(upto, left)) + 1
            p, far_back = int(following[seen[last - 1]]), far_back[far_back < last]
            seen, kind, took, upto = seen[:last], kind[:last], took[:last], upto[:last]
        bits.at = 8 * base + p
        bits.check()
        where = done + upto - took
        done += int(upto[-1])
        plain = kind < 256
        p, value = ends[seen[plain]], kind[plain].astype(np.int64) << 8
        for c, step, shift in zip(others, steps, (16, 0, 24), strict=True):
            value |= c.symbols[ahead[p] & ((1 << c.width) - 1)].astype(np.int64) << shift
            if step is not None:
                p = p + step[p]
        px[where[plain]] = value
        if len(far_back):
            copies += zip(where[far_back].tolist(), took[far_back].tolist(), _back(distance[copied[: len(far_back)]], w).tolist(), strict=True)
        if len(other):
            hits.append(np.stack([where[kind >= 280], kind[kind >= 280] - 280]))
    used["prefix-coded"] += 1
    used["references"] += len(copies)
    hits = np.concatenate(hits, 1) if hits else np.zeros((2, 0), np.int64)
    used["cache hits"] += hits.shape[1]
    return _placed(px, copies, hits, cache_bits)


def _streams(jobs: list[tuple[Bits, list[Code], int, int, int]], used: Counter) -> list[np.ndarray]:
    """_stream() of several images, given as (bits, codes, bits of the cache, width, pixels):
    each step reads a symbol, or the four of a pixel, of every image.

    An entry of a table has bits of a pixel from bit 8 on, and how many bits it takes below,
    so the sum of a pixel's entries has the pixel, and how many bits it takes."""
    flat, tables, before, at = [], [], [], 0
    for bits, codes, *_ in jobs:
        before.append(8 * at)
        flat.append(bits.data + bytes(PADDING))
        at += len(flat[-1])
        for c, shift in zip(codes[:4], (16, 24, 8, 32), strict=True):
            tables.append((c.symbols.astype(np.int64) << shift) | c.lengths)
        kind = codes[0].symbols
        tables[-4] += HIT * (kind >= 280) + REFERENCE * ((kind >= 256) & (kind < 280))
    words = np.ascontiguousarray(np.ndarray(at, "<i8", b"".join([*flat, bytes(8)]), 0, (1,)))  # 64 bits from each byte on
    sizes = np.array([len(t) for t in tables])
    begin, mask = (x.reshape(-1, 4).T.copy() for x in (np.cumsum(sizes) - sizes, sizes - 1))
    table, transparent, first = np.concatenate(tables), bool(mask[3].any()), [j[0].at for j in jobs]
    opaque = [0 if m else int(table[b]) for m, b in zip(mask[3].tolist(), begin[3].tolist(), strict=True)]
    p, until = np.array([b + j[0].at for b, j in zip(before, jobs, strict=True)]), np.array([j[4] for j in jobs])
    lanes, step, further_bits, copies = np.arange(len(jobs)), 0, [0] * len(jobs), [[] for _ in jobs]
    log = np.empty((int(until.max()), len(jobs)), np.int64)
    while len(lanes):
        # What has ended is read on, to no effect, until a twelfth of the images have.
        stop = max(int(np.partition(until[lanes], len(lanes) // 12)[len(lanes) // 12]), step + 1)
        rows, start, places = np.empty((stop - step, len(lanes)), np.int64), step, lanes.tolist()
        (green, red, blue, alpha), (by_green, by_red, by_blue, by_alpha) = begin[:, lanes], mask[:, lanes]
        while step < stop:
            ahead = words.take(p >> 3, mode="clip")
            ahead >>= p & 7
            entry = table[(ahead & by_green) + green]
            ahead >>= entry & 15
            more = table[(ahead & by_red) + red]
            ahead >>= more & 15
            last = table[(ahead & by_blue) + blue]
            more += last
            if transparent:
                more += table[((ahead >> (last & 15)) & by_alpha) + alpha]
            more *= entry < HIT
            more += entry
            rows[step - start] = more
            p += more & 255
            step += 1
            if entry.max() >= REFERENCE:
                for k in np.flatnonzero(entry >= REFERENCE).tolist():
                    lane = places[k]
                    if until[lane] < step:
                        continue
                    bits, codes, _, w, _ = jobs[lane]
                    bits.at = at = int(p[k]) - before[lane]
                    length = _value(bits, (int(entry[k]) >> 16 & 511) - 256)
                    distance = _value(bits, codes[4].next(bits))
                    further_bits[lane] += bits.at - at
                    p[k] = bits.at + before[lane]
                    copies[lane].append((step - 1, length, int(_near_places(w)[distance]) if distance <= 120 else distance - 120))
                    until[lane] -= length - 1
                    if until[lane] < step:
                        raise ValueError("a reference leaves the image")
        log[start:step, lanes] = rows
        stay = until[lanes] > step
        lanes, p = lanes[stay], p[stay]
    log, out = np.ascontiguousarray(log.T), []
    for lane, (bits, _, cache_bits, _, n) in enumerate(jobs):
        said, where, copied = log[lane, : until[lane]], np.arange(until[lane]), []
        bits.at = first[lane] + int((said & 255).sum()) + further_bits[lane]
        bits.check()
        if copies[lane]:
            at, length, back = np.array(copies[lane]).T
            gone = np.zeros(len(said), np.int64)
            gone[at[at + 1 < len(said)] + 1] = length[at + 1 < len(said)] - 1
            where += np.cumsum(gone)
            copied = list(zip(where[at].tolist(), length.tolist(), back.tolist(), strict=True))
        px = np.zeros(n, np.uint32)
        px[where] = (said + opaque[lane]) >> 8
        hit = np.flatnonzero(said >= HIT)
        hit = hit[said[hit] < REFERENCE]
        used["prefix-coded"] += 1
        used["references"] += len(copied)
        used["cache hits"] += len(hit)
        out.append(_placed(px, copied, np.stack([where[hit], (said[hit] >> 16 & 4095) - 280]), cache_bits))
    return out


def _placed(px: np.ndarray, copies: list[tuple[int, int, int]], hits: np.ndarray, cache_bits: int) -> np.ndarray:
    """px with copies (place, length, pixels to go back) and cache hits (places, keys)."""
    n, cached = len(px), hits.shape[1] > 0
    source = np.arange(n) if cached else px
    for at, length, back in copies:
        if back > at or at + length > n:
            raise ValueError("a reference leaves the image")
        source[at : at + length] = source[at - back : at - back + length] if back >= length else np.resize(source[at - back : at], length)
    if not cached:
        return source
    # A copy has its source's key; a hit's colour is that of the last pixel before it with its key.
    keys = (px * np.uint32(HASH)) >> np.uint32(32 - cache_bits)
    keys[hits[0]] = hits[1]
    keys = keys[source].astype(np.uint16)
    by = np.argsort(keys, kind="stable")
    before = np.full(n, -1)
    same = keys[by[1:]] == keys[by[:-1]]
    before[by[1:][same]] = by[:-1][same]
    of = np.arange(n)
    real = hits[0][before[hits[0]] >= 0]
    of[real] = source[before[real]]
    while (of[of] != of).any():
        of = of[of]
    return px[of[source]]


def _image(bits: Bits, w: int, h: int, main: bool = False, used: Counter | None = None) -> np.ndarray:
    """ARGB pixels of an entropy-coded image."""
    got = _begun(bits, w, h, main, used)
    return got if isinstance(got, np.ndarray) else _stream(*got, Counter() if used is None else used)


def _begun(bits: Bits, w: int, h: int, main: bool, used: Counter | None) -> np.ndarray | tuple:
    """The pixels of an image with several groups of codes; else what _stream() needs."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, shift, which = 1, 0, None
    if main and bits.read(1):
        shift = bits.read(3) + 2
        which = (_image(bits, -(-w // (1 << shift)), -(-h // (1 << shift))) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(which.max()) + 1
    codes = [_read_codes(bits, (1 << cache_bits) if cache_bits else 0) for _ in range(groups)]
    n = w * h
    if groups == 1:
        return bits, codes[0], cache_bits, w, n
    out, cache = [0] * n, [0] * (1 << cache_bits)
    across = -(-w // (1 << shift)) if shift else 1
    i = kept = 0
    while i < n:
        own = codes[int(which[(i // w >> shift) * across + (i % w >> shift)])] if which is not None else codes[0]
        s = own[0].next(bits)
        if s < 256:
            red, blue, alpha = (c.next(bits) for c in own[1:4])
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 280:
            length = _value(bits, s - 256)
            d = _value(bits, own[4].next(bits))
            back = int(_back(np.array(d), w))
            if back > i or i + length > n:
                raise ValueError("a reference leaves the image")
            for _ in range(length):
                out[i] = out[i - back]
                i += 1
        else:
            while kept < i:
                cache[(HASH * out[kept] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[kept]
                kept += 1
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4).astype(np.int32)  # blue, green, red, alpha


def _predict(px: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Adds predictions to the residuals px (h, w, 4), pixel by pixel in reading order."""
    h, w, _ = px.shape
    out = px.tolist()
    for y in range(h):
        row, up = out[y], out[y - 1] if y else None
        for x in range(w):
            if not y:
                p = row[x - 1] if x else (0, 0, 0, 255)
            elif not x:
                p = up[0]
            else:
                left, top, corner, right = row[x - 1], up[x], up[x - 1], up[x + 1] if x + 1 < w else row[0]
                p = _predictor(int(modes[y >> shift, x >> shift]), left, top, corner, right)
            row[x] = [(a + b) & 255 for a, b in zip(row[x], p, strict=True)]
    return np.array(out, np.int32).reshape(h, w, 4)


def _mean(a, b):  # noqa: ANN001, ANN202
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _predictor(mode: int, left, top, corner, right):  # noqa: ANN001, ANN202
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _mean(_mean(left, right), top)
        case 6:
            return _mean(left, corner)
        case 7:
            return _mean(left, top)
        case 8:
            return _mean(corner, top)
        case 9:
            return _mean(top, right)
        case 10:
            return _mean(_mean(left, corner), _mean(top, right))
        case 11:
            by_top = sum(abs(a - c) for a, c in zip(top, corner, strict=True))  # distance of the gradient to left
            by_left = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
            return left if by_top < by_left else top
        case 12:
            return [clip(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
        case 13:
            return [clip(m + int((m - c) / 2)) for m, c in zip(_mean(left, top), corner, strict=True)]
    return (0, 0, 0, 255)


def _uncross(px: np.ndarray, factors: np.ndarray, shift: int) -> np.ndarray:
    h, w, _ = px.shape
    f = np.repeat(np.repeat(factors, 1 << shift, 0)[:h], 1 << shift, 1)[:, :w].astype(np.uint8).view(np.int8).astype(np.int32)
    signed = lambda a: a.astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(px[..., 1])
    red = (px[..., 2] + ((f[..., 0] * green) >> 5)) & 255
    blue = (px[..., 0] + ((f[..., 1] * green) >> 5) + ((f[..., 2] * signed(red)) >> 5)) & 255
    return np.stack([blue, px[..., 1], red, px[..., 3]], -1)


def _lossless(data: bytes) -> bytes:
    """The bit stream in a file: of its one lossless chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP image")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            if data[at + 8 : at + 9] != b"\x2f" or at + 8 + size > len(data):
                break
            return data[at + 9 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("not a whole lossless WebP image")


def decode(data: bytes, used: Counter | None = None) -> np.ndarray:
    """The image's samples: (height, width, 4) of red, green, blue, alpha. used counts the
    parts of the format that were met."""
    return decode_all([data], used)[0]


def decode_all(files: list[bytes], used: Counter | None = None) -> list[np.ndarray]:
    """decode() of several files. Small images are read side by side."""
    used = Counter() if used is None else used
    heads = [_head(f, used) for f in files]
    small = [i for i, h in enumerate(heads) if isinstance(h[2], tuple) and h[2][4] <= LANE and sum(c.width for c in h[2][1][:4]) <= LANES]
    pixels = dict(zip(small, _streams([heads[i][2] for i in small], used), strict=True)) if len(small) >= 8 else {}
    return [_finished(*h[:2], pixels[i] if i in pixels else _stream(*h[2], used) if isinstance(h[2], tuple) else h[2], h[3], used) for i, h in enumerate(heads)]


def _head(data: bytes, used: Counter) -> tuple[int, int, np.ndarray | tuple, list[tuple]]:
    """Width and height of the coded image, its pixels or what they are read by, transforms."""
    bits = Bits(_lossless(data))
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    w, steps = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            shift = bits.read(3) + 2
            bw, bh = -(-w // (1 << shift)), -(-height // (1 << shift))
            steps.append((kind, w, shift, _channels(_image(bits, bw, bh)).reshape(bh, bw, 4)))
        elif kind == 2:
            steps.append((kind, w, 0, None))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_image(bits, n, 1)).reshape(n, 4), 0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, w, pack, table))
            w = -(-w // (1 << pack))
    return w, height, _begun(bits, w, height, True, used), steps


def _finished(w: int, height: int, argb: np.ndarray, steps: list[tuple], used: Counter) -> np.ndarray:
    """The samples, with the transforms undone."""
    if not steps:
        return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(height, w, 4)[..., [2, 1, 0, 3]]
    px = _channels(argb).reshape(height, w, 4)
    for kind, w, shift, extra in reversed(steps):
        used[("predictor", "cross-colour", "subtract-green", "palette")[kind]] += 1
        if kind == 0:
            px = _predict(px, extra[..., 1], shift)
        elif kind == 1:
            px = _uncross(px, extra[..., :3], shift)
        elif kind == 2:
            px = px.copy()
            px[..., 0] = (px[..., 0] + px[..., 1]) & 255
            px[..., 2] = (px[..., 2] + px[..., 1]) & 255
        else:
            each = 8 >> shift
            index = px[..., 1]
            if shift:
                index = ((index[..., None] >> (np.arange(1 << shift) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :w]
            padded = np.zeros((256, 4), np.int32)
            padded[: len(extra)] = extra
            px = padded[index]
    return px[..., [2, 1, 0, 3]].astype(np.uint8)


def _width(values: np.ndarray) -> np.ndarray:
    """How many bits numbers below 2^53 have."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums, below 2^53, of the values of each row."""
    return np.bincount(rows, values, n).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after another."""
    return np.repeat(starts + sizes - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


def _lengths(counts: np.ndarray, limit: int = LONGEST) -> np.ndarray:
    """Code lengths up to limit of the symbols with a count, of a complete code for each row:
    those that shares ask for, the shares of rare ones raised; what is left goes to those
    that were rounded up most. In whole numbers, so what a row gets depends on it alone."""
    rows, alphabet = counts.shape
    out, used = np.zeros(counts.shape, np.int64), np.flatnonzero(counts)
    row, kinds = used // alphabet, np.count_nonzero(counts, 1)
    share = np.maximum(counts.ravel()[used] << (limit - 1), counts.sum(1)[row])
    sizes = np.maximum(_width((_sums(row, share, rows)[row] - 1) // share), 1)
    sizes[kinds[row] < 3] = 1
    units = 1 << (limit - sizes)
    free = np.where(kinds < 3, 0, (1 << limit) - _sums(row, units, rows))
    order = np.lexsort((-(share << sizes), row))
    # A lane for each row, its symbols in their order; what has no symbol never fits.
    rank = np.arange(len(used)) - np.repeat(np.cumsum(kinds) - kinds, kinds)
    lanes = np.full((int(kinds.max(initial=0)), rows), 2 << limit)
    lanes[rank, row] = units[order]
    while free.any():
        for unit in lanes:
            more = unit * (unit <= free)
            free -= more
            unit += more
    units[order] = lanes[rank, row]
    out.ravel()[used] = limit + 1 - _width(units)
    return out


def _codes(sizes: np.ndarray) -> np.ndarray:
    """Each symbol's code, its first bit lowest, of the code of each row."""
    rows, alphabet = sizes.shape
    out, used = np.zeros(sizes.shape, np.int64), np.flatnonzero(sizes)
    row, some = used // alphabet, sizes.ravel()[used]
    spans = np.where(np.count_nonzero(sizes, 1)[row] > 1, (1 << LONGEST) >> some, 1 << LONGEST)
    by = np.argsort((row << 4 | some).astype(np.uint16 if rows <= 1 << 12 else np.int64), kind="stable")
    spans = spans[by]  # those of a row fill the code, so the next row begins at 0 again
    out.ravel()[used[by]] = _reversed(LONGEST)[(np.cumsum(spans) - spans) & ((1 << LONGEST) - 1)]
    return out


def _bits(counts: np.ndarray) -> np.ndarray:
    """About the sizes of symbols with the counts of each row, and of their codes."""
    used = np.flatnonzero(counts)
    kinds, total, c = np.count_nonzero(counts, 1), counts.sum(1), counts.ravel()[used]
    saved = np.bincount(used // counts.shape[1], c * np.log2(c), len(counts))
    return np.where(kinds > 1, total * np.log2(np.maximum(total, 1)) - saved + 5 * kinds, 20.0)


def _count(plane: np.ndarray, least: int = 256) -> np.ndarray:
    return np.bincount(plane.ravel(), minlength=least)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lengths or distances: prefix, further bits, and how many they are."""
    small = _small_prefixes()
    return tuple(x[values] for x in small) if values.max(initial=0) < len(small[0]) else _prefixes_of(values)


@lru_cache(maxsize=1)
def _small_prefixes() -> tuple[np.ndarray, ...]:
    return _prefixes_of(np.maximum(np.arange(1 << 14), 1))


def _prefixes_of(values: np.ndarray) -> tuple[np.ndarray, ...]:
    v = values - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1)), v & ((1 << extra) - 1), extra


@lru_cache(maxsize=16)
def _near_values(w: int) -> np.ndarray:
    """Distance values by pixels to go back, as far as neighbours reach; 0 if none is there."""
    out = np.zeros(8 * w + 9, np.int64)
    for i, (dx, dy) in reversed(list(enumerate(NEAR))):
        out[max(1, dx + dy * w)] = i + 1
    return out


def _repeats(argb: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of three pixels or more that are copies of earlier ones of their image, of images
    one after another: places, lengths, pixels to go back. None overlaps another."""
    n, ends = len(argb), np.cumsum(sizes)
    if n < 4:
        return tuple(np.zeros((3, 0), np.int64))
    a = argb.astype(np.uint64)
    key = (a[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (a[2:] * np.uint64(0x165667B19E3779F9))
    # Places in the low bits: sorting the keys sorts them, too. Runs are compared later. As
    # many bits for any number of images, so keys are alike whatever an image is written with.
    key = np.sort((key >> PLACE << PLACE) | np.arange(n - 2, dtype=np.uint64))
    same = np.flatnonzero((key[1:] ^ key[:-1]) >> PLACE == 0)
    by = (key & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    before = np.full(n, -1)
    before[by[same + 1]] = by[same]
    before[before < np.repeat(ends - sizes, sizes)] = -1
    places = np.flatnonzero(before >= 0)
    before = before[places]
    if n > FARTHEST:
        near = places - before <= FARTHEST
        places, before = places[near], before[near]
    stop = ends[np.searchsorted(ends, places, "right")]
    run, on, padded = np.zeros(len(places), np.int64), np.arange(len(places)), np.append(argb, np.uint32(0))
    for d in range(8):
        at = places[on] + d
        on = on[(at < stop[on]) & (padded[at] == padded[before[on] + d])]
        run[on] += 1
    following = np.maximum(np.searchsorted(places, places + run), np.arange(len(places)) + 1).tolist()
    place, run, taken, sizes, k = places.tolist(), run.tolist(), [], [], 0
    while k < len(place):
        length, at = run[k], k
        k = following[k]
        if length == 8:
            i, j, end = place[at], int(before[at]), int(stop[at])
            for most in (64, COPY):
                upto = min(i + most, end)
                differ = argb[i:upto] != argb[j : j + upto - i]
                first = int(differ.argmax())
                length = first if differ[first] else upto - i
                if differ[first] or upto == end:
                    break
            k = bisect_left(place, i + length, at + 1)
        if length >= 3:
            taken.append(at)
            sizes.append(length)
    taken = np.array(taken, np.intp)
    return places[taken], np.array(sizes, np.int64), places[taken] - before[taken]


def _cached(argb: np.ndarray, of: np.ndarray, cache_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel its key, and whether the cache of its image holds it then."""
    keys = ((argb * np.uint32(HASH)) >> (32 - np.maximum(cache_bits, 1)).astype(np.uint32)[of]).astype(np.int64)
    both = of << CACHE | keys
    both = both.astype(np.uint16) if len(cache_bits) <= 1 << 16 - CACHE else both
    by = np.argsort(both, kind="stable")
    held, both, colours = np.zeros(len(argb), bool), both[by], argb[by]
    held[by[1:]] = (both[1:] == both[:-1]) & (colours[1:] == colours[:-1])
    if not cache_bits.all():
        held &= cache_bits[of] > 0
    return keys, held


def _said(sizes: np.ndarray, alphabets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The codes of rows, given by lengths, as values, their bits, and how many a row has."""
    rows, used = len(sizes), np.flatnonzero(sizes)
    row, symbol = np.divmod(used, sizes.shape[1])
    kinds, each = np.bincount(row, minlength=rows), np.arange(rows)
    ends = np.cumsum(kinds)
    first, last = symbol[np.minimum(ends - kinds, len(used) - 1)], symbol[ends - 1]
    plain = (kinds < 3) & ((kinds == 0) | (last < 256))
    # Of every symbol, and the end of the alphabet, the gap before it and its length.
    upto, size = np.zeros((2, len(used) + rows), np.int64)
    upto[np.arange(len(used)) + row], upto[ends + each] = symbol, alphabets
    size[np.arange(len(used)) + row] = sizes.ravel()[used]
    gap = np.diff(upto, prepend=0) - 1
    gap[ends - kinds + each] = upto[ends - kinds + each]
    of = np.repeat(each, kinds + 1)
    keep = ~plain[of]
    of, size, (many, rest) = of[keep], size[keep], np.divmod(gap[keep], 138)
    took = many + np.where(rest >= 3, 1, rest) + (size > 0)
    after = np.cumsum(took)
    said, more, extra = np.zeros((3, int(took.sum())), np.int64)
    said[after[size > 0] - 1] = size[size > 0]
    for t in range(int(many.max(initial=0))):
        at = (after - took)[many > t] + t
        said[at], more[at], extra[at] = 18, 127, 7
    runs = rest >= 3
    at, long = (after - took + many)[runs], rest[runs] >= 11
    said[at], more[at], extra[at] = 17 + long, rest[runs] - np.where(long, 11, 3), np.where(long, 7, 3)
    of = np.repeat(of, took)
    widths = _lengths(np.bincount(of * 19 + said, minlength=rows * 19).reshape(rows, 19), 7)
    codes, ordered = _codes(widths), widths[:, CODE_LENGTH_ORDER]
    told = np.maximum(19 - np.argmax(ordered[:, ::-1] > 0, 1), 4)
    head = np.where(plain, 5 | (kinds == 2) << 1 | np.where(kinds > 0, first, 0) << 3 | np.where(kinds == 2, last, 0) << 11, (told - 4) << 1 | (ordered << (5 + 3 * np.arange(19))).sum(1))
    widths[np.count_nonzero(widths, 1) == 1] = 0
    times = np.bincount(of, minlength=rows)
    values, bits = np.zeros((2, len(of) + rows), np.int64)
    at, heads, n = np.arange(len(of)) + of + 1, np.cumsum(times) - times + each, widths[of, said]
    values[at], bits[at] = codes[of, said] | more << n, n + extra
    values[heads], bits[heads] = head, np.where(plain, 3 + 8 * np.maximum(kinds, 1), 6 + 3 * told)
    return values, bits, times + 1


Parts = list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # values, their bits, how many an image has


def _packed(parts: Parts) -> list[bytes]:
    """The bits of images, each of which has its part of the first values, then of the next."""
    ends = [np.append(0, np.cumsum(bits)) for _, bits, _ in parts]
    upto = [e[np.append(0, np.cumsum(many))] for e, (_, _, many) in zip(ends, parts, strict=True)]
    sizes = sum(np.diff(u) for u in upto)
    first = np.append(0, np.cumsum((sizes + 31) >> 5))  # words
    words, at, low, half = np.zeros(int(first[-1]) + 4, np.uint64), 32 * first[:-1], np.uint64(0xFFFFFFFF), np.uint64(32)
    for (values, _, many), end, u in zip(parts, ends, upto, strict=True):
        start, values = end[:-1] + np.repeat(at - u[:-1], many), values.astype(np.uint64)
        wide = np.flatnonzero(values > low)
        for i, part, s in ((0, values & low, start), (1, values[wide] >> half, start[wide])):  # no two share a bit, so sums are unions
            moved, word = part << (s & 31).astype(np.uint64), (s >> 5) + i
            np.add.at(words, word, moved & low)
            np.add.at(words, word + 1, moved >> half)
        at = at + np.diff(u)
    data = words.astype("<u4").tobytes()
    return [data[4 * f : 4 * f + (n + 7 >> 3)] for f, n in zip(first.tolist(), sizes.tolist(), strict=False)]


def _coded(argb: np.ndarray, sizes: np.ndarray, widths: np.ndarray, main: bool) -> Parts:
    """Images, of so many pixels and so wide, one after another: pixels with the references,
    and the colour cache, that save bits. Every image has its own codes; what is done for
    all at once depends on no other image."""
    n, images = len(argb), len(sizes)
    of, px = np.repeat(np.arange(images), sizes), argb.view(np.uint8).reshape(-1, 4)
    at, length, back = _repeats(argb, sizes)
    kind = np.zeros(n, np.int8)  # 0 literal, 1 start of a copy, 2 in a copy, 3 cache hit
    kind[_ranges(at, length)] = 2
    kind[at] = 1
    value = back + 120
    for w in set(widths.tolist()):
        near = _near_values(w)
        there = np.minimum(back, len(near) - 1)
        value = np.where((widths[of[at]] == w) & (back < len(near)) & (near[there] > 0), near[there], value)
    length_prefix, length_more, length_bits = _prefixes(length)
    far_prefix, far_more, far_bits = _prefixes(value)
    # Four codes of an image, each of WIDE places: green, lengths and keys; red and blue, as
    # samples of a text are alike in all channels; alpha; distances.
    base = of * (4 * WIDE)
    planes = [base + px[:, 1], base + WIDE + px[:, 2], base + WIDE + px[:, 0]]
    opaque = int(argb.min()) >= 0xFF000000
    if not opaque:
        planes.append(base + 2 * WIDE + px[:, 3])
    cache_bits = np.where(sizes > 32, np.clip(_width(sizes) - 2, 1, CACHE), 0)
    keys, held = _cached(argb, of, cache_bits)
    hit, miss = np.flatnonzero((kind == 0) & held), np.flatnonzero((kind == 0) & ~held)
    keys = base[hit] + 280 + keys[hit]
    copied = [base[at] + 256 + length_prefix, base[at] + 3 * WIDE + far_prefix]
    count = lambda *places: np.bincount(np.concatenate(places), minlength=images * 4 * WIDE).reshape(images, 4, WIDE)
    both = count(*(p[miss] for p in planes), *copied)
    counts, with_cache = both + count(*(p[hit] for p in planes)), both + count(keys)
    least = [_bits(c[:, :2].reshape(-1, WIDE)).reshape(-1, 2).sum(1) for c in (with_cache, counts)]
    cached = least[0] < least[1]
    counts[cached] = with_cache[cached]
    if opaque:
        counts[:, 2, 255] = 1
    real = cached[of[hit]]
    hit, keys = hit[real], keys[real]
    kind[hit] = 3
    lengths = _lengths(counts.reshape(-1, WIDE))
    alphabets = np.tile([280, 256, 256, 40], (images, 1))
    alphabets[:, 0] += np.where(cached, 1 << cache_bits, 0)
    values, bits, times = _said(lengths, alphabets.ravel())
    five = (4 * np.arange(images)[:, None] + [0, 1, 1, 2, 3]).ravel()
    place = _ranges((np.cumsum(times) - times)[five], times[five])
    said = values[place], bits[place], times[five].reshape(-1, 5).sum(1)
    table = _codes(lengths) << 8 | np.where(np.count_nonzero(lengths, 1) > 1, 1, 0)[:, None] * lengths
    table = table.ravel()
    values, bits = np.zeros((2, n), np.int64)
    literal = np.flatnonzero(kind == 0)
    v, k = table[planes[0][literal]] >> 8, table[planes[0][literal]] & 255
    for plane in planes[1:]:
        entry = table[plane[literal]]
        v |= (entry >> 8) << k
        k += entry & 255
    values[literal], bits[literal] = v, k
    values[hit], bits[hit] = table[keys] >> 8, table[keys] & 255
    v, k = table[copied[0]] >> 8, table[copied[0]] & 255
    for x, size in ((length_more, length_bits), (table[copied[1]] >> 8, table[copied[1]] & 255), (far_more, far_bits)):
        v |= x << k
        k += size
    values[at], bits[at] = v, k
    told = np.flatnonzero(kind != 2)
    first = np.where(cached, 1 | cache_bits << 1, 0), 1 + 4 * cached + int(main), np.ones(images, np.int64)
    return [first, said, (values[told], bits[told], np.bincount(of[told], minlength=images))]


def _side_by_side(images: Sequence[np.ndarray], main: bool) -> Parts:
    return _coded(np.concatenate([a.ravel() for a in images]).astype(np.uint32, copy=False), np.array([a.size for a in images]), np.array([a.shape[1] for a in images]), main)


class Writer:
    """Collects bits, lowest first."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def array(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts += [(np.array(self.values, np.int64), np.array(self.sizes, np.int64)), (values.astype(np.int64), sizes)]
        self.values, self.sizes = [], []

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All values and their bits."""
        if not self.parts:
            return np.array(self.values, np.int64), np.array(self.sizes, np.int64)
        self.array(np.zeros(0, np.int64), np.zeros(0, np.int64))
        values, sizes = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        return values, sizes

    def bytes(self) -> bytes:
        values, sizes = self.all()
        return _packed([(values, sizes, np.array([len(values)]))])[0]

    def image(self, argb: np.ndarray, main: bool = False) -> None:
        """Writes pixels with the references, and the colour cache, that save bits."""
        for values, sizes, _ in _side_by_side([np.atleast_2d(argb)], main):
            self.array(values, sizes)


def container(stream: bytes) -> bytes:
    """The image file around a bit stream."""
    body = b"\x2f" + stream
    even = body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(even)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + even


def _argb(px: np.ndarray) -> np.ndarray:
    p = px.astype(np.uint32)
    return (p[..., 2] << np.uint32(16)) | (p[..., 1] << np.uint32(8)) | p[..., 0]


def _samples(px: np.ndarray) -> float:
    """About the size of the three channels of px (h, w, 3), in bits, without references."""
    return float(_bits(np.stack([_count(px[..., 1]), _count(px[..., [0, 2]])])).sum())


def _residual(px: np.ndarray, mode: int) -> np.ndarray:
    """px (h, w, 3) less its predictions under one of the modes left, top, their mean,
    and gradient."""
    p = px.astype(np.int16)
    left, top, corner = np.roll(p, 1, 1), np.roll(p, 1, 0), np.roll(p, (1, 1), (0, 1))
    guess = {1: left, 2: top, 7: (left + top) >> 1, 12: np.clip(left + top - corner, 0, 255)}[mode].copy()
    guess[0], guess[:, 0] = left[0], top[:, 0]
    guess[0, 0] = 0
    return ((p - guess) & 255).astype(np.uint8)


def _slopes(x: np.ndarray, ys: list[np.ndarray]) -> list[int]:
    """How each y follows x, in 32nds, all as signed bytes; 0 without a trend."""
    x = x.view(np.int8).astype(np.float32)
    x -= x.mean()
    x = x.ravel()
    spread = float(x @ x)
    return [max(-128, min(127, round(32 * float(x @ y.view(np.int8).ravel().astype(np.float32)) / spread))) if spread else 0 for y in ys]


def _palette(out: Writer, argb: np.ndarray, colours: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins the transform; gives the image of its colours, which follows, and packed
    indices as pixels."""
    h, w = argb.shape
    n = len(colours)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1
    out.put(1, 1)
    out.put(3, 2)
    out.put(n - 1, 8)
    deltas = np.diff(np.ascontiguousarray(colours, "<u4").view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))
    per = 1 << pack
    index = np.pad(index.reshape(h, w), ((0, 0), (0, -w % per))).reshape(h, -1, per)
    return np.ascontiguousarray(deltas).view("<u4").ravel(), (index << (np.arange(per) * (8 >> pack))).sum(-1).astype(np.uint32) << np.uint32(8)


_FOUR = np.array([[0], [256], [256], [512], [512], [768]], np.uint16)


def _decorrelated(out: Writer, px: np.ndarray, argb: np.ndarray) -> np.ndarray:
    """Writes subtract-green or cross-colour, and a predictor, where they make the samples
    smaller; gives what is left as pixels: argb, those of px, if nothing is written."""
    whole = px
    blocks, alpha = (-(-px.shape[0] // 512), -(-px.shape[1] // 512)), np.uint32(0xFF000000)
    blue, green, red = (np.ascontiguousarray(px[..., i]) for i in range(3))
    to_red, to_blue = _slopes(green, [red, blue])
    # Four histograms in one: green, the others, the others less green, steps of green.
    kinds = np.empty((6, green.size), np.uint16)
    kinds[0], kinds[1], kinds[2] = green.ravel(), blue.ravel(), red.ravel()
    kinds[3], kinds[4], kinds[5] = (blue - green).ravel(), (red - green).ravel(), 0
    kinds[5, 1:] = green.ravel()[1:] - green.ravel()[:-1]
    kinds += _FOUR
    of_green, of_rest, of_less, of_next = _bits(np.bincount(kinds.ravel(), minlength=1024).reshape(4, 256)).tolist()
    best = of_green + of_rest
    if (size := of_green + of_less) < best:
        best, px = size, np.stack([blue - green, green, red - green], -1)
        out.put(1, 1)
        out.put(2, 2)
    elif abs(to_red) + abs(to_blue) > 4:
        signed = green.view(np.int8).astype(np.int32)
        crossed = np.stack([blue - ((to_blue * signed) >> 5), green, red - ((to_red * signed) >> 5)], -1).astype(np.uint8)
        if (size := _samples(crossed) + 120) < best:
            best, px = size, crossed
            out.put(1, 1)
            out.put(1, 2)
            out.put(7, 3)
            out.image(np.full(blocks, (to_blue & 255) << 8 | (to_red & 255), np.uint32))
    # Where not even the pixel to the left tells of the next one, no neighbour is tried.
    if of_next < of_green:
        size, mode = min((_samples(_residual(px, m)) + 100, m) for m in (1, 2, 7, 12))
        if size < best:
            px, alpha = _residual(px, mode), np.uint32(0)
            out.put(1, 1)
            out.put(0, 2)
            out.put(7, 3)
            out.image(np.full(blocks, mode << 8, np.uint32))
    return argb if px is whole else _argb(px) | alpha


def _may_change(argb: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which images, of so many pixels, one after another, _decorrelated() may change: the
    same estimates, but for the predictor, from sums over all images."""
    images, starts = len(sizes), np.cumsum(sizes) - sizes
    of, px = np.repeat(np.arange(images), sizes), argb.view(np.uint8).reshape(-1, 4)
    blue, green, red = (np.ascontiguousarray(px[:, i]) for i in range(3))
    after = np.diff(green, prepend=green[:1])
    after[starts] = 0
    base = of << 10
    places = [base + green, (base | 256) + blue, (base | 256) + red, (base | 512) + (blue - green), (base | 512) + (red - green), (base | 768) + after]
    of_green, of_rest, of_less, of_next = _bits(np.bincount(np.concatenate(places), minlength=images << 10).reshape(-1, 256)).reshape(-1, 4).T
    out = (of_less < of_rest) | (of_next < of_green)
    signed = [x.view(np.int8).astype(np.int64) for x in (green, red, blue)]
    total = [np.add.reduceat(x, starts) for x in signed]
    spread = np.add.reduceat(signed[0] * signed[0], starts) * sizes - total[0] * total[0]
    slopes = []
    for x, t in zip(signed[1:], total[1:], strict=True):
        both = np.add.reduceat(signed[0] * x, starts) * sizes - total[0] * t
        slopes.append(np.clip(np.rint(32 * both / np.maximum(spread, 1)), -128, 127).astype(np.int64))
    steep = ~out & (abs(slopes[0]) + abs(slopes[1]) > 4)
    if steep.any():
        at = np.flatnonzero(steep[of])
        own = of[at]
        less = [(x[at] - ((t[own] * signed[0][at]) >> 5)) & 255 for x, t in zip(signed[1:], slopes, strict=True)]
        crossed = np.bincount(np.concatenate([own << 8 | x for x in less]), minlength=images << 8).reshape(-1, 256)
        out |= steep & (_bits(crossed) + 120 < of_rest)
    return out


def encode(rgb: np.ndarray) -> bytes:
    """An image file of (height, width, 3) samples."""
    return encode_all([rgb])[0]


def encode_all(images: list[np.ndarray]) -> list[bytes]:
    """encode() of several images, of 2^21 pixels at most together, side by side. Files do
    not depend on the images that they are written with."""
    sizes = np.array([p.shape[0] * p.shape[1] for p in images])
    whole = _argb(np.concatenate([p.reshape(-1, 3)[:, ::-1] for p in images])) | np.uint32(0xFF000000)
    files, groups = [b""] * len(images), ([], [], [])  # left as they are, with a palette, and with other transforms
    for i, (rgb, end, changes) in enumerate(zip(images, np.cumsum(sizes).tolist(), _may_change(whole, sizes).tolist(), strict=True)):
        h, w, _ = rgb.shape
        out, argb, table = Writer(), whole[end - h * w : end].reshape(h, w), None
        out.put(w - 1 | (h - 1) << 14, 32)
        few = len(set(argb[:2].ravel().tolist())) <= 16
        colours, index = np.unique(argb, return_inverse=True) if few else (None, None)
        if few and len(colours) <= 16:
            table, argb = _palette(out, argb, colours, index)
        elif changes:
            argb = _decorrelated(out, np.ascontiguousarray(rgb[..., ::-1]), argb)
        groups[1 if table is not None else 2 if changes else 0].append((i, out, table, argb))
    for group in groups:
        if group:
            place, outs, tables, left = zip(*group, strict=True)
            first, one = [o.all() for o in outs], np.ones(len(group), np.int64)
            parts = [(*(np.concatenate(x) for x in zip(*first, strict=True)), np.array([len(v) for v, _ in first]))]
            if tables[0] is not None:
                parts += _side_by_side([t[None] for t in tables], False)
            for i, stream in zip(place, _packed([*parts, (0 * one, one, one), *_side_by_side(left, True)]), strict=True):
                files[i] = container(stream)
    return files
