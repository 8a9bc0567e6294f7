"""External induced sorting of the suffixes of a shard, with common-prefix values.

Leftmost S-type suffixes are sorted first: their substrings by induction, then, where
names repeat, by this very sort of the string of names, a name written as one or two
digits so that alphabets stay small, down to strings of SHORT
characters, which are sorted in memory. Common prefixes come back from that recursion as numbers of names and
are carried on as numbers of characters. From the sorted leftmost
S-type suffixes, one scan upwards induces all L-type suffixes and one downwards all S-type
ones.

What a scan induces waits in a priority queue by first character, as tuples (suffix,
length of the prefix shared with the tuple before). Characters leave a scan in order, so
the queue is a radix heap: tuples for later groups of characters lie together and are dealt
out to single characters when the scan comes to their group. Among tuples of a character
the order of arrival is the order of suffixes. A queue holds `room` tuples; what is beyond
goes to a temporary file, block by block, and is read back block by block. Arrays as long
as the text are files mapped to memory if they are over HELD bytes. The result is a stream
of blocks, so a shard may be far larger than memory.

A tuple's shared prefix is one more than the least of those scanned since the last tuple
of its character. Where L- and S-type suffixes of a character meet, it is the shorter of
their runs of that character.

Defined cases: a text without characters gives no blocks, one of a single character one
suffix. Equal characters, periodic texts and runs of any length are ordinary input.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np

ROOM = 1 << 18  # tuples that a queue holds in memory
SHORT = 1 << 20  # characters that are sorted in memory
BLOCK = 1 << 16  # tuples worked on at once
HELD = 1 << 26  # bytes of an array that is held in memory
CAP = 1 << 15  # common prefixes are told apart up to here
WIDE = 1 << 10  # names up to here are one digit

Block = tuple[np.ndarray, np.ndarray]


def scratch(n: int, kind: type) -> np.ndarray:
    """An array to be filled: in memory, or a mapped file that ends with it."""
    if n * np.dtype(kind).itemsize <= HELD:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, kind, "w+", shape=(n,))


class Queue:
    """A monotone priority queue of tuples by character, backed by a file. What is taken
    stays, so that the tuples of a character can be read again, either way round."""

    written = 0  # tuples that went to files, over all queues of this process

    def __init__(self, size: int, room: int, kind: type, long: bool) -> None:
        self.width = isqrt(max(0, size - 1)) + 1  # characters of a group
        self.groups: dict[int, list] = {}  # parts: arrays (character, suffix, shared), or a place in the file
        self.single: dict[int, list] = {}  # parts: arrays (suffix, shared), or a place in the file
        self.kinds = [kind, np.int64 if long else np.int32, np.uint16]
        self.open, self.room, self.held, self.file = -1, room, 0, None
        self.reading: list = []
        self.sizes: dict[int, int] = {}  # tuples in memory, by character, or by ~group

    def put(self, to: np.ndarray, suffix: np.ndarray, shared: np.ndarray) -> None:
        """Tuples in order of arrival within each character; characters ascending."""
        suffix, shared = suffix.astype(self.kinds[1]), shared.astype(self.kinds[2])
        group = to // self.width
        edges = np.flatnonzero(group[1:] != group[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(to)], strict=True):
            if group[a] == self.open:
                self._deal(to[a:b], suffix[a:b], shared[a:b])
            else:
                key = int(group[a])
                self.groups.setdefault(key, []).append((to[a:b], suffix[a:b], shared[a:b]))
                self.sizes[~key] = self.sizes.get(~key, 0) + b - a
        self.held += len(to)
        if self.held > self.room:
            self._spill()

    def _deal(self, to: np.ndarray, suffix: np.ndarray, shared: np.ndarray) -> None:
        edges = np.flatnonzero(to[1:] != to[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(to)], strict=True):
            key = int(to[a])
            self.single.setdefault(key, []).append((suffix[a:b], shared[a:b]))
            self.sizes[key] = self.sizes.get(key, 0) + b - a

    def _spill(self) -> None:
        """Writes the fullest lists, each as one part more, until half the room is free."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for key, n in sorted(self.sizes.items(), key=lambda s: -s[1]):
            if 2 * self.held <= self.room or not n:
                break
            parts = self.single[key] if key >= 0 else self.groups[~key]
            fresh = [i for i, p in enumerate(parts) if not isinstance(p[0], int)]
            # The list that is being read keeps its places; others get one part for all.
            for some in [[i] for i in fresh] if parts is self.reading else [fresh]:
                at = self.file.seek(0, 2)
                whole = [np.concatenate(x) for x in zip(*(parts[i] for i in some), strict=True)]
                for x in whole:
                    self.file.write(x.data)
                parts[some[0]] = (at, len(whole[0]))
            if parts is not self.reading:
                del parts[fresh[0] + 1 :]  # what is not in the file is last
            self.held -= n
            self.sizes[key] = 0
            Queue.written += n

    def _part(self, part: tuple, kinds: list) -> tuple:
        if not isinstance(part[0], int):
            return part
        self.file.seek(part[0])
        raw, out, at = self.file.read(part[1] * sum(np.dtype(k).itemsize for k in kinds)), [], 0
        for k in kinds:
            out.append(np.frombuffer(raw, k, part[1], at))
            at += out[-1].nbytes
        return tuple(out)

    def _blocks(self, parts: list, kinds: list) -> Iterator[list[np.ndarray]]:
        """The parts of a list, also those that arrive meanwhile, some at a time."""
        i = 0
        while i < len(parts):
            got, n = [], 0
            while i < len(parts) and n < BLOCK:
                got.append(self._part(parts[i], kinds))
                n += len(got[-1][0])
                i += 1
            yield [np.concatenate(x) for x in zip(*got, strict=True)] if len(got) > 1 else list(got[0])

    def take(self, c: int) -> Iterator[Block]:
        """The character's tuples in order of arrival, also those that arrive meanwhile."""
        if c // self.width != self.open:
            self.open = c // self.width
            for to, suffix, shared in self._blocks(parts := self.groups.pop(self.open, []), self.kinds):
                by = np.argsort(to, kind="stable")
                self._deal(to[by], suffix[by], shared[by])
            self.sizes.pop(~self.open, None)
            self.held += sum(p[1] for p in parts if isinstance(p[0], int))  # back in memory
        self.reading = self.single.setdefault(c, [])
        for suffix, shared in self._blocks(self.reading, self.kinds[1:]):
            yield suffix.astype(np.int64), shared.astype(np.int32)

    def back(self, c: int) -> Iterator[Block]:
        """The character's tuples, last first; each with what it shares with the one
        after it in order of arrival, 0 for the last."""
        parts, after = self.single.get(c, []), 0
        i = len(parts)
        while i:
            got, n = [], 0
            while i and n < BLOCK:
                i -= 1
                got.insert(0, self._part(parts[i], self.kinds[1:]))
                n += len(got[0][0])
            suffix, shared = (np.concatenate(x) for x in zip(*got, strict=True))
            yield suffix[::-1].astype(np.int64), np.append(after, shared[:0:-1]).astype(np.int32)
            after = int(shared[0])


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type: less than the one after it."""
    n = len(text)
    out = scratch(n, bool)
    rises = False  # of the run that goes on to the right of the block; the last one falls off to the end
    for a in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        part = text[a : min(a + BLOCK + 1, n)]  # with the next block's first character
        last = a + BLOCK >= n
        ends = np.flatnonzero(part[:-1] != part[1:])
        up = part[ends] < part[ends + 1]
        size = len(part) if last else len(part) - 1
        # Each place has the type of the end of its run; a run that leaves the block, of what follows.
        which = np.searchsorted(ends, np.arange(size))
        out[a : a + size] = np.append(up, rises)[which]
        rises = bool(out[a])
    return out


def _run(text: np.ndarray, at: int) -> int:
    """Length of the run of one character at a place, up to CAP."""
    n = 64
    while True:
        differs = np.flatnonzero(text[at : at + n] != text[at])
        if len(differs) or n >= CAP or at + n >= len(text):
            return int(differs[0]) if len(differs) else min(n, len(text) - at)
        n *= 8


def _scan(text: np.ndarray, s_type: np.ndarray, seeds: Callable[[int], Iterator[Block]], up: bool, size: int, room: int, carry: bool) -> Queue:
    """Induces the suffixes of one type from seeds of the other: upwards L-type ones,
    downwards S-type ones. A character's seeds are scanned after its own."""
    n = len(text)
    queue = Queue(size, room, text.dtype.type, n >= 1 << 31)
    since = np.full(size, CAP, np.int32)  # least shared prefix since a character's last tuple

    def induce(suffix: np.ndarray, shared: np.ndarray) -> None:
        at = np.flatnonzero(suffix > 0)
        at = at[s_type[suffix[at] - 1] != up]
        own = suffix[at] - 1
        to = text[own]
        by = np.argsort(to, kind="stable")
        at, to, own = at[by], to[by], own[by]
        if not carry:
            if len(at):
                queue.put(to, own, np.zeros(len(at), np.uint16))
            return
        low = np.minimum.accumulate(shared)
        if len(at):
            tail = np.append(np.minimum.accumulate(shared[::-1])[::-1], CAP)
            starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            got = np.empty(len(at), np.int32)
            if len(at) > len(starts):
                inner = np.ones(len(at), bool)
                inner[starts] = False
                k = np.flatnonzero(inner)
                pairs = np.empty(2 * len(k), np.int64)
                pairs[0::2], pairs[1::2] = at[k - 1] + 1, at[k] + 1
                got[k] = np.minimum.reduceat(np.append(shared, CAP), pairs)[0::2]
            got[starts] = np.minimum(since[to[starts]], low[at[starts]])
            np.minimum(since, low[-1], out=since)
            since[to[starts]] = tail[at[np.append(starts[1:], len(at)) - 1] + 1]
            queue.put(to, own, np.minimum(got + 1, CAP))
        else:
            np.minimum(since, low[-1], out=since)

    if up:
        queue.put(np.array(text[-1:]), np.array([n - 1]), np.zeros(1, np.int32))
    for c in range(size) if up else range(size - 1, -1, -1):
        last, whole = -1, [False]
        for suffix, shared in queue.take(c):
            if last < 0:
                shared[0] = 0
            last = int(suffix[-1])
            induce(suffix, shared)
        for suffix, shared in seeds(c):
            if not whole[0]:
                shared = shared.copy()
                shared[0] = min(_run(text, last), _run(text, int(suffix[0]))) if carry and last >= 0 else 0
                whole[0] = True
            induce(suffix, shared)
    return queue


def _by_character(text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """starts by character, and where each character's begin."""
    counts = np.zeros(size, np.int64)
    for a in range(0, len(starts), BLOCK):
        counts += np.bincount(text[starts[a : a + BLOCK]], minlength=size)
    begin = np.append(0, np.cumsum(counts))
    out, place = scratch(len(starts), np.int64), begin[:-1].copy()
    for a in range(0, len(starts), BLOCK):
        part = starts[a : a + BLOCK]
        first = text[part]
        by = np.argsort(first, kind="stable")
        first = first[by].astype(np.int64)
        new = np.append(True, first[1:] != first[:-1])
        rank = np.arange(len(first)) - np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
        out[place[first] + rank] = part[by]
        place += np.bincount(first, minlength=size)
    return out, begin


def _slices(suffixes_: np.ndarray, shared: np.ndarray | None, begin: np.ndarray) -> Callable[[int], Iterator[Block]]:
    """Seeds from arrays in order of characters."""

    def seeds(c: int) -> Iterator[Block]:
        for a in range(int(begin[c]), int(begin[c + 1]), BLOCK):
            b = min(a + BLOCK, int(begin[c + 1]))
            yield np.array(suffixes_[a:b]), np.zeros(b - a, np.int32) if shared is None else np.array(shared[a:b])

    return seeds


def _names(text: np.ndarray, starts: np.ndarray, ordered: Iterator[np.ndarray]) -> tuple[np.ndarray, int]:
    """Names of the substrings that begin at starts, in text order, and their number;
    equal substrings, equal names, in the order of `ordered`."""
    n, m = len(text), len(starts)
    names, count, before = scratch(m, np.int64), 0, None
    number = scratch(n, np.int32 if n < 1 << 31 else np.int64)  # of the substring that begins at a place
    for i in range(0, m, BLOCK):
        number[starts[i : i + BLOCK]] = np.arange(i, min(i + BLOCK, m))
    for block in ordered:
        where = number[block].astype(np.int64)
        length = np.where(where + 1 < m, starts[np.minimum(where + 1, m - 1)], n - 1) + 1 - block
        last = where == m - 1  # reaches the end of the text and equals no other
        a = np.append(before[0] if before else block[0], block[:-1])
        same = np.append(before[1] if before else -1, length[:-1]) == length
        same &= ~last & ~np.append(before[2] if before else True, last[:-1])
        live, k = np.flatnonzero(same), 0
        while len(live):
            differ = text[a[live] + k] != text[block[live] + k]
            same[live[differ]] = False
            k += 1
            live = live[~differ]
            live = live[k < length[live]]
        names[where] = count - 1 + np.cumsum(~same)
        count += int((~same).sum())
        before = block[-1], length[-1], last[-1]
    return names, count


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, shared: np.ndarray, most: int) -> np.ndarray:
    """Lengths of common prefixes of suffixes a and b, known to be `shared` at least and
    told apart up to most."""
    n, live = len(text), np.flatnonzero(shared < most)
    while len(live):
        x, y = a[live] + shared[live], b[live] + shared[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        shared[live] += 1
        live = live[shared[live] < most]
    return shared


def _leftmost(text: np.ndarray, starts: np.ndarray, names: np.ndarray, count: int, depth: int, room: int) -> Iterator[Block]:
    """The leftmost S-type suffixes in order, from the names of their substrings."""
    n, m = len(text), len(starts)
    digits = 1 if count <= WIDE or 20 * m > 9 * n else 2
    before = -1  # the suffix before a block

    def told(index: np.ndarray, common: np.ndarray) -> Block:
        suffix = np.array(starts[index])
        a = np.append(before if before >= 0 else suffix[0], suffix[:-1])
        end = index + common  # the first name that differs; the last name equals no other
        shared = np.minimum(np.array(starts[end]) - suffix, CAP).astype(np.int32)
        if before < 0:
            shared[0] = 0
        first = int(before < 0)
        shared[first:] = _extend(text, a[first:], suffix[first:], shared[first:], min(depth, CAP))
        return suffix, shared

    if count == m:
        index = scratch(m, np.int64)
        for i in range(0, m, BLOCK):
            index[names[i : i + BLOCK]] = np.arange(i, min(i + BLOCK, m))
        for i in range(0, m, BLOCK):
            part = np.array(index[i : i + BLOCK])
            yield (out := told(part, np.zeros(len(part), np.int64)))
            before = int(out[0][-1])
        return
    base = count if digits == 1 else isqrt(count - 1) + 1
    reduced = scratch(digits * m, np.uint16 if base <= 1 << 16 else np.uint32)
    for i in range(0, m, BLOCK):
        part = names[i : i + BLOCK]
        for k in range(digits):
            reduced[digits * i + k : digits * (i + len(part)) : digits] = part // base ** (digits - 1 - k) % base
    least = CAP  # shared by all since the last suffix that starts at a name
    for suffix, shared in _inside(reduced) if len(reduced) <= SHORT else suffixes(reduced, depth, room):
        at = np.flatnonzero(suffix % digits == 0)
        if not len(at):
            least = min(least, int(shared.min()))
            continue
        low = np.minimum.reduceat(shared, np.append(0, at[:-1] + 1))
        low[0] = min(low[0], least)
        least = int(shared[at[-1] + 1 :].min()) if at[-1] + 1 < len(shared) else CAP
        yield (out := told(suffix[at] // digits, low // digits))
        before = int(out[0][-1])


def _inside(text: np.ndarray) -> Iterator[Block]:
    """What suffixes() gives, of a text so short that it is sorted in memory: ranks by
    prefixes of doubled lengths, which also tell what neighbours share."""
    rank, n, k, ranks = np.unique(text, return_inverse=True)[1].astype(np.int64), len(text), 1, []
    while True:
        ranks.append(np.append(rank, -1).astype(np.int32))
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        keys = rank * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        fresh = np.append(True, keys[order][1:] != keys[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            break
        k *= 2
    shared = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for j in range(len(ranks) - 1, -1, -1):
        x, y = a + shared[1:], b + shared[1:]
        both = np.maximum(x, y) < n
        both &= ranks[j][np.minimum(x, n)] == ranks[j][np.minimum(y, n)]
        shared[1:][both] += 1 << j
    yield order, np.minimum(shared, CAP).astype(np.int32)


def suffixes(text: np.ndarray, depth: int, room: int = ROOM) -> Iterator[Block]:
    """All suffixes of a text of small integers in order, block by block, with the length
    of the prefix that each shares with the one before (right up to depth, at least depth
    beyond)."""
    n = len(text)
    if n < 2:
        if n:
            yield np.zeros(1, np.int64), np.zeros(1, np.int32)
        return
    size = int(text.max()) + 1
    s_type = _types(text)
    starts = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    m = len(starts)
    ordered, shared, begin = starts, np.zeros(m, np.int32), np.zeros(size + 1, np.int64)
    if m:
        rough, begin = _by_character(text, starts, size)
        low = _scan(text, s_type, _slices(rough, None, begin), True, size, room, False)
        high = _scan(text, s_type, low.back, False, size, room, False)
        is_start = scratch(n, bool)
        is_start[starts] = True
        names, count = _names(text, starts, (x for c in range(size) for b, _ in high.back(c) if len(x := b[is_start[b]])))
        del low, high, rough
        ordered, shared, i = scratch(m, np.int64), scratch(m, np.int32), 0
        for s, common in _leftmost(text, starts, names, count, depth, room):
            ordered[i : i + len(s)], shared[i : i + len(s)] = s, common
            i += len(s)
        del names
    low = _scan(text, s_type, _slices(ordered, shared, begin), True, size, room, True)
    high = _scan(text, s_type, low.back, False, size, room, True)
    for c in range(size):
        last = -1
        for suffix, common in low.take(c):
            if last < 0:
                common[0] = 0
            last = int(suffix[-1])
            yield suffix, common
        fresh = True
        for suffix, common in high.back(c):
            if fresh:
                common[0] = min(_run(text, last), _run(text, int(suffix[0]))) if last >= 0 else 0
                fresh = False
            yield suffix, common
