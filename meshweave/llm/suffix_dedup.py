"""Suffix-array dedup: removes every byte that a repeated string of `length` bytes covers.

The corpus is dealt out to shards such that equal strings meet: each window of `length`
bytes goes to the shard of its minimizer, the part of `m` bytes with the least hash, and
neighbouring windows of one minimizer travel as one stretch of text. Stretches whose
minimizer occurs once in all cannot hold a repeated window and stay where they are. Equal
stretches are aggregated before they are shuffled, by a 128-bit hash, so that a group of
copies is sorted once however large it is; it is known to be repeated throughout. A
shard's distinct stretches are sorted by external induced sorting (induced_sort), stretch
after stretch of one minimizer at a time: suffixes that share `length` bytes with a
neighbour in suffix order are repeated windows. A shard of SHARD bytes is many times what
the sort's queues hold, and its result is read as a stream.

A passage that very many documents share in differing surroundings gives one minimizer
very many distinct stretches. As one task must not hold an unbounded group, the windows of
minimizers with more than `hot` distinct stretches, or HOT_BYTES of them, are dealt out once
more by a 128-bit hash of their bytes and counted, which gives the same windows.

Defined cases: null text is empty: nothing is removed. Texts under `length` bytes neither.
Rows that repeat an id and text are documents of their own whose strings repeat. Windows
never cross documents. An empty table gives an empty result. Only id and text are read.
Rows are told apart by their id and a 64-bit hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave.llm import induced_sort
from meshweave.llm.common import pieces, stash

LENGTH = 200
M = 64
HOT, HOT_BYTES = 2048, 1 << 22
SHARD = 1 << 22  # bytes sorted at once
CHUNK = 1 << 19
BROADCAST = 1_000_000  # places in texts, 24 bytes each, that are broadcast; more are joined by a shuffle
B1, B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        got = np.ones(size, np.uint64)
        np.multiply.accumulate(np.full(size - 1, pow(base, -1, 1 << 64) if inverse else base, np.uint64), out=got[1:])
        _powers[base, inverse] = got
    return got[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashed:
    """Hashes of any substrings of a run of bytes."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
        value ^= value >> np.uint64(31)
        self.base, self.sums = base, np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value * _power(base, len(data)), dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * _power(self.base, len(self.sums), True)[start] + (end - start).astype(np.uint64))

    def every(self, m: int) -> np.ndarray:
        return _mix((self.sums[m:] - self.sums[:-m]) * _power(self.base, len(self.sums) - m, True))


def _window_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: least so far from block starts and to block ends."""
    n = len(h)
    padded = np.full(-(-n // w) * w, ~np.uint64(0))
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    to = np.minimum.accumulate(blocks, 1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(since[: n - w + 1], to[w - 1 : n])


def _times(h: np.ndarray, least: np.ndarray, w: int, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often each stretch has its minimizer: more than once where a text repeats
    itself within a window's reach."""
    # A place is some window's minimizer if no window over it has a lower one only.
    edge = np.zeros(w - 1, np.uint64)
    most = ~_window_least(~np.concatenate([edge, least, edge]), w)
    places = np.flatnonzero(h == most)
    lo, hi = np.searchsorted(places, start), np.searchsorted(places, start + count + w - 1)
    n = hi - lo
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    same = h[places[at]] == np.repeat(least[start], n)
    return np.bincount(np.repeat(np.arange(len(start)), n)[same], minlength=len(start))


def chunks(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, r in enumerate(raws):
        size += len(r)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(raws):
        yield start, len(raws)


def stretches(raws: list[bytes], length: int, m: int) -> tuple[np.ndarray, ...]:
    """Of texts in bytes: text index, start in the text, number of windows, minimizer's
    hash, how often it occurs, and two hashes of the bytes, for each stretch of windows
    with one minimizer."""
    sizes = np.array([len(r) for r in raws])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raws), np.uint8)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    h1 = Hashed(data, B1)
    every, w = h1.every(m), length - m + 1
    least = _window_least(every, w)
    owner = np.repeat(np.arange(len(raws)), sizes)[: len(least)]
    whole = np.arange(length, len(data) + 1) <= ends[owner]
    change = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1]))
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, len(least)))
    ok = whole[start]
    start, count = start[ok], count[ok]
    end = start + count + length - 1
    return owner[start], start - (ends - sizes)[owner[start]], count, least[start], _times(every, least, w, start, count), h1.of(start, end), Hashed(data, B2).of(start, end)


def _raws(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def repeated_windows(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text, ranges of its windows of `length` bytes that also start elsewhere
    in these texts, by induced sorting."""
    joined = np.zeros(sum(map(len, texts)) + len(texts), np.uint16)
    begin, at = [], 0
    for t in texts:
        begin.append(at)
        joined[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.uint16) + 1
        at += len(t) + 1
    hit, before = np.zeros(len(joined), bool), 0
    for order, shared in induced_sort.suffixes(joined, length):
        same = shared >= length
        hit[order[same]] = True
        hit[np.append(before, order[:-1])[same]] = True
        before = order[-1]
    out = []
    for b, t in zip(begin, texts, strict=True):
        mine = hit[b : b + max(0, len(t) - length + 1)]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


def removed(docs: DataFrame, length: int = LENGTH, m: int = M, hot: int = HOT) -> DataFrame:
    """Rows (id, th, spans) of documents with bytes to remove, from rows (id, th, text):
    spans is an array of (start, end), merged and ascending."""
    kind = docs.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raws = _raws(batch.column("text"))
            for a, b in chunks(raws):
                own, start, n, mh, k, h1, h2 = stretches(raws[a:b], length, m)
                take = pa.array(own)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(mh.view(np.int64)), pa.array(k.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column("id").take(take), part.column("th").take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["mh", "k", "h1", "h2", "id", "th", "start", "n"])

    placed = stash(docs.select("id", "th", "text").mapInArrow(place, f"mh long, k int, h1 long, h2 long, id {kind}, th long, start int, n int"), "placed")
    seen = placed.groupBy("mh").agg(F.sum("k").alias("c"), F.max("k").alias("k"), F.min("h1").alias("a"), F.max("h1").alias("b")).where("c > 1").select("mh", ((F.col("a") != F.col("b")) | (F.col("k") > 1)).alias("mixed"))
    shared = stash(placed.drop("k").join(seen, "mh"), "stretches")
    # Equal stretches are repeated throughout.
    content = shared.groupBy("mh", "h1", "h2", "mixed").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "start", "n")).alias("at"))
    content = stash(content, "contents")
    copies = shared.join(content.where("c > 1").select("h1", "h2"), ["h1", "h2"], "left_semi").select("id", "th", F.col("start").alias("from"), (F.col("start") + F.col("n") + length - 1).alias("to"))

    texts = _cut(docs, content.where("mixed").select("mh", "c", "at.*"), length)
    many = content.where("mixed").groupBy("mh").agg(F.count("*").alias("k"), F.sum(F.col("at.n") + length - 1).alias("size")).where((F.col("k") > hot) | (F.col("size") > HOT_BYTES)).select("mh")
    texts = stash(texts.join(many.withColumn("hot", F.lit(True)), "mh", "left"), "texts")
    spans = copies.unionByName(_sorted(texts.where("hot is null").drop("hot"), kind, length)).unionByName(_counted(texts.where("hot"), kind, length))
    return _merged(spans, kind)


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (mh, c, id, th, start, n) with the bytes of each stretch."""
    kind = docs.schema["id"].dataType.simpleString()
    by_doc = stash(wanted.groupBy("id", "th").agg(F.collect_list(F.struct("mh", "c", "start", "n")).alias("cuts")), "cuts")
    small = by_doc.agg(F.sum(F.size("cuts"))).first()[0] or 0
    side = by_doc.withColumnsRenamed({"id": "id2", "th": "th2"})
    rows = docs.join(F.broadcast(side) if small <= BROADCAST else side, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).select("id", "th", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                cols = {k: [] for k in ("mh", "c", "start", "bytes")}
                own = []
                for j, (raw, cuts) in enumerate(zip(_raws(part.column("text")), part.column("cuts").to_pylist(), strict=True)):
                    for cut in cuts:
                        own.append(j)
                        cols["mh"].append(cut["mh"])
                        cols["c"].append(cut["c"])
                        cols["start"].append(cut["start"])
                        cols["bytes"].append(raw[cut["start"] : cut["start"] + cut["n"] + length - 1])
                take = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("th").take(take), pa.array(cols["mh"], pa.int64()), pa.array(cols["c"], pa.int64()), pa.array(cols["start"], pa.int32()), pa.array(cols["bytes"], pa.binary())], ["id", "th", "mh", "c", "start", "bytes"])

    return rows.mapInArrow(run, f"id {kind}, th long, mh long, c long, start int, bytes binary").dropDuplicates(["id", "th", "start"])


def _sorted(texts: DataFrame, kind: str, length: int) -> DataFrame:
    """Spans found by sorting the stretches of one shard after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for (i, th, _, c, start, _), ranges in zip(rows, repeated_windows([r[5] for r in rows], length), strict=True):
                if c == 1:
                    out += [(i, th, start + a, start + b + length - 1) for a, b in ranges]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], schema_id), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["id", "th", "from", "to"])

        held, size, last = [], 0, None
        for batch in pieces(batches):
            schema_id = batch.schema.field("id").type
            for row in zip(*[batch.column(k).to_pylist() for k in ("id", "th", "mh", "c", "start", "bytes")], strict=True):
                if size >= SHARD and row[2] != last:  # between minimizers only
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[2]
        if held:
            yield flush(held)

    return texts.repartition("mh").sortWithinPartitions("mh").select("id", "th", "mh", "c", "start", "bytes").mapInArrow(run, f"id {kind}, th long, `from` int, `to` int")


def _counted(texts: DataFrame, kind: str, length: int) -> DataFrame:
    """Spans found by counting the windows of hot minimizers under 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i, raw in enumerate(batch.column("bytes").to_pylist()):
                data = np.frombuffer(raw, np.uint8)
                n = len(data) - length + 1
                take = pa.array(np.full(n, i))
                cols = [batch.column(k).take(take) for k in ("id", "th", "c")]
                at = batch.column("start")[i].as_py() + np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at), *[pa.array(Hashed(data, b).every(length).view(np.int64)) for b in (B1, B2)]], ["id", "th", "c", "at", "h1", "h2"])

    windows = texts.select("id", "th", "c", "start", "bytes").mapInArrow(run, f"id {kind}, th long, c long, at int, h1 long, h2 long")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("k")).where("k > 1").select("h1", "h2")
    return windows.where("c = 1").join(twice, ["h1", "h2"], "left_semi").select("id", "th", F.col("at").alias("from"), (F.col("at") + length).alias("to"))


def _merged(spans: DataFrame, kind: str) -> DataFrame:
    """Rows (id, th, spans): each document's spans, merged."""
    by_doc = spans.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for spans in batch.column("all").to_pylist():
                merged: list[list[int]] = []
                for s in spans:
                    if merged and s["from"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["to"])
                    else:
                        merged.append([s["from"], s["to"]])
                out.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["id", "th", "spans"])

    return by_doc.mapInArrow(run, f"id {kind}, th long, spans array<struct<start:int,end:int>>")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, m: int = M, hot: int = HOT, with_bytes: bool = True) -> DataFrame:
    """Rows (key column, n_bytes, n_removed, n_spans, kept_sha256, and kept_bytes if
    wanted) for every row of docs."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    found = stash(removed(rows.where("text is not null"), length, m, hot), "spans").withColumnsRenamed({"id": "id2", "th": "th2"})
    small = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    joined = rows.join(F.broadcast(found) if small <= BROADCAST else found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left").select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_bytes
        for batch in pieces(batches):
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for raw, spans in zip(_raws(part.column("text")), part.column("spans").to_pylist(), strict=True):
                    kept, at = [], 0
                    for s in spans or []:
                        kept.append(raw[at : s["start"]])
                        at = s["end"]
                    kept = b"".join([*kept, raw[at:]])
                    out.append((len(raw), len(raw) - len(kept), len(spans or []), hashlib.sha256(kept).hexdigest()) + (kept,) * with_bytes)
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]], names)

    made = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes)
    return made.withColumnRenamed("id", key)
