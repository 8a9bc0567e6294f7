"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line, by (document, line number), is equal or one edit away.
Equal lines are found by a 128-bit hash; lines of any length take part. For lines of
`near_chars` characters or more, each distinct one then emits every variant with one
character deleted, as hashed keys: lines with a common variant at the same place differ by
a substitution, and a line that is another's variant lacks one of its characters. Pairs
that meet are verified by their edit distance, and the earliest line is kept.

Only lines that can have a partner emit variants. A line is cut into four pieces of a
length that lines of neighbouring lengths share; one edit leaves three of them as they
are, counted from the start before the edit and from the end after it. So a line that
shares no such three pieces with another line has no partner, and one that does emits
only the deletions in the remaining gap. Groups with a common variant are bounded by the
alphabet and the line's length, as only distinct lines take part. Lines of 16 characters
and less are too short for pieces and emit all their variants, which are few.

The edit bound is 0 or 1. With one deletion, all lines of a group are within the bound of
each other, so that each need only meet the earliest; with more deletions they are not, and
every pair of a group would have to be made.

Defined cases: null text stays null. Blank lines (of the six ASCII white-space characters
alone) always stay, as do lines under `min_chars` characters, which is off by default. One edit is much of a short line (any two
lines of one character are near), hence `near_chars`. Of equal positions (rows that repeat
an id) none is earlier, so repeated rows of a document keep or lose the same lines. Null
ids come first. An empty table gives an empty result. All columns are passed through,
whatever their names; only id and text are read. Rows are told apart by their id and a
64-bit hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.llm.common import stash

WHITE = " \t\n\x0b\x0c\r"
PIECES = 4
STEP = 4  # piece lengths are multiples of this
LEAST = PIECES * STEP + 1


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows (id, th, at, line) of the lines that take part."""
    line = F.col("line")
    return docs.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where((F.length(line) >= min_chars) & (F.trim(line, F.lit(WHITE)) != ""))


def _piece_size(n):  # noqa: ANN001, ANN202
    """Of a line of n characters, a column or a number."""
    return STEP * (F.floor(n / (PIECES * STEP)).cast("int") if isinstance(n, Column) else n // (PIECES * STEP))


def _piece_keys(line: Column, size: Column) -> Column:
    """Keys of all but one piece, under the length's piece size and, where it differs, that
    of one less."""

    def keys(q: Column) -> list[Column]:
        return [F.xxhash64(F.lit(j), q, F.substr(line, F.lit(1), j * q), F.substr(line, size - (PIECES - 1 - j) * q + 1, (PIECES - 1 - j) * q)) for j in range(PIECES)]

    own, less = _piece_size(size), _piece_size(size - 1)
    return F.when((own == less) | (less == 0), F.array(*keys(own))).otherwise(F.array(*keys(own), *keys(less)))


def _gap(size: int, i: int) -> tuple[int, int]:
    """The places that the i-th key of a line leaves out."""
    q, j = _piece_size(size - i // PIECES), i % PIECES
    return j * q, size - (PIECES - 1 - j) * q


def _hash_table() -> np.ndarray:
    """A fixed odd multiplier per character class: scrambles code points before hashing."""
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


BASE = 0xD1B54A32D192ED03
_scrambled = _hash_table()


def variants(line: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the line with the character at each place of the spans
    deleted; the line itself comes first, at place -1."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    value = _scrambled[codes & np.uint64(0xFFFF)] + codes * np.uint64(0x94D049BB133111EB)
    n = len(codes)
    power = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, BASE, np.uint64), out=power[1:])
    term = value * power[:n]
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    after = value * np.concatenate([np.zeros(1, np.uint64), power[: n - 1]])
    after = np.concatenate([np.zeros(1, np.uint64), np.cumsum(after, dtype=np.uint64)])
    at = np.unique(np.concatenate([np.arange(a, min(b, n)) for a, b in spans]))
    h = np.concatenate([before[-1:], before[at] + after[-1] - after[at + 1]])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64), np.concatenate([[-1], at]).astype(np.int32)


def removed_lines(docs: DataFrame, min_chars: int = 1, max_edits: int = 1, near_chars: int = 10) -> DataFrame:
    """Rows (id, th, at, near) of the lines to remove, from rows (id, th, text)."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    line, size = F.col("line"), F.length("line")
    # A line of LEAST - 1 characters has keys for partners of one character more.
    sought = {"keys": F.when(size >= max(near_chars, LEAST - 1), _piece_keys(line, size)), "short": size.between(near_chars, LEAST - 1)} if max_edits else {}
    marked = _lines(docs, min_chars).select("id", "th", "at", F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"), *[c.alias(n) for n, c in sought.items()])
    first = F.min(F.struct("id", "at", "th"))
    distinct = stash(marked.groupBy("k1", "k2").agg(first.alias("first"), F.count("*").alias("n"), *[F.first(n).alias(n) for n in sought]), "lines")
    cut = distinct.where("n > 1").select("k1", "k2", "first", F.lit(False).alias("near"))
    if max_edits:
        cut = cut.unionByName(_near(docs, distinct))
    # As a table of its own, so that a line that very many documents hold can be split in the join.
    cut = stash(cut.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.max("near").alias("near")), "cut")
    place = F.struct("id", "at")
    hit = marked.drop(*sought).join(cut, ["k1", "k2"])
    return hit.where(F.col("near") | (place > F.struct("first.id", "first.at"))).select("id", "th", "at", "near")


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Rows (k1, k2, first, near) of distinct lines with an earlier one an edit away."""
    keys = distinct.select(F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    # A line is known by its first place alone while keys meet.
    keyed = distinct.where("not short").select("first.*", F.posexplode("keys").alias("i", "key"))
    able = keyed.join(shared, "key", "left_semi").select("id", "th", "at", "i").unionByName(distinct.where("short").select("first.*", F.lit(-1).alias("i")))
    by_line = able.groupBy("id", "th", "at").agg(F.collect_set("i").alias("gaps"))
    by_doc = by_line.groupBy("id", "th").agg(F.collect_list(F.struct("at", "gaps")).alias("c"))
    told = docs.alias("d").join(by_doc.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.th") == F.col("c.th"))).select("d.id", "d.th", F.split("d.text", "\n", -1).alias("all"), F.inline("c.c"))
    line = F.col("line")
    texts = told.select("id", "th", "at", "gaps", F.get("all", F.col("at")).alias("line")).select("*", F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2"))
    texts = stash(texts.dropDuplicates(["k1", "k2"]), "near-lines")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [variants(t, [(0, len(t)) if i < 0 else _gap(len(t), i) for i in gaps]) for t, gaps in zip(part.column("line").to_pylist(), part.column("gaps").to_pylist(), strict=True)]
                take = pa.array(np.repeat(np.arange(len(made)), [len(h) for h, _ in made]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in made])), pa.array(np.concatenate([p for _, p in made])), *[part.column(c).take(take) for c in ("id", "at", "k1", "k2")]], ["v", "place", "id", "at", "k1", "k2"])

    id_type = docs.schema["id"].dataType.simpleString()
    emitted = texts.mapInArrow(emit, f"v long, place int, id {id_type}, at int, k1 long, k2 long")
    me = F.struct("id", "at", "k1", "k2")
    rows = emitted.select("v", "place", me.alias("me"))
    group = W.partitionBy("v")
    same = F.min("me").over(group.orderBy("place").rangeBetween(0, 0))
    whole = F.min(F.when(F.col("place") < 0, F.col("me"))).over(group)
    longer = F.min(F.when(F.col("place") >= 0, F.col("me"))).over(group)
    partners = F.when(F.col("place") < 0, F.array(longer)).otherwise(F.array(same, whole))
    pairs = rows.select("me", partners.alias("partners")).select("me", F.explode("partners").alias("with")).where(F.col("with") < F.col("me")).distinct()
    pairs = pairs.select(F.col("me.k1").alias("k1"), F.col("me.k2").alias("k2"), F.col("with.k1").alias("w1"), F.col("with.k2").alias("w2"))
    other = texts.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("line").alias("with_line"))
    own = texts.select("k1", "k2", "line", F.struct("id", "at", "th").alias("first"))
    near = pairs.join(own, ["k1", "k2"]).join(other, ["w1", "w2"]).where(F.levenshtein("line", "with_line") <= 1)
    return near.select("k1", "k2", "first", F.lit(True).alias("near")).distinct()


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 1, max_edits: int = 1, counts: bool = False, near_chars: int = 10) -> DataFrame:
    """docs with the removed lines gone from text; with counts, also n_lines, n_exact and
    n_near, long (a line that is both counts as near)."""
    used = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text")).where("text is not null")
    gone = removed_lines(used, min_chars, max_edits, near_chars).distinct()
    by_doc = gone.groupBy("id", "th").agg(F.collect_set("at").alias("gone"), F.count_if("near").alias("near"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    own = F.col("row")[text]
    out = rows.join(by_doc, F.col("row")[key].eqNullSafe(F.col("id")) & (F.xxhash64(own) == F.col("th")), "left")
    parts = F.split(own, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("gone", i)), "\n")
    cols = [(F.when(F.col("gone").isNull(), own).otherwise(kept) if c == text else F.col("row")[c]).alias(c) for c in docs.columns]
    if counts:
        near = F.coalesce("near", F.lit(0))
        cols += [F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), (F.coalesce(F.size("gone"), F.lit(0)) - near).cast("long").alias("n_exact"), near.cast("long").alias("n_near")]
    return out.select(*cols)
