"""Divergence of sources: how far the words of a (language, source) group lie from those
of the language's other groups, and which words make a group stand out.

Each group gives each kept term of its language a smoothed probability p, also the terms
that it never uses, so a sum over all kept terms for each two groups would be a table of
groups x groups x terms. It is taken apart instead by where the counts are not zero:

    sum f(p, q) = V * f(p0, q0)                                   both zero: a constant
                + sum over the first's terms of f(p, q0) - f(p0, q0)    one-sided terms
                + sum over the second's terms of f(p0, q) - f(p0, q0)
                + sum over shared terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

p0 and q0 being the probabilities of a count of 0. One-sided sums need no terms: a
histogram of each group's counts prices them for any partner. Shared terms come from a
join of postings (language, term) -> (source, count), which holds the counts over zero
only, and each pair of groups once.

All arithmetic is on whole numbers: counts times 10^9 as decimals, the rest as longs.

Defined cases: null text, language and source count as ''. Repeated rows each count as a
document. A group without terms has counts of 0 throughout; a language without kept terms
gives its pairs a value of 0 and no terms. Equal values rank by item, in order of UTF-8.
Words of any length are terms. An empty table gives an empty result. Only the three
columns named are read, whatever others are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.llm.common import pieces, stash

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
CHUNK = 1 << 20  # bytes of a text cut into words at once
ENTRIES, BYTES = 1 << 17, 1 << 26  # a task's tally is passed on beyond these
BROADCAST = 16 << 20  # bytes of the table of groups; a larger one is joined by a shuffle
#: Bytes of terms, A-Z in lower case; all else to blanks. Bytes of characters that are not
#: ASCII are 0x80 and over.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each CHUNK or so, cut between terms."""
    data, at = text.translate(_TERM), 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def tallies(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences and documents of a term in a group.
    Every group has a row of the term '', which no text holds, with counts of 0. Tasks add
    up before the shuffle, so common terms cost a row a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = [b"", *n]
                cols = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in pieces(batches):
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in _parts(text):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                entries, size = entries + len(n) - before, size + len(text)
                if entries > ENTRIES or size > BYTES:
                    yield from rows()
                    entries = size = 0
        yield from rows()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    used = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))
    counted = used.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)); null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    share = (wide(n) + F.lit(2)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.nullif((wide(total) + F.lit(2).cast("decimal(1,0)") * wide(terms)).cast("decimal(22,0)"), F.lit(0).cast("decimal(22,0)"))
    return F.call_function("div", share, below) + 1


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs up to 10^9 + 1: the square is under 2^63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if its bytes, counted, are few. df is read twice: pass a stash."""
    width = sum((F.length(c) * 4 if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST else df


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): `pair` has every other source of the
    language by divergence, `term` the `top` terms that a group uses more than its
    language does."""
    every = stash(tallies(docs), "tallies")
    group = ["lang", "source"]
    kept = every.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where((F.col("docs") >= least_docs) & (F.col("term") != "")).drop("docs")
    kept = stash(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    posting = stash(every.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "term", "source", "n", "all_n"), "postings")
    sums = posting.groupBy(group).agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    of = every.select(group).distinct().join(sums, group, "left").join(langs, "lang", "left")
    of = of.select(*group, F.coalesce("total", zero).alias("total"), F.coalesce("lang_n", zero).alias("lang_n"), F.coalesce("v", zero).alias("v"))
    groups = _small(stash(of.withColumn("p0", _p(zero, F.col("total"), F.col("v"))), "groups"))

    priced = posting.join(groups, group).select("lang", "term", "source", "n", "p0", _p(F.col("n"), F.col("total"), F.col("v")).alias("p"), _p(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q"))
    priced = stash(priced, "priced")

    # Constants and one-sided terms, for each pair of groups from either side.
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    histogram = priced.groupBy(*group, "p", "p0").agg(F.count("*").alias("terms"))
    lone = histogram.join(other, "lang").where("source <> item").select(F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), "lang", (F.col("terms") * (_f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q0")))).alias("value"))
    both_zero = groups.join(other, "lang").where("source < item").select(F.col("source").alias("a"), F.col("item").alias("b"), "lang", F.coalesce(F.col("v") * _f(F.col("p0"), F.col("q0")), zero).alias("value"))
    side = lambda x: priced.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p{x}"), F.col("p0").alias(f"z{x}"))
    p, q, p0, q0 = F.col("pa"), F.col("pb"), F.col("za"), F.col("zb")
    shared = side("a").join(side("b"), ["lang", "term"]).where("a < b").select("a", "b", "lang", (_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)).alias("value"))
    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (lone, shared)]
    summed = both_zero.select("lang", "a", "b", "value").unionByName(parts[0]).unionByName(parts[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = summed.select("lang", "value", F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])))

    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("value"), "item")).alias("rank")
    out = lambda df, part: df.select(*group, F.lit(part).alias("part"), "item", "value", place)
    # Ranks up to `top` are taken in each task before the shuffle, so a large group is no trouble.
    terms = out(priced.where("p > q").select(*group, F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value")), "term").where(F.col("rank") <= top)
    return out(pairs, "pair").unionByName(terms)
