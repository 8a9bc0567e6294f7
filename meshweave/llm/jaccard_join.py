"""N-gram Jaccard join: a grouped prefix join, down to connected components.

Shingles are ordered by how common a frequency sketch of the whole corpus says they are,
rare ones first, then by hash. Two sets that are similar enough share a shingle in their
prefixes under any such order. Documents with the same prefix and set size form one
group, and only groups are joined on prefix shingles. How many prefix shingles a pair of
groups shares bounds its members' overlap; pairs that can still link are expanded to
members and verified on whole sets.

Within a shingle's list of groups no all-pairs join is made. Each group is first verified
against the best-supported group that it shares most with, which joins up copies of one
text in as many comparisons as there are copies. Lists that then lie in one component are
done: their further links would change nothing. Only between different components are
all pairs that pass the bounds verified, so no link that matters is lost. A group whose
members lie in several components is paired with itself, too, whether or not its prefix
meets another. The bounds come from the prefix shingles that a pair shares and from bits
of its whole sets.

Defined cases: null or empty text, or text without words, has an empty set and links with
nothing. Fewer words than a shingle make one shingle. Equal sets are linked. Rows that
share an id are one document: their texts count as linked. Rows with a null id take no
part in links and have a null component. Repeated rows repeat. An empty table gives an
empty result. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.llm import shingles
from meshweave.llm.common import pieces, stash
from meshweave.llm.components import components

SLOTS = 1 << 16  # counters of the frequency sketch
MASKS = 4  # longs of a group's shingle bits
WHOLE = 8  # longs of the bits of a whole set
SALTED = 512  # members that one task compares with a leader, about
BROADCAST = 1_000_000  # rows of two or three longs; more are joined by a shuffle


def _least(n: Column, percent: int) -> Column:
    """The least overlap that a set of size n needs with any partner."""
    return F.floor((n * percent + 99) / 100)


def classes(docs: DataFrame, n: int) -> np.ndarray:
    """For each slot of the sketch, how much more than the average its shingles occur:
    0 for the average or less, 4 more for each doubling."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in pieces(batches):
            for a, b in shingles.chunks(texts := batch.column("text").to_pylist()):
                got = shingles.sets(texts[a:b], n)
                total += np.bincount((np.concatenate(got) >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    summed = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SLOTS)
    total[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return np.clip(np.floor(4 * np.log2(np.maximum(total, 1) / max(total.mean(), 1))), 0, 200).astype(np.uint8)


def prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (id, n, s1, s2, p1, p2, prefix, b0, b1, ...): set size, digests of set and
    prefix, and a bit for each shingle of the whole set."""
    order = docs.sparkSession.sparkContext.broadcast(classes(docs, n))

    def one(s: np.ndarray) -> tuple:
        size = len(s)
        by = np.lexsort((s, order.value[(s >> np.uint64(48)).astype(np.int64)]))
        p = s[by[: size - (size * percent + 99) // 100 + 1]] if size else s
        digest = lambda x, salt: int(shingles.mix(x ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64))
        bits = np.zeros(64 * WHOLE, np.uint8)
        bits[(shingles.mix(s ^ np.uint64(5)) >> np.uint64(32)).astype(np.int64) % len(bits)] = 1
        return size, digest(s, 1), digest(s, 2), digest(p, 3), digest(p, 4), p.view(np.int64), np.packbits(bits, bitorder="little").view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            for a, b in shingles.chunks(texts):
                cols = list(zip(*[one(s) for s in shingles.sets(texts[a:b], n)], strict=True))
                ends = np.cumsum([0, *map(len, cols[5])]).astype(np.int32)
                made = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[5])))]
                whole = [pa.array(np.ascontiguousarray(x)) for x in np.stack(cols[6]).T]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *made, *whole], ["id", "n", "s1", "s2", "p1", "p2", "prefix", *[f"b{j}" for j in range(WHOLE)]])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>" + "".join(f", b{j} long" for j in range(WHOLE)))


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (node, ...) with the node's text. A side of checked size is broadcast."""
    small = wanted.limit(BROADCAST + 1).count() <= BROADCAST
    return docs.join(F.broadcast(wanted) if small else wanted, docs["id"] == wanted["node"]).select(*wanted.columns, "text")


def verify(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (node, lead), those that link. Members go to their leader's set in parts
    of about SALTED, with a copy of the leader's text for each part."""
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("parts"))
    members = pairs.join(parts, "lead").select("lead", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", F.lit(True).alias("member"))
    leaders = parts.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lead").alias("node"), F.lit(False).alias("member"))
    rows = _with_text(docs, stash(members.unionByName(leaders), "pairs")).repartition("lead", "part").sortWithinPartitions("lead", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, []
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            for a, b in shingles.chunks(texts):
                cols = batch.slice(a, b - a).drop_columns(["text"]).to_pydict()
                got = shingles.sets(texts[a:b], n)
                hits = []
                for i, s in enumerate(got):
                    if (key := (cols["lead"][i], cols["part"][i])) != group:
                        group, leader = key, []
                    if not cols["member"][i]:
                        leader.append(s)
                    elif any(_similar(s, x, percent) for x in leader):
                        hits.append(i)
                part = batch.slice(a, b - a).select(["lead", "node"]).take(pa.array(hits, pa.int64()))
                yield pa.RecordBatch.from_arrays(part.columns, ["a", "b"])

    kind = docs.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of sets of sizes n and m that link."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))  # rounded up


def _bounds(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sizes n, m and the number of shared prefix shingles leave a link possible:
    beyond the prefix that ends first, a set has its size less its prefix left."""
    needed = _needed(n, m, percent)
    rest = F.greatest(_least(n, percent), _least(m, percent)) - 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (shared + rest >= needed)


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 4, percent: int = 85, rounds: int = 2) -> DataFrame:
    """Rows (key column, n_shingles, component_id). Sets link when their Jaccard
    similarity is percent / 100 or more."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = stash(prefixes(docs, n, percent), "prefixes")
    live = rows.where("n > 0 and id is not null")
    own_bits = [f"b{j}" for j in range(WHOLE)]
    same_set = live.groupBy("s1", "s2", "n", "p1", "p2").agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in own_bits])
    # Bits that all sets of a group have, and bits that any has.
    every, some = [F.bit_and(f"b{j}").alias(f"e{j}") for j in range(WHOLE)], [F.bit_or(f"b{j}").alias(f"s{j}") for j in range(WHOLE)]
    groups = stash(live.groupBy("n", "p1", "p2").agg(F.min("id").alias("g"), F.count("*").alias("w"), F.first("prefix").alias("prefix"), *every, *some), "groups")
    nodes = stash(same_set.join(groups.select("n", "p1", "p2", "g"), ["n", "p1", "p2"]).select("s1", "s2", "n", "node", "g", *own_bits), "nodes")
    # An id with several texts is one document: it is a link between their sets.
    digest = F.struct("s1", "s2", "n")
    several = live.groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").select("id")
    shared = live.join(several, "id").select("id", "s1", "s2", "n").distinct().join(nodes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"]).select(F.col("id").alias("a"), F.col("node").alias("b"))

    tokens = groups.select("g", "n", "w", F.explode("prefix").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    lists = stash(tokens.join(common, "token", "left_semi"), "lists")

    links = nodes.where("node <> g").select(F.col("node"), F.col("g").alias("lead"))
    links = verify(docs, links, n, percent).unionByName(shared)
    open_lists, of = lists, None
    for turn in range(rounds):
        best = open_lists.groupBy("token").agg(F.max_by(F.struct("g", "n"), F.struct("w", F.xxhash64(F.lit(turn), "g"))).alias("best"))
        met = open_lists.join(best, "token").where("g <> best.g")
        if of is not None:
            met = met.join(of.select(F.col("g").alias("bg"), F.col("c").alias("bc")), F.col("best.g") == F.col("bg")).where("c <> bc")
        met = met.groupBy("g", "n", F.col("best.g").alias("lead"), F.col("best.n").alias("m")).agg(F.count("*").alias("shared"))
        chosen = met.where(_bounds(F.col("shared"), F.col("n"), F.col("m"), percent)).groupBy("g").agg(F.max_by("lead", F.struct("shared", "lead")).alias("lead"))
        stars = chosen.join(nodes.select("node", "g"), "g").select("node", "lead")
        links = stash(links.unionByName(verify(docs, stars, n, percent)), "links")
        found = components(links)
        member = nodes.join(found, "node", "left").select("node", "g", "n", *own_bits, F.coalesce("component", "node").alias("c"))
        # A list is done when all members of its groups lie in one component.
        of = stash(member.groupBy("g").agg(F.min("c").alias("c"), F.max("c").alias("c2")), "of")
        spread = lists.join(of, "g")
        open_tokens = spread.groupBy("token").agg(F.min("c").alias("a"), F.max("c2").alias("b")).where("a <> b").select("token")
        open_lists = stash(spread.join(open_tokens, "token", "left_semi"), "open")

    # Each of a group's k shingles sets a bit; a bit that the other lacks is a shingle not
    # shared. With i shingles before this one, no more are shared than the lesser of both
    # before it and the lesser of both after it. A bit of whole sets bounds all that they
    # share in the same way.
    own, slot = W.partitionBy("g"), F.pmod(F.xxhash64(F.lit("bit"), "token"), F.lit(64 * MASKS))
    bits = [F.bit_or(F.when(F.floor(slot / 64) == j, F.expr("shiftleft(1L, cast(pmod(xxhash64('bit', token), 64) as int))")).otherwise(F.lit(0).cast("long"))).over(own).alias(f"m{j}") for j in range(MASKS)]
    wide = [f"{x}{j}" for x in "es" for j in range(WHOLE)]
    placed = stash(open_lists.join(groups.select("g", *wide), "g").select("token", "g", "n", "c", "c2", *wide, F.count("*").over(own).alias("k"), (F.row_number().over(own.orderBy("token")) - 1).alias("i"), *bits), "placed")
    cols = ["g", "n", "c", "c2", "k", "i", *[f"m{j}" for j in range(MASKS)], *wide]
    left, right = (placed.select("token", *[F.col(c).alias(c + side) for c in cols]) for side in "ab")
    lacks = lambda x, y: sum((F.bit_count(F.col(f"m{j}{x}").bitwiseAND(F.bitwise_not(f"m{j}{y}"))) for j in range(MASKS)), F.lit(0))
    most = F.least(F.col("ka") - lacks("a", "b"), F.col("kb") - lacks("b", "a"), F.least("ia", "ib") + F.least(F.col("ka") - F.col("ia"), F.col("kb") - F.col("ib")))
    # Groups of several components meet others, whatever their smallest one.
    apart = (F.col("ca") != F.col("cb")) | (F.col("c2a") != F.col("c2b")) | (F.col("ca") != F.col("c2a"))
    alone = lambda x, y: sum((F.bit_count(F.col(f"e{j}{x}").bitwiseAND(F.bitwise_not(f"s{j}{y}"))) for j in range(WHOLE)), F.lit(0))
    able = _bounds(most, F.col("na"), F.col("nb"), percent) & (F.least(F.col("na") - alone("a", "b"), F.col("nb") - alone("b", "a")) >= _needed(F.col("na"), F.col("nb"), percent))
    met = left.join(right, "token").where((F.col("ga") < F.col("gb")) & apart & able)
    met = met.groupBy("ga", "na", "gb", "nb").agg(F.count("*").alias("shared")).where(_bounds(F.col("shared"), F.col("na"), F.col("nb"), percent))
    # They also meet themselves, even if no other group has a shingle of their prefix.
    split = of.where("c <> c2").select(F.col("g").alias("ga"), F.col("g").alias("gb"))
    side = lambda x, key: member.select(F.col("g").alias(f"g{x}"), F.col("node").alias(key), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{c}{x}") for c in own_bits])
    # Bits of the members' own sets are weighed while groups are expanded.
    lone = lambda x, y: sum((F.bit_count(F.col(f"{c}{x}").bitwiseAND(F.bitwise_not(f"{c}{y}"))) for c in own_bits), F.lit(0))
    close = F.least(F.col("na") - lone("a", "b"), F.col("nb") - lone("b", "a")) >= _needed(F.col("na"), F.col("nb"), percent)
    rest = met.select("ga", "gb").unionByName(split).join(side("a", "node"), "ga").join(side("b", "lead"), "gb").where((F.col("ca") != F.col("cb")) & close).select("node", "lead")
    more = stash(verify(docs, rest, n, percent), "more")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    named = nodes.join(found, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component_id"))
    kept = rows.select("id", "n", "s1", "s2")
    out = kept.join(named, ["s1", "s2", "n"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
