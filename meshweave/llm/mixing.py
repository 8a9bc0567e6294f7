"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent and normalised to weights. The exponent
is bisected on [0, 1]: as large as it may be with the weights' entropy still at the
target, or, where that repeats some source more often than the limit, as small as the
limit allows. Weights become token budgets, and budgets a stream of blocks: each source
goes through seeded permutations of its documents, epoch after epoch, until its budget is
used; every block takes the same share of each source's stream, in an order of its own.

Positions in a source's permutation are prefix sums over hash bins of bounded size, so a
source that holds a third of all rows is worked on in as many parts as it has bins.

Defined cases: a document counts as max(1, words) tokens, so null and empty texts count
as 1. A null source is a source of its own. Repeated rows are documents of their own,
taken together in the order, those that share an id by length and a hash of their text. An empty table gives an empty result. Columns other than
those named are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.llm.common import stash, word_count

STEPS = 60
HELD = 65_536  # sources up to this number are held by the driver while bisecting
FANOUT = 1024  # bins of one part of a prefix sum
SPAN = float(1 << 60)


@dataclass
class Moments:
    """Of shares p under an exponent: sum of p^a, of p^a ln p, and extremes of p^(a-1)."""

    z: float
    s: float
    most: float
    least: float

    def entropy(self, exponent: float) -> float:
        return math.log(self.z) - exponent * self.s / self.z


def _moments(shares: DataFrame) -> Callable[[float], Moments]:
    """Works on a bounded number of sources in the driver, and on more as a Spark job."""
    held = [r["share"] for r in shares.select("share").orderBy("share").limit(HELD + 1).collect()]
    if len(held) <= HELD:
        return lambda a: Moments(math.fsum(p**a for p in held), math.fsum(p**a * math.log(p) for p in held), max(p ** (a - 1) for p in held), min(p ** (a - 1) for p in held))
    p = F.col("share")
    return lambda a: Moments(*shares.agg(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.ln(p)), F.max(F.pow(p, F.lit(a - 1))), F.min(F.pow(p, F.lit(a - 1)))).first())


def bisect(holds: Callable[[float], bool], falling: bool) -> float:
    """falling: the largest exponent of [0, 1] where a condition still holds that fails
    from some exponent on; else the smallest from which on it holds."""
    lo, hi = 0.0, 1.0
    if falling and holds(hi):
        return hi
    if not falling and holds(lo):
        return lo
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        if holds(mid) == falling:
            lo = mid
        else:
            hi = mid
    return lo if falling else hi


def weights(sized: DataFrame, entropy: float, repeats: float, budget: int | None) -> tuple[DataFrame, int, float]:
    """Rows (key, total, budget) from rows (key, tokens); the sum of tokens to give out,
    and the exponent. entropy is a share of the largest one, that of equal weights.
    Without a budget, the least one that uses every document once."""
    totals = stash(sized.groupBy("key").agg(F.sum("tokens").alias("total")), "mix-totals")
    row = totals.agg(F.sum("total").alias("all"), F.count("*").alias("n")).first()
    if not row["n"]:
        return totals.withColumn("budget", F.col("total")), 0, 1.0
    shares = totals.withColumn("share", F.col("total") / F.lit(float(row["all"])))
    moments = _moments(shares)
    target = entropy * math.log(row["n"])

    def repeated(a: float) -> float:
        m = moments(a)
        return m.most / m.least if budget is None else m.most / m.z * budget / row["all"]

    exponent = max(bisect(lambda a: moments(a).entropy(a) >= target, True), bisect(lambda a: repeated(a) <= repeats, False))
    m = moments(exponent)
    given = row["all"] * m.z / m.least if budget is None else float(budget)
    share = F.pow(F.col("share"), F.lit(exponent)) / m.z
    least = F.col("total") if budget is None else F.lit(0)
    return shares.select("key", "total", F.greatest(least, F.floor(share * given)).cast("long").alias("budget")), math.floor(given), exponent


def _hash(*cols: Column) -> Column:
    """60 bits that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, entropy: float = 0.95, repeats: float = 4.0, budget: int | None = None, block_tokens: int = 1 << 17, seed: int = 17, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Rows (key column, source, tokens, epoch, block, position): every taken copy of a
    document, its block of the stream and its place there. A document is taken while its
    source's budget isn't used up, so a source's last document may pass it."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    sized = stash(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), name.alias("key"), F.greatest(word_count(F.col(text)), F.lit(1)).alias("tokens"), F.xxhash64(F.col(text)).alias("th")), "mix-sized")
    budgets, given, _ = weights(sized, entropy, repeats, budget)
    blocks = max(1, -(-given // block_tokens))
    total, limit = F.col("total"), F.col("budget")
    copies = sized.join(budgets, "key").where(limit > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((limit - 1) / total))))
    copies = copies.withColumn("h", _hash(F.lit(seed), "epoch", "id")).withColumn("bin", F.floor(F.col("h") / SPAN * F.ceil(total / block_tokens)))
    where = ["key", "epoch", "bin"]
    bins = copies.groupBy(*where).agg(F.sum("tokens").alias("n")).withColumn("part", F.floor(F.col("bin") / FANOUT))
    parts = bins.groupBy("key", "epoch", "part").agg(F.sum("n").alias("m"))
    parts = parts.withColumn("before_part", F.sum("m").over(W.partitionBy("key", "epoch").orderBy("part")) - F.col("m")).drop("m")
    bins = bins.withColumn("before", F.sum("n").over(W.partitionBy("key", "epoch", "part").orderBy("bin")) - F.col("n")).join(parts, ["key", "epoch", "part"])
    bins = bins.select(*where, (F.col("before") + F.col("before_part")).alias("before"))
    inside = F.sum("tokens").over(W.partitionBy(*where).orderBy("h", "id", "tokens", "th").rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")
    placed = copies.withColumn("inside", inside).join(bins, where).withColumn("start", F.col("epoch") * total + F.col("before") + F.col("inside"))
    taken = placed.where(F.col("start") < limit).withColumn("block", F.floor(F.col("start") / limit * blocks))
    taken = taken.withColumn("position", F.row_number().over(W.partitionBy("block").orderBy(_hash(F.lit(seed), "epoch", "id", F.lit("block")), "key", "epoch", "start")).cast("long"))
    return taken.select(F.col("id").alias(key), F.col("source").alias(source), "tokens", F.col("epoch").cast("long").alias("epoch"), F.col("block").cast("long").alias("block"), "position")
