"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document's features are summed up per (language, source) in log-bucketed quantile
sketches (a count per bucket of fixed relative width: adding the counts of two sketches
gives the sketch of both, exactly). Merging the sketches of a language's sources gives the
language's, and merging those the one of all. A source's sketch is then shrunk towards its
language's, and that towards the one of all, by the weight of `prior` documents: small
groups lean on what is known of larger ones, large groups on themselves, without a size
from which on it changes. Thresholds are quantiles and their distances, nothing else; a
join gives each document those of its group.

A share's threshold is high = q90 + reach * max(q90 - q50, q95 - q90), or the sketch's mean
where that is more (of findings that few documents have, both quantiles are 0). A document
is over it if its count is more than chance gives: where that share of its words (or lines)
gives m, a count of n > m is at most exp(-(n ln(n / m) - n + m)) likely, and has to be less
so than a normal value `reach` spreads away, exp(-reach^2 / 2). One repeated line in a short
text so is a finding only where such lines are very rare, six of twelve are one anywhere.
Mean word length has the same threshold and one below, as it is no count, without the rest.

Defined cases: null text has no words and fails the base rule. Null languages and
sources form groups of their own. Ties lie in the same bucket. Repeated rows each count.
An empty table gives an empty result. Other columns are not read by the query; features()
passes on those of `keep`, and verdicts() all columns of feats.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.llm.common import pieces

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GAMMA = 1.02  # width of a bucket: quantiles are right within 1 %
#: Feature: numerator, denominator, and whether the numerator counts findings.
FEATURES = {
    "symbol_share": ("n_symbols", "n_words", True),
    "dup_line_share": ("n_dup_lines", "n_lines", True),
    "repeat_share": ("n_repeat_words", "n_words", True),
    "word_length": ("word_chars", "n_words", False),
}
PRIOR, REACH = 100, 3.0


def base_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The BASE features of one text, and its lines with a word. bytes.split() splits at
    the six ASCII white-space characters and no others."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        seen, until = Counter(grams), 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return len(words), chars, symbols, dup, repeated, len(lines)


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns of keep, the BASE counts of each whole text, and n_lines."""
    names = (*BASE, "n_lines")
    used = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [base_counts(t) for t in batch.column("__text").to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in cols]], [*batch.schema.names[:-1], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[:-1])
    return used.mapInArrow(count, f"{fields}, " + ", ".join(f"{c} long" for c in names))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bucket(value: Column) -> Column:
    """Of the sketch: k for values in (GAMMA^(k-1), GAMMA^k]; all of 0 share one bucket."""
    return F.when(value > 0, F.ceil(F.round(F.ln(value) / math.log(GAMMA), 9))).otherwise(-100000).cast("int")


def _middle(bucket: Column) -> Column:
    """A bucket's value: within 1 % of all that it holds."""
    return F.when(bucket == -100000, 0.0).otherwise(F.pow(F.lit(GAMMA), bucket) * (2 / (1 + GAMMA)))


def _shrunk(own: DataFrame, parent: DataFrame, by: list[str], prior: int) -> DataFrame:
    """Sketches own (*by, feature, bucket, n) plus `prior` documents dealt out as those of
    their parent (by's first columns, feature, bucket, n); weights to six places, so that
    sums do not depend on their order."""
    up = [F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in parent.columns if c not in ("bucket", "n")]
    share = parent.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*[c for c in parent.columns if c not in ("bucket", "n")]))).drop("n")
    groups = own.select(*by, "feature").distinct().alias("o")
    lent = groups.join(share.alias("p"), up).select(*[f"o.{c}" for c in (*by, "feature")], "bucket", F.round(F.col("share") * prior, 6).cast("decimal(24,6)").alias("n"))
    both = own.select(*by, "feature", "bucket", F.col("n").cast("decimal(24,6)").alias("n")).unionByName(lent)
    return both.groupBy(*by, "feature", "bucket").agg(F.sum("n").cast("decimal(24,6)").alias("n"))


def thresholds(feats: DataFrame, prior: int = PRIOR, reach: float = REACH) -> DataFrame:
    """Rows (lang, source, feature, low, high); low is null for shares."""
    long = feats.where(~base_failed()).select("lang", "source", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), _bucket(F.col(a) / F.col(b)).alias("bucket")) for f, (a, b, _) in FEATURES.items()])))
    fine = long.groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))
    by_lang = fine.groupBy("lang", "feature", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("feature", "bucket").agg(F.sum("n").alias("n"))
    merged = _shrunk(fine, _shrunk(by_lang, overall, ["lang"], prior), ["lang", "source"], prior)
    group = ["lang", "source", "feature"]
    # A group has as many rows as its sketch has buckets: bounded by the doubles' range.
    upto = merged.withColumn("upto", F.sum("n").over(W.partitionBy(*group).orderBy("bucket"))).withColumn("total", F.sum("n").over(W.partitionBy(*group)))
    q = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), _middle(F.col("bucket"))))
    # Rounded, as the sum of doubles depends on their order.
    mean = F.round(F.sum(F.col("n").cast("double") * _middle(F.col("bucket"))) / F.max("total").cast("double"), 9)
    cut = upto.groupBy(*group).agg(*[q(p).alias(f"q{p}") for p in (5, 10, 50, 90, 95)], mean.alias("mean"))
    low = F.col("q10") - reach * F.greatest(F.col("q50") - F.col("q10"), F.col("q10") - F.col("q5"))
    high = F.col("q90") + reach * F.greatest(F.col("q90") - F.col("q50"), F.col("q95") - F.col("q90"))
    two_sided = F.col("feature").isin(*[f for f, (_, _, counted) in FEATURES.items() if not counted])
    return cut.select(*group, F.when(two_sided, low).alias("low"), F.when(two_sided, high).otherwise(F.greatest(high, "mean")).alias("high"))


def _over(n: Column, m: Column, reach: float) -> Column:
    """Whether n is more findings than chance gives where m are to be expected."""
    return (n > m) & ((m <= 0) | (n * F.ln(n / m) - n + m > reach * reach / 2))


def verdicts(feats: DataFrame, prior: int = PRIOR, reach: float = REACH) -> DataFrame:
    """feats with base_failed and kept. feats is read twice: pass a stash."""
    names = [f"{f}_{x}" for f in FEATURES for x in ("low", "high")]
    cut = thresholds(feats, prior, reach).groupBy("lang", "source").agg(*[F.max(F.when(F.col("feature") == f, F.col(x))).alias(f"{f}_{x}") for f in FEATURES for x in ("low", "high")])
    cut = cut.select(F.struct("lang", "source", *names).alias("cut"))
    out = feats.select(F.struct(*feats.columns).alias("row")).join(cut, F.col("row.lang").eqNullSafe(F.col("cut.lang")) & F.col("row.source").eqNullSafe(F.col("cut.source")), "left").select("row.*", "cut")
    fits = F.lit(True)
    for f, (a, b, counted) in FEATURES.items():
        low, high, n, of = F.col(f"cut.{f}_low"), F.col(f"cut.{f}_high"), F.col(a), F.col(b)
        # Quantiles are right within a bucket, so the bucket of a threshold still passes.
        fits = fits & (~_over(n, high * of, reach) if counted else (n / of).between(low / GAMMA, high * GAMMA))
    failed = base_failed()
    return out.select(*feats.columns, failed.alias("base_failed"), F.when(failed, False).otherwise(F.coalesce(fits, F.lit(True))).alias("kept"))
