"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at each of `rows` positions, one bit per language. An
n-gram sets its language's bit at `hashes` positions; looking an n-gram up is the AND of
those positions, which gives every language that has the n-gram at once. A document's
per-language popcounts over its n-grams, corrected for each language's false-positive
rate, decide.

Defined cases: null text, or text without a letter, gives `und` with score 0. Equal
scores go to the language that sorts first. Rows repeat in the result as they do in the
input. An empty training set gives `und` for all. Columns of the input other than the
id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshweave.llm.common import pieces

N = 4  # characters of an n-gram
CHUNK = 1 << 18  # characters worked on at once
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about CHUNK characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 3
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams with a letter, the index of the text of each, and whether
    each text has a letter. Runs of other characters count as one blank."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) for t in lowered), np.int64, len(lowered)) + 3
    joined = "".join(f"  {t} " for t in lowered).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(joined, np.uint32)
    letter = _is_letter()[codes]
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    for at in (ends - sizes, ends - sizes + 1, ends - 1):
        keep[at] = True
    some = np.bincount(owner[letter], minlength=len(texts)) > 0
    codes, owner, letter = np.where(letter, codes, 0)[keep].astype(np.uint64), owner[keep], letter[keep]
    if len(codes) < N:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), some
    last = len(codes) - N + 1
    h = np.zeros(last, np.uint64)
    has = np.zeros(last, bool)
    for i in range(N):
        h = (h ^ codes[i : i + last]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        has |= letter[i : i + last]
    has &= owner[:last] == owner[N - 1 :]
    return h[has], owner[:last][has], some


@dataclass
class LanguageFilter:
    """The trained filter: rows x words of 64 language bits, and the corrections."""

    languages: list[str]
    table: np.ndarray
    hashes: int
    false_positive: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names = np.array([*self.languages, "und"], object)
        out, scores = [], []
        for a, b in chunks(texts):
            h, owner, some = ngrams(texts[a:b])
            mask = np.full((len(h), self.table.shape[1]), ~np.uint64(0))
            for at in positions(h, len(self.table), self.hashes):
                mask &= self.table[at]
            n = np.bincount(owner, minlength=b - a).astype(float)
            best, which = np.full(b - a, -np.inf), np.full(b - a, len(self.languages))
            for i, fp in enumerate(self.false_positive):
                bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits = np.bincount(owner, weights=bit, minlength=b - a)
                est = (hits / np.maximum(n, 1) - fp) / (1 - fp)
                better = est > best
                best, which = np.where(better, est, best), np.where(better, i, which)
            which = np.where(some & (n > 0), which, len(self.languages))
            out += list(names[which])
            scores.append(np.where(which < len(self.languages), np.clip(best, 0, 1), 0.0))
        return out, np.concatenate(scores) if scores else np.zeros(0)


def positions(h: np.ndarray, rows: int, hashes: int) -> Iterator[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield ((h + np.uint64(i) * step) & np.uint64(rows - 1)).astype(np.int64)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 4000, rows: int = 1 << 20, hashes: int = 3, min_per_doc: float = 0.005, least_ratio: float = 0.1, max_languages: int = 1024) -> LanguageFilter:
    """Learn from rows with a text and a language.

    docs_per_language bounds the sample: where a language has more rows, those whose
    hashed key falls under the fraction that gives about so many are taken, so the
    filter costs the same at any input size. An n-gram counts for a language if it
    occurs min_per_doc times per sampled document, and twice at least, and at least
    least_ratio times as often as in the language that has it most: wrong labels would
    otherwise carry one language's n-grams into another. rows must be a power of two and
    bounds what reaches the driver. Over max_languages is an error."""
    usable = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(counts)
    words = max(1, -(-len(languages) // 64))
    table = np.zeros((rows, words), np.uint64)
    if not languages:
        return LanguageFilter([], table, hashes, np.zeros(0))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, docs_per_language / counts[name]))])
    least = F.array(*[F.lit(max(2.0, min_per_doc * min(docs_per_language, counts[name]))) for name in languages])
    unit = F.pmod(F.xxhash64(F.col("key")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(unit < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for i, name in enumerate(languages):
                mine = [texts[k] for k in np.flatnonzero(langs == name)]
                for a, b in chunks(mine):
                    grams, n = np.unique(ngrams(mine[a:b])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i, np.int32)), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            i, gram = batch.column("lang").to_numpy(), batch.column("gram").to_numpy().view(np.uint64)
            bit = (np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64)
            for at in positions(gram, rows, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(i // 64), pa.array(bit)], ["at", "word", "bits"])

    sampled = F.array(*[F.lit(float(min(docs_per_language, counts[name]))) for name in languages])
    often = sample.select("text", "lang").mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= F.element_at(least, F.col("lang") + 1))
    by_gram = often.withColumn("rate", F.col("n") / F.element_at(sampled, F.col("lang") + 1)).groupBy("gram").agg(F.collect_list(F.struct("lang", "rate")).alias("in"), F.max("rate").alias("most"))
    kept = by_gram.select("gram", "most", F.inline("in")).where(F.col("rate") >= least_ratio * F.col("most"))
    set_bits = kept.select("lang", "gram").mapInArrow(place, "at long, word int, bits long").groupBy("at", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[set_bits["at"].to_numpy(), set_bits["word"].to_numpy()] = set_bits["bits"].to_numpy().view(np.uint64)
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageFilter(languages, table, hashes, np.minimum(fill**hashes, 0.99))


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and lang_pred and score of each whole text. The filter has a
    size fixed by its parameters, and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    used = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, scores = shared.value.predict(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[:-1])
    return used.mapInArrow(predict, f"{fields}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
