"""Quality of documents by a linear-chain conditional random field over their lines.

Each line gets features of its bytes and words (shares of upper case, digits, symbols,
stops, long and repeated words, words seen earlier in the text, and so on), which count
for the line itself and, with weights of their own, for the lines before and after it. The
field labels lines good or bad: weights of features say how good a line looks by itself
and beside its neighbours, weights of transitions how labels follow one another. A
document's score is the mean of its lines' marginals by forward-backward recursion,
weighted by their lengths.

Fit: on a sample of at most `most_docs` labelled documents, by smallest hash of the id,
those of over `most_lines` lines left out; their lines bear their document's label. The
bounds make the sample fit into the driver; features are computed where documents lie.
Scoring goes through every line of every document.

Defined cases: null and empty texts have one line without a character, which is scored as
any other. Lines end at \\n alone. A label of 1 is good, 0 bad; rows with other labels or
null ids don't take part in the fit; documents or labels that repeat take part as often as
they meet. Without labels all scores are 0.5. Equal texts have equal scores. Rows repeat
in the result as they do in the input; an empty table gives an empty result. Only id and
text, and the id and quality of labels, are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave.llm import shingles
from meshweave.llm.common import pieces

MOST_DOCS, MOST_LINES = 4000, 1000
RIDGE = 2.0  # of the weights, in documents
STEPS = 150  # of the fit
GOOD = 0.7
#: Classes of bytes. Continuation bytes of UTF-8 are of none.
UPPER, LOWER, OTHER, DIGIT, BLANK, STOP, BAR, SYMBOL, CONTINUATION = range(9)
_class = np.full(256, SYMBOL, np.uint8)
_class[0x41:0x5B], _class[0x61:0x7B], _class[0x30:0x3A] = UPPER, LOWER, DIGIT
_class[[0x20, *range(0x09, 0x0E)]], _class[list(b".,;:'\"()-")], _class[list(b"|<>{}[]\\")] = BLANK, STOP, BAR
_class[0xC0:], _class[0x80:0xC0] = OTHER, CONTINUATION
FEATURES = ("bias", "upper", "digit", "stop", "bar", "symbol", "ends_with_stop", "short", "word_length", "long_words", "same_word_again", "windows_again", "line_again", "blank")


@dataclass
class Lines:
    """Of some texts: features of all lines, lengths in characters, and where each text's
    lines begin (one more entry than texts)."""

    x: np.ndarray
    length: np.ndarray
    begin: np.ndarray


def _again(h: np.ndarray) -> np.ndarray:
    """Whether an equal value stands before."""
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return first[back] < np.arange(len(h))


def lines_of(texts: list[str | None]) -> Lines:
    lines = [(t or "").split("\n") for t in texts]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.concatenate([[0], np.cumsum(counts)])
    flat = [x for one in lines for x in one]
    owner = np.repeat(np.arange(len(lines)), counts).astype(np.uint64)
    data = np.frombuffer(("\n".join(flat) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    kind = _class[data]
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(flat)
    # Characters of each class: differences of running counts, one class at a time.
    per = np.empty((CONTINUATION, n), np.float32)
    for k in range(CONTINUATION):
        run = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        per[k] = run[ends] - run[starts]
    length = per.sum(axis=0)
    seen = np.maximum(length - per[BLANK], 1)
    last = kind[np.maximum(ends - 1, 0)]

    words, at = shingles.word_hashes(flat)
    size = np.diff(at)
    many = np.maximum(size, 1)
    line = np.repeat(np.arange(n), size)

    def share(hit: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.bincount(where[hit], minlength=n) / many

    text = owner[line] if len(line) else np.zeros(0, np.uint64)
    same = np.zeros(len(words), bool)
    windows = np.zeros(len(words), bool)
    if len(words) > 2:
        same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        grams = shingles.mix(shingles.mix(words[:-2]) + words[1:-1]) + words[2:]
        windows[:-2] = _again(shingles.mix(grams) + shingles.mix(text[:-2])) & (text[:-2] == text[2:])
    # A line again: the same words as an earlier line of the text.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles.mix(words), dtype=np.uint64)])
    whole = sums[at[1:]] - sums[at[:-1]]
    again = _again(shingles.mix(whole) + shingles.mix(owner)) & (size > 0)
    chars = seen / many
    x = np.stack(
        [
            np.ones(n),
            per[UPPER] / seen,
            per[DIGIT] / seen,
            per[STOP] / seen,
            per[BAR] / seen,
            per[SYMBOL] / seen,
            (last == STOP) & (length > 0),
            1 / (1 + size / 4),
            np.minimum(chars, 20) / 10,
            chars > 12,
            share(same, line),
            share(windows, line),
            again,
            size == 0,
        ],
        axis=1,
    ).astype(np.float32)
    return Lines(x, length, begin)


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


@dataclass
class Field:
    """weights: of the features of the line, the one before and the one after, for good
    against bad. steps: log potentials of (bad, bad), (bad, good), (good, bad), (good, good)."""

    weights: np.ndarray
    steps: np.ndarray

    def unary(self, some: Lines) -> np.ndarray:
        """Log odds of each line for good, from features alone."""
        w = self.weights.reshape(3, -1)
        own, before, after = ((some.x * v).sum(axis=1) for v in w)  # line by line: the same wherever it stands
        first, last = some.begin[:-1], some.begin[1:] - 1
        u = own.copy()
        u[1:] += before[:-1]
        u[first[first > 0]] -= before[first[first > 0] - 1]
        u[:-1] += after[1:]
        u[last[last + 1 < len(u)]] -= after[last[last + 1 < len(u)] + 1]
        return u

    def messages(self, u: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of forward (own line included) and backward messages. Texts go side by
        side, a line a step; the longer ones come first, so that those still on are a slice."""
        bb, bg, gb, gg = self.steps
        size = np.diff(begin)
        by = np.argsort(-size, kind="stable")
        start, size = begin[:-1][by], size[by]
        on = [int(k) for k in np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")]
        r, b = np.empty_like(u), np.zeros_like(u)
        r[start] = u[start]
        for t in range(1, len(on)):
            at = start[: on[t]] + t
            p = r[at - 1]
            r[at] = u[at] + bg + _softplus(gg - bg + p) - bb - _softplus(gb - bb + p)
        for t in range(len(on) - 1, 0, -1):
            at = start[: on[t]] + t
            p = u[at] + b[at]
            b[at - 1] = gb + _softplus(gg - gb + p) - bb - _softplus(bg - bb + p)
        return r, b

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, z in shingles.chunks(texts):
            some = lines_of(texts[a:z])
            r, b = self.messages(self.unary(some), some.begin)
            good = 1 / (1 + np.exp(-np.clip(r + b, -500, 500)))
            weight = some.length + 1.0  # an empty line counts, too
            out[a:z] = np.add.reduceat(good * weight, some.begin[:-1]) / np.add.reduceat(weight, some.begin[:-1])
        return np.clip(np.round(out, 12), 0.0, 1.0)


def _beside(some: Lines) -> np.ndarray:
    """Features of each line, the one before and the one after, side by side."""
    n, k = some.x.shape
    wide = np.zeros((n, 3 * k))
    wide[:, :k] = some.x
    wide[1:, k : 2 * k] = some.x[:-1]
    wide[some.begin[:-1], k : 2 * k] = 0
    wide[:-1, 2 * k :] = some.x[1:]
    wide[some.begin[1:] - 1, 2 * k :] = 0
    return wide


def fit(some: Lines, label: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> Field:
    """Greatest conditional likelihood of the texts' labels on all their lines, by gradient
    steps with momentum and a scale for each weight. A text weighs as one, however long."""
    k = some.x.shape[1]
    if not len(label):
        return Field(np.zeros(3 * k), np.zeros(4))
    wide, sizes = _beside(some), np.diff(some.begin)
    y = np.repeat(label, sizes).astype(float)
    weight = np.repeat(1.0 / sizes, sizes)
    inner = np.ones(len(y), bool)
    inner[some.begin[:-1]] = False  # lines with one before
    at = np.flatnonzero(inner)
    kinds = (2 * y[at - 1] + y[at]).astype(int)
    p, m, v = np.zeros(3 * k + 4), np.zeros(3 * k + 4), np.zeros(3 * k + 4)
    for step in range(1, steps + 1):
        field = Field(p[:-4], p[-4:])
        u = wide @ field.weights
        r, b = field.messages(u, some.begin)
        good = 1 / (1 + np.exp(-np.clip(r + b, -500, 500)))
        grad = np.empty_like(p)
        grad[:-4] = wide.T @ ((y - good) * weight)
        before, after = r[at - 1], (u + b)[at]
        joint = np.stack([0 * before, after, before, before + after]) + field.steps[:, None]
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        grad[-4:] = np.bincount(kinds, weight[at], minlength=4) - joint @ weight[at]
        grad = (grad - ridge * p) / len(label)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(p[:-4], p[-4:])


def train(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_lines: int = MOST_LINES) -> Field:
    """A field from docs(doc_id, text) and labels(doc_id, quality), over a sample within the
    bounds named."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    ids = known.join(docs.select(F.col("doc_id").alias("id")), F.col("doc_id") == F.col("id"), "left_semi").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)) < most_lines)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            for a, z in shingles.chunks(texts):
                some = lines_of(texts[a:z])
                x = [some.x[i:j].tobytes() for i, j in zip(some.begin, some.begin[1:], strict=False)]
                length = [some.length[i:j].tobytes() for i, j in zip(some.begin, some.begin[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, z - a).select(["doc_id", "quality"]).columns, pa.array(x, pa.binary()), pa.array(length, pa.binary())], ["doc_id", "quality", "x", "length"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    got = rows.select("doc_id", "quality", "text").mapInArrow(featured, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, x binary, length binary").orderBy("doc_id", "quality", "x").limit(2 * most_docs).toArrow()
    x = [np.frombuffer(b, np.float32).reshape(-1, len(FEATURES)) for b in got["x"].to_pylist()]
    if not x:
        return fit(Lines(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0), np.zeros(1, np.int64)), np.zeros(0))
    return fit(Lines(np.concatenate(x), np.zeros(0), np.concatenate([[0], np.cumsum([len(a) for a in x])])), np.array(got["quality"].to_pylist()))


def score(docs: DataFrame, field: Field, good: float = GOOD) -> DataFrame:
    """The columns of docs but for text, with score and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = field.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").withColumn("predicted", F.when(F.col("score") >= good, 1).otherwise(0).cast("int"))
