"""BPE encoding and decoding with a contiguous rank array per word.

A word's parts lie in one list with the merge rank of each neighbouring pair in another;
the lowest rank is looked for again and again, its boundary deleted, and the two ranks
beside it refreshed. Words come back often, so each Python worker keeps what it has
encoded, up to a fixed number of words. Over LONG parts, a heap finds the lowest rank.

Tokenizer files in the layout of the tokenizers library are read, with the steps that
the word-end vocabulary uses: NFC, white space to single blanks, lower case, split by a
pattern, bytes as printable characters, a suffix at the word end. Added tokens are found
in the raw text first. Decoding without a decoder joins tokens with blanks.

Defined cases: null text counts as empty and gives no tokens; characters that the
vocabulary lacks give none either. Repeated rows repeat. An empty table gives an empty
result. Other columns are passed through or not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 200
CACHED = 150_000
NEVER = 1 << 60
#: Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable
    Latin-1, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


@dataclass
class Tokenizer:
    """What a tokenizer file says. Small enough to broadcast: a vocabulary."""

    tokens: list[str]
    inner: list[int]  # id of each byte's character inside a word; -1 if there is none
    final: list[int]  # and at its end
    merges: dict[int, tuple[int, int]]  # left id << 32 | right id: rank, merged id
    added: dict[str, int]
    pattern: str

    @classmethod
    def read(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in [*vocab.items(), *added.items()]:
            tokens[i] = t
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}")
        chars = byte_characters()
        return cls(tokens, [vocab.get(c, -1) for c in chars], [vocab.get(c + suffix, -1) for c in chars], merges, added, pattern)

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[b] for b in raw[-1:]]
        ids = [i for i in ids if i >= 0]
        return self._heap(ids) if len(ids) > LONG else self._ranks(ids)

    def _rank(self, a: int, b: int) -> int:
        got = self.merges.get(a << 32 | b)
        return got[0] if got else NEVER

    def _ranks(self, ids: list[int]) -> list[int]:
        ranks = [self._rank(a, b) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            lowest = min(ranks)
            if lowest == NEVER:
                break
            i = ranks.index(lowest)
            ids[i] = self.merges[ids[i] << 32 | ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = self._rank(ids[i - 1], ids[i])
            if i < len(ranks):
                ranks[i] = self._rank(ids[i], ids[i + 1])
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self._rank(ids[i], ids[i + 1])) < NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a << 32 | b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self._rank(ids[k], ids[after[k]])) < NEVER:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [i for i in ids if i >= 0]


class Encoder(dict):
    """A worker's encoder: packed ids by word, kept up to CACHED words."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.find = regex.compile(tokenizer.pattern).findall
        self.blank = regex.compile(f"[{SPACE}]+").sub
        self.parts = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(tokenizer.added, key=len, reverse=True)) or "(?!)").finditer

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        self[word] = got = np.array(self.tokenizer.word(word), "<u4").tobytes()
        return got

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter has no final sigma
        return b"".join(map(self.__getitem__, self.find(self.blank(" ", text).lower())))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text."""
        if not text:
            return np.zeros(0, "<u4")
        out, at = [], 0
        for m in self.parts(text):
            out += [self._plain(text[at : m.start()]), np.array([self.tokenizer.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        out.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokenizer.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """The columns of keep and, of each whole text, ids (array of int) and decoded, or,
    if only digests are wanted, n_tokens, ids_sha256 and decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer.read(path))
    used = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [encoder.encode(t) for t in batch.column("__text").to_pylist()]
                back = [encoder.decode(i) for i in ids]
                if digests:
                    cols = [pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string())]
                else:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    cols = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], *(x.split(" ")[0] for x in made.split(", "))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[:-1])
    return used.mapInArrow(run, f"{fields}, {made}" if fields else made)
