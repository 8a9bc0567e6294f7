"""Media columns: texts as payloads of lossless WebP images, written, read back, described.

A payload fills rows of 64 pixels of three samples; one of more than 16,384 rows takes
several images. Texts are written and read in groups of bounded bytes, so memory follows
the longest text, not the batch; what a text becomes does not depend on its group.

Defined cases: a null text is an empty payload, padded like any other. Equal texts give
equal media. Repeated rows repeat. An empty table gives an empty result. Other columns
are passed through or not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave.llm import webp

ROW = 64  # pixels
UNIT = 3 * ROW  # bytes
BLANK = b" "
TOGETHER, TOGETHER_BYTES = 600, 1 << 20  # rows and bytes of files that are read together
WRITTEN_BYTES = 1 << 19  # of payloads that are written together, until they are as many


def payload(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, and with blanks up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + BLANK * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def store(data: bytes) -> list[bytes]:
    """Image files of a payload."""
    return store_all([data])[0]


def store_all(loads: list[bytes]) -> list[list[bytes]]:
    """store() of several payloads, whose images are written side by side."""
    images, of = [], []
    for i, data in enumerate(loads):
        rows = np.frombuffer(data, np.uint8).reshape(-1, ROW, 3)
        for at in range(0, len(rows), webp.SIDE):
            images.append(rows[at : at + webp.SIDE])
            of.append(i)
    out: list[list[bytes]] = [[] for _ in loads]
    for at, end in spans([image.size for image in images], WRITTEN_BYTES):
        for i, file in zip(of[at:end], webp.encode_all(images[at:end]), strict=True):
            out[i].append(file)
    return out


def load(files: list[bytes]) -> np.ndarray:
    """The pixel array of a payload's image files: (rows, 64, 3)."""
    return np.concatenate([webp.decode(f)[..., :3] for f in files])


def load_all(stored: list[list[bytes]]) -> Iterator[np.ndarray]:
    """load() of several payloads, of which small ones are read side by side."""
    images = iter(webp.decode_all([f for files in stored for f in files]))
    for files in stored:
        yield np.concatenate([next(images)[..., :3] for _ in files])


def together(media: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows, of at most TOGETHER rows and about TOGETHER_BYTES each."""
    return spans((sum(len(f.as_buffer()) for f in files) for files in media), TOGETHER_BYTES)


def spans(sizes: Iterable[int], least: int) -> Iterator[tuple[int, int]]:
    """Ranges that end where their sizes reach least, or after TOGETHER of them."""
    start, end, size = 0, 0, 0
    for n in sizes:
        end, size = end + 1, size + n
        if size >= least or end - start == TOGETHER:
            yield start, end
            start, size = end, 0
    if start < end:
        yield start, end


def describe(pixels: np.ndarray) -> str:
    """Width x height, mean of each channel, and a histogram of samples in 16 bins."""
    mean = pixels.reshape(-1, 3).mean(0)
    bins = np.bincount(pixels.ravel() >> 4, minlength=16)
    return f"{pixels.shape[1]}x{pixels.shape[0]} rgb={','.join(f'{m:.3f}' for m in mean)} hist={','.join(map(str, bins))}"


def write(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_bytes, and media (array of binary) of each whole text."""
    used = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column("__text")), 0).to_pylist()
            for at, end in spans((max(1, -(-n // UNIT)) * UNIT for n in sizes), WRITTEN_BYTES):
                batch = whole.slice(at, end - at)
                loads = [payload(t.as_py()) for t in batch.column("__text")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([n for n, _ in loads], pa.int64()), pa.array(store_all([p for _, p in loads]), pa.list_(pa.binary()))], [*batch.schema.names[:-1], "n_bytes", "media"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[:-1])
    return used.mapInArrow(run, f"{fields}, n_bytes long, media array<binary>")


def read(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), pixels: bool = True) -> DataFrame:
    """The columns of keep, digests of the bytes read back from media and of media, the
    feature string and, if wanted, the pixel array (binary; rows x 64 x 3 samples)."""
    used = stored.select(*[F.col(c) for c in keep], F.col("media").alias("__media"))
    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pixels binary" * pixels

    def one(files: list[bytes], px: np.ndarray) -> tuple:
        data = px.tobytes()
        sha = hashlib.sha256()
        for f in files:
            sha.update(f)
        return (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), sum(map(len, files)), sha.hexdigest(), describe(px)) + (data,) * pixels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split(" ")[0] for x in made.split(", ")]
        for whole in batches:
            for at, end in together(whole.column("__media")):
                batch = whole.slice(at, end - at)
                stored = batch.column("__media").to_pylist()
                rows = list(map(one, stored, load_all(stored)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]], [*batch.schema.names[:-1], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[:-1])
    return used.mapInArrow(run, f"{fields}, {made}")
