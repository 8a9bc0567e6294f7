"""Lossless WebP: round trips, and streams that use every part of the format."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshweave.llm import media, queries, webp


def reverse(code, n):
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


class Stream(webp.Writer):
    """Writes test streams with given symbols under flat codes of the whole alphabet."""

    def flat(self, alphabet):
        """A code of all symbols: the first 2^k - (alphabet - 2^k) ... simply: lengths 8 and 9."""
        long = 2 * (alphabet - 256)
        lengths = [8] * (alphabet - long) + [9] * long
        self.put(0, 1)
        order = webp.CODE_LENGTH_ORDER
        self.put(len(order) - 4, 4)
        for s in order:
            self.put(1 if s in (8, 9) else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(n - 8, 1)
        codes, code, last = [], 0, 8
        for n in lengths:
            code <<= n - last
            last = n
            codes.append((reverse(code, n), n))
            code += 1
        return codes

    def simple(self, *symbols):
        self.put(1, 1)
        self.put(len(symbols) - 1, 1)
        self.put(1, 1)
        for s in symbols:
            self.put(s, 8)


def small(out, pixels):
    """An entropy-coded image of literals."""
    out.image(np.array(pixels, np.uint32))


def header(w, h):
    out = Stream()
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(0, 4)
    return out


@pytest.mark.parametrize(("h", "w", "k"), [(1, 1, 1), (3, 64, 2), (5, 64, 4), (7, 64, 13), (9, 33, 100), (20, 64, 256), (50, 64, 9999)])
def test_round_trip(h, w, k):
    rng = np.random.default_rng(h)
    rgb = rng.integers(0, 256, (k, 3))[rng.integers(0, k, (h, w))].astype(np.uint8)
    back = webp.decode(webp.encode(rgb))
    assert (back[..., :3] == rgb).all() and (back[..., 3] == 255).all()


def test_references_and_cache():
    out = header(6, 2)
    out.put(0, 1)
    out.put(1, 1)
    out.put(3, 4)  # a cache of 8 colours
    out.put(0, 1)
    green = out.flat(280 + 8)
    planes = [out.flat(256) for _ in range(3)]
    out.simple(0, 1)  # distance prefixes 0 and 1: values 1 and 2, the pixels above and left
    put = lambda c: out.put(*c)

    def literal(r, g, b, a=255):
        put(green[g])
        for p, v in zip(planes, (r, b, a)):
            put(p[v])

    literal(1, 2, 3)
    literal(40, 50, 60)
    put(green[256 + 3])  # length 4
    out.put(1, 1)  # distance 2: the pixel to the left
    argb = 255 << 24 | 1 << 16 | 2 << 8 | 3
    put(green[280 + (webp.HASH * argb % 2**32 >> 29)])
    put(green[256 + 4])  # length 5 or 6, one more bit
    out.put(0, 1)
    out.put(0, 1)  # distance 1: the pixel above
    px = webp.decode(webp.container(out.bytes()))[..., :3]
    a, b = [1, 2, 3], [40, 50, 60]
    assert px.tolist() == [[a, b, b, b, b, b], [a, b, b, b, b, b]]


def test_transforms():
    """Predictor, cross-colour and subtract-green, undone by plain code here."""
    rng = np.random.default_rng(5)
    h, w = 9, 10
    residual = rng.integers(0, 256, (h, w, 4))
    modes = np.array([[m % 14 for m in range(i * 3, i * 3 + 3)] for i in range(3)])
    factors = rng.integers(0, 256, (3, 3, 3))
    argb = lambda px: (px[..., 3].astype(np.uint32) << 24) | (px[..., 0].astype(np.uint32) << 16) | (px[..., 1].astype(np.uint32) << 8) | px[..., 2].astype(np.uint32)
    out = header(w, h)
    out.put(1, 1)
    out.put(2, 2)
    out.put(1, 1)
    out.put(0, 2)
    out.put(0, 3)
    small(out, (modes << 8).astype(np.uint32))
    out.put(1, 1)
    out.put(1, 2)
    out.put(0, 3)
    small(out, (factors[..., 2] << 16 | factors[..., 1] << 8 | factors[..., 0]).astype(np.uint32))
    out.put(0, 1)
    out.image(argb(residual), True)
    got = webp.decode(webp.container(out.bytes()))
    s8 = lambda v: (int(v) & 255) - 256 if int(v) & 128 else int(v) & 255
    want = np.zeros((h, w, 4), int)
    for y in range(h):
        for x in range(w):
            r, g, b, a = map(int, residual[y, x])
            f = factors[y >> 2, x >> 2]
            r = (r + (s8(f[0]) * s8(g) >> 5)) & 255
            b = (b + (s8(f[1]) * s8(g) >> 5) + (s8(f[2]) * s8(r) >> 5)) & 255
            left, top = want[y, x - 1] if x else None, want[y - 1, x] if y else None
            if not y:
                p = left if x else np.array([0, 0, 0, 255])
            elif not x:
                p = top
            else:
                corner = want[y - 1, x - 1]
                right = want[y - 1, x + 1] if x + 1 < w else want[y, 0]
                m = lambda i, j: (i + j) // 2
                t = np.abs(top - corner).sum() < np.abs(left - corner).sum()
                half = m(left, top)
                p = [np.array([0, 0, 0, 255]), left, top, right, corner, m(m(left, right), top), m(left, corner), m(left, top), m(corner, top), m(top, right), m(m(left, corner), m(top, right)), left if t else top, np.clip(left + top - corner, 0, 255), np.clip(half + np.trunc((half - corner) / 2).astype(int), 0, 255)][modes[y >> 2, x >> 2]]
            want[y, x] = (np.array([r, g, b, a]) + p) & 255
    want[..., 0] = (want[..., 0] + want[..., 1]) & 255
    want[..., 2] = (want[..., 2] + want[..., 1]) & 255
    assert (got == want).all()


def test_meta_codes():
    out = header(8, 4)
    out.put(0, 1)
    out.put(0, 1)
    out.put(1, 1)
    out.put(0, 3)
    small(out, np.array([[0, 1 << 8]], np.uint32))
    for g in (7, 9):
        out.simple(g)
        for v in (1, 2, 255):
            out.simple(v)
        out.simple(0)
    px = webp.decode(webp.container(out.bytes()))
    assert (px[:, :4, 1] == 7).all() and (px[:, 4:, 1] == 9).all()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_any_text(text):
    n, data = media.payload(text.encode("utf-8", "replace").decode())
    assert len(data) % 192 == 0 and len(data) > 0
    assert media.load(media.store(data)).tobytes() == data


def test_long_text_takes_several_images():
    data = media.payload("ab c" * 900_000)[1]
    files = media.store(data)
    assert len(files) == 2 and media.load(files).tobytes() == data


def test_query(spark, sf):
    """Every column against plain code; the files themselves are read by the test above."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r for r in queries.op9_media(spark, sf).collect()}
    files = {r["doc_id"]: r["media"] for r in media.write(docs).collect()}
    assert len(rows) == docs.count()
    for i, text in docs.collect():
        raw = (text or "").encode()
        data = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        n = len(data) // 3
        mean = [sum(data[k::3]) / n for k in range(3)]
        bins = [0] * 16
        for x in data:
            bins[x >> 4] += 1
        stored = b"".join(files[i])
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        size, rgb, hist = r["feature"].split(" ")
        assert size == f"64x{n // 64}" and hist == "hist=" + ",".join(map(str, bins))
        assert [float(x) for x in rgb[4:].split(",")] == pytest.approx(mean, abs=6e-4)


def test_texts_are_coded_and_read_by_the_method(spark, sf):
    used = Counter()
    for (text,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        for file in media.store(media.payload(text)[1]):
            webp.decode(file, used)
    assert used["prefix-coded"] >= 200 and used["references"] > 200 and used["cache hits"] > 2000


def test_smooth_images_use_the_transforms():
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:64, 0:64]
    slope = ((x * 3 + y * 2)[..., None] + rng.integers(0, 3, (64, 64, 3))) % 256
    grey = rng.integers(0, 256, (64, 64, 1)) + rng.integers(0, 3, (64, 64, 3))
    half = rng.integers(0, 128, (64, 64, 1)) * np.array([1, 2, 0]) // 2 + np.array([40, 0, 9]) + rng.integers(0, 4, (64, 64, 3)) * np.array([1, 0, 1])
    for made, parts in ((slope, {"predictor"}), (grey, {"subtract-green"}), (half, {"cross-colour"}), (np.zeros((9, 64, 3)), {"palette"})):
        used, rgb = Counter(), made.astype(np.uint8)
        assert (webp.decode(webp.encode(rgb), used)[..., :3] == rgb).all()
        assert parts <= set(used), used


def test_broken_files():
    rng = np.random.default_rng(4)
    file = webp.encode(rng.integers(97, 123, (6, 64, 3)).astype(np.uint8))
    chunk = file[12:]
    wide = b"RIFF" + (len(chunk) + 22).to_bytes(4, "little") + b"WEBPVP8X" + (10).to_bytes(4, "little") + bytes(10) + chunk
    assert (webp.decode(wide) == webp.decode(file)).all()
    stream = file[21:]
    for n in (0, 3, 9, len(stream) // 3, len(stream) - 9):
        with pytest.raises(ValueError):
            webp.decode(webp.container(stream[:n]))
    for n in (0, 11, 19, len(file) // 2):
        with pytest.raises(ValueError):
            webp.decode(file[:n])


def test_null_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, None, b"x"), (2, "", b"x"), (2, "", b"y")], "doc_id long, text string, media binary")
    rows = media.read(media.write(df)).collect()
    assert len(rows) == 3 and len({r["payload_sha256"] for r in rows}) == 1 and {r["payload_bytes"] for r in rows} == {192}
    assert media.read(media.write(df.limit(0))).count() == 0


def test_images_read_side_by_side():
    """Small images of texts, smooth ones, flat ones and large ones, against one at a time."""
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:20, 0:64]
    slope = ((x * 3 + y * 2)[..., None] + rng.integers(0, 3, (20, 64, 3))) % 256
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(200)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 200, n)) for n in (1, 3, 40, 90, 300, 900, 4000, 40, 41, 42, 700)]
    files = [f for t in texts for f in media.store(media.payload(t.decode())[1])] + [webp.encode(p.astype(np.uint8)) for p in (slope, np.zeros((9, 64, 3)), slope[:1])]
    together, alone = Counter(), Counter()
    got, want = webp.decode_all(files, together), [webp.decode(f, alone) for f in files]
    assert all((a == b).all() and a.shape == b.shape for a, b in zip(got, want, strict=True))
    assert together == alone and min(alone["references"], alone["cache hits"]) > 0
    stream = files[4][21:]
    for n in (len(stream) // 2, len(stream) - 9):
        with pytest.raises(ValueError):
            webp.decode_all(files[:5] + [webp.container(stream[:n])] + files[5:])


def test_rows_read_together_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(media, "TOGETHER", 3)
    monkeypatch.setattr(media, "TOGETHER_BYTES", 10)
    rows = [[b"a"], [b"b" * 9, b"c"], [b"d"], [b"e"], [b"f"], [b"g"]]
    assert list(media.together(pa.array(rows, pa.list_(pa.binary())))) == [(0, 2), (2, 5), (5, 6)]
    assert list(media.together(pa.array([], pa.list_(pa.binary())))) == []


def mixed_images(seed):
    """Texts, palettes, smooth images and noise, of several widths."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:20, 0:64]
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(150)]
    texts = [media.payload(b" ".join(words[i] for i in rng.integers(0, 150, n)).decode())[1] for n in (0, 1, 9, 40, 300, 1200, 40)]
    made = [np.frombuffer(t, np.uint8).reshape(-1, 64, 3) for t in texts] + [((x * 3 + y * 2)[..., None] + rng.integers(0, 3, (20, 64, 3))) % 256]
    for _ in range(8):
        k, h, w = rng.integers(1, 400), rng.integers(1, 30), rng.integers(1, 90)
        made.append(rng.integers(0, 256, (k, 3))[rng.integers(0, k, (h, w))])
    return [m.astype(np.uint8) for m in made]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_images_written_side_by_side(seed):
    """Every image comes back, and its file is the one that it has alone or in any order."""
    images = mixed_images(seed)
    files = webp.encode_all(images)
    assert all((webp.decode(f)[..., :3] == m).all() for f, m in zip(files, images, strict=True))
    assert files == [webp.encode(m) for m in images] and files[::-1] == webp.encode_all(images[::-1])


def test_codes_are_made_for_a_group_at_once(monkeypatch):
    """Writing more texts makes groups larger, and takes no more steps."""
    made, times = webp._lengths, []
    monkeypatch.setattr(webp, "_lengths", lambda counts, *limit: times.append(len(counts)) or made(counts, *limit))
    loads = [media.payload(f"text {i} of some length, " * (i % 7 + 1))[1] for i in range(400)]
    stored = media.store_all(loads)
    assert len(times) <= 8 and len(stored) == 400
    assert all(media.load(f).tobytes() == p for f, p in zip(stored[::25], loads[::25], strict=True))


def test_codes_are_complete():
    rng = np.random.default_rng(9)
    counts = np.where(rng.random((40, 344)) < rng.random((40, 1)), rng.integers(1, 5, (40, 344)) ** rng.integers(1, 9, (40, 1)), 0)
    counts[:4] = 0
    counts[1, 7], counts[2, [3, 200]], counts[3, [0, 1, 343]] = 5, [1, 900], [1, 1, 1 << 20]
    for limit in (7, 11):
        some = counts if limit == 11 else counts[:, :19]
        lengths = webp._lengths(some, limit)
        assert ((lengths > 0) == (some > 0)).all() and lengths.max() <= limit
        many = (some > 0).sum(1) > 1
        assert (np.where(lengths > 0, 2.0**-lengths, 0).sum(1)[many] == 1).all()
        assert all((a[None] == b).all() for a, b in ((webp._lengths(some[i : i + 1], limit)[0], lengths[i : i + 1]) for i in range(40)))


def test_long_and_many_rows_are_written_in_groups(spark, monkeypatch):
    monkeypatch.setattr(media, "WRITTEN_BYTES", 1000)
    assert list(media.spans([400, 700, 5000, 1, 2], 1000)) == [(0, 2), (2, 3), (3, 5)]
    texts = ["a b" * n for n in (0, 5, 900, 1, 0, 3000, 20)] + [None]
    assert media.store_all([media.payload(t)[1] for t in texts]) == [media.store(media.payload(t)[1]) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r["doc_id"]: r["media"] for r in media.write(df).collect()} == {i: media.store(media.payload(t)[1]) for i, t in enumerate(texts)}
