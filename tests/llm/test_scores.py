"""Operators 11 to 13 against plain code, by enumeration and on held-out rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.llm import divergence, language_id, quality_crf, queries, whitening

# ---- op11


def test_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    field = quality_crf.Field(np.zeros(3 * len(quality_crf.FEATURES)), rng.normal(size=4) * 2)
    sizes = [1, 5, 3, 1, 7]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    u = rng.normal(size=begin[-1]) * 3
    r, b = field.messages(u, begin)
    for i, j in zip(begin, begin[1:], strict=False):
        total, good = 0.0, np.zeros(j - i)
        for labels in itertools.product((0, 1), repeat=int(j - i)):
            w = math.exp(sum(u[i + t] * y for t, y in enumerate(labels)) + sum(field.steps[2 * a + c] for a, c in zip(labels, labels[1:], strict=False)))
            total += w
            good += w * np.array(labels)
        assert np.allclose(1 / (1 + np.exp(-(r + b)[i:j])), good / total)


def test_gradient_reaches_the_best_weights():
    """At the end of a long fit, no small change of a weight raises the likelihood."""
    texts = ["good words here.\nand more of it.", "BAD## BAD##\nBAD## BAD##", "fine text, short.", "## $$ %%\nok then.\n## $$"] * 3
    label = np.array([1, 0, 1, 0] * 3)
    some = quality_crf.lines_of(texts)
    field = quality_crf.fit(some, label, steps=3000, ridge=1.0)

    def value(p):
        f, total = quality_crf.Field(p[:-4], p[-4:]), -0.5 * (p @ p) / len(label)
        u = f.unary(some)
        for k, (i, j) in enumerate(zip(some.begin, some.begin[1:], strict=False)):
            every = {}
            for labels in itertools.product((0, 1), repeat=int(j - i)):
                every[labels] = sum(u[i + t] * y for t, y in enumerate(labels)) + sum(f.steps[2 * a + c] for a, c in zip(labels, labels[1:], strict=False))
            top = every[(label[k],) * int(j - i)]
            total += (top - math.log(sum(map(math.exp, every.values())))) / (j - i) / len(label)
        return total

    p = np.concatenate([field.weights, field.steps])
    for k in range(len(p)):
        for d in (-0.05, 0.05):
            q = p.copy()
            q[k] += d
            assert value(q) < value(p) + 1e-5


def test_line_features_by_plain_code():
    text = "The CAT sat, 12 times.\nThe CAT sat, 12 times.\n\nno no noé || ##"
    some = quality_crf.lines_of(["x", text, None])
    assert list(some.begin) == [0, 1, 5, 6]
    at = dict(zip(quality_crf.FEATURES, some.x[1:5].T, strict=True))
    seen = 22 - 4
    assert np.allclose(at["upper"], [4 / seen, 4 / seen, 0, 0])
    assert np.allclose(at["digit"], [2 / seen, 2 / seen, 0, 0])
    assert np.allclose(at["stop"], [2 / seen, 2 / seen, 0, 0])
    assert np.allclose(at["bar"], [0, 0, 0, 2 / 11]) and np.allclose(at["symbol"], [0, 0, 0, 2 / 11])
    assert list(at["ends_with_stop"]) == [1, 1, 0, 0] and list(at["line_again"]) == [0, 1, 0, 0] and list(at["blank"]) == [0, 0, 1, 0]
    assert np.allclose(at["windows_again"], [0, 3 / 5, 0, 0]) and np.allclose(at["same_word_again"], [0, 0, 0, 1 / 5])


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op11_quality_classifier(spark, folder)
    met = got.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert len(met) > 500 and (met["predicted"] == met["quality"]).mean() > 0.98
    good, bad = met[met["quality"] == 1]["score"], met[met["quality"] == 0]["score"]
    assert np.mean([(good > b).mean() for b in bad]) > 0.99


def test_scores_are_those_of_plain_calls(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = quality_crf.train(docs.where(~language_id.held_out()), labels)
    got = {r["doc_id"]: r for r in queries.op11_quality_classifier(spark, sf).collect()}
    for d in docs.collect():
        r = got[d["doc_id"]]
        assert abs(r["score"] - field.scores([d["text"]])[0]) < 1e-9
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)


def test_fit_reads_nothing_of_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(language_id.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_crf.train(docs.where(~language_id.held_out()), x) for x in (labels, other))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.steps, b.steps)


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b c."), (2, "## ##")], "doc_id long, text string")
    none = quality_crf.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality_crf.score(docs, none).collect()] == [0.5, 0.5]
    one = quality_crf.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert all(0.5 < r["score"] <= 1 for r in quality_crf.score(docs, one).collect())


# ---- op12


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_eigen(n):
    rng = np.random.default_rng(n)
    b = rng.normal(size=(n, n))
    for a in (b + b.T, b @ b.T, np.zeros((n, n)), np.diag(np.arange(n) // 2.0), np.ones((n, n))):
        values, axes = whitening.eigen(a)
        size = max(abs(a).max(), 1e-300) * n
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size, rtol=0)
        assert abs(axes @ axes.T - np.eye(n)).max() < 1e-12
        assert abs(axes @ a - values[:, None] * axes).max() <= 1e-12 * size


def test_merged_moments_are_those_of_all_rows():
    x = np.random.default_rng(5).integers(-300, 300, (500, 6)) + 10_000
    whole, parts = whitening.Moments.empty(6), whitening.Moments.empty(6)
    whole.add(x)
    for block in np.array_split(x, [0, 1, 90, 91, 400]):
        one = whitening.Moments.empty(6)
        one.add(block)
        parts.merge(whitening.Moments.of(one.row(0).to_pylist()[0]))
    for got in (whole, parts):
        assert got.n == 500 and got.sums == x.sum(axis=0).tolist()
        assert np.allclose(got.scatter / 500, np.cov(x.T, bias=True), rtol=1e-11, atol=1e-9)


def test_many_parts_are_merged_in_tasks(spark):
    rows = spark.range(3000).selectExpr("array(id % 57, id % 11 - 4) as x").repartition(150)
    got = whitening.moments(rows, 2)
    x = np.array([(i % 57, i % 11 - 4) for i in range(3000)])
    assert got.n == 3000 and got.sums == x.sum(axis=0).tolist()
    assert np.allclose(got.scatter / 3000, np.cov(x.T, bias=True), rtol=1e-11)


def _whitened_plainly(rows):
    """(id, component) -> (n, deviation, whitened up to its sign, explained), in numpy."""
    fine = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in fine}))
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return [(i, k + 1, n, int(((n * np.array(x) - s) ** 2).sum()), abs((np.array(x) - s / n) @ axes[:, k]) / math.sqrt(values[k]), values[k] / values.sum()) for i, x in fine for k in range(min(4, len(s)))]


def test_whitening_by_plain_code(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(queries.op12_whitening(spark, folder).collect(), key=lambda r: (r["vec_id"], r["component"]))
    want = sorted(_whitened_plainly(rows))
    assert len(got) == len(want)
    signs = {}
    for g, w in zip(got, want, strict=True):
        assert (g["vec_id"], g["component"], g["n"], g["deviation"]) == w[:4]
        assert math.isclose(abs(g["whitened"]), w[4], rel_tol=1e-8, abs_tol=1e-10) and math.isclose(g["explained"], w[5], rel_tol=1e-9)
        signs.setdefault(g["component"], []).append(g["whitened"])
    assert max(r["identity_error"] for r in got) < 1e-9


def test_vectors_of_other_lengths_and_none(spark):
    give = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert give([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0  # one vector: no variance
    got = give([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [3.0, 2.0]), (4, [9.0]), (5, [1.0, 2.0])]).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3, 5] and {r["component"] for r in got} == {1} and {r["n"] for r in got} == {3}
    assert all(abs(r["explained"] - 1) < 1e-12 for r in got)
    huge = give([(1, [1e300, 2.0]), (2, [-1e300, 2.0]), (3, [0.0, 1.0])]).collect()
    assert {(r["vec_id"], r["component"]) for r in huge} == {(1, 1), (2, 1), (3, 1)}  # the other variance is nothing beside the first
    assert [r["deviation"] is None for r in sorted(huge, key=lambda r: r["vec_id"])] == [True, True, False]


# ---- op13


def _divergence_plainly(docs, least, top):
    counts, seen, every = {}, {}, set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        every.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        counts.setdefault((lang, source), Counter()).update(terms)
        seen.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang in {x for x, _ in every}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {s: counts[lang, s] for x, s in every if x == lang}
        whole = sum(groups.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept} for s, c in [*groups.items(), (None, whole)]}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(-f(p[s][t], p[None][t]), t) for t in kept if groups[s][t] and p[s][t] > p[None][t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(sorted(rows, key=lambda x: (x[0], x[1].encode()))[:most])]
    return sorted(out)


def test_divergence_by_plain_code(spark):
    words = ["tree", "Tree", "été", "Été", "a", "zz", "\U0001f600", "～", "it's", "x1y", "z" * 300]
    rng = np.random.default_rng(9)
    docs = [(lang, source, " ".join(rng.choice(words, size=rng.integers(0, 30)))) for lang in ("en", None, "") for source in ("a", "b", None, "") for _ in range(4)]
    docs += [("en", "c", None), ("de", "a", None), ("de", "b", "few"), ("fr", None, "alone " * 3), *docs[:5]]
    got = divergence.divergence(spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, source string, text string, n long, term string"), least_docs=3, top=4)
    assert sorted(map(tuple, got.collect())) == _divergence_plainly(docs, 3, 4)


def test_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 7)
    text = "One two,three 4 FÜnf über x" * 9
    assert [w.decode() for part in divergence._parts(text.encode()) for w in part] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_tallies_that_are_passed_on_early(spark, monkeypatch):
    docs = spark.createDataFrame([("en", str(i % 3), f"w{chr(97 + i % 26)} same text again") for i in range(60)], "lang string, source string, text string")
    whole = sorted(map(tuple, divergence.tallies(docs).collect()))
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    assert sorted(map(tuple, divergence.tallies(docs).collect())) == whole
