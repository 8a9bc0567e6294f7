"""Language ID and the whole pipeline against plain Python, on every row of a table."""

import itertools
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from meshweave.llm import language_id, queries, sql


def grams(text):
    """4-grams with a letter: letters in lower case, one blank after each run of them."""
    out, before = [None, None], False
    for ch in text.lower():
        if ch.isalpha() or before:
            out.append(ch if ch.isalpha() else None)
        before = ch.isalpha()
    out.append(None)
    return [g for i in range(len(out) - 3) if any(g := tuple(out[i : i + 4]))]


class PlainLanguages:
    """Sets of n-grams instead of filters: no false positives."""

    def __init__(self, rows):
        docs, counts = Counter(lang for _, lang in rows), defaultdict(Counter)
        for text, lang in rows:
            counts[lang].update(grams(text))
        often = {lang: {g: n / docs[lang] for g, n in c.items() if n >= max(2, 0.005 * docs[lang])} for lang, c in counts.items()}
        most = Counter()
        for rates in often.values():
            for g, r in rates.items():
                most[g] = max(most[g], r)
        self.sets = {lang: {g for g, r in often[lang].items() if r >= 0.1 * most[g] * (1 - 1e-12)} for lang in sorted(often)}

    def scores(self, text):
        all_ = grams(text or "")
        return {lang: sum(g in s for g in all_) / len(all_) for lang, s in self.sets.items()} if all_ else {}


def learnt(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(~language_id.held_out()).where("text is not null and lang is not null")
    return PlainLanguages([tuple(r) for r in docs.select("text", "lang").collect()])


def test_language_id_against_sets(spark):
    folder = "/root/testdata/sf0.01"
    plain = learnt(spark, folder)
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    sure = 0
    for r in queries.op5_language_id(spark, folder).collect():
        scores = plain.scores(texts[r["doc_id"]])
        if not scores:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        best = sorted(scores.values(), reverse=True)
        assert abs(r["score"] - scores[r["lang_pred"]]) < 0.03
        if best[0] - best[1] > 0.03:
            assert scores[r["lang_pred"]] == best[0]
            sure += 1
    assert sure > 0.95 * len(texts)


def test_filter_ties_and_corrections():
    import numpy as np

    table = np.zeros((1 << 10, 1), np.uint64)
    table[:] = 3  # every n-gram is in both languages
    model = language_id.LanguageFilter(["a", "b"], table, 3, np.array([0.0, 0.0]))
    assert model.predict(["word"])[0] == ["a"]
    model.false_positive[0] = 0.9  # as good as nothing was found, less what chance gives
    assert model.predict(["word"])[1][0] == pytest.approx(1.0)
    table[:] = 1
    model.false_positive[:] = [0.5, 0.0]
    assert model.predict(["word"]) == (["a"], pytest.approx([1.0]))


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def without_repeated_lines(texts):
    """Of id -> text, in order of ids: what is left; lines of 20 characters may differ by one edit."""
    seen, ends, out = set(), defaultdict(list), {}
    for i in sorted(texts):
        kept = []
        for line in texts[i].split("\n"):
            keys = {("l", line[:9]), ("r", line[-9:])} if len(line) >= 20 else set()
            gone = line.strip(" ") != "" and (line in seen or any(near(line, b) for key in keys for b in ends[key]))
            if not gone:
                kept.append(line)
            if line.strip(" ") != "" and line not in seen:
                seen.add(line)
                for key in keys:
                    ends[key].append(line)
        out[i] = "\n".join(kept)
    return out


def first_of_each_group(texts):
    sets, name = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            name[b] = a
    return {i for i in sets if root(i) == i}


def test_pipeline_against_plain_code(spark, sf, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = learnt(spark, sf)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    language, close = {}, set()
    for i, r in docs.items():
        scores = plain.scores(r["text"])
        if scores:
            best = max(sorted(scores), key=scores.get)
            if scores[best] >= corpus_pipeline.LEAST_SCORE:
                language[i] = best
            if abs(scores[best] - corpus_pipeline.LEAST_SCORE) < 0.03 or sorted(scores.values())[-1] - sorted(scores.values())[-2] < 0.03:
                close.add(i)  # false positives may decide
    first = {r["doc_id"]: r for r in corpus_pipeline.identify(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert set(first) ^ set(language) <= close and len(close) < 0.05 * len(docs)
    assert all(first[i]["lang"] == language[i] for i in first if i in language and i not in close)

    lines = without_repeated_lines({i: r["text"] for i, r in first.items()})
    left = {i: t for i, t in lines.items() if t == first[i]["text"] or t.strip(" ")}
    kept = first_of_each_group(left)
    third = spark.createDataFrame([(i, left[i], first[i]["lang"], first[i]["source"], len(left[i])) for i in sorted(kept)], "doc_id long, text string, lang string, source string, n_chars long")
    third.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    copies = Counter(i for (i,) in con.sql(sql.ORACLES["op1_mix"]).select("doc_id").fetchall())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    want = Counter({(i, first[i]["lang"], first[i]["source"], tuple(tokenizer.encode(left[i], add_special_tokens=False).ids)): n for i, n in copies.items()})
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"])) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows) and len(kept) > 0.5 * len(docs)
