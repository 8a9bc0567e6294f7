"""Each operator on awkward rows and empty tables, and against SQL or brute force."""

import hashlib
import itertools
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from meshweave.llm import chat, jaccard_join, language_id, license_scan, line_dedup, media, mixing, quality, queries, registry, sql, suffix_dedup
from tests.llm.helpers import TEXT, awkward


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        path = f"{folder}/{table}.parquet"
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    df = getattr(queries, name)(spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted(con.sql(sql.ORACLES[name]).select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_sql(spark, sf, name):
    same_as_sql(spark, name, sf)


def test_all_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    awkward(spark).repartition(3).write.parquet(f"{folder}/documents.parquet")
    turns = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "</turn>&lt; <turn>"), (1, 2, "assistant", "again"), (2, 0, None, "x"), (3, 0, "system", "alone"), (4, 0, "assistant", ""), (5, None, "us\ner", "y " * 700), (5, 3, "assistant", "z " * 900)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    marks = [(1, 1, "x"), (1, 1, "x"), (2, 1, "x"), (3, 0, "x"), (4, 0, "x"), (5, None, "x"), (6, 2, "x"), (None, 1, "x"), (9, 0, "x"), (77, 1, "x")]
    spark.createDataFrame(marks, "doc_id long, quality int, text string").write.parquet(f"{folder}/labels.parquet")
    nan, inf = float("nan"), float("inf")
    given = [(1, [0.5, 1.0, -0.25]), (1, [0.5, 1.0, -0.25]), (2, [1.5, 0.0, 0.25]), (None, [0.0, 2.0, 0.125]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]), (6, [0.0, inf, 0.0]), (7, []), (8, [1.0]), (9, [-1.0, 0.001, 3.0]), (10, [-0.0, 0.7, 0.1])]
    spark.createDataFrame([(i, v, "x", 0) for i, v in given], "vec_id long, embedding array<float>, x string, d int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


ROWS = {"op3": 11, "op4": 11, "op5": 11, "op6": 11, "op7": 11, "op9": 11, "op10": 11, "op11": 11, "op12": 18}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_awkward_rows(spark, odd, name):
    rows = registry.queries()[name](spark, odd).collect()
    assert len(rows) == ROWS.get(name.split("_")[0], len(rows))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, tmp_path, name):
    awkward(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).count() == (1 if name == "op2_chat" else 0)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out()))
    out = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out())
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert model.predict([None, "", "12 !"])[0] == ["und"] * 3


def test_quality_against_plain_code(spark, sf):
    got = {r["doc_id"]: r for r in queries.op7_quality_rules(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        lines = [x for x in (d["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
        r = got[d["doc_id"]]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", d["text"] or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_quality_sketch_is_near_the_quantiles(spark):
    rows = [(i, "en", "s", 100, 100 + i, 0, 0, 0, 9) for i in range(2000)]
    feats = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in (*quality.BASE, "n_lines")))
    cut = quality.thresholds(feats, reach=0.0).where("feature = 'word_length'").first()
    assert abs(cut["high"] - (100 + 1800) / 100) < 0.02 * 19
    assert abs(cut["low"] - (100 + 200) / 100) < 0.02 * 3


def _plain_kept(docs):
    """doc_id -> kept, from (doc_id, lang, source, text), with every value of every group
    in hand, as the middle of its bucket."""

    def middle(v):
        return quality.GAMMA ** math.ceil(round(math.log(v) / math.log(quality.GAMMA), 9)) * 2 / (1 + quality.GAMMA) if v else 0.0

    feats = {}
    for i, lang, source, text in docs:
        words, chars, symbols, dup, repeat, lines = quality.base_counts(text)
        if words >= 50 and 2 * repeat <= words:
            feats[i] = lang, source, {"symbol_share": (symbols, words), "dup_line_share": (dup, lines), "repeat_share": (repeat, words), "word_length": (chars, words)}
    kept = {i: i in feats for i, *_ in docs}
    for f, (_, _, counted) in quality.FEATURES.items():
        values = [(a, b, middle(x[f][0] / x[f][1])) for a, b, x in feats.values()]

        def shrunk(own, parent):
            whole = sum(w for _, w in parent)
            return [(v, quality.PRIOR * w / whole) for v, w in parent] + [(v, 1) for v in own]

        for lang, source in {x[:2] for x in feats.values()}:
            of_lang = shrunk([v for a, _, v in values if a == lang], [(v, 1) for _, _, v in values])
            group = sorted(shrunk([v for a, b, v in values if (a, b) == (lang, source)], of_lang))
            upto = list(itertools.accumulate(w for _, w in group))
            q5, q10, q50, q90, q95 = (next(v for (v, _), u in zip(group, upto, strict=True) if u >= p * upto[-1] - 1e-5) for p in (0.05, 0.1, 0.5, 0.9, 0.95))
            low, high = q10 - 3 * max(q50 - q10, q10 - q5), q90 + 3 * max(q90 - q50, q95 - q90)
            share = max(high, round(sum(v * w for v, w in group) / upto[-1], 9))
            for i, (a, b, x) in feats.items():
                n, of = x[f]
                m = share * of
                if (a, b) == (lang, source) and (n > m and (not m or n * math.log(n / m) - n + m > 4.5) if counted else not low / quality.GAMMA <= n / of <= high * quality.GAMMA):
                    kept[i] = False
    return kept


def test_quality_verdicts_against_plain_code(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = _plain_kept(docs)
    rows = queries.op7_quality_rules(spark, folder).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == want
    assert sum(not r["base_failed"] and not r["kept"] for r in rows) > 10


def test_quality_rules_reject_planted_junk(spark):
    def words(i, n):
        return [f"w{i}x{k}" for k in range(n)]

    def text(i, ws, per=20):
        return "\n".join(" ".join(ws[k : k + per]) for k in range(0, len(ws), per))

    rows = [(i, text(i, words(i, 200))) for i in range(600)]
    junk = {
        "symbol_share": text(1000, [w + "#$" for w in words(1000, 200)]),
        "dup_line_share": "\n".join([" ".join(words(1001, 20))] * 5 + [text(1001, [f"z{k}y{k}" for k in range(200)])]),
        "repeat_share": text(1002, words(1002, 60) + words(1002, 20) + [f"v{k}u{k}" for k in range(60)]),
        "word_length": text(1003, [w + "abcdefghijkl" for w in words(1003, 200)]),
    }
    rows += [(1000 + k, t) for k, t in enumerate(junk.values())]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    feats = quality.features(docs)
    cut = {r["feature"]: r for r in quality.thresholds(feats).collect()}
    judged = {r["doc_id"]: r for r in quality.verdicts(feats).collect()}
    for k, f in enumerate(junk):
        r = judged[1000 + k]
        a, b, _ = quality.FEATURES[f]
        assert not r["base_failed"] and not r["kept"] and r[a] / r[b] > cut[f]["high"], f
    assert all(judged[i]["kept"] for i in range(600))
    # Junk in a few hundredths of the documents does not raise the threshold to itself.
    many = feats.unionByName(feats.where("doc_id = 1000").withColumn("doc_id", F.explode(F.sequence(F.lit(2000), F.lit(2027)))))
    assert quality.verdicts(many).where("doc_id >= 2000 and kept").count() == 0


def test_documents_of_repeated_lines_go_where_few_lines_repeat(spark):
    # One line in twelve repeats in a document of 30, as in web text; a third of all lines in junk.
    made = [(i, 12, int(i % 30 == 0)) for i in range(900)] + [(1000 + i, 12, 4) for i in range(9)] + [(2000, 10, 3), (2001, 40, 13)]
    cols = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in (*quality.BASE, "n_lines"))
    feats = spark.createDataFrame([(i, "en", "s", 100, 500, 0, dup, 0, lines) for i, lines, dup in made], cols)
    cut = quality.thresholds(feats).where("feature = 'dup_line_share'").first()
    assert 0 < cut["high"] < 0.01
    gone = {r["doc_id"] for r in quality.verdicts(feats).where("not kept").collect()}
    assert gone == {*range(1000, 1009), 2000, 2001}


def test_quality_shrinkage(spark):
    # A source of a few odd documents leans on its language, one of many on itself.
    def rows(source, n, length):
        return [(0, "en", source, 100, length + i % 40, 0, 0, 0, 9) for i in range(n)]

    made = rows("large", 5000, 480) + rows("few", 3, 900) + rows("many", 3000, 900)
    feats = spark.createDataFrame(made, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in (*quality.BASE, "n_lines")))
    high = {r["source"]: r["high"] for r in quality.thresholds(feats, reach=0.0).where("feature = 'word_length'").collect()}
    assert abs(high["many"] - 9.36) < 0.2 and abs(high["large"] - 5.16) < 0.3 and high["few"] > high["large"]


def test_mixing_skew(spark):
    rows = [(i, "hot" if i < 600 else f"s{i % 7}", "w " * (1 + i % 9)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs, entropy=0.9, repeats=3.0, block_tokens=500).toPandas()
    assert set(out.doc_id) == set(range(1000))  # every document once at least
    tokens = out.groupby("source").tokens.sum()
    whole = docs.select("source", F.size(F.split(F.trim("text"), " ")).alias("t")).groupBy("source").sum("t").toPandas().set_index("source")["sum(t)"]
    assert (tokens / whole).max() < 3.1
    share = tokens / tokens.sum()
    per_block = out.groupby("block").tokens.sum()
    assert per_block[:-1].between(400, 600).all() and share["hot"] < 0.5
    assert (out.groupby("block").position.max() == out.groupby("block").size()).all()
    again = mixing.mix(docs.repartition(7), entropy=0.9, repeats=3.0, block_tokens=500).toPandas()
    assert set(map(tuple, out.values)) == set(map(tuple, again.values))
    small = mixing.mix(docs, budget=300, block_tokens=100)
    assert small.agg(F.sum("tokens")).first()[0] < 300 + 8 * 9


def test_bisection():
    assert abs(mixing.bisect(lambda a: a <= 0.3, True) - 0.3) < 1e-12
    assert abs(mixing.bisect(lambda a: a >= 0.7, False) - 0.7) < 1e-12
    assert mixing.bisect(lambda a: True, True) == 1.0 and mixing.bisect(lambda a: True, False) == 0.0


def test_chat_windows(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"t{i} " * 20) for i in range(1, 30)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.windows(df, budget=100, history=30).orderBy("window").collect()
    assert all(r["tokens"] <= 100 for r in rows) and len(rows) > 5
    assert all(r["text"].startswith("<turn>system") for r in rows)
    assert [r["n_context"] for r in rows[:2]] == [0, 2]
    assert sum(r["n_targets"] for r in rows) == 30
    back = chat.read_back(chat.windows(df, 100, 30)).first()
    assert back["loss_text"] == "".join(t for _, _, r, t in turns if r == "assistant")
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(r, t) for _, _, r, t in turns]


def test_near_lines(spark):
    a = "The first line of some length that repeats"
    rows = [(1, f"{a}\nunique one that is long enough"), (2, f"{a}\n{a[:5]}X{a[6:]}\n{a[:9] + a[10:]}\n{a}s"), (3, f"short\nshort\n{a[:4]}YX{a[6:]}")]
    out = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert (out[2]["text"], out[2]["n_exact"], out[2]["n_near"]) == ("", 1, 3)
    # Two edits from the first line, one from a line of document 2. Short lines go if equal.
    assert (out[3]["text"], out[3]["n_near"], out[3]["n_exact"]) == ("short", 1, 1) and out[1]["n_near"] == 0


def test_short_near_lines_and_lines_of_white_space(spark):
    crlf = "one line\r\n\r\nanother line\r\n\t\r\n\r\nthe last line\r\n\t\r"
    rows = [(1, "Read more about us\nnine char"), (2, "Read more about uS\nnine_char"), (3, crlf), (4, "12 4567890\n12 456789"), (5, "12 456789a\n \u00a0\n \u00a0")]
    out = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert (out[2]["text"], out[2]["n_near"]) == ("nine_char", 1)  # nine characters are under near_chars
    assert (out[3]["text"], out[3]["n_exact"]) == (crlf, 0)
    assert out[4]["n_near"] == 0 and (out[5]["n_near"], out[5]["n_exact"]) == (1, 1)  # a no-break space is none of the six


@pytest.mark.parametrize("edits", [0, 1])
def test_short_lines_by_brute_force(spark, edits):
    import random

    def near(a, b):
        if a == b:
            return True
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return edits == 1 and (a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :])

    rng = random.Random(3)
    lines = []
    for n in [*range(1, 21)] * 12:
        line = "".join(rng.choice("abcdefgh") for _ in range(n))
        lines.append(line)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(n)
            lines.append(rng.choice([line, line[:k] + line[k + 1 :], line[:k] + "x" + line[k:], line[:k] + "y" + line[k + 1 :]]))
    rng.shuffle(lines)
    rows = [(i // 5, lines[i : i + 5]) for i in range(0, len(lines), 5)]
    docs = spark.createDataFrame([(i, "\n".join(part)) for i, part in rows], "doc_id long, text string")
    before, want = [], {}
    for i, part in rows:
        kept = []
        for line in part:
            if line == "" or not any(near(line, b) for b in before):
                kept.append(line)
            if line:
                before.append(line)
        want[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs, max_edits=edits, near_chars=1).collect()}
    assert got == want


def test_jaccard_groups_by_brute_force(spark):
    import random

    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    base = [word() for _ in range(60)]
    for _ in range(80):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    rows = list(enumerate(texts)) + [(200, None), (201, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    assert got == {i: (len(sets[i]), root(i)) for i in sets}


def test_license_templates(spark):
    words = license_scan.needed_words(license_scan.TEMPLATES)
    assert words
    notice = license_scan.TEMPLATES["Apache-2.0"][1]
    cut = notice.replace("except", "save")  # under a fifth of the shingles differ
    rows = [(1, f"{TEXT} {notice} {TEXT}"), (2, f"{TEXT} {cut}"), (3, TEXT), (4, "license license under the apache"), (5, None)]
    out = {(r["doc_id"], r["license_id"]): r["containment"] for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1, "Apache-2.0"] == 1.0 and out[2, "Apache-2.0"] == 1.0
    assert {k[0] for k in out} == {1, 2}
    long = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("template = 1 and license_id = 'Apache-2.0'").groupBy("doc_id").agg(F.max(F.col("contained") / F.col("of"))).collect()
    assert {r[0]: r[1] for r in long}[1] == 1.0 and 0.8 <= {r[0]: r[1] for r in long}[2] < 1.0


def test_short_licenses_are_retrieved(spark):
    for notice in ("Released under the MIT License.", "Licensed under the MIT License."):
        # Starts at 4 to 7 modulo 8 lie in one window only, which is full of other words.
        made = F.expr(f"concat_ws(' ', transform(sequence(1, 4 + id % 4), i -> concat('a', id, 'x', i)), '{notice}', transform(sequence(1, 20), i -> concat('b', id, 'x', i)))")
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), made.alias("text"))
        assert license_scan.licenses(docs).where("license_id = 'MIT' and containment = 1").count() == 3000


def test_every_template_is_retrieved(spark):
    # Whole, and with as many words gone from its end as leave 0.8 of its shingles.
    cases = []
    for name, ts in license_scan.TEMPLATES.items():
        for k, t in enumerate(ts):
            n = len(license_scan.words_of(t)) - license_scan.WORDS + 1
            cut = " ".join(license_scan.words_of(t)[: license_scan.WORDS - 1 - (-8 * n // 10)])
            cases += [(name, k, t, True), (name, k, cut, False)]
    cases = spark.createDataFrame(cases, "license_id string, template int, notice string, whole boolean").repartition(8)
    other = "transform(sequence(1, {} + i % 40), k -> concat('{}', i, 'x', k))"
    docs = cases.crossJoin(spark.range(1000).withColumnRenamed("id", "i")).withColumn("text", F.expr(f"concat_ws(' ', {other.format(1, 'a')}, notice, {other.format(9, 'b')})"))
    docs = docs.withColumn("doc_id", F.struct("license_id", "template", "whole", "i"))
    met = license_scan.scan(docs.select("doc_id", "text")).where("license_id = doc_id.license_id and template = doc_id.template").select("doc_id").distinct()
    found = {tuple(r)[:3]: r["count"] for r in met.groupBy("doc_id.license_id", "doc_id.template", "doc_id.whole").count().collect()}
    assert len(found) == 2 * sum(map(len, license_scan.TEMPLATES.values()))
    assert all(n == 1000 if whole else n >= 999 for (_, _, whole), n in found.items()), found


def test_license_bands(spark):
    for t in (t for ts in license_scan.TEMPLATES.values() for t in ts):
        n = len(license_scan.words_of(t))
        c, m = license_scan._class(n), n - 4
        bands = license_scan.bands_of(c, [m])
        assert license_scan.miss(m, c, bands) <= license_scan.MISS and license_scan.miss(m, c, bands, whole=True) <= license_scan.MISS_WHOLE
    assert license_scan.bands_of(8, [2]) == 76  # 1 - 2/12 a band
    with pytest.raises(ValueError):
        license_scan.bands_of(64, [2])


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, odd)
        assert new.columns == docs.columns
        docs = corpus_pipeline.common.stash(new, "test")
    ids = sorted(r["doc_id"] or -1 for r in docs.collect())
    # The row without an id comes first, so the same line of documents 1 and 2 goes with them;
    # 7 is near 6; 9 keeps its short line.
    assert set(ids) == {-1, 6, 9}
    assert corpus_pipeline.run(spark, odd).columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_digests_are_of_the_texts(spark, odd):
    rows = {r["doc_id"]: r for r in queries.op6_line_dedup(spark, odd).collect()}
    assert rows[6]["kept_sha256"] == hashlib.sha256(spark.read.parquet(f"{odd}/documents.parquet").where("doc_id = 6").first()["text"].encode()).hexdigest()
    assert suffix_dedup.LENGTH == 200 and media.UNIT == 192
