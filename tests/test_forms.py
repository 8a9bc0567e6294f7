"""Graphs in parts: digests, tiles, repaired pairs, the document of metrics."""

import json
import math
import os
import random

from pyspark.sql import functions as F

from meshweave.analyzer import Analyzer
from meshweave.graph import Graph
from meshweave.operators import paths
from meshweave.sources import files
from tests.test_metrics import graph


def test_a_fingerprint_tells_any_change(spark):
    g = graph(spark, [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0)], directed=True, nodes="abcd")
    same = Graph(g.nodes.repartition(5), g.arcs.repartition(3, "dst"), True, True)
    assert same.fingerprint() == g.fingerprint() == g.add_tag("a", "k", "v").fingerprint()
    others = [g.add_node("e"), g.remove_node("d"), g.add_edge("a", "c", 1.0), g.remove_edge("a", "b"), g.remove_edge("a", "b").add_edge("a", "b", 1.5), Graph(g.nodes, g.arcs, False, True), g.free()]
    assert len({x.fingerprint() for x in [g, *others]}) == len(others) + 1
    tricky = [graph(spark, [], nodes=n) for n in (["a", "b"], ["a1:b"])]
    assert tricky[0].fingerprint() != tricky[1].fingerprint()


def test_changes_are_found_in_the_parts_that_differ(spark):
    g = graph(spark, [("a", "b", 1.0), ("b", "c", 2.0)], directed=True)
    new = g.remove_edge("a", "b").add_edge("a", "b", 1.5).remove_edge("b", "c").add_node("d")
    got = {(r["kind"], r["src"], r["dst"]): (r["mine"], r["other"]) for r in g.changes(new).collect()}
    assert got == {("arc", "a", "b"): (1.0, 1.5), ("arc", "b", "c"): (2.0, None), ("node", "d", None): (None, 1.0)}
    assert g.changes(g).isEmpty()


def test_analyzers_of_equal_graphs_share_pairs(spark):
    a, b, c = (Analyzer(graph(spark, ["ab", "bc"]), share=s) for s in (True, True, False))
    assert a.pairs() is b.pairs() and c.pairs() is not a.pairs()
    b.clear_cache()
    assert Analyzer(a.graph, share=True).pairs() is not a.pairs()


def test_tiles(spark):
    draw = random.Random(2)
    names = [f"n{i}" for i in range(23)]
    edges = sorted({(*draw.sample(names, 2), float(draw.randint(1, 9))) for _ in range(60)})
    edges = list({e[:2]: e for e in edges}.values()) + [("n1", "n1", 4.0)]
    g = graph(spark, edges, directed=True, nodes=names)
    tiles, order = g.tiles(4)
    at = {r["id"]: r["at"] for r in order.collect()}
    assert [n for n, _ in sorted(at.items(), key=lambda x: x[1])] == sorted(names)
    found = []
    for t in tiles.collect():
        assert len(t["starts"]) == 5 and t["starts"][0] == 0 and t["starts"][4] == len(t["columns"]) == len(t["weights"]) > 0
        found += [(4 * t["i"] + r, 4 * t["j"] + t["columns"][k], t["weights"][k]) for r in range(4) for k in range(t["starts"][r], t["starts"][r + 1])]
    assert sorted(found) == sorted((at[a], at[b], w) for a, b, w in edges)
    back = Graph.from_tiles(tiles, order, True, True, 4)
    assert back.fingerprint() == g.fingerprint()
    assert Graph.from_matrix(g.matrix(), True, True).fingerprint() == g.fingerprint()


def test_pairs_are_repaired_after_twenty_changes(spark):
    draw = random.Random(11)
    names = [chr(97 + i) for i in range(14)]
    for weighted in (False, True):
        edges = {tuple(sorted(draw.sample(names, 2))): float(draw.randint(1, 3)) for _ in range(20)}
        make = lambda e, ids: graph(spark, [(*k, w) if weighted else k for k, w in sorted(e.items())], nodes=ids)  # noqa: B023, E731
        before, new = make(edges, names), dict(edges)
        for k in draw.sample(sorted(edges), 8):
            del new[k]
        while len(new) < len(edges) + 4:
            new.setdefault(tuple(sorted(draw.sample([*names, "z"], 2))), 2.0)
        after = make(new, [*names, "z"])
        p = paths.pairs(before)
        got, sources = paths.repaired(p, before, after)
        as_rows = lambda df: sorted((r["src"], r["dst"], r["dist"], r["hops"], r["sigma"]) for r in df.collect())
        assert as_rows(got) == as_rows(paths.pairs(after))
        assert 0 < sources.count() <= 15


def test_only_sources_that_a_change_concerns_are_searched(spark):
    g = graph(spark, ["ab", "bc", "de", "ef"], directed=True)
    after = g.remove_edge("b", "c")
    _, sources = paths.repaired(paths.pairs(g), g, after)
    assert sorted(r["id"] for r in sources.collect()) == ["a", "b"]
    a = Analyzer(g)
    a.pairs()
    assert a.after(after).pairs().count() == g.size() + 4


def test_the_document_of_metrics_in_files(spark, tmp_path):
    ids = ["a", 'b"', "c\\", "", "é"]
    rows = [("m1", None, None, 2.5), ("m2", None, None, float("nan")), ("m2", ids[0], None, 1e-7), ("m0", ids[3], None, 3.0), ("m0", ids[4], None, None)]
    rows += [("m9", a, b, float(i)) for i, (a, b) in enumerate((a, b) for a in ids[:3] for b in ids)]
    df = spark.createDataFrame(rows, "metric string, id string, other string, value double").repartition(4)
    files.write_metrics_document(df, f"{tmp_path}/doc")
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))
    assert whole == json.loads(files.metrics_document(df).first()["json"])
    assert whole["m1"] == 2.5 and whole["m2"] == {"global": None, "average": None, "local": {"a": 1e-7}} and whole["m0"] == {"": 3.0, "é": None}
    assert whole["m9"] == {a: {b: float(5 * i + j) for j, b in enumerate(ids)} for i, a in enumerate(ids[:3])} and math.isclose(len(whole), 4)


def test_metrics_are_written_apart(spark, tmp_path):
    """Rows of one metric are made without those of others, and are not sorted by metric."""
    made = spark.sparkContext.accumulator(0)

    def counted_rows(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    kind = "metric string, id string, other string, value double"
    part = lambda name: spark.createDataFrame([(None, "a", "b", 1.0), (None, "c", None, 2.5)], kind).mapInArrow(counted_rows, kind).withColumn("metric", F.lit(name))
    names = ["shortest_paths", "page_rank", "other one"]
    df = part(names[0]).unionByName(part(names[1])).unionByName(part(names[2]))
    files.write_metrics(df, f"{tmp_path}/m")
    assert made.value == 6
    got = sorted(tuple(x or "" for x in r) for r in files.read_metrics(spark, f"{tmp_path}/m").select("metric", "id", "other", "value").collect())
    assert got == sorted((n, *x) for n in names for x in (("a", "b", 1.0), ("c", "", 2.5)))
