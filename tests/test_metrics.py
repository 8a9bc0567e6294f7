"""Metrics on small graphs with known values, and invariants."""

import pytest

from meshweave import config
from meshweave.analyzer import Analyzer
from meshweave.graph import Graph, GraphError, node_rows
from meshweave.operators import centrality, community, paths, report, structure
from meshweave.operators.bimap import Bimap
from meshweave.plans import catalog
from meshweave.sources import tables


def graph(spark, edges, directed=False, nodes=""):
    ids = sorted({x for e in edges for x in e[:2]} | set(nodes))
    weighted = bool(edges) and len(edges[0]) == 3
    kind = "src string, dst string" + ", weight double" * weighted
    return Graph.of(node_rows(spark, ids), spark.createDataFrame([tuple(e) for e in edges], kind), directed, weighted).stashed()


def values(df):
    return {r["id"]: round(r["value"], 9) for r in df.collect()}


def test_star(spark):
    a = Analyzer(graph(spark, ["ca", "cb", "cd"]), config.Config(edge_betweenness=config.EdgeBetweenness(False)))
    assert values(a.degree_centrality())["c"] == 1.0
    assert values(a.betweenness_centrality()) == {"a": 0, "b": 0, "c": 1.0, "d": 0}
    assert {r["value"] for r in a.edge_betweenness_centrality().collect()} == {3.0}
    assert a.clustering_coefficient()[0].first()[0] == 0
    assert tuple(a.diameter().first()) == (2, 2.0)


def test_triangle(spark):
    a = Analyzer(graph(spark, ["12", "23", "13"]))
    assert set(values(a.closeness_centrality()).values()) == {1.0} and set(values(a.clustering_coefficient()[1]).values()) == {1.0}
    assert set(values(a.page_rank()).values()) == {round(1 / 3, 9)} and set(values(a.betweenness_centrality()).values()) == {0.0}
    assert a.degree_assortativity().first()[0] == 0.0


def test_tied_paths(spark):
    edges = [("A", "B", 1.0), ("B", "C", 1.0), ("A", "C", 2.0), ("C", "D", 1.0)]
    a = Analyzer(graph(spark, edges, directed=True))
    got = sorted((r["nodes"], r["total"]) for r in a.shortest_paths("A", "D").collect())
    assert got == [(["A", "B", "C", "D"], 3.0), (["A", "C", "D"], 3.0)]
    b = Analyzer(a.graph.remove_edge("A", "C"))
    assert b.shortest_paths("A", "D").count() == 1
    with pytest.raises(GraphError):
        Analyzer(b.graph.remove_edge("B", "C")).shortest_paths("A", "D")
    with pytest.raises(GraphError):
        b.shortest_paths("Z", "D")
    assert [r["nodes"] for r in a.shortest_paths("A", "A").collect()] == [["A"]]
    with pytest.raises(GraphError):
        paths.pairs(graph(spark, [("a", "b", 1e-10)], directed=True))


def test_assortativity(spark):
    g = graph(spark, ["01", "02", "03", "12"], directed=True)
    assert abs(structure.assortativity(g).first()[0] + 2 / 3) < 1e-12


def test_communities(spark):
    g = graph(spark, ["12", "23", "13", "45", "56", "46", "34"])
    c = {r["id"]: r["community"] for r in community.greedy(g).collect()}
    assert c == {"1": 0, "2": 0, "3": 0, "4": 1, "5": 1, "6": 1}
    part = community.greedy(g)
    assert abs(structure.modularity(g, part).first()[0] - 2 * (3 / 7 - 0.25)) < 1e-9
    assert abs(structure.modularity(g, part.where("community = 1")).first()[0] - 2 * (3 / 7 - 0.25)) < 1e-9  # others are in 0
    assert abs(Analyzer(g).modularity().first()[0] - 0.357142857) < 1e-8


def test_community_rounds(spark, sf):
    g = graph(spark, ["12", "23", "13", "45", "56", "46", "34"], nodes="1234567")
    assert {r["id"]: r["community"] for r in community.rounds(g).collect()} == {"1": 0, "2": 0, "3": 0, "4": 1, "5": 1, "6": 1, "7": 2}
    assert community.rounds(graph(spark, [], nodes="abc")).count() == 3
    hub = community.rounds(graph(spark, ["ab", "ac", "ad"])).collect()
    assert len({r["community"] for r in hub}) == 1

    for d in (sf, "/root/testdata/sf0.01"):
        g = tables.suppliers(spark, d)
        of = {r["id"]: r["community"] for r in catalog.queries()["greedy_communities"](spark, d).collect()}
        assert set(of) == {r["id"] for r in g.nodes.collect()}  # every supplier, by all arcs
        edges = {tuple(sorted((r["src"], r["dst"]))) for r in g.arcs.collect() if r["src"] != r["dst"]}
        m, degree, inside, across = len(edges), {}, 0, {}
        for u, v in edges:
            x, y = sorted((of[u], of[v]))
            for c in (x, y):
                degree[c] = degree.get(c, 0) + 1
            inside += x == y
            across[x, y] = across.get((x, y), 0) + (x != y)
        q = inside / m - sum((k / (2 * m)) ** 2 for k in degree.values())
        assert all(2 * m * n <= degree[x] * degree[y] for (x, y), n in across.items() if x != y)  # no merge gains
        assert q > 0
        if d == sf:
            assert q > 0.9 * structure.modularity(g, community.greedy(g)).first()[0]


def test_edge_cases(spark):
    g = graph(spark, [], directed=True, nodes="abc")
    assert values(centrality.eigenvector(g)) == {n: round(1 / 3, 9) for n in "abc"}
    assert set(values(centrality.page_rank(g)).values()) == {round(1 / 3, 9)}
    assert tuple(paths.diameter(paths.pairs(g)).first()) == (0, 0.0)
    assert structure.assortativity(g).first()[0] == 0 and set(values(structure.clustering(g)).values()) == {0.0}
    assert structure.modularity(g, community.greedy(g)).first()[0] == 0
    empty = Graph.empty(spark, True, False)
    assert centrality.page_rank(empty).count() == 0 and centrality.degree(empty).count() == 0
    one = graph(spark, [], nodes="x")
    assert values(centrality.degree(one)) == {"x": 0.0} and values(centrality.closeness(one)) == {"x": 0.0}


def test_dangling(spark):
    r = values(centrality.page_rank(graph(spark, ["12", "13"], directed=True)))
    assert abs(sum(r.values()) - 1) < 1e-8 and r["2"] == r["3"] > r["1"]


def test_stops_by_tolerance(spark):
    g = graph(spark, ["12", "23", "31", "14"], directed=True)
    loose, tight = values(centrality.page_rank(g, config.PageRank(tol=0.05))), values(centrality.page_rank(g))
    assert loose != tight and abs(sum(loose.values()) - 1) < 1e-8


def test_components_and_report(spark):
    g = graph(spark, ["ab", "bc", "xy"])
    assert {r["id"]: r["component"] for r in paths.components(g).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r["id"] for r in paths.largest_component(g).collect()} == {"a", "b", "c"}
    df = lambda rows: spark.createDataFrame(rows, "id string, value double")
    e = report.errors(df([("a", 1.0), ("b", 2.0), ("c", 3.0)]), df([("a", 1.5), ("b", 2.0), ("z", 9.0)])).first()
    assert (e["n_ref"], e["n_cmp"], e["n_common"], e["missing_in_compare"], e["missing_in_reference"], e["max_abs_error_key"], e["l1_error"]) == (3, 3, 2, 1, 1, "a", 0.5)


def test_bimap(spark):
    rows = lambda x: spark.createDataFrame(x, "key string, value string")
    b = Bimap.empty(spark).insert(rows([("Apple", "5"), ("Banana", "4"), ("Orange", "3")])).insert(rows([("Cake", "4")])).remove_key("Orange")
    assert b.by_key("Banana") is None and b.by_value("4") == "Cake" and b.by_value("3") is None and b.by_key("Apple") == "5"


def test_metrics_as_one_document(spark):
    import json

    from meshweave.analyzer import METRICS, Analyzer
    from meshweave.graph import Graph, GraphError, node_rows
    from meshweave.sources import files

    g = Graph.of(node_rows(spark, ["a", 'b"', "c"]), spark.createDataFrame([("a", 'b"'), ('b"', "c")], "src string, dst string"), False, False)
    rows = Analyzer(g).metrics()
    got = json.loads(files.metrics_document(rows).first()["json"])
    assert set(got) == set(METRICS)
    assert got["diameter"] == 2 and got["shortest_paths"]["a"] == {"a": 0, 'b"': 1, "c": 2}
    assert got["betweenness_centrality"] == {"a": 0, 'b"': 1, "c": 0}
    assert got["clustering_coefficient"] == {"global": 0, "average": 0, "local": {"a": 0, 'b"': 0, "c": 0}}
    assert set(got["edge_betweenness_centrality"]["a"]) == {'b"'}
    with pytest.raises(GraphError):
        files.metrics_document(rows, most=5)


def test_page_rank_without_settings_goes_on_to_its_limit(spark):
    from meshweave.operators import centrality

    g = Graph.of(node_rows(spark, "abc"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string"), True, False)
    assert all(abs(r["value"] - 1 / 3) < 1e-9 for r in centrality.page_rank(g).collect())
