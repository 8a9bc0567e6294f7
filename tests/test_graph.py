"""The data model: golden graphs, rules and forms."""

import pytest

from meshweave.graph import Graph, GraphError, deserialize, node_rows
from meshweave.sources import files


def chain(spark, directed, weighted):
    g = Graph.empty(spark, directed, weighted).add_nodes(node_rows(spark, "ABCDE"))
    rows = [(a, b, float(w)) for a, b, w in zip("ABCD", "BCDE", (1, 2, 3, 4))]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    return g.add_edges(edges if weighted else edges.drop("weight")).remove_edge("A", "B").stashed()


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("weighted", [True, False])
def test_forms(spark, directed, weighted):
    g = chain(spark, directed, weighted)
    w = [2, 3, 4] if weighted else [1, 1, 1]
    out = {"B": {"C": w[0]}, "C": {"D": w[1]}, "D": {"E": w[2]}}
    if not directed:
        for a, b, x in zip("BCD", "CDE", w):
            out.setdefault(b, {})[a] = x
    lines = "".join(f"    {n}: map[{' '.join(f'{k}:{v}' for k, v in sorted(out.get(n, {}).items()))}]\n" for n in "ABCDE")
    text = f"Graph:\n  Directed: {str(directed).lower()}\n  Weighted: {str(weighted).lower()}\n  Nodes:\n{lines}"
    assert g.text().first()[0] == text
    cells = {r["id"]: r["cells"] for r in g.matrix().collect()}
    assert cells == {a: [float(out.get(a, {}).get(b, 0)) for b in "ABCDE"] for a in "ABCDE"}
    back = deserialize(g.serialize())
    assert back.text().first()[0] == text and back.hash() == g.hash()
    assert (back.directed, back.weighted) == (directed, weighted)


def test_rules(spark):
    g = Graph.empty(spark, False, True).add_node("a").add_node("b")
    for bad in (lambda: g.add_node("a"), lambda: g.add_edge("a", "b"), lambda: g.add_edge("a", "b", 0.0), lambda: g.add_edge("a", "c", 1.0), lambda: g.add_edge("a", "a", 1.0), lambda: g.remove_edge("a", "b"), lambda: g.remove_node("z"), lambda: g.edge_weight("a", "b"), lambda: g.node("z")):
        with pytest.raises(GraphError):
            bad()
    h = g.add_edge("a", "b", 2.5)
    assert h.edge_weight("b", "a") == 2.5 and h.has_edge("a", "b") and h.edge_count() == 2 and not g.has_edge("a", "b")
    with pytest.raises(GraphError):
        h.add_edge("b", "a", 1.0)
    assert h.remove_node("a").edge_count() == 0 and h.size() == 2 and h.free().size() == 0
    loop = Graph.empty(spark, True, False).add_node("x").add_edge("x", "x")
    assert loop.degrees().first()["degree"] == 1


def test_tags(spark):
    g = Graph.empty(spark, True, False).add_node("a").add_tag("a", "k", "v")
    assert g.has_tag("a", "k") and g.tag("a", "k") == "v" and g.tag("a", "z") is None
    with pytest.raises(GraphError):
        g.add_tag("a", "k", "w")
    assert g.update_tag("a", "k", "w").tag("a", "k") == "w"
    assert not g.remove_tag("a", "k").has_tag("a", "k")
    with pytest.raises(GraphError):
        g.remove_tag("a", "z")


def test_paths(spark):
    g = Graph.empty(spark, True, True).add_nodes(node_rows(spark, "ABCDEF"))
    g = g.add_edges(spark.createDataFrame([("A", "B", 1.0), ("B", "C", 2.0), ("C", "D", 3.14), ("D", "E", 4.0)], "src string, dst string, weight double"))
    nodes, weights, total = g.path(*"ABCDE")
    assert nodes == list("ABCDE") and weights == [0, 1, 2, 3.14, 4] and abs(total - 10.14) < 1e-12
    with pytest.raises(GraphError, match="A F"):
        g.path("A", "F")
    assert g.path() == ([], [], 0.0) and g.path("Z")[2] == 0.0


def test_number_text(spark):
    cases = {2.0: "2", 3.14: "3.14", 1e-5: "1e-05", 0.0001: "0.0001", 1e20: "100000000000000000000", 1e21: "1e+21", 12345678.5: "12345678.5", 0.1: "0.1", 123456789.0: "123456789"}
    g = Graph.of(node_rows(spark, ["a", *map(str, range(len(cases)))]), spark.createDataFrame([("a", str(i), v) for i, v in enumerate(cases)], "src string, dst string, weight double"), True, True)
    line = g.lines().where("id = 'a'").first()["line"]
    assert line == "    a: map[" + " ".join(f"{i}:{t}" for i, t in enumerate(cases.values())) + "]\n"


def test_files(spark, tmp_path):
    g = chain(spark, False, False)
    files.write_json(g, f"{tmp_path}/g.json")
    assert files.read_json(spark, f"{tmp_path}/g.json").hash() == g.hash()
    files.write_parquet(g, f"{tmp_path}/g")
    assert files.read_parquet(spark, f"{tmp_path}/g", False, False).hash() == g.hash()
    for text in ('{"A":true,"B":true}\n{"A":{"B":true},"B":{"A":true}}\ntrue', '[{"A":true,"B":true},{"A":{"B":true},"B":{"A":true}},true]', '{"V":{"A":true,"B":true},"E":{"A":{"B":true},"B":{"A":true}},"undirected":true}'):
        old = files.parse(spark.createDataFrame([(text,)], "json string"))
        assert not old.directed and old.has_edge("B", "A") and old.size() == 2
    with pytest.raises(GraphError):
        files.parse(spark.createDataFrame([("{}",)], "json string"))
    e = files.read_edges(spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x")], "src string, dst string"), False)
    assert e.checked().edge_count() == 2
