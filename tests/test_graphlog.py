"""Graph logs: layouts, text in pieces, and files that no task holds whole."""

import json

import pytest

from meshweave.graph import GraphError
from meshweave.sources import files, graphlog
from tests.test_metrics import graph

NODES, ARCS = [("node", "A", None, None), ("node", "B", None, None)], [("arc", "A", "B", 1.0), ("arc", "B", "A", 1.0)]
BOTH = [("flag", "undirected", None, 1.0)]
DOCUMENTS = {
    '{"nodes":{"a":{"b":1,"c":2.5e0},"b":{},"x\\"}\\u00e9":{"a":1e-3}},"directed":true,"weighted":true}': [("node", "a", None, None), ("arc", "a", "b", 1.0), ("arc", "a", "c", 2.5), ("node", "b", None, None), ("node", 'x"}é', None, None), ("arc", 'x"}é', "a", 0.001), ("flag", "directed", None, 1.0), ("flag", "weighted", None, 1.0)],
    '{"A":true,"B":true,"C":false}\n{"A":{"B":true},"B":{"A":true,"C":false}}\ntrue': NODES + ARCS + BOTH,
    ' [ {"A":true, "B":true},\n {"A":{"B":true},"B":{"A":true}}, true]': NODES + ARCS + BOTH,
    '{"V":{"A":true,"B":true},"E":{"A":{"B":true},"B":{"A":true}},"undirected":"yes"}': NODES + ARCS + BOTH,
    '{"directed":false,"nodes":{"é":{}}}': [("flag", "directed", None, 0.0), ("node", "é", None, None)],
    '{"directed":true,"weighted":true}\n{"directed":{"weighted":true}}\nfalse': [("node", "directed", None, None), ("node", "weighted", None, None), ("arc", "directed", "weighted", 1.0), ("flag", "undirected", None, 0.0)],
    "{}\n{}\ntrue": BOTH,
    "{}": [],
    "": [],
}


@pytest.mark.parametrize("text", DOCUMENTS)
@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_layouts_in_pieces_of_any_size(text, size):
    got = graphlog.rows(graphlog.leaves(graphlog.tokens(text[i : i + size] for i in range(0, len(text), size))))
    assert list(got) == DOCUMENTS[text]


@pytest.mark.parametrize("text", ['{"nodes":{}', '{"nodes":{"a":[}}', '{"a" b}', '{1:2}', '{"a":nope}', '{"a":"never ends'])
def test_broken_documents(text):
    with pytest.raises(graphlog.Broken):
        list(graphlog.rows(graphlog.leaves(graphlog.tokens([text]))))


def test_a_million_arcs_a_piece_at_a_time():
    """A document of one line: rows come as it is read, and none of it is held back."""
    taken = 0

    def made():
        nonlocal taken
        yield '{"nodes":{'
        for i in range(1000):
            taken = i
            yield ("," if i else "") + json.dumps(str(i)) + ":{" + ",".join(f'"{j}":1' for j in range(1000)) + "}"
        yield '},"directed":true,"weighted":false}'

    arcs = 0
    for kind, src, *_ in graphlog.rows(graphlog.leaves(graphlog.tokens(made()))):
        arcs += kind == "arc"
        assert kind == "flag" or taken - int(src) <= 1
    assert arcs == 1_000_000


def test_round_trip_through_files(spark, tmp_path):
    g = graph(spark, [("a", "b", 1.5), ("b", 'c"}', 2e-5), ("é", "a", 1e21)], directed=True, nodes=["lone"])
    files.write_json(g, f"{tmp_path}/log")
    text = "".join(p.read_text() for p in sorted((tmp_path / "log").glob("part-*")))
    assert json.loads(text) == {"nodes": {"a": {"b": 1.5}, "b": {'c"}': 2e-5}, 'c"}': {}, "lone": {}, "é": {"a": 1e21}}, "directed": True, "weighted": True}
    back = files.read_json(spark, f"{tmp_path}/log")
    assert back.fingerprint() == g.fingerprint()
    (tmp_path / "old.json").write_text('{"A":true,"B":true}\n{"A":{"B":true},"B":{"A":true}}\ntrue')
    old = files.read_json(spark, f"{tmp_path}/old.json")
    assert not old.directed and not old.weighted and old.edge_count() == 2
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(GraphError):
        files.read_json(spark, f"{tmp_path}/none.json")
