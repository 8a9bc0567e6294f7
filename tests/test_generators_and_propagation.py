"""Random graphs by their statistics, propagation against an event queue, streams."""

import heapq

import pytest
from pyspark.sql import functions as F

from meshweave.functions import rng
from meshweave.graph import Graph, GraphError
from meshweave.operators import generators as gen
from meshweave.streaming import live, propagation


def degrees(g):
    return sorted(r["degree"] for r in g.degrees().collect())


def test_regular(spark):
    assert set(degrees(gen.random_regular(spark, 60, 4, seed=1).checked())) == {4}


def test_barabasi_albert(spark):
    d = degrees(gen.barabasi_albert(spark, 200, 3, seed=2).checked())
    assert d[0] >= 2 and sum(d) == 2 * (3 + 197 * 3) and d[-1] > 15
    assert sum(degrees(gen.barabasi_albert(spark, 20, 1, seed=2).checked())) == 38


def test_watts_strogatz(spark):
    d = degrees(gen.watts_strogatz(spark, 200, 6, 0.2, seed=3).checked())
    assert sum(d) == 200 * 6 and d[0] >= 3
    assert set(degrees(gen.watts_strogatz(spark, 30, 5, 0.0, seed=3))) == {4}


def test_shapes(spark):
    assert degrees(gen.grid(spark, 10, 10).checked()).count(4) == 64
    assert set(degrees(gen.grid(spark, 3, 4, torus=True).checked())) == {4}
    hexes = gen.triangle_hex(spark, 3).checked()
    assert hexes.size() == 19 and max(degrees(hexes)) == 6 and hexes.tag("9", "center") == "true"
    assert gen.triangle_hex(spark, 0).size() == 0


def test_seeds(spark):
    a, b, c = (gen.erdos_renyi(spark, 80, 0.1, seed=s).hash() for s in (1, 1, 2))
    assert a == b != c
    mean = sum(degrees(gen.erdos_renyi(spark, 300, 0.2, seed=4))) / 300
    assert abs(mean - 299 * 0.2) < 4


def test_dispatch(spark):
    assert gen.standard(spark, "erdos_renyi", {"n": 10, "p": 0.5}, seed=1).size() == 10
    assert gen.standard(spark, "random_geometric", {"n": 10, "k": 3.0}, seed=1).size() == 10
    assert gen.standard(spark, "none", {}).weighted
    for model, params in (("x", {}), ("grid", {"rows": 2}), ("random_geometric", {"n": 3, "r": 0.1, "k": 1.0}), ("waxman", {"n": 3, "alpha": 0.0, "beta": 0.5}), ("random_regular", {"n": 5, "k": 3})):
        with pytest.raises(GraphError):
            gen.standard(spark, model, params)


def events(peers, links, start, choose):
    """An event queue: first times, and number of sends."""
    seen, got, sends, queue = {}, {}, 0, [(0.0, 0, start, start)]
    while queue:
        t, kind, peer, sender = heapq.heappop(queue)
        if kind == 0:
            got.setdefault(peer, set()).add(sender)
            if peer not in seen:
                seen[peer] = t
                heapq.heappush(queue, (t + peers[peer], 1, peer, peer))
        else:
            for dst in choose(peer, sorted(set(links.get(peer, {})) - got[peer])):
                sends += 1
                heapq.heappush(queue, (t + links[peer][dst], 0, dst, peer))
    return seen, sends


@pytest.mark.parametrize("factor", [None, 0.5])
def test_propagation(spark, factor):
    g = gen.erdos_renyi(spark, 30, 0.15, seed=5).stashed()
    net = propagation.network(g, 1 + 50 * rng.uniform(1, "id"), 1 + 50 * rng.uniform(2, "src", "dst"))
    published = spark.createDataFrame([("m", "0")], "content string, peer string")
    log = propagation.simulate(net, published, propagation.flooding if factor is None else propagation.gossip(factor, seed=3))
    peers = {r["id"]: r["proc_ms"] for r in net.peers.collect()}
    links = {}
    for r in net.links.collect():
        links.setdefault(r["src"], {})[r["dst"]] = r["lat_ms"]
    order = {(r["src"], r["dst"]): r["u"] for r in net.links.select("src", "dst", rng.uniform(3, F.lit("m"), "src", "dst").alias("u")).collect()}
    choose = (lambda p, x: x) if factor is None else (lambda p, x: sorted(x, key=lambda d: (order[p, d], d))[: int(len(x) * factor)])
    seen, sends = events(peers, links, "0", choose)
    got = {r["id"]: r["timestamp"] for r in propagation.first_times(log).collect()}
    assert got.keys() == seen.keys() and all(abs(got[k] - seen[k]) < 1e-6 for k in seen)
    assert log.where("type = 'send'").count() == sends
    assert abs(propagation.reachability(net, log, "m") - len(seen) / 30) < 1e-12
    info = propagation.message_info(net, log, "0", "m").first()
    assert info["seen"] == 0.0 and info["first_from"] == "0" and "0" in info["received"]
    assert propagation.peer_log(log, "0", "none").count() == 0
    with pytest.raises(GraphError):
        propagation.message_info(net, log, "zz", "m")


def test_overlay_rules(spark):
    weighted = Graph.empty(spark, True, True)
    with pytest.raises(GraphError):
        propagation.network(weighted, F.lit(1.0), F.lit(1.0))
    with pytest.raises(GraphError):
        propagation.gossip(1.5)
    net = propagation.network(gen.grid(spark, 2, 2), F.lit(1.0), F.lit(1.0))
    with pytest.raises(GraphError):
        propagation.simulate(net, spark.createDataFrame([("m", "9")], "content string, peer string"))


def test_streams(spark, tmp_path):
    rows = [("m", "a", "a", "2024-01-01 00:00:00"), ("m", "b", "a", "2024-01-01 00:00:01"), ("m", "b", "c", "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "content string, id string, `from` string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("content string, id string, `from` string, ts timestamp").parquet(f"{tmp_path}/in")
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    for name, df, mode, n in (("first", live.first_receptions(stream), "append", 2), ("sent", live.forwards(stream, links), "append", 2), ("windows", live.reached(stream), "complete", 1)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n
