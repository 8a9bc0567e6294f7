"""Searches dealt by source, against searches by joins and plain ones."""

import os
import random
import uuid

import numpy as np
import pytest

from meshweave import analyzer, config, session
from meshweave.operators import bits, centrality, dealt, paths
from tests.test_metrics import graph, values
from tests.test_searches import plain


@pytest.fixture(scope="module")
def mixed(spark):
    """Ties, a path beside them, lone nodes."""
    draw = random.Random(8)
    names = [f"{i:02d}" for i in range(40)]
    edges = sorted({tuple(sorted(draw.sample(names[:20], 2))) for _ in range(40)} | {(f"{i:02d}", f"{i + 1:02d}") for i in range(22, 26)})
    return names, edges, {d: graph(spark, edges, directed=d, nodes=names) for d in (False, True)}


@pytest.fixture(scope="module")
def path(spark):
    names = [f"{i:02d}" for i in range(80)]
    return graph(spark, list(zip(names, names[1:])), directed=True)


def jobs(spark, run):
    """How many jobs run."""
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, "")
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("directed", [False, True])
def test_betweenness_is_that_of_joins(mixed, directed):
    g = mixed[2][directed]
    assert values(centrality.betweenness(g)) == values(centrality.betweenness(g, most_pairs=1 << 20))


def test_betweenness_takes_no_job_a_level(path, spark):
    got = {}
    assert jobs(spark, lambda: got.update(values(centrality.betweenness(path)))) < 80  # levels
    assert got == {f"{i:02d}": round(i * (79 - i) / (79 * 78), 9) for i in range(80)}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("directed", [False, True])
def test_betweenness_of_edges_is_that_of_joins(mixed, directed):
    got, want = ([(u, v, round(x, 9)) for u, v, x in rows(centrality.edge_betweenness(mixed[2][directed], most_pairs=m))] for m in (None, 1 << 20))
    assert got == want


def test_betweenness_of_edges_takes_no_job_a_level(path, spark):
    got = {}
    assert jobs(spark, lambda: got.update({r["src"]: round(r["value"], 9) for r in centrality.edge_betweenness(path).collect()})) < 80
    assert got == {f"{i:02d}": round((i + 1) * (79 - i) / (79 * 78), 9) for i in range(79)}


@pytest.mark.parametrize("directed", [False, True])
def test_pairs_are_those_of_joins_and_lie_on_no_disk(mixed, spark, directed):
    g, folder = mixed[2][directed], session.shared_dir(spark)
    joined = paths.breadth_first(g)
    want, before = rows(joined), set(os.listdir(folder))
    got = paths.pairs(g)
    assert rows(got) == want and got.dtypes == joined.dtypes
    stashes = [spark.read.parquet(f"{folder}/{x}") for x in set(os.listdir(folder)) - before]
    assert all("sigma" not in x.columns for x in stashes)
    some = g.nodes.where("id < '03'")
    assert rows(paths.pairs(g, some)) == [r for r in want if r[0] < "03"] and rows(paths.pairs(g, g.nodes.where("false"))) == []


def test_closeness_takes_no_job_a_level(path, spark):
    got = {}
    assert jobs(spark, lambda: got.update(values(centrality.closeness(path)))) < 80
    assert got == {f"{i:02d}": round(i / 79 * 2 / (i + 1), 9) if i else 0 for i in range(80)}


@pytest.mark.parametrize("directed", [False, True])
def test_sums_and_lengths_without_joins(mixed, directed):
    names, edges, g = mixed
    far = plain(edges, directed, names)
    assert {(r["src"], r["dst"]): r["dist"] for r in bits.lengths(g[directed]).collect()} == far
    for backwards in (False, True):
        found, longest = bits.sums(g[directed], backwards)
        sums = {r["id"]: (r["reached"], r["far"]) for r in found.collect()}
        for n in names:
            d = [x for (s, t), x in far.items() if (s if backwards else t) == n and s != t]
            assert sums.get(n, (0, 0)) == (len(d), sum(d))
        assert longest == max(far.values())


def test_lengths_take_no_job_a_level(path, spark):
    assert jobs(spark, lambda: bits.lengths(path).count()) < 80 and bits.lengths(path).count() == 80 * 81 // 2


def test_a_diameter_takes_no_job_a_level(spark):
    names = [f"{i:02d}" for i in range(80)]
    g = graph(spark, list(zip(names, names[1:])))
    assert jobs(spark, lambda: bits.diameter(g)) < 80 and bits.diameter(g) == (79, 80)


def plain_levels(edges, n, source):
    """Distances and numbers of shortest paths from a source."""
    dist, sigma, front = {source: 0}, {source: 1.0}, [source]
    while front:
        ahead = {}
        for u in front:
            for a, b in edges:
                if a == u and b not in dist:
                    ahead[b] = ahead.get(b, 0) + sigma[u]
        dist |= dict.fromkeys(ahead, dist[front[0]] + 1)
        sigma |= ahead
        front = list(ahead)
    return dist, sigma


def test_hubs_and_batches_in_a_task():
    """A row with more arcs than are taken one by one, in pieces; batches of few sources."""
    n, draw = 1500, random.Random(3)
    edges = sorted({(i, 0) for i in range(1, 900)} | {(0, i) for i in range(900, 1500)} | {tuple(draw.sample(range(n), 2)) for _ in range(300)})
    of, into = (np.array(x, np.int32) for x in zip(*edges))
    ways, sources = dealt.Ways(of, into, n), np.array([1, 5, 899, 1000, 1001])
    dist, sigma, levels = dealt.counted(ways, sources)
    seen = np.full((n, 5), -1)
    seen[sources, np.arange(5)] = 0
    for level, at, found in dealt.bit_levels(ways, sources):
        bit = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[at, :5]
        seen[at] = np.where(bit == 1, level, seen[at])
    assert (seen == dist).all()
    for j, s in enumerate(sources.tolist()):
        d, k = plain_levels(edges, n, s)
        assert dict(enumerate(dist[:, j].tolist())) == {i: d.get(i, -1) for i in range(n)}
        assert {i: x for i, x in enumerate(sigma[:, j].tolist()) if x} == k


def test_large_pair_tables_after_changes_lie_on_no_disk(mixed, spark, monkeypatch):
    g, folder = mixed[2][False], session.shared_dir(spark)
    after = g.remove_edge(*mixed[1][0])
    want = rows(paths.pairs(after))
    monkeypatch.setattr(analyzer, "MOST_KEPT", 100)
    before = set(os.listdir(folder))
    a = analyzer.Analyzer(g)
    a.pairs()
    assert rows(a.after(after).pairs()) == want
    assert all("sigma" not in spark.read.parquet(f"{folder}/{x}").columns for x in set(os.listdir(folder)) - before)


def test_metrics_keep_no_large_pair_table(mixed, spark, monkeypatch):
    g, folder = mixed[2][True], session.shared_dir(spark)
    settings = config.Config(page_rank=config.PageRank(max_iter=1), eigenvector=config.Eigenvector(max_iter=1), modularity=config.Modularity(g.nodes.selectExpr("id", "0 community")))
    monkeypatch.setattr(analyzer, "MOST_KEPT", 100)
    before = set(os.listdir(folder))
    found = analyzer.Analyzer(g, settings).metrics()
    new = [x for x in set(os.listdir(folder)) - before if x.startswith("stash-")]
    assert all("sigma" not in spark.read.parquet(f"{folder}/{x}").columns for x in new)
    assert rows(found.where("metric = 'shortest_paths'").select("id", "other", "value")) == rows(paths.pairs(g).select("src", "dst", "dist"))
