"""Searches as bits, by levels and from both ends, against plain breadth-first search."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meshweave import config, session
from meshweave.graph import GraphError
from meshweave.operators import bits, centrality, community, paths
from tests.test_metrics import graph, values


def plain(edges, directed, nodes):
    """(src, dst) -> distance of all reachable pairs."""
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        if not directed:
            out[b].add(a)
    found = {}
    for s in nodes:
        seen, front = {s: 0}, [s]
        for u in front:
            for v in out[u]:
                if v not in seen:
                    seen[v] = seen[u] + 1
                    front.append(v)
        found |= {(s, v): d for v, d in seen.items()}
    return found


@pytest.fixture(scope="module")
def tangled(spark):
    """70 nodes, so that a long does not hold all of them: parts, a tail, lone nodes."""
    draw = random.Random(4)
    names = [f"{i:02d}" for i in range(70)]
    edges = sorted({tuple(sorted(draw.sample(names[:45], 2))) for _ in range(70)} | {(f"{i:02d}", f"{i + 1:02d}") for i in range(50, 54)})
    return names, edges, {d: graph(spark, edges, directed=d, nodes=names) for d in (False, True)}


@pytest.mark.parametrize("directed", [False, True])
def test_sums_and_lengths(tangled, directed):
    names, edges, g = tangled
    far = plain(edges, directed, names)
    got = {(r["src"], r["dst"]): r["dist"] for r in bits.lengths(g[directed], words=1).collect()}
    assert got == far
    for backwards in (False, True) if directed else (False,):
        rows, longest = bits.sums(g[directed], backwards, words=1)
        sums = {r["id"]: (r["reached"], r["far"]) for r in rows.collect()}
        for n in names:
            d = [x for (s, t), x in far.items() if (s if backwards else t) == n and s != t]
            assert sums.get(n, (0, 0)) == (len(d), sum(d))
        assert longest == max(far.values())


def test_diameter_by_bounds(tangled, spark):
    names, edges, g = tangled
    longest, searches = bits.diameter(g[False], probes=4, most_words=0)
    assert longest == max(plain(edges, False, names).values()) and searches <= 61
    star = graph(spark, [("hub", f"{i:03d}") for i in range(200)])
    assert bits.diameter(star, probes=4, most_words=0) == (2, 4)  # of 201 nodes
    assert bits.diameter(graph(spark, [], nodes="ab"), most_words=0) == (0, 0)


def test_one_pair_from_both_ends(spark):
    four = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]
    chain = [("A", "B"), ("B", "C"), ("C", "D")]
    for edges, want in ((four, [["A", "B", "D"], ["A", "C", "D"]]), (chain, [["A", "B", "C", "D"]])):
        for directed in (True, False):
            got = paths.shortest_paths(graph(spark, edges, directed=directed), "A", "D").collect()
            assert sorted(r["nodes"] for r in got) == want and {r["total"] for r in got} == {len(want[0]) - 1.0}
    g = graph(spark, chain, directed=True, nodes="Z")
    for a, b in (("D", "A"), ("A", "Z"), ("A", "nowhere"), ("nowhere", "A")):
        with pytest.raises(GraphError):
            paths.shortest_paths(g, a, b)
    assert [tuple(r) for r in paths.shortest_paths(g, "B", "B").collect()] == [(["B"], 0.0)]


def test_one_pair_has_all_ties(tangled):
    names, edges, g = tangled
    far = plain(edges, False, names)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    src, dst = max((p for p in far if p[0] < p[1] and p[1] < "45"), key=lambda p: (far[p], p))

    def ways(v):
        return [[src]] if v == src else [w + [v] for u in near[v] if far[src, u] == far[src, v] - 1 for w in ways(u)]

    got = paths.shortest_paths(g[False], src, dst).collect()
    assert sorted(r["nodes"] for r in got) == sorted(ways(dst)) and {r["total"] for r in got} == {float(far[src, dst])}


def test_weighted_pair_goes_no_further_than_its_end(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 2.0), ("c", "d", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("f", "g", 1.0)]
    g = graph(spark, edges)
    assert sorted(r["nodes"] for r in paths.shortest_paths(g, "a", "c").collect()) == [["a", "b", "c"], ["a", "c"]]
    assert paths.relaxed(g, g.nodes.where("id = 'a'"), "c").where("dst >= 'e'").isEmpty()


def test_batches_of_sources_give_the_same_betweenness(spark):
    edges = ["ab", "bc", "cd", "da", "ce"]
    g = graph(spark, edges, nodes="abcdex")
    whole, parts = (values(centrality.betweenness(g, most_pairs=m)) for m in (1 << 20, 18))
    assert whole == parts and max(whole.values()) > 0
    every = [{(r["src"], r["dst"]): round(r["value"], 9) for r in centrality.edge_betweenness(g, most_pairs=m).collect()} for m in (1 << 20, 18)]
    assert every[0] == every[1] and len(every[0]) == len(edges)


def test_scratch_bounds_what_lies_on_disk(spark):
    folder = session.shared_dir(spark)
    before = set(os.listdir(folder))
    with session.scratch() as keep:
        inside = session.stash(spark.range(5))
        kept = keep(inside.where("id > 2"))
    assert len(set(os.listdir(folder)) - before) == 1 and kept.count() == 2


def test_a_round_of_page_rank_is_one_exchange(spark):
    a, _ = session.bucketed(spark.range(1000).selectExpr("cast(id % 50 as string) src", "cast(id as string) dst"), "src")
    rank, seen = session.bucketed(spark.range(1000).selectExpr("cast(id as string) id", "1.0D r"), "id", F.sum("r").alias("total"))
    assert seen["total"] == 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given = a.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("r").alias("got"))
        plan = rank.join(given, "id", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1


def test_page_rank_settings_out_of_range(spark):
    g = graph(spark, ["ab", "bc", "cd", "de"])
    assert centrality.in_range(config.PageRank(alpha=1.0, max_iter=0, tol=0.0)) == (0.85, 1000, 1e-6)
    assert centrality.in_range(config.PageRank()) == (0.85, 100, 1e-6) and centrality.in_range(None) == (0.85, 1000, 1e-6)
    odd = config.PageRank(alpha=-1.0, tol=0.1, max_iter=0)
    assert values(centrality.page_rank(g, odd)) == values(centrality.page_rank(g, config.PageRank(tol=0.1)))


def one_at_a_time(edges, nodes):
    """id -> community, by the definition."""
    pairs = {tuple(sorted(e)) for e in edges}
    m, name = len(pairs), {n: n for n in nodes}
    while True:
        share, between = defaultdict(int), defaultdict(int)
        for u, v in pairs:
            a, b = sorted((name[u], name[v]))
            share[a] += 1
            share[b] += 1
            between[a, b] += a != b
        gains = [(share[a] * share[b] - 2 * m * e, a, b) for (a, b), e in between.items() if e and 2 * m * e - share[a] * share[b] > 2e-12 * m * m]
        if not gains:
            order = sorted(set(name.values()))
            return {n: order.index(c) for n, c in name.items()}
        _, keep, gone = min(gains)
        name = {n: keep if c == gone else c for n, c in name.items()}


@pytest.mark.parametrize(("window", "most_rows"), [(512, 200_000), (3, 200_000), (8, 12)])
def test_windows_of_merges_are_merges_one_at_a_time(tangled, spark, window, most_rows):
    names, edges, g = tangled
    some = edges if window > 100 else [e for e in edges if e[1] < "22"]
    small = g[False] if window > 100 else graph(spark, some)
    ids = names if window > 100 else {x for e in some for x in e}
    got = {r["id"]: r["community"] for r in community.greedy(small, window, most_rows).collect()}
    assert got == one_at_a_time(some, ids)


def test_a_window_stops_where_the_outside_may_be_better():
    rng = random.Random(7)
    for _ in range(200):
        names = [chr(97 + i) for i in range(9)]
        edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(14)}
        m, between = len(edges), dict.fromkeys(edges, 1)
        share = defaultdict(int)
        for u, v in edges:
            share[u] += 1
            share[v] += 1
        want, got = one_at_a_time(edges, names), {n: n for n in names}
        while True:
            gains = sorted((share[u] * share[v] - 2 * m * e, u, v) for (u, v), e in between.items() if 2 * m * e > share[u] * share[v])
            if not gains:
                break
            best = [(-q, u, v) for q, u, v in gains[:2]]
            inside = {c for _, *p in best for c in p}
            rows = [(u, v, e, share[u], share[v]) for (u, v), e in between.items() if {u, v} & inside]
            made = community.merges(best, rows, m, 2e-12 * m * m, len(gains) > 2)
            assert made
            for keep, gone in made:
                got = {n: keep if c == gone else c for n, c in got.items()}
                share[keep] += share.pop(gone)
                moved = defaultdict(int)
                for (u, v), e in between.items():
                    u, v = (keep if x == gone else x for x in (u, v))
                    if u != v:
                        moved[tuple(sorted((u, v)))] += e
                between = moved
        order = sorted(set(got.values()))
        assert {n: order.index(c) for n, c in got.items()} == want


def test_delta_stepping(spark):
    """A long path beside long arcs: what is far waits, and is followed less often."""
    n = 9
    edges = [(f"p{i}", f"p{i + 1}", 1.0) for i in range(n)] + [("p0", f"p{i}", 3.0 * i) for i in range(2, n + 1)] + [(f"p{i}", f"q{i}", 0.5) for i in range(n + 1)]
    g = graph(spark, edges, directed=True)
    start = g.nodes.where("id = 'p0'")
    found, followed = {}, {}
    for delta in (1.5, None, float("inf")):
        followed[delta] = []
        found[delta] = {r["dst"]: r["dist"] for r in paths.relaxed(g, start, delta=delta, counts=followed[delta]).collect()}
    want = {f"p{i}": float(i) for i in range(n + 1)} | {f"q{i}": i + 0.5 for i in range(n + 1)}
    assert all(f == want for f in found.values())
    assert sum(followed[1.5]) < sum(followed[float("inf")])


def test_one_window_holds_the_links_of_a_small_graph(spark, monkeypatch):
    draw, names = random.Random(5), [f"{i:03d}" for i in range(500)]
    g = graph(spark, sorted({tuple(sorted(draw.sample(names, 2))) for _ in range(800)}), nodes=names)
    calls, merges = [], community.merges
    monkeypatch.setattr(community, "merges", lambda *x: calls.append(1) or merges(*x))
    got = {r["id"]: r["community"] for r in community.greedy(g).collect()}
    assert len(calls) <= 2
    assert got == {r["id"]: r["community"] for r in community.greedy(g, window=300).collect()} and len(calls) > 4
