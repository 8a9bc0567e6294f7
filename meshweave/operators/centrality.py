"""Centralities: rows (id, value), or (src, dst, value) for edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshweave import config
from meshweave.graph import Graph
from meshweave.operators import bits, dealt, paths
from meshweave.session import bucketed, scratch, stash

#: Rows of pairs that a batch of sources may make: what lies on disk at once follows it.
MOST_PAIRS = 1 << 28


def _values(g: Graph, found: DataFrame, value: Column | str = "value") -> DataFrame:
    """found(id, value) for all nodes, 0 where there is none."""
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0.0)).cast("double").alias("value"))


def degree(g: Graph, c: config.Degree = config.Degree()) -> DataFrame:
    """Neighbours, without loops, over n - 1; all 0 for one node."""
    n = g.size()
    a = g.arcs.where("src <> dst")
    out, into = a.select(F.col("src").alias("id")), a.select(F.col("dst").alias("id"))
    ends = out if not g.directed or c.mode == "out" else into if c.mode == "in" else out.unionByName(into)
    counted = ends.groupBy("id").agg(F.count("*").alias("value"))
    return _values(g, counted, F.col("value") / F.lit(float(n - 1)) if n > 1 else F.lit(0.0))


def closeness(g: Graph, c: config.Closeness = config.Closeness(), p: DataFrame | None = None) -> DataFrame:
    """(r - 1) / sum of distances, times (r - 1) / (n - 1) if improved or undirected, r - 1
    nodes being in reach. Directed: distances into the node, or out of it if reverse. p:
    pairs of a weighted graph; without weights a node needs counts and sums only."""
    n, out = g.size(), g.directed and c.reverse
    if g.weighted:
        p = paths.pairs(g) if p is None else p
        found = p.where("dist > 0").groupBy(F.col("src" if out else "dst").alias("id")).agg(F.count("*").alias("r"), F.sum("dist").alias("s"))
    else:
        found = bits.sums(g, backwards=out)[0].select("id", F.col("reached").alias("r"), F.col("far").cast("double").alias("s"))
    base = F.col("r") / F.nullif("s", F.lit(0.0))
    improved = c.wf_improved or not g.directed
    return _values(g, found, base * F.col("r") / F.lit(float(n - 1)) if improved and n > 1 else base)


def batches(g: Graph, most_pairs: int) -> Iterator[DataFrame]:
    """Nodes (id) in parts whose searches make about most_pairs rows at most."""
    parts = -(-(g.size() ** 2) // most_pairs)
    for k in range(parts):
        yield g.nodes.select("id").where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)


def shares(g: Graph, levels: list[DataFrame]) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Of levels(src, dst, sigma) of an unweighted graph, from the last but one back: rows
    (src, dst, sigma, delta) and those of the next level. delta is the sum, over the targets
    beyond dst, of the share of their shortest paths from src that go over it. Each level
    is joined with arcs once."""
    back = stash(g.arcs.where("src <> dst").select(F.col("src").alias("u"), F.col("dst")))
    ahead = levels[-1].withColumn("delta", F.lit(0.0)) if levels else None
    for level in reversed(levels[:-1]):
        pulled = ahead.join(back, "dst").groupBy("src", F.col("u").alias("dst")).agg(F.sum((1 + F.col("delta")) / F.col("sigma")).alias("x"))
        here = stash(level.join(pulled, ["src", "dst"], "left").select("src", "dst", "sigma", (F.col("sigma") * F.coalesce("x", F.lit(0.0))).alias("delta")))
        yield here, ahead
        ahead = here


def dependencies(g: Graph, p: DataFrame) -> DataFrame:
    """Rows (src, u, v, ratio) of a weighted graph: each arc on shortest paths from src, with the share of the
    shortest paths to v that come over u."""
    a = g.arcs.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight")
    start = p.select("src", F.col("dst").alias("u"), F.col("dist").alias("du"), F.col("sigma").alias("gu")).join(a, "u")
    met = start.join(p.select("src", F.col("dst").alias("v"), F.col("dist").alias("dv"), F.col("sigma").alias("gv")), ["src", "v"])
    return met.where(F.abs(F.col("du") + F.col("weight") - F.col("dv")) <= paths.EPS).select("src", "u", "v", (F.col("gu") / F.col("gv")).alias("ratio"))


def accumulate(steps: DataFrame) -> DataFrame:
    """Rows (src, dst, delta): sum over the targets beyond dst of the share of their
    shortest paths from src that go over it. A round adds targets one arc further on."""
    steps = stash(steps)
    part = stash(steps.groupBy("src", F.col("u").alias("dst")).agg(F.sum("ratio").alias("delta")))
    every = part
    while True:
        ahead = steps.join(part.withColumnsRenamed({"dst": "v"}), ["src", "v"])
        part = stash(ahead.groupBy("src", F.col("u").alias("dst")).agg(F.sum(F.col("ratio") * F.col("delta")).alias("delta")))
        if part.isEmpty():
            break
        every = every.unionByName(part)
    return every.groupBy("src", "dst").agg(F.sum("delta").alias("delta"))


def betweenness(g: Graph, c: config.Betweenness = config.Betweenness(), p: DataFrame | None = None, most_pairs: int | None = None) -> DataFrame:
    """Over all pairs (each once if undirected), the share of shortest paths that pass. p:
    pairs of a weighted graph. Without weights tasks search from a share of the sources
    each; by joins, if most_pairs is given or the graph doesn't fit a task, sources go in
    batches of most_pairs rows."""
    n = g.size()
    if n < 3:
        return _values(g, g.nodes.select("id", F.lit(0.0).alias("value")))
    scale = 1.0 / ((n - 1) * (n - 2)) if c.normalized else 1.0 if g.directed else 0.5
    passed = F.sum("delta").alias("x")
    if g.weighted:
        p = stash(paths.pairs(g) if p is None else p)
        total = accumulate(dependencies(g, p)).where("src <> dst").groupBy("dst").agg(passed)
    elif most_pairs is None and dealt.fits(g):
        rows, ids = dealt.dealt(g, dealt.nodes_task, "at int, x double")
        total = stash(rows.groupBy("at").agg(F.sum("x").alias("x")).join(ids, "at").select(F.col("id").alias("dst"), "x"))
    else:
        total = None
        for some in batches(g, most_pairs or MOST_PAIRS):
            with scratch() as keep:
                # The last level passes on nothing, the first are the sources themselves.
                parts = [here for here, _ in shares(g, paths.levels(g, some))][:-1]
                parts = [here.select("dst", "delta") for here in parts] + ([total.select("dst", F.col("x").alias("delta"))] if total is not None else [])
                total = keep(reduce(DataFrame.unionByName, parts).groupBy("dst").agg(passed)) if parts else total
    if total is None:
        return _values(g, g.nodes.select("id", F.lit(0.0).alias("value")))
    return _values(g, total.select(F.col("dst").alias("id"), (F.col("x") * scale).alias("value")))


def edge_betweenness(g: Graph, c: config.EdgeBetweenness = config.EdgeBetweenness(), scale: str = "nodes", most_pairs: int | None = None) -> DataFrame:
    """Over all pairs, the share of shortest paths by arcs, weights aside, that use an
    edge. Undirected edges once, src < dst. Normalized by the factor of nodes, or, with
    scale="pairs", by the number of pairs. most_pairs: as of betweenness()."""
    n = g.size()
    name = lambda a, b: [F.col(a).alias("src"), F.col(b).alias("dst")] if g.directed else [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]
    factor = 1.0 if g.directed else 0.5
    if c.normalized and n > 2:
        factor *= (1.0 if g.directed else 2.0) / ((n - 1) * (n - 2) if scale == "nodes" else n * (n - 1))
    arcs = stash(g.arcs.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")))
    total, whole = None, most_pairs is None and dealt.fits(g)
    if whole:
        rows, ids = dealt.dealt(g, dealt.edges_task, "u int, v int, x double")
        summed = rows.groupBy("u", "v").agg(F.sum("x").alias("x")).withColumnsRenamed({"u": "i", "v": "j"})
        total = stash(summed.join(ids.select(F.col("at").alias("i"), F.col("id").alias("u")), "i").join(ids.select(F.col("at").alias("j"), F.col("id").alias("v")), "j").select("u", "v", "x"))
    for some in [] if whole else batches(g, most_pairs or MOST_PAIRS):
        with scratch() as keep:
            parts = [] if total is None else [total]
            for here, ahead in shares(g, paths.levels(g, some)):
                gone = ahead.select("src", F.col("dst").alias("v"), ((1 + F.col("delta")) / F.col("sigma")).alias("x")).join(arcs, "v")
                used = gone.join(here.select("src", F.col("dst").alias("u"), "sigma"), ["src", "u"])
                parts.append(used.groupBy("u", "v").agg(F.sum(F.col("sigma") * F.col("x")).alias("x")))
            total = keep(reduce(DataFrame.unionByName, parts).groupBy("u", "v").agg(F.sum("x").alias("x"))) if parts else total
    every = arcs.select(*name("u", "v")).distinct()
    if total is None:
        return every.withColumn("value", F.lit(0.0))
    summed = total.groupBy(*name("u", "v")).agg((F.sum("x") * factor).alias("value"))
    return every.join(summed, ["src", "dst"], "left").select("src", "dst", F.coalesce("value", F.lit(0.0)).alias("value"))


def _normalized(g: Graph, given: DataFrame | None, n: int) -> DataFrame:
    """given(id, value) over the graph's nodes, summing to 1; uniform if it sums to 0."""
    if given is None:
        return g.nodes.select("id", F.lit(1.0 / n).alias("p"))
    mine = g.nodes.select("id").join(given, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))
    total = mine.agg(F.sum("value")).first()[0]
    return mine.select("id", (F.col("value") / F.lit(total) if total else F.lit(1.0 / n)).alias("p"))


def in_range(c: config.PageRank | None) -> tuple[float, int, float]:
    """alpha, most rounds and tolerance: those of c, or, for each that is missing or out of
    range, what holds without settings."""
    if c is None:
        return 0.85, 1000, 1e-6
    return c.alpha if 0 < c.alpha < 1 else 0.85, c.max_iter if c.max_iter > 0 else 1000, c.tol if c.tol > 0 else 1e-6


def page_rank(g: Graph, c: config.PageRank | None = None) -> DataFrame:
    """Power iteration without weights and loops; stops when the sum of changes is under
    n * tol. Settings out of range fall back to what holds without settings: 1,000 rounds,
    0.85 and 1e-6. Arcs and ranks lie in buckets of the node that arcs start from, so a
    round is one job with one exchange, that of the shares given to each node; what the
    next round needs of all ranks is observed while they are written."""
    alpha, rounds, tol = in_range(c)
    c = c or config.PageRank()
    n = g.size()
    if not n:
        return g.nodes.select("id", F.lit(0.0).alias("value"))
    a = g.arcs.where("src <> dst").select("src", "dst")
    if g.directed and c.reverse:
        a = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    a = bucketed(a, "src")[0]
    degrees = a.groupBy("src").agg(F.count("*").alias("k"))
    jump = _normalized(g, c.personalization, n).withColumnRenamed("p", "jump")
    hang = _normalized(g, c.dangling, n).withColumnRenamed("p", "hang") if c.dangling is not None else jump.select("id", F.col("jump").alias("hang"))
    base = jump.join(hang, "id").join(degrees.withColumnRenamed("src", "id"), "id", "left")
    change = F.sum(F.abs(F.col("r") - F.col("before"))).alias("change")
    lost = F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("r"))), F.lit(0.0)).alias("lost")
    total = F.sum("r").alias("total")
    rank, seen = bucketed(base.select("id", "jump", "hang", "k", F.lit(1.0 / n).alias("r"), F.lit(0.0).alias("before")), "id", change, lost, total)
    for _ in range(rounds):
        given = a.join(rank.select(F.col("id").alias("src"), (alpha * F.col("r") / F.col("k")).alias("share")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        new = (1 - alpha) * F.col("jump") + F.lit(alpha * seen["lost"]) * F.col("hang") + F.coalesce("got", F.lit(0.0))
        rank, seen = bucketed(rank.join(given, "id", "left").select("id", "jump", "hang", "k", new.alias("r"), F.col("r").alias("before")), "id", change, lost, total)
        if seen["change"] < n * tol:
            break
    return rank.select("id", (F.col("r") / F.lit(seen["total"]) if seen["total"] else F.col("r")).alias("value"))


def eigenvector(g: Graph, c: config.Eigenvector = config.Eigenvector()) -> DataFrame:
    """Power iteration without weights, loops included: sums over in-neighbours (out if
    reverse), scaled to length 1, until the sum of changes is under n * tol. Where all
    sums are 0, the values before stay. A round is one job with one exchange: sums are
    stored as they are, with their length observed, and scaled when they are read."""
    rounds, tol = c.max_iter if c.max_iter > 0 else 100, c.tol if c.tol > 0 else 1e-6
    n = g.size()
    if not n:
        return g.nodes.select("id", F.lit(0.0).alias("value"))
    a = g.arcs.select("src", "dst")
    if g.directed and c.reverse:
        a = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    a = bucketed(a, "src")[0]
    if c.start is None:
        x = g.nodes.select("id", F.lit(1.0 / n).alias("y"))
    else:
        x = g.nodes.select("id").join(c.start, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("y"))
    # A round's values are y / norm. Their change needs the norm, which is known once y is
    # stored, so it is observed in the next round.
    state, norm = bucketed(x.select("id", "y", F.col("y").alias("before")), "id")[0], 1.0
    for turn in range(rounds):
        summed = a.join(state.select(F.col("id").alias("src"), (F.col("y") / F.lit(norm)).alias("x")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("got"))
        met = state.join(summed, "id", "left").select("id", F.coalesce("got", F.lit(0.0)).alias("y"), (F.col("y") / F.lit(norm)).alias("x"), "before")
        new, seen = bucketed(met.select("id", "y", F.col("x").alias("before"), F.abs(F.col("x") - F.col("before")).alias("off")), "id", F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"), F.sum("off").alias("change"))
        # The change of the round before is known now: if it was small, that round's values stay.
        if turn and seen["change"] < n * tol:
            break
        if not seen["norm"]:
            break
        state, norm = new.select("id", "y", "before"), seen["norm"]
    return state.select("id", (F.col("y") / F.lit(norm)).alias("value"))
