"""All shortest paths as a table of pairs, and what follows from it.

pairs(src, dst, dist, hops, sigma): distance, least number of arcs of a shortest path, and
number of shortest paths; reachable pairs only, each node with itself included. Searches
run from all sources at once, a level a round; a round's result is stashed, so plans stay
short and lost executors cost one round. Pairs of an unweighted graph whose arcs fit a task
stream from tasks that each search from a share of the sources (`dealt`): they are searched
for when they are read, and lie on no disk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave.graph import Graph, GraphError
from meshweave.operators import bits, dealt
from meshweave.session import observed, stash

EPS = 1e-9  # distances closer than this tie
BROADCAST = 100_000  # changed arcs, two ids and a weight each; more are joined by a shuffle


def _sources(g: Graph, sources: DataFrame | None) -> DataFrame:
    return (g.nodes if sources is None else sources).select(F.col("id").alias("src"), F.col("id").alias("dst"))


def levels(g: Graph, sources: DataFrame | None = None) -> list[DataFrame]:
    """Rows (src, dst, sigma) of an unweighted graph for each distance from 0, from all
    nodes or those in sources(id). Without directions a level's neighbours lie in it, in
    the one before or in the one after, so only two levels are looked through for what was
    seen. A level and the count of its rows are one job."""
    a = stash(g.arcs.where("src <> dst").select(F.col("src").alias("dst"), F.col("dst").alias("to")))
    rows = F.count("*").alias("rows")
    frontier, found = observed(_sources(g, sources).select("src", "dst", F.lit(1.0).alias("sigma")), rows)
    out: list[DataFrame] = []
    while found["rows"]:
        out.append(frontier)
        known = out if g.directed else out[-2:]
        before = reduce(DataFrame.unionByName, [x.select("src", "dst") for x in known])
        ahead = frontier.join(a, "dst").groupBy("src", F.col("to").alias("dst")).agg(F.sum("sigma").alias("sigma"))
        frontier, found = observed(ahead.join(before, ["src", "dst"], "left_anti").select("src", "dst", "sigma"), rows)
    return out


def breadth_first(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """pairs of an unweighted graph, from all nodes or those in sources(id)."""
    parts = [x.select("src", "dst", F.lit(float(n)).alias("dist"), F.lit(n).alias("hops"), "sigma") for n, x in enumerate(levels(g, sources))]
    return reduce(DataFrame.unionByName, parts) if parts else _sources(g, sources).select("src", "dst", F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(1.0).alias("sigma"))


DONE, HEAVY, LIGHT = 0, 1, 2  # what is left to do of a distance: nothing, its heavy arcs, all arcs


def relaxed(g: Graph, sources: DataFrame | None = None, target: str | None = None, delta: float | None = None, counts: list[int] | None = None) -> DataFrame:
    """Rows (src, dst, dist) of a weighted graph by delta-stepping: of the distances whose
    arcs are still to be followed, those within `delta` of the least are taken, first along
    arcs lighter than delta until none of them falls any more, then along the others once.
    So what lies far waits until it is nearly final, and is followed once rather than with
    each fall. A round is one join, one aggregate and one job. delta: by default the mean
    weight; infinite, all that fell in a round is followed in the next. With a target,
    distances of its own and more are not followed, nor of use. counts: gets the number of
    distances followed in each round, at the cost of a job."""
    a = stash(g.arcs.where("src <> dst").select(F.col("src").alias("dst"), F.col("dst").alias("to"), "weight"))
    if delta is None:
        delta = a.agg(F.avg("weight")).first()[0] or 1.0
    heavy = not a.where(F.col("weight") >= F.lit(delta)).isEmpty()
    least = [F.min(F.when(F.col("left") == k, F.col("dist"))).alias(name) for k, name in ((HEAVY, "heavy"), (LIGHT, "light"))]
    end = F.min(F.when(F.col("dst") == F.lit(target), F.col("dist"))).alias("end")
    best, found = observed(_sources(g, sources).select("src", "dst", F.lit(0.0).alias("dist"), F.lit(LIGHT).alias("left")), *least, end)
    limit = delta
    while True:
        low = min((x for x in (found["heavy"], found["light"]) if x is not None), default=None)
        if low is None or (found["end"] is not None and low >= found["end"]):
            return best.select("src", "dst", "dist")
        if low >= limit:
            limit = low + delta
        if found["end"] is not None:
            limit = min(limit, found["end"])
        light = found["light"] is not None and found["light"] < limit
        kind, then = (LIGHT, HEAVY if heavy else DONE) if light else (HEAVY, DONE)
        taken = (F.col("left") == kind) & (F.col("dist") < F.lit(limit))
        if counts is not None:
            counts.append(best.where(taken).count())
        arcs = a.where((F.col("weight") < F.lit(delta)) if light else (F.col("weight") >= F.lit(delta)))
        reached = best.where(taken).join(arcs, "dst").select("src", F.col("to").alias("dst"), (F.col("dist") + F.col("weight")).alias("dist"), F.lit(LIGHT).alias("left"))
        kept = best.withColumn("left", F.when(taken, F.lit(then)).otherwise(F.col("left")))
        # Of equal distances the one that was there stays, with less or as much left to do.
        both = reached.unionByName(kept).groupBy("src", "dst").agg(F.min(F.struct("dist", "left")).alias("x"))
        best, found = observed(both.select("src", "dst", "x.dist", "x.left"), *least, end)


def _tellable(g: Graph) -> None:
    if g.weighted and not g.arcs.where(F.col("weight") <= EPS).isEmpty():
        raise GraphError(f"weights over {EPS} are needed to tell shortest paths apart")


def weighted(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """pairs of a weighted graph. Ties are told within EPS, so weights must exceed it."""
    _tellable(g)
    best = relaxed(g, sources)
    steps = stash(steps_of(g, best))
    walks = stash(best.where("src = dst").select("src", "dst", F.lit(0).alias("hops"), F.lit(1.0).alias("n")))
    every = walks
    while True:
        ahead = walks.join(steps.select("src", F.col("u").alias("dst"), "v"), ["src", "dst"])
        walks = stash(ahead.groupBy("src", F.col("v").alias("dst"), (F.col("hops") + 1).alias("hops")).agg(F.sum("n").alias("n")))
        if walks.isEmpty():
            break
        every = every.unionByName(walks)
    counted = every.groupBy("src", "dst").agg(F.min("hops").alias("hops"), F.sum("n").alias("sigma"))
    return best.join(counted, ["src", "dst"]).select("src", "dst", "dist", "hops", "sigma")


def steps_of(g: Graph, pairs: DataFrame) -> DataFrame:
    """Rows (src, u, v): arcs u to v on a shortest path from src, of pairs(src, dst, dist)."""
    a = g.arcs.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight")
    start = pairs.select("src", F.col("dst").alias("u"), F.col("dist").alias("du")).join(a, "u")
    met = start.join(pairs.select("src", F.col("dst").alias("v"), F.col("dist").alias("dv")), ["src", "v"])
    return met.where(F.abs(F.col("du") + F.col("weight") - F.col("dv")) <= EPS).select("src", "u", "v")


def streams(g: Graph) -> bool:
    """Whether pairs(g) are searched for as they are read."""
    return not g.weighted and dealt.fits(g)


def pairs(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    if streams(g):
        return dealt.dealt(g, dealt.pairs_task, dealt.PAIRS, sources, names=True)[0]
    return weighted(g, sources) if g.weighted else breadth_first(g, sources)


def repaired(p: DataFrame, before: Graph, after: Graph) -> tuple[DataFrame, DataFrame]:
    """pairs of `after`, from p, those of `before`, and the sources (id) that were searched
    anew: those from which an arc that went lay on a shortest path, or from which an arc
    that came would be on one, and new nodes. All others keep their rows."""
    _tellable(after)
    old, new = (g.arcs.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight") for g in (before, after))
    gone, come = (stash(x.join(y.withColumnRenamed("weight", "w2"), ["u", "v"], "left").where("w2 is null or w2 <> weight").drop("w2")) for x, y in ((old, new), (new, old)))
    near = p.select(F.col("src").alias("id"), F.col("dst").alias("u"), F.col("dist").alias("du"))
    end = p.select(F.col("src").alias("id"), F.col("dst").alias("v"), F.col("dist").alias("dv"))
    out, into = (near.join(F.broadcast(x) if x.limit(BROADCAST + 1).count() <= BROADCAST else x, "u").join(end, ["id", "v"], "left") for x in (gone, come))
    over = F.col("du") + F.col("weight") - F.col("dv")
    fresh = after.nodes.select("id").join(before.nodes.select("id"), "id", "left_anti")
    hit = out.where(F.abs(over) <= EPS).select("id").unionByName(into.where(F.col("dv").isNull() | (over <= EPS)).select("id")).unionByName(fresh)
    hit = stash(hit.distinct().join(after.nodes.select("id"), "id", "left_semi"))
    left = p.join(hit.withColumnRenamed("id", "src"), "src", "left_anti").join(after.nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return stash(left.select("src", "dst", "dist", "hops", "sigma").unionByName(pairs(after, hit))), hit


def shortest_paths(g: Graph, src: str, dst: str) -> DataFrame:
    """Rows (nodes array<string>, total) of all shortest paths from src to dst. No other
    pair is looked at: without weights the search goes from both ends until it meets, with
    weights from src as far as dst is."""
    g._need(src)
    if not g.weighted:
        return _from_both_ends(g, src, dst)
    _tellable(g)
    p = stash(relaxed(g, g.nodes.where(F.col("id") == src), dst))
    end = p.where(F.col("dst") == dst).select("dist").take(1)
    if not end:
        raise GraphError(f"no path from {src} to {dst}")
    p = p.where(F.col("dist") <= F.lit(end[0][0] + EPS))
    back = stash(steps_of(g, p).select(F.col("v").alias("head"), "u"))
    live = g.nodes.sparkSession.createDataFrame([(dst, [dst])], "head string, nodes array<string>")
    done = live.where(F.col("head") == src)
    while True:
        live, found = observed(live.where(F.col("head") != src).join(back, "head").select(F.col("u").alias("head"), F.array_prepend("nodes", F.col("u")).alias("nodes")), F.count("*").alias("rows"))
        if not found["rows"]:
            break
        done = done.unionByName(live.where(F.col("head") == src))
    return done.select("nodes", F.lit(end[0][0]).alias("total"))


def _from_both_ends(g: Graph, src: str, dst: str) -> DataFrame:
    """The smaller of two frontiers goes on by a level, until one holds nodes of the other:
    all shortest paths then pass those, and are read off the levels on either side."""
    arcs = stash(g.arcs.where("src <> dst").select("src", "dst"))
    seed = lambda x: stash(g.nodes.where(F.col("id") == x).select("id"))
    ahead, behind = [seed(src)], [seed(dst)]
    seen, sizes = {0: ahead[0], 1: behind[0]}, [1, behind[0].count()]
    meet = ahead[0].join(behind[0], "id")
    met = src == dst
    while not met:
        way = 0 if sizes[0] <= sizes[1] else 1
        side, ends = (ahead, ("src", "dst")) if way == 0 else (behind, ("dst", "src"))
        reached = arcs.join(side[-1].withColumnRenamed("id", ends[0]), ends[0], "left_semi").select(F.col(ends[1]).alias("id")).distinct()
        other = (behind if way == 0 else ahead)[-1].withColumn("hit", F.lit(True))
        new = reached.join(seen[way], "id", "left_anti").join(other, "id", "left")
        level, found = observed(new, F.count("*").alias("rows"), F.count("hit").alias("hits"))
        if not found["rows"]:
            raise GraphError(f"no path from {src} to {dst}")
        side.append(level.select("id"))
        seen[way], sizes[way] = seen[way].unionByName(side[-1]), found["rows"]
        met, meet = found["hits"] > 0, level.where("hit").select("id")
    live = meet.select(F.col("id").alias("first"), F.col("id").alias("last"), F.array("id").alias("nodes"))
    for level in reversed(ahead[:-1]):
        steps = arcs.join(level.withColumnRenamed("id", "src"), "src", "left_semi").select("src", F.col("dst").alias("first"))
        live = stash(live.join(steps, "first").select(F.col("src").alias("first"), "last", F.array_prepend("nodes", F.col("src")).alias("nodes")))
    for level in reversed(behind[:-1]):
        steps = arcs.join(level.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("last"), F.col("dst").alias("next"))
        live = stash(live.join(steps, "last").select("first", F.col("next").alias("last"), F.array_append("nodes", F.col("next")).alias("nodes")))
    return live.select("nodes", F.lit(float(len(ahead) + len(behind) - 2)).alias("total"))


def diameter(p: DataFrame) -> DataFrame:
    """One row (hops, weight): the longest distance between reachable pairs, and the
    fewest hops of a pair at it; zeros where there is none. p: pairs of the graph."""
    top = p.where("src <> dst").agg(F.max(F.struct(F.col("dist"), (-F.col("hops")).alias("h"))).alias("m"))
    return top.select(F.coalesce(-F.col("m.h"), F.lit(0)).cast("long").alias("hops"), F.coalesce("m.dist", F.lit(0.0)).alias("weight"))


def diameter_of(g: Graph) -> DataFrame:
    """The row of diameter() without a table of pairs where there are no weights."""
    if g.weighted:
        return diameter(pairs(g))
    longest = bits.diameter(g)[0]
    return g.nodes.sparkSession.range(1).select(F.lit(longest).cast("long").alias("hops"), F.lit(float(longest)).alias("weight"))


def components(g: Graph) -> DataFrame:
    """Rows (id, component): weakly connected, named by the smallest id. Labels spread to
    neighbours and then jump to their own label's, so rounds are few."""
    both = g.arcs.select("src", "dst").unionByName(g.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    both = stash(both.distinct())
    label = stash(g.nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(label.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("c2"))
        lower = label.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("c2", "component")).alias("c"))
        jump = lower.join(label.select(F.col("id").alias("c"), F.col("component").alias("c3")), "c").select("id", "component", F.least("c", "c3").alias("c"))
        new, found = observed(jump, F.count_if(F.col("c") != F.col("component")).alias("lowered"))
        label = new.select("id", F.col("c").alias("component"))
        if not found["lowered"]:
            return label


def largest_component(g: Graph) -> DataFrame:
    """Rows (id) of the largest component; of equal ones, the first by name."""
    c = stash(components(g))
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(best, "component", "left_semi").select("id")
