"""Standard graphs. All are tables computed from hashes of a seed and of ids, so a seed
gives one graph whatever the partitioning. Parameters out of range raise GraphError.

Models that add edges one by one elsewhere are rounds of joins here: what a draw refers
to is looked up for all edges at once, and draws that clash are drawn again."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.functions import rng
from meshweave.graph import Graph, GraphError
from meshweave.session import stash

Weight = Callable[[Column, Column], Column]


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise GraphError(what)


def _graph(nodes: DataFrame, edges: DataFrame, directed: bool, weight: Weight | None) -> Graph:
    """edges(i, j) of numbers; weight: of the two ids."""
    named = edges.select(F.col("i").cast("string").alias("src"), F.col("j").cast("string").alias("dst"))
    if weight is not None:
        named = named.withColumn("weight", weight(F.col("src"), F.col("dst")))
    return Graph.of(nodes.withColumn("id", F.col("id").cast("string")), named, directed, weight is not None, check=False)


def grid(spark: SparkSession, rows: int, cols: int, torus: bool = False, directed: bool = False, weight: Weight | None = None) -> Graph:
    """Ids row * cols + column, tags x and y; arcs to the right and down. A torus wraps,
    and has no arcs along a side of 2 or less."""
    _need(rows >= 0 and cols >= 0, "rows and cols are 0 or more")
    cells = spark.range(rows * cols).select("id", F.floor(F.col("id") / max(cols, 1)).alias("x"), (F.col("id") % max(cols, 1)).alias("y"))
    nodes = cells.select("id", F.create_map(F.lit("x"), F.col("x").cast("string"), F.lit("y"), F.col("y").cast("string")).alias("tags"))

    def along(at: str, size: int, step: Column) -> DataFrame:
        if torus and size <= 2:
            return cells.where("false").select(F.col("id").alias("i"), F.col("id").alias("j"))
        there = cells if torus else cells.where(F.col(at) < size - 1)
        return there.select(F.col("id").alias("i"), step.alias("j"))

    right = along("y", cols, F.col("x") * cols + (F.col("y") + 1) % max(cols, 1))
    down = along("x", rows, ((F.col("x") + 1) % max(rows, 1)) * cols + F.col("y"))
    return _graph(nodes, right.unionByName(down), directed, weight)


def triangle_hex(spark: SparkSession, edge: int, directed: bool = False, weight: Weight | None = None) -> Graph:
    """A hexagon of triangles with `edge` nodes a side, in axial coordinates; ids by q,
    then r; tags q and r, and center at the middle."""
    _need(edge >= 0, "edge is 0 or more")
    reach = edge - 1
    cells = spark.range(max(0, 2 * edge - 1)).select((F.col("id") - reach).alias("q"))
    if edge:
        cells = cells.select("q", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("r")).where(F.abs(F.col("q") + F.col("r")) <= reach)
    else:
        cells = cells.withColumn("r", F.lit(0))
    # Nodes before column q: full columns have 2 * edge - 1 - |q| nodes.
    before = F.coalesce(F.aggregate(F.filter(F.sequence(F.lit(-reach), F.lit(reach)), lambda c: c < F.col("q")), F.lit(0), lambda a, c: a + F.lit(2 * edge - 1) - F.abs(c).cast("int")), F.lit(0)) if edge else F.lit(0)
    cells = cells.withColumn("id", before + F.col("r") - F.greatest(F.lit(-reach), -F.col("q") - reach))
    place = F.create_map(F.lit("q"), F.col("q").cast("string"), F.lit("r"), F.col("r").cast("string"))
    center = (F.col("q") == 0) & (F.col("r") == 0)
    nodes = cells.select("id", F.when(center, F.map_concat(place, F.create_map(F.lit("center"), F.lit("true")))).otherwise(place).alias("tags"))
    far = cells.select(F.col("q").alias("q2"), F.col("r").alias("r2"), F.col("id").alias("j"))
    ways = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in ((1, 0), (0, 1), (1, -1))])
    steps = cells.select(F.col("id").alias("i"), "q", "r", F.inline(ways)).select("i", (F.col("q") + F.col("dq")).alias("q2"), (F.col("r") + F.col("dr")).alias("r2"))
    return _graph(nodes, steps.join(far, ["q2", "r2"]).select("i", "j"), directed, weight)


def erdos_renyi(spark: SparkSession, n: int, p: float, directed: bool = False, seed: int | None = None, weight: Weight | None = None) -> Graph:
    """Every pair (every ordered pair if directed) with probability p."""
    _need(n >= 0 and 0 <= p <= 1, "n is 0 or more, p from 0 to 1")
    seed = rng.resolve(seed)
    ids = spark.range(n)
    others = F.sequence(F.lit(0), F.lit(n - 1)) if directed else F.sequence(F.col("i"), F.lit(n - 1))
    drawn = ids.select(F.col("id").alias("i")).select("i", F.explode(others).alias("j")).where("i <> j") if n else ids.select(F.col("id").alias("i"), F.col("id").alias("j"))
    return _graph(ids, drawn.where(rng.uniform(seed, "i", "j") < p), directed, weight)


def points(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select("id", rng.uniform(seed, "id", F.lit("x")).alias("x"), rng.uniform(seed, "id", F.lit("y")).alias("y"))


def _placed(p: DataFrame) -> DataFrame:
    return p.select("id", F.create_map(F.lit("x"), F.col("x").cast("string"), F.lit("y"), F.col("y").cast("string")).alias("tags"))


def random_geometric(spark: SparkSession, n: int, r: float, directed: bool = False, seed: int | None = None, weight: Weight | None = None) -> Graph:
    """Points of the unit square; arcs from lower to higher numbers within distance r.
    Points meet by cells of side r: a range join."""
    _need(n >= 0 and 0 <= r <= 1, "n is 0 or more, r from 0 to 1")
    p = points(spark, n, rng.resolve(seed))
    side = max(r, 1 / math.sqrt(max(n, 1)) / 8, 1e-9)
    cell = lambda c: F.floor(F.col(c) / side)
    own = p.select(F.col("id").alias("i"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.array(*[F.struct((cell("x") + a).alias("cx"), (cell("y") + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    far = p.select(F.col("id").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.inline(near))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y2"), F.lit(2.0)))
    return _graph(_placed(p), own.join(far, ["cx", "cy"]).where((F.col("i") < F.col("j")) & (d <= r)).select("i", "j"), directed, weight)


def radius_for_degree(k: float, n: int) -> float:
    """Of a random geometric graph of n nodes with k neighbours each, about."""
    _need(k >= 0 and n > 0, "k is 0 or more, n over 0")
    return math.sqrt(k / (math.pi * (n - 1))) if n > 1 else 0.0


def waxman(spark: SparkSession, n: int, alpha: float, beta: float, directed: bool = False, seed: int | None = None, weight: Weight | None = None) -> Graph:
    """Points of the unit square; i < j with probability alpha * exp(-d / (beta * L)), L
    being the largest distance. Every pair has a chance, so every pair is drawn."""
    _need(n >= 0 and 0 < alpha <= 1 and 0 < beta <= 1, "n is 0 or more, alpha and beta over 0, up to 1")
    seed = rng.resolve(seed)
    p = stash(points(spark, n, seed))
    far = p.select(F.col("id").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y2"), F.lit(2.0)))
    both = p.withColumnRenamed("id", "i").join(far, F.col("i") < F.col("j")).select("i", "j", d.alias("d"))
    longest = both.agg(F.max("d")).first()[0]
    chance = alpha * F.exp(-F.col("d") / F.lit(beta * longest)) if longest else F.lit(alpha)
    return _graph(_placed(p), both.where(rng.uniform(seed, "i", "j") < chance).select("i", "j"), directed, weight)


def barabasi_albert(spark: SparkSession, n: int, m: int, directed: bool = False, seed: int | None = None, weight: Weight | None = None) -> Graph:
    """A clique of m nodes, then nodes that attach to m different earlier ones, by degree.

    Edge k of the whole list has places 2k (its new node) and 2k + 1 (its target). A
    target is a uniform draw from all places of earlier nodes' edges, so a node is drawn
    as often as it has edges; draws of target places are followed, for all edges at once,
    until they end at a node. Draws of one node that agree are drawn again."""
    _need(n >= 0 and m >= 1 and n > m, "n is 0 or more, m at least 1, n over m")
    seed = rng.resolve(seed)
    clique = m * (m - 1) // 2
    start = spark.range(m).select(F.col("id").alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j")).where("i < j")
    numbered = start.select("i", "j", (F.col("i") * (2 * m - F.col("i") - 1) / 2 + F.col("j") - F.col("i") - 1).cast("long").alias("k"))
    fixed = numbered.select(F.explode(F.array(F.struct((2 * F.col("k")).alias("place"), F.col("i").alias("node")), F.struct((2 * F.col("k") + 1).alias("place"), F.col("j").alias("node")))).alias("x")).select("x.*") if clique else spark.createDataFrame([], "place long, node long")
    slots = spark.range((n - m) * m).select((F.col("id") + clique).alias("k"), (m + F.floor(F.col("id") / m)).alias("v"), (F.col("id") % m).alias("slot"))
    slots = slots.withColumn("turn", F.lit(0))
    while True:
        # Where no edge is there yet (m = 1), the first node is the only choice.
        places = 2 * (clique + (F.col("v") - m) * m)
        drawn = stash(slots.select("k", "v", "slot", "turn", F.when(places > 0, F.floor(rng.uniform(seed, "v", "slot", "turn") * places)).alias("place")))
        known = fixed.unionByName(drawn.select((2 * F.col("k")).alias("place"), F.col("v").alias("node")))
        live = drawn.where("place is not null").select("k", "place")
        ended = drawn.where("place is null").select("k", F.lit(0).cast("long").alias("node"))
        points_to = drawn.select((2 * F.col("k") + 1).alias("place"), F.col("place").alias("next"), F.col("k").alias("k2"))
        while True:
            met = live.join(known, "place", "left").join(points_to, "place", "left")
            met = stash(met.select("k", "node", F.when(F.col("k2").isNotNull() & F.col("next").isNull(), F.lit(0).cast("long")).alias("first"), "next"))
            ended = ended.unionByName(met.where("node is not null or first is not null").select("k", F.coalesce("node", "first").alias("node")))
            live = met.where("node is null and first is null").select("k", F.col("next").alias("place"))
            if live.isEmpty():
                break
        got = stash(drawn.join(ended, "k"))
        again = F.row_number().over(W.partitionBy("v", "node").orderBy("slot")) > 1
        judged = stash(got.withColumn("again", again))
        if judged.where("again").isEmpty():
            break
        slots = judged.select("k", "v", "slot", F.when(F.col("again"), F.col("turn") + 1).otherwise(F.col("turn")).alias("turn"))
    edges = numbered.select("i", "j").unionByName(got.select(F.col("v").alias("i"), F.col("node").alias("j")))
    return _graph(spark.range(n), edges, directed, weight)


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, directed: bool = False, seed: int | None = None, weight: Weight | None = None) -> Graph:
    """A ring with arcs to the next k // 2 nodes, each moved with probability beta to a
    uniform node that is no neighbour yet and not itself. An edge is there until it has
    moved, so there are n * (k // 2) edges at any time; of moves that clash, that of the
    edge with the lowest number is made, and the others are drawn again. What has found no
    place in so many turns draws among the nodes that are free; an edge without any stays."""
    _need(0 <= k < n and 0 <= beta <= 1, "k from 0 to n - 1, beta from 0 to 1")
    seed = rng.resolve(seed)
    half = k // 2
    if not half:
        return _graph(spark.range(n), spark.range(0).select(F.col("id").alias("i"), F.col("id").alias("j")), directed, weight)
    pair = lambda i, j: [F.col(i).alias("a"), F.col(j).alias("b")] if directed else [F.least(i, j).alias("a"), F.greatest(i, j).alias("b")]
    ring = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(half))).alias("s")).select("i", "s", ((F.col("i") + F.col("s")) % n).alias("j"))
    edges = stash(ring.select("i", "s", "j", *pair("i", "j"), (rng.uniform(seed, "i", "s", F.lit("move")) < beta).alias("move")))
    turn, most = 0, 16
    while not edges.where("move").isEmpty():
        asked = edges.where("move").select("i", "s")
        if turn < most:
            asked = asked.withColumn("t", F.floor(rng.uniform(seed, "i", "s", F.lit(turn)) * n))
        else:
            asked = asked.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        free = asked.where("i <> t").select("*", *pair("i", "t")).join(edges.select("a", "b"), ["a", "b"], "left_anti")
        if turn >= most:
            free = free.withColumn("r", F.row_number().over(W.partitionBy("i", "s").orderBy(rng.uniform(seed, "i", "s", "t", F.lit(turn)), "t"))).where("r = 1").drop("r")
        won = stash(free.withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy("i", "s"))).where("r = 1").select("i", "s", "t", F.col("a").alias("a2"), F.col("b").alias("b2")))
        if turn >= most and won.isEmpty():
            break
        met = edges.join(won, ["i", "s"], "left")
        edges = stash(met.select("i", "s", F.coalesce("t", "j").alias("j"), F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), (F.col("move") & F.col("t").isNull()).alias("move")))
        turn += 1
    return _graph(spark.range(n), edges.select("i", "j"), directed, weight)


def ordered(df: DataFrame, *by: str) -> DataFrame:
    """df with a number `at` in order of by, from 0: counts of range partitions give each
    one its first number."""
    parts = stash(df.repartitionByRange(*by).withColumn("in_part", F.spark_partition_id()))
    counts = parts.groupBy("in_part").agg(F.count("*").alias("n"))
    before = counts.select("in_part", (F.sum("n").over(W.orderBy("in_part")) - F.col("n")).alias("before_part"))  # a row per partition
    return parts.join(F.broadcast(before), "in_part").withColumn("at", F.col("before_part") + F.row_number().over(W.partitionBy("in_part").orderBy(*by)) - 1).drop("in_part", "before_part")


def random_regular(spark: SparkSession, n: int, k: int, directed: bool = False, seed: int | None = None, weight: Weight | None = None) -> Graph:
    """Every node has k neighbours: k stubs each, in hash order, neighbours in that order
    joined. Loops and repeats give their stubs back for the next turn; where the last few
    cannot be joined, all starts again with the next seed."""
    _need(0 <= k < n and n * k % 2 == 0, "k from 0 to n - 1, n * k even")
    seed = rng.resolve(seed)
    none = spark.createDataFrame([], "i long, j long")
    for start in range(20):
        placed, open_ = none, spark.range(n * k).select(F.col("id").alias("stub"), F.floor(F.col("id") / max(k, 1)).alias("node"))
        for turn in range(30):
            left = open_.count()
            if not left:
                return _graph(spark.range(n), placed, directed, weight)
            mixed = ordered(open_.withColumn("h", rng.uniform(seed + start, "stub", F.lit(turn))), "h", "stub")
            met = mixed.groupBy(F.floor(F.col("at") / 2).alias("pair")).agg(F.min(F.struct("at", "node", "stub")).alias("x"), F.max(F.struct("at", "node", "stub")).alias("y"))
            met = met.select("pair", F.least("x.node", "y.node").alias("i"), F.greatest("x.node", "y.node").alias("j"), F.array("x.stub", "y.stub").alias("stubs"))
            good = met.where("i <> j").join(placed, ["i", "j"], "left_anti")
            good = stash(good.withColumn("r", F.row_number().over(W.partitionBy("i", "j").orderBy("pair"))).where("r = 1").select("i", "j", "stubs"))
            placed = stash(placed.unionByName(good.select("i", "j")))
            open_ = stash(open_.join(good.select(F.explode("stubs").alias("stub")), "stub", "left_anti"))
    raise GraphError("no regular graph was found")


#: Names of the models, their makers, and the parameters that each takes.
MODELS = {
    "erdos_renyi": (erdos_renyi, {"n": int, "p": float}),
    "barabasi_albert": (barabasi_albert, {"n": int, "m": int}),
    "watts_strogatz": (watts_strogatz, {"n": int, "k": int, "beta": float}),
    "random_regular": (random_regular, {"n": int, "k": int}),
    "waxman": (waxman, {"n": int, "alpha": float, "beta": float}),
    "grid": (grid, {"rows": int, "cols": int, "torus": bool}),
    "triangle_hex": (triangle_hex, {"edge": int}),
}


def standard(spark: SparkSession, model: str, params: dict, directed: bool = False, seed: int | None = None, weight: Weight | None = None) -> Graph:
    """A model by name. random_geometric takes n and either r or k, neighbours each;
    none is an empty weighted graph."""

    def typed(names: dict[str, type]) -> dict:
        out = {}
        for name, kind in names.items():
            value = params.get(name)
            if kind is float and type(value) is int:
                value = float(value)
            _need(type(value) is kind, f"{model} needs {name} as {kind.__name__}")
            out[name] = value
        return out

    if model == "none":
        return Graph.empty(spark, directed, True)
    if model == "random_geometric":
        _need(("r" in params) != ("k" in params), "random_geometric needs r or k")
        n = typed({"n": int})["n"]
        r = typed({"r": float})["r"] if "r" in params else radius_for_degree(typed({"k": float})["k"], n)
        return random_geometric(spark, n, r, directed, seed, weight)
    _need(model in MODELS, f"no model {model}")
    make, names = MODELS[model]
    more = {} if model in ("grid", "triangle_hex") else {"seed": seed}
    return make(spark, **typed(names), directed=directed, weight=weight, **more)
