"""Clustering, assortativity and modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshweave import config
from meshweave.graph import Graph


def clustering(g: Graph) -> DataFrame:
    """Rows (id, value). Undirected: linked pairs of neighbours over all pairs. Directed:
    directed triangles over those possible. Loops aside; 0 where no pair is possible.
    Triangles are found over arcs from nodes of lower to higher degree, so a node with
    very many neighbours costs little."""
    a = g.arcs.where("src <> dst").select("src", "dst")
    both = a if not g.directed else a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    b = both.groupBy("src", "dst").agg(F.count("*").alias("b")) if g.directed else both.withColumn("b", F.lit(1))
    size = b.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"), F.sum("b").alias("total"), F.count_if(F.col("b") == 2).alias("mutual"))
    rank = size.select("id", F.struct("k", "id").alias("r"))
    up = b.join(rank.withColumnsRenamed({"id": "src", "r": "r1"}), "src").join(rank.withColumnsRenamed({"id": "dst", "r": "r2"}), "dst").where("r1 < r2").select("src", "dst", "b")
    x = up.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("b").alias("uv"))
    y = up.select(F.col("src").alias("u"), F.col("dst").alias("w"), F.col("b").alias("uw"))
    z = up.select(F.col("src").alias("v"), F.col("dst").alias("w"), F.col("b").alias("vw"))
    corners = x.join(y, "u").join(z, ["v", "w"]).select((F.col("uv") * F.col("uw") * F.col("vw")).alias("t"), F.explode(F.array("u", "v", "w")).alias("id"))
    t = corners.groupBy("id").agg(F.sum("t").alias("t"))
    met = g.nodes.select("id").join(size, "id", "left").join(t, "id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    possible = F.col("k") * (F.col("k") - 1) / 2 if not g.directed else F.col("total") * (F.col("total") - 1) - 2 * F.col("mutual")
    value = F.col("t") / possible
    return met.select("id", F.coalesce(F.when(possible > 0, value), F.lit(0.0)).alias("value"))


def average_clustering(local: DataFrame) -> DataFrame:
    """One row (value): the mean of clustering()."""
    return local.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))


def assortativity(g: Graph, c: config.Assortativity = config.Assortativity()) -> DataFrame:
    """One row (value): of the degrees j, k at the ends of edges, (E[jk] - E[(j+k)/2]^2) /
    (E[(j^2+k^2)/2] - E[(j+k)/2]^2); 0 without edges or spread. Loops count in degrees
    and are passed over as edges."""
    out = g.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    into = g.arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("d"))
    first, second = {"out-out": (out, out), "in-in": (into, into), "in-out": (into, out)}.get(c.mode, (out, into)) if g.directed else (out, out)
    edges = g.arcs.where("src <> dst" if g.directed else "src < dst")
    j = edges.join(first.select(F.col("id").alias("src"), F.col("d").alias("j")), "src", "left").join(second.select(F.col("id").alias("dst"), F.col("d").alias("k")), "dst", "left")
    j = j.select(F.coalesce("j", F.lit(0)).cast("double").alias("j"), F.coalesce("k", F.lit(0)).cast("double").alias("k"))
    e = j.agg(F.avg(F.col("j") * F.col("k")).alias("jk"), F.avg((F.col("j") + F.col("k")) / 2).alias("m"), F.avg((F.col("j") * F.col("j") + F.col("k") * F.col("k")) / 2).alias("s"))
    below = F.col("s") - F.col("m") * F.col("m")
    return e.select(F.coalesce(F.when(below != 0, (F.col("jk") - F.col("m") * F.col("m")) / below), F.lit(0.0)).alias("value"))


def projected(g: Graph) -> DataFrame:
    """Rows (u, v), u < v: edges without direction, loops and repeats."""
    return g.arcs.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def modularity(g: Graph, partition: DataFrame) -> DataFrame:
    """One row (value): of partition(id, community), sum over communities of the share of
    edges inside less the square of the share of degrees. Nodes without a community are
    in 0; no edges or an empty partition give 0."""
    if partition.isEmpty():
        return g.nodes.agg(F.lit(0.0).alias("value"))
    e = projected(g)
    of = g.nodes.select("id").join(partition, "id", "left").select("id", F.coalesce("community", F.lit(0)).alias("c"))
    met = e.join(of.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(of.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
    ends = met.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), (F.col("cu") == F.col("cv")).alias("inside")), F.struct(F.col("cv").alias("c"), F.lit(False).alias("inside")))).alias("x")).select("x.*")
    per = ends.groupBy("c").agg(F.count("*").alias("k"), F.count_if("inside").alias("l"))
    total = per.agg(F.sum("k").alias("m2"))
    return per.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(2 * F.col("l") / F.col("m2") - F.pow(F.col("k") / F.col("m2"), F.lit(2.0))), F.lit(0.0)).alias("value"))
