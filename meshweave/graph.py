"""Graphs as two DataFrames.

nodes(id string, tags map<string,string>), arcs(src string, dst string, weight double).
An undirected graph holds both arcs of an edge, an unweighted one weights of 1. Node ids
order as strings. A Graph never changes: operations give a new one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.session import stash

NODES = "id string, tags map<string,string>"
ARCS = "src string, dst string, weight double"
DIGITS = 3  # hex digits of the finest digests: 4,096 parts
SIDE = 256  # of a tile
JSON = "nodes map<string,map<string,double>>, directed boolean, weighted boolean"


class GraphError(ValueError):
    """A rule of the data model is broken, or something asked for is not there."""


def number_text(x: Column) -> Column:
    """Shortest decimal text of a double: 1 rather than 1.0, exponents from 1e+21 on and
    below 1e-4, with a sign and two digits."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    shown = x.cast("string")
    mantissa, power = F.regexp_extract(shown, r"^(-?[\d.]+?)(?:\.0)?E", 1), F.regexp_extract(shown, r"E(-?\d+)$", 1)
    signed = F.concat(F.when(F.startswith(power, F.lit("-")), "-").otherwise("+"), F.lpad(F.regexp_replace(power, "-", ""), 2, "0"))
    small = (F.abs(x) < 1e-4) & (x != 0)
    exact = F.when(shown.contains("E"), F.when(F.abs(x) < 1e21, _shift(mantissa, power)).otherwise(F.concat(mantissa, F.lit("e"), signed))).otherwise(F.regexp_replace(shown, r"\.0$", ""))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").when(small, F.concat(mantissa, F.lit("e"), signed)).when(F.abs(x) < 1e-3, plain).otherwise(exact)


def _shift(mantissa: Column, power: Column) -> Column:
    """Digits of mantissa E power without an exponent, for a power of 7 to 20."""
    sign = F.when(F.startswith(mantissa, F.lit("-")), "-").otherwise("")
    digits = F.regexp_replace(mantissa, "-", "")
    whole = F.regexp_replace(digits, r"\.", "")
    size = power.cast("int") + 1
    padded = F.rpad(whole, 40, "0")
    left, right = F.substr(padded, F.lit(1), size), F.regexp_replace(F.substr(whole, size + 1), "0+$", "")
    return F.concat(sign, left, F.when(F.length(right) > 0, F.concat(F.lit("."), right)).otherwise(""))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    arcs: DataFrame
    directed: bool
    weighted: bool

    # ---- making

    @classmethod
    def empty(cls, spark: SparkSession, directed: bool, weighted: bool) -> Graph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], ARCS), directed, weighted)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, directed: bool, weighted: bool, check: bool = True) -> Graph:
        """From nodes(id[, tags]) and edges(src, dst[, weight]), each edge once. Undirected
        edges are mirrored. check: whether rules are tested, at the cost of a few jobs."""
        tags = F.col("tags") if "tags" in nodes.columns else F.create_map().cast("map<string,string>")
        if weighted != ("weight" in edges.columns):
            raise GraphError("weights belong to weighted graphs, and only to them")
        weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
        arcs = edges.select(F.col("src").cast("string"), F.col("dst").cast("string"), weight.alias("weight"))
        if not directed:
            arcs = arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        made = cls(nodes.select(F.col("id").cast("string"), tags.alias("tags")), arcs, directed, weighted)
        return made.checked() if check else made

    @classmethod
    def from_matrix(cls, rows: DataFrame, directed: bool, weighted: bool) -> Graph:
        """From rows (id, cells array<double>) of a square matrix, in order of id; 0 is no arc."""
        from meshweave.operators.generators import ordered

        order = ordered(rows.select("id"), "id").select("id", (F.col("at") + 1).alias("i"))
        cells = rows.select(F.col("id").alias("src"), F.posexplode("cells").alias("j", "weight")).where("weight <> 0")
        arcs = cells.join(order.select(F.col("id").alias("dst"), (F.col("i") - 1).alias("j")), "j").select("src", "dst", F.col("weight") if weighted else F.lit(1.0).alias("weight"))
        return cls(rows.select("id", F.create_map().cast("map<string,string>").alias("tags")), arcs, directed, weighted).checked()

    def checked(self) -> Graph:
        """Self, or GraphError for the first rule that is broken."""
        a, ids = self.arcs, self.nodes.select("id")
        if not self.nodes.where("id is null").isEmpty() or not ids.groupBy("id").count().where("count > 1").isEmpty():
            raise GraphError("node ids are unique and not null")
        ends = a.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if not ends.join(ids, "id", "left_anti").isEmpty():
            raise GraphError("both ends of an edge are nodes")
        bad = "weight is null or not weight > 0" if self.weighted else "weight is null or weight <> 1"
        if not a.where(bad).isEmpty():
            raise GraphError("weights are greater than 0, or 1 in an unweighted graph")
        if not self.directed and not a.where("src = dst").isEmpty():
            raise GraphError("an undirected graph has no loops")
        if not a.groupBy("src", "dst").count().where("count > 1").isEmpty():
            raise GraphError("an arc occurs once")
        if not self.directed:
            back = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w2"))
            if not a.join(back, ["src", "dst"], "left").where("w2 is null or w2 <> weight").isEmpty():
                raise GraphError("an undirected edge has two arcs of one weight")
        return self

    def stashed(self) -> Graph:
        """The same graph, computed once."""
        return replace(self, nodes=stash(self.nodes), arcs=stash(self.arcs))

    # ---- nodes

    def has_node(self, node: str) -> bool:
        return not self.nodes.where(F.col("id") == node).isEmpty()

    def node(self, node: str) -> DataFrame:
        self._need(node)
        return self.nodes.where(F.col("id") == node)

    def _need(self, node: str) -> None:
        if not self.has_node(node):
            raise GraphError(f"no node {node}")

    def node_ids(self) -> DataFrame:
        return self.nodes.select("id").orderBy("id")

    def size(self) -> int:
        return self.nodes.count()

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """nodes(id[, tags]); one that is there is an error."""
        if not nodes.join(self.nodes, "id", "left_semi").isEmpty() or not nodes.groupBy("id").count().where("count > 1").isEmpty():
            raise GraphError("a node is there already")
        tags = F.col("tags") if "tags" in nodes.columns else F.create_map().cast("map<string,string>")
        return replace(self, nodes=self.nodes.unionByName(nodes.select("id", tags.alias("tags"))))

    def add_node(self, node: str) -> Graph:
        return self.add_nodes(self.nodes.sparkSession.createDataFrame([(node,)], "id string"))

    def remove_nodes(self, ids: DataFrame) -> Graph:
        """ids(id); arcs from and to them go as well."""
        if not ids.join(self.nodes, "id", "left_anti").isEmpty():
            raise GraphError("no such node")
        arcs = self.arcs.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
        return replace(self, nodes=self.nodes.join(ids, "id", "left_anti").select("id", "tags"), arcs=arcs.select("src", "dst", "weight"))

    def remove_node(self, node: str) -> Graph:
        return self.remove_nodes(self.nodes.sparkSession.createDataFrame([(node,)], "id string"))

    # ---- edges

    def add_edges(self, edges: DataFrame) -> Graph:
        """edges(src, dst[, weight]), all or none."""
        more = Graph.of(self.nodes, edges, self.directed, self.weighted, check=False)
        return replace(self, arcs=self.arcs.unionByName(more.arcs)).checked()

    def add_edge(self, src: str, dst: str, weight: float | None = None) -> Graph:
        if self.weighted != (weight is not None):
            raise GraphError("weights belong to weighted graphs, and only to them")
        row, kind = ((src, dst), "src string, dst string") if weight is None else ((src, dst, float(weight)), ARCS)
        return self.add_edges(self.nodes.sparkSession.createDataFrame([row], kind))

    def remove_edges(self, edges: DataFrame) -> Graph:
        """edges(src, dst); one that is not there is an error."""
        gone = edges.select("src", "dst")
        if not self.directed:
            gone = gone.unionByName(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        if not gone.join(self.arcs, ["src", "dst"], "left_anti").isEmpty():
            raise GraphError("no such edge")
        return replace(self, arcs=self.arcs.join(gone, ["src", "dst"], "left_anti").select("src", "dst", "weight"))

    def remove_edge(self, src: str, dst: str) -> Graph:
        return self.remove_edges(self.nodes.sparkSession.createDataFrame([(src, dst)], "src string, dst string"))

    def has_edge(self, src: str, dst: str) -> bool:
        return not self.arcs.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def edge_weight(self, src: str, dst: str) -> float:
        got = self.arcs.where((F.col("src") == src) & (F.col("dst") == dst)).select("weight").take(1)
        if not got:
            raise GraphError(f"no edge {src} {dst}")
        return got[0][0]

    def edge_count(self) -> int:
        """Arcs: an undirected edge counts twice."""
        return self.arcs.count()

    def neighbors(self, node: str) -> DataFrame:
        return self.arcs.where(F.col("src") == node).select(F.col("dst").alias("id"))

    def degrees(self) -> DataFrame:
        """Rows (id, degree): out-arcs, a loop once."""
        out = self.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    # ---- tags

    def _tags(self, node: str, change: Column) -> Graph:
        return replace(self, nodes=self.nodes.withColumn("tags", F.when(F.col("id") == node, change).otherwise(F.col("tags"))))

    def has_tag(self, node: str, key: str) -> bool:
        return not self.node(node).where(F.map_contains_key("tags", key)).isEmpty()

    def tag(self, node: str, key: str) -> str | None:
        return self.node(node).select(F.try_element_at("tags", F.lit(key))).first()[0]

    def add_tag(self, node: str, key: str, value: str) -> Graph:
        if self.has_tag(node, key):
            raise GraphError(f"node {node} has a tag {key}")
        return self.update_tag(node, key, value)

    def update_tag(self, node: str, key: str, value: str) -> Graph:
        self._need(node)
        return self._tags(node, F.map_concat(F.map_filter("tags", lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value))))

    def remove_tag(self, node: str, key: str) -> Graph:
        if not self.has_tag(node, key):
            raise GraphError(f"node {node} has no tag {key}")
        return self._tags(node, F.map_filter("tags", lambda k, _: k != key))

    # ---- paths

    def paths(self, sequences: DataFrame) -> DataFrame:
        """Of rows (path_id, nodes array<string>): rows (path_id, nodes, weights, total,
        missing). weights start with a 0 for the first node; missing is the first pair
        without an arc, or null. An empty sequence is an empty path."""
        hops = sequences.select("path_id", F.posexplode("nodes").alias("at", "dst")).withColumn("src", F.lag("dst").over(W.partitionBy("path_id").orderBy("at")))
        met = hops.join(self.arcs, ["src", "dst"], "left").withColumn("w", F.when(F.col("at") == 0, 0.0).otherwise(F.col("weight")))
        lacking = F.min(F.when(F.col("w").isNull(), F.struct("at", "src", "dst")))
        summed = met.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("weights"), lacking.alias("lacking"))
        out = sequences.join(summed, "path_id", "left")
        total = F.aggregate(F.coalesce("weights", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
        return out.select("path_id", "nodes", F.coalesce("weights", F.array().cast("array<double>")).alias("weights"), F.when(F.col("lacking").isNull(), total).alias("total"), F.when(F.col("lacking").isNotNull(), F.concat_ws(" ", "lacking.src", "lacking.dst")).alias("missing"))

    def path(self, *nodes: str) -> tuple[list[str], list[float], float]:
        """One path: its nodes, weights and total; GraphError if an edge is missing."""
        if not nodes:
            return [], [], 0.0
        row = self.paths(self.nodes.sparkSession.createDataFrame([(0, list(nodes))], "path_id int, nodes array<string>")).first()
        if row["missing"] is not None:
            raise GraphError(f"no edge {row['missing']}")
        return row["nodes"], row["weights"], row["total"]

    # ---- forms

    def lines(self) -> DataFrame:
        """Rows (id, line): the node's part of the text dump."""
        out = self.arcs.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", number_text(F.col("weight")).alias("w")))).alias("out"))
        pairs = F.transform(F.coalesce("out", F.array().cast("array<struct<dst:string,w:string>>")), lambda x: F.concat(x["dst"], F.lit(":"), x["w"]))
        return self.nodes.select("id").join(out, "id", "left").select("id", F.concat(F.lit("    "), "id", F.lit(": map["), F.array_join(pairs, " "), F.lit("]\n")).alias("line"))

    def node_texts(self) -> DataFrame:
        """Rows (id, text): each node with its arcs, as text."""
        arcs = F.regexp_extract("line", r": (map\[.*\])\n$", 1)
        return self.lines().select("id", F.concat(F.lit("Node(ID: "), "id", F.lit(", Edges: "), arcs, F.lit(")")).alias("text"))

    def text(self) -> DataFrame:
        """One row (text): header, flags and a line per node, in order of ids."""
        body = self.lines().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "").alias("body"))
        head = f"Graph:\n  Directed: {str(self.directed).lower()}\n  Weighted: {str(self.weighted).lower()}\n  Nodes:\n"
        return body.select(F.concat(F.lit(head), F.coalesce("body", F.lit(""))).alias("text"))

    def hash(self) -> str:
        """Hex SHA-256 of the text dump: flags, nodes, arcs and weights, but no tags."""
        return self.text().select(F.sha2("text", 256)).first()[0]

    def digests(self, digits: int = DIGITS) -> list[DataFrame]:
        """A tree of digests, from the leaves to the root: rows (prefix, digest) for
        prefixes of `digits`, `digits` - 1, .. 0 hex digits. A leaf is the SHA-256 of a node
        or an arc with its weight; a digest is that of the sorted ones under its prefix, so
        leaves are dealt evenly and no row grows with the graph if digits do."""
        node = F.concat(F.lit("n"), F.length("id"), F.lit(":"), "id")
        arc = F.concat(F.lit("a"), F.length("src"), F.lit(":"), "src", F.length("dst"), F.lit(":"), "dst", number_text(F.col("weight")))
        leaves = self.nodes.select(F.sha2(node, 256).alias("digest")).unionByName(self.arcs.select(F.sha2(arc, 256).alias("digest")))
        level, out = leaves.withColumn("prefix", F.substr("digest", F.lit(1), F.lit(digits))), []
        for k in range(digits, -1, -1):
            joined = F.array_join(F.array_sort(F.collect_list(F.concat("prefix", "digest"))), "")
            level = level.groupBy(F.substr("prefix", F.lit(1), F.lit(k)).alias("at")).agg(F.sha2(joined, 256).alias("digest")).select(F.col("at").alias("prefix"), "digest")
            out.append(level)
        return out

    def fingerprint(self, digits: int = DIGITS) -> str:
        """Hex digest of flags, nodes, arcs and weights, without the graph in one row. Equal
        for equal graphs, whoever made them and however they are partitioned."""
        root = self.digests(digits)[-1].first()
        flags = f"{str(self.directed).lower()},{str(self.weighted).lower()},"
        return hashlib.sha256((flags + (root["digest"] if root else "")).encode()).hexdigest()

    def changes(self, other: Graph, digits: int = DIGITS) -> DataFrame:
        """Rows (kind, src, dst, mine, other) of nodes and arcs that only one graph has, or
        of which weights differ. Only those parts of both are compared whose digests differ."""
        mine, theirs = self.digests(digits)[0], other.digests(digits)[0].withColumnRenamed("digest", "d2")
        parts = mine.join(theirs, "prefix", "full").where(~F.col("digest").eqNullSafe(F.col("d2"))).select("prefix")

        def rows(g: Graph, name: str) -> DataFrame:
            node = F.concat(F.lit("n"), F.length("id"), F.lit(":"), "id")
            arc = F.concat(F.lit("a"), F.length("src"), F.lit(":"), "src", F.length("dst"), F.lit(":"), "dst", number_text(F.col("weight")))
            every = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(1.0).alias(name), F.sha2(node, 256).alias("h"))
            every = every.unionByName(g.arcs.select(F.lit("arc").alias("kind"), "src", "dst", F.col("weight").alias(name), F.sha2(arc, 256).alias("h")))
            return every.join(parts, F.substr("h", F.lit(1), F.lit(digits)) == F.col("prefix"), "left_semi").drop("h")

        a, b = rows(self, "mine").alias("a"), rows(other, "other").alias("b")
        same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.src") == F.col("b.src")) & F.col("a.dst").eqNullSafe(F.col("b.dst"))
        met = a.join(b, same, "full").where(~F.col("mine").eqNullSafe(F.col("other")))
        return met.select(F.coalesce("a.kind", "b.kind").alias("kind"), F.coalesce("a.src", "b.src").alias("src"), F.coalesce("a.dst", "b.dst").alias("dst"), "mine", "other")

    def _numbered(self) -> DataFrame:
        """Rows (id, at): nodes in order of ids, from 0."""
        from meshweave.operators.generators import ordered

        return stash(ordered(self.nodes.select("id"), "id").select("id", "at"))

    def matrix(self) -> DataFrame:
        """Rows (id, cells array<double>) of the dense matrix, cells in order of ids. Arcs
        are gathered by row, and the rest of a row is zeros."""
        at, n = self._numbered(), self.size()
        cells = self.arcs.join(at.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("at", "weight"))).alias("w"))
        every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("w", i.cast("long")), F.lit(0.0)))
        return at.select("id").join(cells, "id", "left").select("id", every.alias("cells"))

    def tiles(self, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
        """The matrix in square tiles, and the order of its nodes (id, at). A row (i, j,
        starts, columns, weights) is tile i, j in compressed rows: row r has the columns and
        weights from starts[r] to starts[r + 1]. Tiles without arcs have no row, and none
        holds more than side * side weights, whatever the degrees."""
        at = self._numbered()
        ends = self.arcs.join(at.select(F.col("id").alias("src"), F.col("at").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("at").alias("b")), "dst")
        cut = lambda c: (F.floor(F.col(c) / side).cast("long"), (F.col(c) % side).cast("int"))
        (i, r), (j, c) = cut("a"), cut("b")
        cells = ends.select(i.alias("i"), j.alias("j"), F.struct(r.alias("r"), c.alias("c"), "weight").alias("x")).groupBy("i", "j").agg(F.array_sort(F.collect_list("x")).alias("x"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(side)), lambda k: F.size(F.filter("x", lambda y: y["r"] < k)))
        return cells.select("i", "j", counts.alias("starts"), F.transform("x", lambda y: y["c"]).alias("columns"), F.transform("x", lambda y: y["weight"]).alias("weights")), at

    def serialize(self) -> DataFrame:
        """One row (json) of nodes with their arcs, and the flags; no tags."""
        if not self.arcs.where("isnan(weight) or abs(weight) = double('inf')").isEmpty():
            raise GraphError("weights that are no finite numbers have no JSON form")
        out = self.arcs.groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dst", "weight")))).alias("out"))
        nodes = self.nodes.select("id").join(out, "id", "left").select("id", F.coalesce("out", F.create_map().cast("map<string,double>")).alias("out"))
        whole = nodes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.map_entries("out").alias("e"))))).alias("m")).select(F.transform_values("m", lambda _, v: F.map_from_entries(v)).alias("nodes"))
        return whole.select(F.to_json(F.struct("nodes", F.lit(self.directed).alias("directed"), F.lit(self.weighted).alias("weighted"))).alias("json"))

    @classmethod
    def from_tiles(cls, tiles: DataFrame, order: DataFrame, directed: bool, weighted: bool, side: int = SIDE) -> Graph:
        """From what tiles() gives."""
        row = F.inline(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.struct(r.alias("r"), F.get("starts", r).alias("lo"), F.get("starts", r + 1).alias("hi"))))
        rows = tiles.select("i", "j", "columns", "weights", row).where("hi > lo")
        cells = rows.select((F.col("i") * side + F.col("r")).alias("a"), "j", F.inline(F.arrays_zip(F.slice("columns", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("c"), F.slice("weights", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("weight"))))
        arcs = cells.select("a", (F.col("j") * side + F.col("c")).alias("b"), "weight").join(order.select(F.col("id").alias("src"), F.col("at").alias("a")), "a").join(order.select(F.col("id").alias("dst"), F.col("at").alias("b")), "b")
        return cls(order.select("id", F.create_map().cast("map<string,string>").alias("tags")), arcs.select("src", "dst", "weight"), directed, weighted)

    def free(self) -> Graph:
        """An empty graph with the same flags."""
        return Graph.empty(self.nodes.sparkSession, self.directed, self.weighted)


def deserialize(rows: DataFrame, column: str = "json") -> Graph:
    """From one row of JSON text as serialize() writes it."""
    got = rows.select(F.from_json(column, JSON).alias("g")).select("g.*")
    flags = got.select("directed", "weighted").first()
    if flags is None or flags["directed"] is None or flags["weighted"] is None:
        raise GraphError("not a graph in JSON")
    return _from_maps(got, flags["directed"], flags["weighted"])


def _from_maps(got: DataFrame, directed: bool, weighted: bool) -> Graph:
    outs = got.select(F.explode("nodes").alias("id", "out"))
    arcs = outs.select(F.col("id").alias("src"), F.explode("out").alias("dst", "weight"))
    return Graph(outs.select("id", F.create_map().cast("map<string,string>").alias("tags")), arcs, directed, weighted).checked()


def node_rows(spark: SparkSession, ids: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")
