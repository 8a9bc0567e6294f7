"""Named queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import fields, is_dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshweave import config
from meshweave.analyzer import Analyzer
from meshweave.functions import rng
from meshweave.graph import Graph, GraphError, deserialize, node_rows
from meshweave.operators import bits, centrality, community, generators, paths, report, structure
from meshweave.operators.bimap import Bimap
from meshweave.plans import sql
from meshweave.session import shared_dir, stash
from meshweave.sources import files, tables
from meshweave.streaming import live, propagation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TINY = 1e-300  # a tolerance that no iteration meets: rounds are then fixed


def query(oracle: str | None = None, base: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. base: SQL of its graph."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {base} {oracle}" if base else oracle
        return f

    return keep


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Values to nine digits: sums in another order differ beyond."""
    return df.select(*[F.round(c, 9).alias(c) if c in (names or ("value",)) else F.col(c) for c in df.columns])


# ---- degrees and distances


@query(sql.degree("out"), sql.SUPPLIERS)
def degree_undirected(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.degree(tables.suppliers(spark, d)))


@query(sql.degree("total"), sql.USERS)
def degree_total(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.degree(tables.users(spark, d)))


@query(sql.degree("in"), sql.USERS)
def degree_in(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.degree(tables.users(spark, d), config.Degree("in")))


@query(sql.degree("out"), sql.USERS)
def degree_out(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.degree(tables.users(spark, d), config.Degree("out")))


@query("SELECT src, dst, dist, hops, sigma FROM pairs", sql.SUPPLIERS + sql.PAIRS)
def all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return paths.pairs(tables.suppliers(spark, d))


@query("SELECT src, dst, dist, hops, sigma FROM pairs", sql.NATIONS + sql.WEIGHTED_PAIRS)
def all_pairs_weighted(spark: SparkSession, d: str) -> DataFrame:
    return paths.pairs(tables.nations(spark, d))


@query(sql.DIAMETER, sql.SUPPLIERS + sql.PAIRS)
def diameter(spark: SparkSession, d: str) -> DataFrame:
    return paths.diameter_of(tables.suppliers(spark, d))


@query(sql.DIAMETER, sql.NATIONS + sql.WEIGHTED_PAIRS)
def diameter_weighted(spark: SparkSession, d: str) -> DataFrame:
    return paths.diameter_of(tables.nations(spark, d))


@query(""", ends AS (SELECT min(id) AS s, max(id) AS t FROM nodes),
onway AS (SELECT q.dst AS id, q.hops FROM ends JOIN pairs p ON p.src = s AND p.dst = t JOIN pairs q ON q.src = s JOIN pairs r ON r.src = q.dst AND r.dst = t WHERE q.hops + r.hops = p.hops),
found AS (SELECT s AS head, s AS path, 0 AS d FROM ends UNION ALL SELECT arcs.dst, path || '>' || arcs.dst, d + 1 FROM found JOIN arcs ON arcs.src = head JOIN onway ON id = arcs.dst AND hops = d + 1)
SELECT path, d::DOUBLE AS total FROM found, ends WHERE head = t""", sql.SUPPLIERS + sql.PAIRS)
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    g = tables.suppliers(spark, d)
    ends = g.nodes.agg(F.min("id"), F.max("id")).first()
    return paths.shortest_paths(g, ends[0], ends[1]).select(F.array_join("nodes", ">").alias("path"), "total")


@query(sql.closeness("dst", True), sql.SUPPLIERS + sql.PAIRS)
def closeness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.closeness(tables.suppliers(spark, d)))


@query(sql.closeness("dst", True), sql.USERS + sql.PAIRS)
def closeness_directed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.closeness(tables.users(spark, d)))


@query(sql.closeness("src", True), sql.USERS + sql.PAIRS)
def closeness_reverse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.closeness(tables.users(spark, d), config.Closeness(reverse=True)))


@query(sql.closeness("dst", False), sql.USERS + sql.PAIRS)
def closeness_plain(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.closeness(tables.users(spark, d), config.Closeness(wf_improved=False)))


@query(sql.closeness("dst", True), sql.NATIONS + sql.WEIGHTED_PAIRS)
def closeness_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.closeness(tables.nations(spark, d)))


@query(sql.betweenness(False), sql.SUPPLIERS + sql.PAIRS)
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.betweenness(tables.suppliers(spark, d)))


@query(sql.betweenness(True), sql.USERS + sql.PAIRS)
def betweenness_directed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.betweenness(tables.users(spark, d)))


@query(sql.betweenness(True), sql.NATIONS + sql.WEIGHTED_PAIRS)
def betweenness_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.betweenness(tables.nations(spark, d)))


@query(sql.edge_betweenness(False), sql.SUPPLIERS + sql.PAIRS)
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.edge_betweenness(tables.suppliers(spark, d)))


@query(sql.edge_betweenness(True), sql.USERS + sql.PAIRS)
def edge_betweenness_directed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.edge_betweenness(tables.users(spark, d)))


# ---- iterations


@query(sql.page_rank(20, 0.85), sql.SUPPLIERS)
def page_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.page_rank(tables.suppliers(spark, d), config.PageRank(max_iter=20, tol=TINY)))


@query(sql.page_rank(8, 0.85), sql.LINKS)
def page_rank_dangling(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.page_rank(tables.links(spark, d), config.PageRank(max_iter=8, tol=TINY)))


PREFERRED = "(CASE WHEN id::BIGINT % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END) / (SELECT count(*) FROM nodes WHERE id::BIGINT % 3 = 0)"


@query(sql.page_rank(10, 0.5, PREFERRED), sql.USERS)
def page_rank_personalized(spark: SparkSession, d: str) -> DataFrame:
    g = tables.users(spark, d)
    wanted = g.nodes.where(F.col("id").cast("long") % 3 == 0).select("id", F.lit(1.0).alias("value"))
    return rounded(centrality.page_rank(g, config.PageRank(alpha=0.5, max_iter=10, tol=TINY, personalization=wanted)))


@query(sql.page_rank(10, 0.85, src="dst", dst="src"), sql.USERS)
def page_rank_reverse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.page_rank(tables.users(spark, d), config.PageRank(max_iter=10, tol=TINY, reverse=True)))


@query(sql.eigenvector(15), sql.SUPPLIERS)
def eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.eigenvector(tables.suppliers(spark, d), config.Eigenvector(max_iter=15, tol=TINY)))


@query(sql.eigenvector(10), sql.USERS)
def eigenvector_directed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.eigenvector(tables.users(spark, d), config.Eigenvector(max_iter=10, tol=TINY)))


@query(sql.eigenvector(10, "dst", "src"), sql.USERS)
def eigenvector_reverse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(centrality.eigenvector(tables.users(spark, d), config.Eigenvector(max_iter=10, tol=TINY, reverse=True)))


# ---- structure


@query(sql.CLUSTERING, sql.SUPPLIERS)
def clustering(spark: SparkSession, d: str) -> DataFrame:
    return rounded(structure.clustering(tables.suppliers(spark, d)))


@query(sql.CLUSTERING_DIRECTED, sql.USERS)
def clustering_directed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(structure.clustering(tables.users(spark, d)))


@query(sql.CLUSTERING.replace("SELECT id, round(", "SELECT round(avg(").replace(" END, 9) AS value", " END), 9) AS value"), sql.SUPPLIERS)
def clustering_average(spark: SparkSession, d: str) -> DataFrame:
    return rounded(structure.average_clustering(structure.clustering(tables.suppliers(spark, d))))


@query(sql.assortativity("out", "out", False), sql.SUPPLIERS)
def assortativity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(structure.assortativity(tables.suppliers(spark, d)))


def _assortativity(mode: str) -> None:
    first, second = mode.split("-")

    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(structure.assortativity(tables.users(spark, d), config.Assortativity(mode)))

    run.__name__ = f"assortativity_{first}_{second}"
    query(sql.assortativity(first, second, True), sql.USERS)(run)


for _mode in ("out-in", "out-out", "in-in", "in-out"):
    _assortativity(_mode)


@query(sql.MODULARITY, sql.NATIONS)
def modularity(spark: SparkSession, d: str) -> DataFrame:
    regions = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("int").alias("community"))
    return rounded(structure.modularity(tables.nations(spark, d), regions))


@query(sql.GREEDY, sql.SUPPLIERS)
def greedy_communities(spark: SparkSession, d: str) -> DataFrame:
    return community.greedy(tables.suppliers(spark, d))


@query("SELECT src, dst, hops::BIGINT AS dist FROM pairs", sql.USERS + sql.PAIRS)
def path_lengths(spark: SparkSession, d: str) -> DataFrame:
    return bits.lengths(tables.users(spark, d))


@query(", reach AS (SELECT id, id AS c FROM nodes UNION SELECT r.id, x.t FROM reach r JOIN (SELECT src AS s, dst AS t FROM arcs UNION SELECT dst, src FROM arcs) x ON x.s = r.c) SELECT id, min(c) AS component FROM reach GROUP BY id", sql.SUPPLIERS)
def components(spark: SparkSession, d: str) -> DataFrame:
    return paths.components(tables.suppliers(spark, d))


# ---- the graph itself


@query(sql.TEXT, sql.NATIONS)
def graph_text_and_hash(spark: SparkSession, d: str) -> DataFrame:
    return tables.nations(spark, d).text().select("text", F.sha2("text", 256).alias("hash"))


@query(sql.MATRIX, sql.NATIONS)
def matrix(spark: SparkSession, d: str) -> DataFrame:
    return tables.nations(spark, d).matrix().select("id", F.array_join(F.transform("cells", lambda x: x.cast("long").cast("string")), " ").alias("cells"))


@query("SELECT src, dst, weight FROM arcs", sql.NATIONS)
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return deserialize(tables.nations(spark, d).serialize()).arcs


@query("SELECT src, dst, weight FROM arcs", sql.SUPPLIERS)
def legacy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return files.parse(files.write_legacy(tables.suppliers(spark, d)).select(F.col("text").alias("json"))).arcs


@query("SELECT src, dst, 1.0::DOUBLE AS weight FROM arcs", sql.NATIONS)
def from_matrix(spark: SparkSession, d: str) -> DataFrame:
    return Graph.from_matrix(tables.nations(spark, d).matrix(), True, False).arcs


@query("SELECT id, count(src) AS degree FROM nodes LEFT JOIN arcs ON src = id GROUP BY id", sql.USERS)
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return tables.users(spark, d).degrees()


@query("SELECT dst AS id FROM arcs WHERE src = (SELECT min(id) FROM nodes)", sql.USERS)
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = tables.users(spark, d)
    return g.neighbors(g.nodes.agg(F.min("id")).first()[0])


@query("SELECT count(*) AS arcs, (SELECT count(*) FROM nodes) AS nodes FROM arcs", sql.USERS)
def counts(spark: SparkSession, d: str) -> DataFrame:
    g = tables.users(spark, d)
    return g.arcs.agg(F.count("*").alias("arcs")).crossJoin(g.nodes.agg(F.count("*").alias("nodes")))


@query("SELECT src, dst, weight FROM arcs WHERE src::BIGINT % 10 <> 0 AND dst::BIGINT % 10 <> 0", sql.USERS)
def remove_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = tables.users(spark, d)
    return g.remove_nodes(g.nodes.where(F.col("id").cast("long") % 10 == 0).select("id")).arcs


@query("SELECT src, dst, weight FROM arcs WHERE (src::BIGINT + dst::BIGINT) % 5 <> 0", sql.SUPPLIERS)
def remove_edges(spark: SparkSession, d: str) -> DataFrame:
    g = tables.suppliers(spark, d)
    gone = g.arcs.where((F.col("src").cast("long") + F.col("dst").cast("long")) % 5 == 0).where("src < dst")
    return g.remove_edges(gone.select("src", "dst")).arcs


@query("SELECT src, dst, weight FROM arcs UNION SELECT id || 'x', id, 1.0 FROM nodes UNION SELECT id, id || 'x', 1.0 FROM nodes", sql.SUPPLIERS)
def add_nodes_and_edges(spark: SparkSession, d: str) -> DataFrame:
    g = tables.suppliers(spark, d)
    more = g.nodes.select(F.concat("id", F.lit("x")).alias("id"))
    return g.add_nodes(more).add_edges(more.select(F.col("id").alias("src"), F.regexp_replace("id", "x", "").alias("dst"))).arcs


@query("SELECT a.src || '>' || a.dst AS path_id, a.weight + b.weight AS total FROM arcs a JOIN arcs b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst", sql.NATIONS)
def path_totals(spark: SparkSession, d: str) -> DataFrame:
    """There and back over every arc but loops."""
    g = tables.nations(spark, d)
    ways = g.arcs.where("src <> dst").select(F.concat_ws(">", "src", "dst").alias("path_id"), F.array("src", "dst", "src").alias("nodes"))
    return g.paths(ways).where("missing is null").select("path_id", "total")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, 'yes' AS seen FROM nation WHERE n_nationkey = 3")
def tags(spark: SparkSession, d: str) -> DataFrame:
    nodes = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("old"), F.lit("x")).alias("tags"))
    g = Graph(nodes, tables.nations(spark, d).arcs, True, True).add_tag("3", "seen", "no").update_tag("3", "seen", "yes").remove_tag("3", "old")
    return g.node("3").select("id", F.col("tags")["name"].alias("name"), F.col("tags")["seen"].alias("seen"))


FIRST = "(SELECT min((src, dst)) AS p FROM arcs)"


@query(f"SELECT true AS has_node, false AS has_other, true AS has_edge, false AS has_far_edge, weight AS edge_weight, (SELECT count(*) FROM nodes) AS size, (SELECT count(*) FROM arcs) AS edge_count, true AS directed, true AS weighted FROM arcs, {FIRST} WHERE src = p[1] AND dst = p[2]", sql.NATIONS)
def lookups(spark: SparkSession, d: str) -> DataFrame:
    g = tables.nations(spark, d)
    src, dst = g.arcs.agg(F.min(F.struct("src", "dst")).alias("p")).select("p.*").first()
    row = (g.has_node(src), g.has_node("nowhere"), g.has_edge(src, dst), g.has_edge(src, "nowhere"), g.edge_weight(src, dst), g.size(), g.edge_count(), g.directed, g.weighted)
    return spark.createDataFrame([row], "has_node boolean, has_other boolean, has_edge boolean, has_far_edge boolean, edge_weight double, size long, edge_count long, directed boolean, weighted boolean")


@query("SELECT id FROM nodes", sql.SUPPLIERS)
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    return tables.suppliers(spark, d).node_ids()


@query("SELECT id, 'Node(ID: ' || id || ', Edges: map[' || coalesce(string_agg(dst || ':' || weight::BIGINT, ' ' ORDER BY dst), '') || '])' AS text FROM nodes LEFT JOIN arcs ON src = id GROUP BY id", sql.NATIONS)
def node_texts(spark: SparkSession, d: str) -> DataFrame:
    return tables.nations(spark, d).node_texts()


@query("SELECT sha256(text) AS hash FROM whole", sql.NATIONS + sql.TEXT[: sql.TEXT.index(" SELECT text, sha256")])
def graph_hash(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(tables.nations(spark, d).hash(),)], "hash string")


@query("SELECT n_name AS tag, true AS has_tag, false AS has_other FROM nation WHERE n_nationkey = 3")
def tag_lookups(spark: SparkSession, d: str) -> DataFrame:
    nodes = tables.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.create_map(F.lit("name"), F.col("n_name")).alias("tags"))
    g = Graph(nodes, tables.nations(spark, d).arcs, True, True)
    return spark.createDataFrame([(g.tag("3", "name"), g.has_tag("3", "name"), g.has_tag("3", "other"))], "tag string, has_tag boolean, has_other boolean")


@query("SELECT 0::BIGINT AS nodes, 0::BIGINT AS arcs, true AS directed, true AS weighted")
def freed(spark: SparkSession, d: str) -> DataFrame:
    g = tables.nations(spark, d).free()
    return spark.createDataFrame([(g.size(), g.edge_count(), g.directed, g.weighted)], "nodes long, arcs long, directed boolean, weighted boolean")


#: Of the rules of the data model: what breaks one, as (nodes, edges, directed, weighted).
BROKEN = {
    "a node twice": (["a", "a"], [], True, False),
    "an end that is no node": (["a"], [("a", "b")], True, False),
    "a weight of 0": (["a", "b"], [("a", "b", 0.0)], True, True),
    "a weight of an unweighted graph": (["a", "b"], [("a", "b", 2.0)], True, False),
    "a loop without directions": (["a"], [("a", "a")], False, False),
    "an edge twice": (["a", "b"], [("a", "b"), ("a", "b")], True, False),
    "an edge both ways without directions": (["a", "b"], [("a", "b"), ("b", "a")], False, False),
    "no rule": (["a", "b"], [("a", "b")], False, False),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {str(name != 'no rule').lower()})" for name in BROKEN) + ") t(rule, refused)")
def broken_rules(spark: SparkSession, d: str) -> DataFrame:
    def refused(nodes: list, edges: list, directed: bool, weighted: bool) -> bool:
        kind = "src string, dst string" + (", weight double" if edges and len(edges[0]) == 3 or weighted else "")
        try:
            Graph.of(node_rows(spark, nodes), spark.createDataFrame(edges, kind), directed, weighted)
        except GraphError:
            return True
        return False

    return spark.createDataFrame([(name, refused(*case)) for name, case in BROKEN.items()], "rule string, refused boolean")


@query("SELECT src, dst, dist, hops, sigma FROM pairs", sql.NATIONS + sql.WEIGHTED_PAIRS)
def analyzer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The kept pair table, made anew after the cache was cleared."""
    a = Analyzer(tables.nations(spark, d))
    before = a.pairs()
    if a.pairs() is not before:
        raise GraphError("the pair table is not kept")
    a.clear_cache()
    return a.pairs()


def _fields(prefix: str, c: object) -> list[tuple[str, str]]:
    return [x for f in fields(c) for x in (_fields(f"{f.name}.", getattr(c, f.name)) if is_dataclass(getattr(c, f.name)) else [(prefix + f.name, str(getattr(c, f.name)).lower())])]


@query("""SELECT * FROM (VALUES ('degree.mode', 'total'), ('closeness.wf_improved', 'true'), ('closeness.reverse', 'false'), ('betweenness.normalized', 'true'), ('edge_betweenness.normalized', 'true'),
('page_rank.alpha', '0.85'), ('page_rank.max_iter', '100'), ('page_rank.tol', '1e-06'), ('page_rank.personalization', 'none'), ('page_rank.dangling', 'none'), ('page_rank.reverse', 'false'),
('eigenvector.max_iter', '100'), ('eigenvector.tol', '1e-06'), ('eigenvector.start', 'none'), ('eigenvector.reverse', 'false'), ('assortativity.mode', 'projected'), ('assortativity.ignore_loops', 'true'), ('modularity.partition', 'none')) t(name, value)""")
def default_settings(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_fields("", config.Config()), "name string, value string")


def _inline(text: str) -> str:
    """A tail of common tables and a SELECT, as a subquery."""
    return f"(WITH RECURSIVE {text.lstrip(', ')})" if text.startswith(",") else f"({text})"


def _rows(metric: str, text: str, other: str = "NULL::VARCHAR", value: str = "value", key: str = "id") -> str:
    return f"SELECT '{metric}' AS metric, {key} AS id, {other} AS other, {value} AS value FROM {_inline(text)}"


BY_REST = sql.MODULARITY.replace("SELECT n_nationkey::VARCHAR AS id, n_regionkey AS c FROM nation", "SELECT id, id::BIGINT % 4 AS c FROM nodes")
WHOLE = {"key": "NULL::VARCHAR"}
SUITE = [
    _rows("degree_centrality", sql.degree("total")),
    _rows("closeness_centrality", sql.closeness("dst", True)),
    _rows("betweenness_centrality", sql.betweenness(True)),
    _rows("edge_betweenness_centrality", sql.edge_betweenness(True), "dst", key="src"),
    _rows("eigenvector_centrality", sql.eigenvector(10)),
    _rows("page_rank", sql.page_rank(10, 0.85)),
    _rows("clustering_coefficient", sql.CLUSTERING_DIRECTED),
    _rows("clustering_coefficient", sql.CLUSTERING_DIRECTED.replace("SELECT id, round(", "SELECT round(avg(").replace(" END, 9) AS value", " END), 9) AS value"), **WHOLE),
    _rows("degree_assortativity_coefficient", sql.assortativity("out", "in", True), **WHOLE),
    _rows("modularity", BY_REST, **WHOLE),
    _rows("diameter", sql.DIAMETER, value="hops::DOUBLE", **WHOLE),
    _rows("diameter_weight", sql.DIAMETER, value="weight", **WHOLE),
    _rows("shortest_paths", "SELECT src, dst, dist FROM pairs", "dst", "dist", "src"),
]


@query(" UNION ALL ".join(SUITE), sql.USERS + sql.PAIRS)
def metrics_suite(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of one graph, through a sink and back."""
    g = tables.users(spark, d)
    rest = g.nodes.select("id", (F.col("id").cast("long") % 4).cast("int").alias("community"))
    settings = config.Config(page_rank=config.PageRank(max_iter=10, tol=TINY), eigenvector=config.Eigenvector(max_iter=10, tol=TINY), modularity=config.Modularity(rest))
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    files.write_metrics(rounded(Analyzer(g, settings).metrics()), path)
    return files.read_metrics(spark, path)


DOCUMENT = "betweenness_centrality closeness_centrality degree_centrality eigenvector_centrality page_rank".split()
DOCUMENT_TYPE = ", ".join([*[f"{m} map<string, double>" for m in DOCUMENT], *[f"{m} map<string, map<string, double>>" for m in ("shortest_paths", "edge_betweenness_centrality")], *[f"{m} double" for m in ("degree_assortativity_coefficient", "diameter", "diameter_weight", "modularity")], "clustering_coefficient struct<global: double, average: double, local: map<string, double>>"])
PLAIN = sql.NATIONS.replace("count(*)::DOUBLE AS weight", "1.0::DOUBLE AS weight").replace("GROUP BY 1, 2", "WHERE (s_nationkey + c_nationkey) % 3 <> 0 GROUP BY 1, 2")
CLUSTER = {k: f"SELECT metric || '.{k}' AS metric, id, other, value FROM ({SUITE[n]})" for k, n in (("local", 6), ("global", 7), ("average", 7))}


@query(" UNION ALL ".join([*CLUSTER.values(), *[s for n, s in enumerate(SUITE) if n not in (6, 7)]]), PLAIN + sql.PAIRS)
def metrics_document(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of one graph as one JSON document in files, read back from it."""
    weighted = tables.nations(spark, d)
    g = Graph(weighted.nodes, stash(weighted.arcs.where((F.col("src").cast("long") + F.col("dst").cast("long")) % 3 != 0).withColumn("weight", F.lit(1.0))), True, False)
    rest = g.nodes.select("id", (F.col("id").cast("long") % 4).cast("int").alias("community"))
    settings = config.Config(page_rank=config.PageRank(max_iter=10, tol=TINY), eigenvector=config.Eigenvector(max_iter=10, tol=TINY), modularity=config.Modularity(rest))
    path = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    files.write_metrics_document(stash(rounded(Analyzer(g, settings).metrics())), path)
    parts = spark.read.text(path, wholetext=True).select(F.struct(F.input_file_name().alias("file"), "value").alias("part"))
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["value"]), "").alias("json")).select(F.from_json("json", DOCUMENT_TYPE).alias("m")).select("m.*")
    none, rows = F.lit(None).cast("string"), []
    cluster = F.col("clustering_coefficient")
    for m, c in [*[(m, F.col(m)) for m in DOCUMENT], ("clustering_coefficient.local", cluster["local"])]:
        rows.append(whole.select(F.explode(c).alias("id", "value")).select(F.lit(m).alias("metric"), "id", none.alias("other"), "value"))
    for m in ("shortest_paths", "edge_betweenness_centrality"):
        rows.append(whole.select(F.explode(m).alias("id", "to")).select("id", F.explode("to").alias("other", "value")).select(F.lit(m).alias("metric"), "id", "other", "value"))
    for m, c in [*[(m, F.col(m)) for m in ("degree_assortativity_coefficient", "diameter", "diameter_weight", "modularity")], *[(f"clustering_coefficient.{k}", cluster[k]) for k in ("global", "average")]]:
        rows.append(whole.select(F.lit(m).alias("metric"), none.alias("id"), none.alias("other"), c.alias("value")))
    return reduce(DataFrame.unionByName, rows)


# ---- forms in parts


TREE = """, l4 AS (SELECT sha256('n' || length(id) || ':' || id) AS d FROM nodes UNION ALL SELECT sha256('a' || length(src) || ':' || src || length(dst) || ':' || dst || weight::BIGINT) FROM arcs),
l3 AS (SELECT substr(d, 1, 3) AS p, sha256(string_agg(substr(d, 1, 3) || d, '' ORDER BY d)) AS d FROM l4 GROUP BY 1),
l2 AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(p || d, '' ORDER BY p)) AS d FROM l3 GROUP BY 1), l1 AS (SELECT substr(p, 1, 1) AS p, sha256(string_agg(p || d, '' ORDER BY p)) AS d FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS p, sha256(string_agg(p || d, '' ORDER BY p)) AS d FROM l1)
SELECT p AS prefix, d AS digest FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0"""


@query(TREE, sql.SUPPLIERS)
def digests(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, tables.suppliers(spark, d).digests(3))


@query("SELECT 'arc' AS kind, src, dst, weight AS mine, NULL::DOUBLE AS other FROM arcs WHERE (src::BIGINT + dst::BIGINT) % 5 = 0 UNION ALL SELECT 'node', id || 'x', NULL, NULL, 1.0 FROM nodes WHERE id::BIGINT % 9 = 0", sql.SUPPLIERS)
def changes(spark: SparkSession, d: str) -> DataFrame:
    """What a graph and a changed one differ in, found by their digests."""
    g = tables.suppliers(spark, d)
    gone = g.arcs.where((F.col("src").cast("long") + F.col("dst").cast("long")) % 5 == 0).where("src < dst")
    more = g.nodes.where(F.col("id").cast("long") % 9 == 0).select(F.concat("id", F.lit("x")).alias("id"))
    return g.changes(g.remove_edges(gone.select("src", "dst")).add_nodes(more))


TILES = """, place AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM nodes),
c AS (SELECT a.n // 16 AS i, b.n // 16 AS j, a.n % 16 AS r, b.n % 16 AS c, weight FROM arcs JOIN place a ON a.id = src JOIN place b ON b.id = dst)
SELECT i, j, starts, columns, weights FROM (SELECT i, j, string_agg(n::VARCHAR, ' ' ORDER BY k) AS starts FROM (SELECT t.i, t.j, k, count(c.r) AS n FROM (SELECT DISTINCT i, j FROM c) t CROSS JOIN range(17) x(k) LEFT JOIN c ON c.i = t.i AND c.j = t.j AND c.r < k GROUP BY ALL) GROUP BY i, j)
JOIN (SELECT i, j, string_agg(c::VARCHAR, ' ' ORDER BY r, c) AS columns, string_agg(weight::BIGINT::VARCHAR, ' ' ORDER BY r, c) AS weights FROM c GROUP BY i, j) USING (i, j)"""


@query(TILES, sql.SUPPLIERS)
def matrix_tiles(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), " ").alias(c)
    return tables.suppliers(spark, d).tiles(16)[0].select("i", "j", text("starts"), text("columns"), text("weights"))


LAYOUTS = ("current", "lines", "array", "object")


@query(" UNION ALL ".join(f"SELECT '{name}' AS layout, src, dst, weight FROM arcs" for name in LAYOUTS), sql.SUPPLIERS)
def graph_logs(spark: SparkSession, d: str) -> DataFrame:
    """One graph written in each layout of graph logs and read back from the files."""
    g, folder = tables.suppliers(spark, d), f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    files.write_json(g, f"{folder}/current")
    lines = stash(files.write_legacy(g).select(F.split("text", "\n").alias("x")))
    text = {"lines": F.array_join("x", "\n"), "array": F.concat(F.lit("["), F.array_join("x", ","), F.lit("]")), "object": F.concat(F.lit('{"V":'), F.col("x")[0], F.lit(',"E":'), F.col("x")[1], F.lit(',"bidirectional":'), F.col("x")[2], F.lit("}"))}
    for name, c in text.items():
        lines.select(c).write.text(f"{folder}/{name}")
    return reduce(DataFrame.unionByName, [files.read_json(spark, f"{folder}/{name}").arcs.select(F.lit(name).alias("layout"), "src", "dst", "weight") for name in LAYOUTS])


@query("SELECT src, dst, weight FROM arcs", sql.NATIONS)
def tiles_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return Graph.from_tiles(*tables.nations(spark, d).tiles(7), True, True, 7).arcs


@query("SELECT src, dst, dist, hops, sigma FROM pairs", sql.SUPPLIERS.replace("arcs AS (SELECT src", "every AS (SELECT src", 1).replace("sup_every", "sup_arcs") + ", arcs AS (SELECT * FROM every WHERE (src::BIGINT * dst::BIGINT) % 23 <> 0 UNION SELECT a.id, b.id, 1.0::DOUBLE FROM nodes a JOIN nodes b ON abs(a.id::BIGINT - b.id::BIGINT) = 37 WHERE greatest(a.id::BIGINT, b.id::BIGINT) % 11 = 0)" + sql.PAIRS)
def pairs_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """The pair table of a graph of which edges went and came, repaired."""
    g = tables.suppliers(spark, d)
    a = Analyzer(g)
    a.pairs()
    number = lambda c: F.col(c).cast("long")
    left = g.arcs.where((number("src") * number("dst")) % 23 != 0)
    new = g.nodes.select(F.col("id").alias("src"), (number("id") - 37).cast("string").alias("dst")).where(number("src") % 11 == 0).join(g.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    both = new.select("src", "dst").unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).join(left, ["src", "dst"], "left_anti").withColumn("weight", F.lit(1.0))
    return a.after(Graph(g.nodes, stash(left.unionByName(both)), False, False)).pairs()


# ---- generators


def _ends(g: Graph) -> DataFrame:
    return g.arcs.where("src < dst").select("src", "dst") if not g.directed else g.arcs.select("src", "dst")


def _canonical(text: str) -> str:
    return f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM ({text})"


@query(sql.GRID.format(rows=20, cols=30, right="y < 29", down="x < 19"))
def grid(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.grid(spark, 20, 30))


@query(sql.GRID.format(rows=2, cols=5, right="true", down="false"))
def grid_torus(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.grid(spark, 2, 5, torus=True))


@query(sql.HEX.format(e=5))
def triangle_hex(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.triangle_hex(spark, 6))


@query(_canonical(sql.erdos_renyi(300, 0.05, 7, False)))
def erdos_renyi(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.erdos_renyi(spark, 300, 0.05, seed=7))


@query(sql.erdos_renyi(300, 0.02, 8, True))
def erdos_renyi_directed(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.erdos_renyi(spark, 300, 0.02, directed=True, seed=8))


@query(_canonical(sql.points(500, 9) + " SELECT i::VARCHAR AS src, j::VARCHAR AS dst FROM d WHERE d <= 0.08"))
def random_geometric(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.random_geometric(spark, 500, 0.08, seed=9))


@query(_canonical(sql.points(200, 10) + f" SELECT i::VARCHAR AS src, j::VARCHAR AS dst FROM d WHERE {sql.uniform(10, 'i', 'j')} < 0.6 * exp(-d / (0.3 * (SELECT max(d) FROM d)))"))
def waxman(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.waxman(spark, 200, 0.6, 0.3, seed=10))


@query()
def barabasi_albert(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.barabasi_albert(spark, 500, 3, seed=11))


@query()
def watts_strogatz(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.watts_strogatz(spark, 500, 10, 0.1, seed=12))


@query()
def random_regular(spark: SparkSession, d: str) -> DataFrame:
    return _ends(generators.random_regular(spark, 200, 6, seed=13))


@query("SELECT i::VARCHAR AS id, round(-ln(1 - " + sql.uniform(1, "i") + ") / 2.0, 9) AS exponential, round(3.0 / pow(1 - " + sql.uniform(1, "i") + ", 1 / 2.5), 9) AS pareto, round(exp(4.6 + 0.5 * sqrt(-2 * ln(1 - " + sql.uniform(1, "i", "'u'") + ")) * cos(2 * pi() * " + sql.uniform(1, "i", "'v'") + ")), 6) AS log_normal FROM range(500) t(i)")
def variates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id").cast("string")
    return spark.range(500).select(i.alias("id"), F.round(rng.exponential(1, i, rate=2.0), 9).alias("exponential"), F.round(rng.pareto(1, i, least=3.0, alpha=2.5), 9).alias("pareto"), F.round(rng.log_normal(1, i, mu=4.6, sigma=0.5), 6).alias("log_normal"))


def _shape(g: Graph, least: int = 0) -> DataFrame:
    """One row of counts: nodes, edges, loops, edges that occur twice, nodes of fewer than
    `least` neighbours."""
    e = _ends(g).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    n = e.agg(F.count("*").alias("edges"), F.count_if(F.col("a") == F.col("b")).alias("loops"), (F.count("*") - F.count_distinct("a", "b")).alias("twice"))
    few = g.degrees().agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") < least).alias("few"))
    return n.crossJoin(few).select(*[F.col(c).cast("long").alias(c) for c in ("nodes", "edges", "loops", "twice", "few")])  # a row each


def _shape_sql(nodes: int, edges: int) -> str:
    return f"SELECT {nodes}::BIGINT AS nodes, {edges}::BIGINT AS edges, 0::BIGINT AS loops, 0::BIGINT AS twice, 0::BIGINT AS few"


@query(_shape_sql(500, 3 + 497 * 3))
def barabasi_albert_shape(spark: SparkSession, d: str) -> DataFrame:
    return _shape(generators.barabasi_albert(spark, 500, 3, seed=11), least=3)


@query(_shape_sql(500, 2500))
def watts_strogatz_shape(spark: SparkSession, d: str) -> DataFrame:
    return _shape(generators.watts_strogatz(spark, 500, 10, 0.1, seed=12), least=1)


@query(_shape_sql(30, 30 * 14))
def watts_strogatz_dense(spark: SparkSession, d: str) -> DataFrame:
    return _shape(generators.watts_strogatz(spark, 30, 28, 0.5, seed=12), least=1)


@query("SELECT i::VARCHAR AS id, 6::BIGINT AS degree FROM range(200) t(i)")
def random_regular_degrees(spark: SparkSession, d: str) -> DataFrame:
    return generators.random_regular(spark, 200, 6, seed=13).degrees()


@query("SELECT (SELECT count(*) FROM nodes) AS nodes, true AS numbered, true AS settled", sql.SUPPLIERS)
def greedy_communities_shape(spark: SparkSession, d: str) -> DataFrame:
    """Whether communities are numbered from 0 and no merge of two would gain."""
    g = tables.suppliers(spark, d)
    label = stash(community.rounds(g))
    e = structure.projected(g).join(label.withColumnsRenamed({"id": "u", "community": "cu"}), "u").join(label.withColumnsRenamed({"id": "v", "community": "cv"}), "v")
    m = e.count()
    ends = e.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count("*").alias("a"))
    between = e.where("cu <> cv").groupBy(F.least("cu", "cv").alias("x"), F.greatest("cu", "cv").alias("y")).agg(F.count("*").alias("e"))
    gain = between.join(ends.withColumnsRenamed({"c": "x", "a": "ax"}), "x").join(ends.withColumnsRenamed({"c": "y", "a": "ay"}), "y").where(F.lit(2 * m) * F.col("e") > F.col("ax") * F.col("ay"))
    row = label.agg(F.count("*").alias("nodes"), ((F.min("community") == 0) & (F.max("community") + 1 == F.count_distinct("community"))).alias("numbered"))
    return row.withColumn("settled", F.lit(gain.isEmpty()))


def _edges(model: str, text: str) -> str:
    return f"SELECT '{model}' AS model, src, dst FROM ({text})"


DISPATCHED = {
    "grid": ({"rows": 20, "cols": 30, "torus": False}, sql.GRID.format(rows=20, cols=30, right="y < 29", down="x < 19")),
    "triangle_hex": ({"edge": 6}, sql.HEX.format(e=5)),
    "erdos_renyi": ({"n": 300, "p": 0.05}, _canonical(sql.erdos_renyi(300, 0.05, 7, False))),
    "random_geometric": ({"n": 400, "k": 12.0}, _canonical(sql.points(400, 7) + " SELECT i::VARCHAR AS src, j::VARCHAR AS dst FROM d WHERE d <= sqrt(12.0::DOUBLE / (pi() * 399))")),
    "waxman": ({"n": 200, "alpha": 0.6, "beta": 0.3}, _canonical(sql.points(200, 7) + f" SELECT i::VARCHAR AS src, j::VARCHAR AS dst FROM d WHERE {sql.uniform(7, 'i', 'j')} < 0.6 * exp(-d / (0.3 * (SELECT max(d) FROM d)))")),
}
#: Models and settings that the dispatcher refuses.
REFUSED = [("erdos_renyi", {"n": 10}), ("random_geometric", {"n": 10, "r": 0.1, "k": 2.0}), ("no_such_model", {})]


@query(" UNION ALL ".join([_edges(m, text) for m, (_, text) in DISPATCHED.items()] + [f"SELECT '{m}', 'refused', NULL" for m, _ in REFUSED]))
def standard_models(spark: SparkSession, d: str) -> DataFrame:
    made = [_ends(generators.standard(spark, m, params, seed=7)).select(F.lit(m).alias("model"), "src", "dst") for m, (params, _) in DISPATCHED.items()]
    refused = []
    for m, params in REFUSED:
        try:
            generators.standard(spark, m, params, seed=7)
        except GraphError:
            refused.append((m, "refused", None))
    return reduce(DataFrame.unionByName, [*made, spark.createDataFrame(refused, "model string, src string, dst string")])


@query("SELECT k, n, round(sqrt(k / (pi() * (n - 1))), 12) AS r FROM (VALUES (20.0::DOUBLE, 1000::BIGINT), (4.5::DOUBLE, 50::BIGINT)) t(k, n)")
def radius_for_degree(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, n, round(generators.radius_for_degree(k, n), 12)) for k, n in ((20.0, 1000), (4.5, 50))], "k double, n long, r double")


@query("SELECT i::VARCHAR AS id, round(5 + 2 * sqrt(-2 * ln(1 - " + sql.uniform(2, "i", "'u'") + ")) * cos(2 * pi() * " + sql.uniform(2, "i", "'v'") + "), 6) AS normal, round(-1 + 4 * " + sql.uniform(2, "i") + ", 9) AS between_, (SELECT count(*) FROM range(1, 11) t(k) WHERE " + sql.uniform(2, "i", "k") + " < 0.3) AS binomial, (SELECT count(*) FROM (SELECT sum(exp(-2.5) * pow(2.5, k) / factorial(k::INTEGER)::DOUBLE) OVER (ORDER BY k) AS upto FROM range(0, 30) t(k)) WHERE upto <= " + sql.uniform(2, "i") + ") AS poisson FROM range(500) t(i)")
def more_variates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id").cast("string")
    return spark.range(500).select(
        i.alias("id"),
        F.round(rng.normal(2, i, mean=5.0, deviation=2.0), 6).alias("normal"),
        F.round(rng.between(2, i, low=-1.0, high=3.0), 9).alias("between_"),
        rng.binomial(2, i, n=10, p=0.3).cast("long").alias("binomial"),
        rng.poisson(2, i, mean=2.5).cast("long").alias("poisson"),
    )


# ---- propagation


def _overlay(spark: SparkSession, d: str) -> tuple[propagation.Network, DataFrame]:
    g = tables.suppliers(spark, d)
    ms = lambda *k: F.floor(rng.uniform(*k) * 100) + 1
    net = propagation.network(g, ms(5, "id"), ms(6, "src", "dst"))
    return net, g.nodes.agg(F.min("id").alias("peer")).select(F.lit("m").alias("content"), "peer")


def _flood(spark: SparkSession, d: str) -> tuple[propagation.Network, DataFrame]:
    net, published = _overlay(spark, d)
    return net, propagation.simulate(net, published)


@query('SELECT \'m\' AS content, id AS peer_id, f AS "from", t AS timestamp FROM first', sql.SUPPLIERS + sql.FLOOD)
def flood_first_receptions(spark: SparkSession, d: str) -> DataFrame:
    return propagation.first_receptions(_flood(spark, d)[1])


@query("SELECT 'm' AS content, sum(n - 1)::BIGINT AS duplicates FROM (SELECT id, count(DISTINCT f) AS n FROM (SELECT dst AS id, src AS f FROM sends UNION ALL SELECT id, id FROM start) GROUP BY id)", sql.SUPPLIERS + sql.FLOOD)
def flood_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return propagation.duplicates(_flood(spark, d)[1])


@query("SELECT dst AS id, arrive AS t, src AS sender FROM sends UNION ALL SELECT id, 0.0, id FROM start", sql.SUPPLIERS + sql.FLOOD)
def flood_log(spark: SparkSession, d: str) -> DataFrame:
    return _flood(spark, d)[1].where("type = 'recv'").select("id", "t", F.col("from").alias("sender"))


@query(", halt AS (SELECT least(min(CASE WHEN nxt IS NULL OR nxt - t > 30 THEN t END) + 30, min(t) + 400) AS stop FROM (SELECT t, lead(t) OVER (ORDER BY t) AS nxt FROM first)) SELECT id AS peer_id, t AS timestamp FROM first, halt WHERE t <= stop", sql.SUPPLIERS + sql.FLOOD)
def flood_expired(spark: SparkSession, d: str) -> DataFrame:
    return propagation.first_receptions(propagation.expire(_flood(spark, d)[1], 30.0, 400.0)).select("peer_id", "timestamp")


@query("SELECT round(count(*) / (SELECT count(*) FROM nodes)::DOUBLE, 9) AS value FROM first", sql.SUPPLIERS + sql.FLOOD)
def flood_reachability(spark: SparkSession, d: str) -> DataFrame:
    net, log = _flood(spark, d)
    return spark.createDataFrame([(round(propagation.reachability(net, log, "m"), 9),)], "value double")


@query()
def gossip_first_receptions(spark: SparkSession, d: str) -> DataFrame:
    net, published = _overlay(spark, d)
    return propagation.first_receptions(propagation.simulate(net, published, propagation.gossip(0.6, seed=3)))


# ---- helpers


@query("""WITH a AS (SELECT o_custkey::VARCHAR AS id, sum(o_totalprice)::DOUBLE AS value FROM orders GROUP BY 1), b AS (SELECT o_custkey::VARCHAR AS id, sum(o_totalprice)::DOUBLE AS value FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
j AS (SELECT a.id AS i, b.id AS k, a.value AS r, b.value AS c, b.value - a.value AS d FROM a FULL JOIN b ON a.id = b.id)
SELECT count(i) AS n_ref, count(k) AS n_cmp, count(d) AS n_common, count(*) FILTER (k IS NULL) AS missing_in_compare, count(*) FILTER (i IS NULL) AS missing_in_reference, round(avg(abs(d)), 4) AS mae, round(sqrt(avg(d * d)), 4) AS rmse, round(max(abs(d)), 4) AS max_abs_error, round(avg(abs(d) / abs(r)), 6) AS mape FROM j""")
def error_report(spark: SparkSession, d: str) -> DataFrame:
    orders = tables.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    summed = lambda x: x.groupBy("id").agg(F.sum("v").alias("value"))
    e = report.errors(summed(orders), summed(orders.where("o_orderkey % 2 = 0")))
    return e.select("n_ref", "n_cmp", "n_common", "missing_in_compare", "missing_in_reference", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("max_abs_error", 4).alias("max_abs_error"), F.round("mape", 6).alias("mape"))


@query("SELECT n_name AS key, n_nationkey::VARCHAR AS value FROM nation WHERE n_nationkey NOT IN (1, 2) UNION ALL SELECT 'Cake', '1'")
def bimap(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    return Bimap(rows).insert(spark.createDataFrame([("Cake", "1")], "key string, value string")).remove_value("2").pairs


DAY = 86_400_000
SILENCES = f"""WITH log AS (SELECT event_type AS content, user_id::VARCHAR AS id, props->>'$.k' AS sender, ts FROM events),
cut AS (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY content, id ORDER BY ts, sender)) > {DAY}, true) AS fresh FROM log),
numbered AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY content, id ORDER BY ts, sender) AS n FROM cut)
SELECT content, id, min(ts) AS began, max(ts) AS ended, arg_min(sender, (ts, sender)) AS first_from, count(*) AS receptions, count(DISTINCT sender) - 1 AS duplicates
FROM numbered GROUP BY content, id, n HAVING epoch_ms(max(ts)) + {DAY} < (SELECT epoch_ms(max(ts)) - 3600000 FROM log)"""


@query(SILENCES)
def reception_episodes(spark: SparkSession, d: str) -> DataFrame:
    """First receptions and duplicates of each peer and content, as the events stream by."""
    return live.drained(live.episodes(live.receptions(spark, d), DAY / 1000, "1 hour")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "ended")})


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rank(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
