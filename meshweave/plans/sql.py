"""DuckDB SQL that gives the rows of the catalog's queries."""

from __future__ import annotations

SUPPLIER_ARCS = """
sup_of AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
sup_met AS (SELECT a.s, b.s AS t, count(*) AS n FROM sup_of a JOIN sup_of b ON a.o = b.o AND a.s <> b.s GROUP BY 1, 2),
sup_arcs AS (SELECT s::VARCHAR AS src, t::VARCHAR AS dst, n::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS r FROM sup_met) WHERE r <= 3),
nodes AS (SELECT s_suppkey::VARCHAR AS id FROM supplier),
"""
SUPPLIERS = SUPPLIER_ARCS + "arcs AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM (SELECT src, dst FROM sup_arcs UNION SELECT dst, src FROM sup_arcs))"
SUPPLIERS_DIRECTED = SUPPLIER_ARCS + "arcs AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM sup_arcs)"
USERS = """
bought AS (SELECT user_id, lead(user_id) OVER (ORDER BY ts::DATE, ts, event_id) AS nxt FROM events WHERE event_type = 'purchase'),
nodes AS (SELECT DISTINCT user_id::VARCHAR AS id FROM bought),
arcs AS (SELECT DISTINCT user_id::VARCHAR AS src, nxt::VARCHAR AS dst, 1.0::DOUBLE AS weight FROM bought WHERE nxt IS NOT NULL AND nxt <> user_id)
"""
NATIONS = """
nodes AS (SELECT n_nationkey::VARCHAR AS id FROM nation),
arcs AS (SELECT s_nationkey::VARCHAR AS src, c_nationkey::VARCHAR AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
"""
LINKS = """
arcs AS (SELECT DISTINCT url AS src, dst, 1.0::DOUBLE AS weight FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages) WHERE dst <> ''),
nodes AS (SELECT src AS id FROM arcs UNION SELECT dst FROM arcs)
"""
#: Walks of each length: those of the least length are the shortest paths.
PAIRS = """,
walks AS (
  SELECT 0 AS h, id AS src, id AS dst, 1.0::DOUBLE AS n FROM nodes
  UNION ALL
  SELECT h + 1, w.src, a.dst, sum(n) FROM walks w JOIN arcs a ON a.src = w.dst WHERE h < 12 GROUP BY 1, 2, 3
), pairs AS (SELECT src, dst, min(h) AS hops, arg_min(n, h) AS sigma, min(h)::DOUBLE AS dist FROM walks GROUP BY 1, 2)
"""
WEIGHTED_PAIRS = """,
walks AS (
  SELECT 0 AS h, id AS src, id AS dst, 0.0::DOUBLE AS d, 1.0::DOUBLE AS n FROM nodes
  UNION ALL
  SELECT h, src, dst, m, sum(n) FROM (SELECT h + 1 AS h, w.src, a.dst, d + weight AS d, n, min(d + weight) OVER (PARTITION BY w.src, a.dst) AS m FROM walks w JOIN arcs a ON a.src = w.dst WHERE h < 12 AND a.src <> a.dst) WHERE d = m GROUP BY 1, 2, 3, 4
), least AS (SELECT src, dst, min(d) AS dist FROM walks GROUP BY 1, 2),
pairs AS (SELECT src, dst, dist, min(h) AS hops, sum(n) AS sigma FROM walks JOIN least USING (src, dst) WHERE d = dist GROUP BY 1, 2, 3)
"""
COUNT = "(SELECT count(*) FROM nodes)"


def degree(mode: str) -> str:
    ends = {"out": "SELECT src AS id FROM loose", "in": "SELECT dst AS id FROM loose", "total": "SELECT src AS id FROM loose UNION ALL SELECT dst FROM loose"}[mode]
    return f", loose AS (SELECT * FROM arcs WHERE src <> dst), ends AS ({ends}) SELECT id, round(coalesce(k, 0) / ({COUNT} - 1)::DOUBLE, 9) AS value FROM nodes LEFT JOIN (SELECT id, count(*) AS k FROM ends GROUP BY id) USING (id)"


def closeness(end: str, improved: bool) -> str:
    return f"SELECT id, round(coalesce(r / s {f'* r / ({COUNT} - 1)' if improved else ''}, 0), 9) AS value FROM nodes LEFT JOIN (SELECT {end} AS id, count(*)::DOUBLE AS r, sum(dist) AS s FROM pairs WHERE dist > 0 GROUP BY 1) USING (id)"


def betweenness(directed: bool) -> str:
    return f"SELECT id, round(coalesce(x, 0) / (({COUNT} - 1) * ({COUNT} - 2)), 9) AS value FROM nodes LEFT JOIN (SELECT a.dst AS id, sum(a.sigma * b.sigma / c.sigma) AS x FROM pairs a JOIN pairs b ON b.src = a.dst JOIN pairs c ON c.src = a.src AND c.dst = b.dst WHERE a.hops > 0 AND b.hops > 0 AND abs(a.dist + b.dist - c.dist) < 1e-9 GROUP BY 1) USING (id)"


def edge_betweenness(directed: bool) -> str:
    used = "SELECT e.src, e.dst, a.sigma * b.sigma / c.sigma AS x FROM arcs e JOIN pairs a ON a.dst = e.src JOIN pairs b ON b.src = e.dst JOIN pairs c ON c.src = a.src AND c.dst = b.dst WHERE a.hops + 1 + b.hops = c.hops"
    ends = "src, dst" if directed else "least(src, dst) AS src, greatest(src, dst) AS dst"
    return f"SELECT {ends}, round(sum(x) / (({COUNT} - 1) * ({COUNT} - 2)), 9) AS value FROM ({used}) GROUP BY 1, 2"


def page_rank(rounds: int, alpha: float, start: str = f"1.0 / {COUNT}", hang: str | None = None, src: str = "src", dst: str = "dst") -> str:
    """start and hang: SQL for a node's share of jumps and of what hangs."""
    return f""", out AS (SELECT {src} AS s, {dst} AS d, count(*) OVER (PARTITION BY {src}) AS k FROM arcs WHERE src <> dst),
base AS (SELECT id, {start} AS p, {hang or start} AS q, id NOT IN (SELECT s FROM out) AS dangling FROM nodes),
rec AS (
  SELECT 0 AS i, id, 1.0::DOUBLE / {COUNT} AS r FROM nodes
  UNION ALL
  SELECT t.i + 1, b.id, {1 - alpha!r} * p + {alpha!r} * coalesce(lost, 0) * q + coalesce(g, 0)
  FROM base b LEFT JOIN (SELECT d AS id, sum({alpha!r} * r / k) AS g FROM rec JOIN out ON s = rec.id GROUP BY d) USING (id),
       (SELECT max(i) AS i, sum(r) FILTER (dangling) AS lost FROM rec JOIN base USING (id)) t WHERE t.i < {rounds}
) SELECT id, round(r / sum(r) OVER (), 9) AS value FROM rec WHERE i = {rounds}"""


def eigenvector(rounds: int, src: str = "src", dst: str = "dst") -> str:
    return f""", rec AS (
  SELECT 0 AS i, id, 1.0::DOUBLE / {COUNT} AS x FROM nodes
  UNION ALL
  SELECT i + 1, id, y / sqrt(sum(y * y) OVER ()) FROM (SELECT t.i, n.id, coalesce(y, 0) AS y FROM nodes n LEFT JOIN (SELECT {dst} AS id, sum(x) AS y FROM rec JOIN arcs ON {src} = rec.id GROUP BY 1) USING (id), (SELECT max(i) AS i FROM rec) t WHERE t.i < {rounds})
) SELECT id, round(x, 9) AS value FROM rec WHERE i = {rounds}"""


CLUSTERING = """, loose AS (SELECT src, dst FROM arcs WHERE src <> dst), k AS (SELECT src AS id, count(*) AS k FROM loose GROUP BY 1),
t AS (SELECT a.src AS id, count(*) AS t FROM loose a JOIN loose b ON b.src = a.src AND a.dst < b.dst JOIN loose c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT id, round(CASE WHEN k > 1 THEN coalesce(t, 0) / (k * (k - 1) / 2.0) ELSE 0 END, 9) AS value FROM nodes LEFT JOIN k USING (id) LEFT JOIN t USING (id)"""
CLUSTERING_DIRECTED = """, b AS (SELECT src, dst, count(*) AS b FROM (SELECT src, dst FROM arcs WHERE src <> dst UNION ALL SELECT dst, src FROM arcs WHERE src <> dst) GROUP BY 1, 2),
k AS (SELECT src AS id, sum(b) AS k, count(*) FILTER (b = 2) AS m FROM b GROUP BY 1),
t AS (SELECT x.src AS id, sum(x.b * y.b * z.b) AS t FROM b x JOIN b y ON y.src = x.dst JOIN b z ON z.src = y.dst AND z.dst = x.src WHERE x.dst <> z.src GROUP BY 1)
SELECT id, round(CASE WHEN k * (k - 1) - 2 * m > 0 THEN coalesce(t, 0) / 2.0 / (k * (k - 1) - 2 * m) ELSE 0 END, 9) AS value FROM nodes LEFT JOIN k USING (id) LEFT JOIN t USING (id)"""


def assortativity(first: str, second: str, directed: bool) -> str:
    d = lambda end: f"(SELECT {end} AS id, count(*)::DOUBLE AS d FROM arcs GROUP BY 1)"
    name = {"out": "src", "in": "dst"}
    return f""", e AS (SELECT coalesce(x.d, 0) AS j, coalesce(y.d, 0) AS k FROM arcs LEFT JOIN {d(name[first])} x ON x.id = src LEFT JOIN {d(name[second])} y ON y.id = dst WHERE src {'<>' if directed else '<'} dst),
m AS (SELECT avg(j * k) AS jk, avg((j + k) / 2) AS m, avg((j * j + k * k) / 2) AS s FROM e)
SELECT round((jk - m * m) / (s - m * m), 9) AS value FROM m"""


MODULARITY = """, p AS (SELECT n_nationkey::VARCHAR AS id, n_regionkey AS c FROM nation),
e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM arcs WHERE src <> dst),
m AS (SELECT count(*)::DOUBLE AS m FROM e),
l AS (SELECT a.c, count(*) AS l FROM e JOIN p a ON a.id = u JOIN p b ON b.id = v WHERE a.c = b.c GROUP BY 1),
k AS (SELECT c, count(*) AS k FROM (SELECT u AS id FROM e UNION ALL SELECT v FROM e) JOIN p USING (id) GROUP BY 1)
SELECT round(sum(coalesce(l, 0) / m - pow(k / (2 * m), 2)), 9) AS value FROM k LEFT JOIN l USING (c), m"""
DIAMETER = "SELECT coalesce(arg_min(hops, (-dist, hops)), 0)::BIGINT AS hops, coalesce(max(dist), 0.0) AS weight FROM pairs WHERE src <> dst"
LINES = "SELECT '    ' || id || ': map[' || coalesce(string_agg(dst || ':' || weight::BIGINT, ' ' ORDER BY dst), '') || ']' || chr(10) AS line, id FROM nodes LEFT JOIN arcs ON src = id GROUP BY id"
TEXT = f", lines AS ({LINES}), whole AS (SELECT 'Graph:' || chr(10) || '  Directed: true' || chr(10) || '  Weighted: true' || chr(10) || '  Nodes:' || chr(10) || string_agg(line, '' ORDER BY id) AS text FROM lines) SELECT text, sha256(text) AS hash FROM whole"
MATRIX = "SELECT a.id, string_agg(coalesce(weight, 0)::BIGINT::VARCHAR, ' ' ORDER BY b.id) AS cells FROM nodes a CROSS JOIN nodes b LEFT JOIN arcs ON src = a.id AND dst = b.id GROUP BY 1"


def uniform(seed: int, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *keys])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def erdos_renyi(n: int, p: float, seed: int, directed: bool) -> str:
    return f"SELECT i::VARCHAR AS src, j::VARCHAR AS dst FROM range({n}) a(i), range({n}) b(j) WHERE {'i <> j' if directed else 'i < j'} AND {uniform(seed, 'i', 'j')} < {p}"


def points(n: int, seed: int) -> str:
    return f"WITH p AS (SELECT i AS id, {uniform(seed, 'i', chr(39) + 'x' + chr(39))} AS x, {uniform(seed, 'i', chr(39) + 'y' + chr(39))} AS y FROM range({n}) t(i)), d AS (SELECT a.id AS i, b.id AS j, sqrt(pow(a.x - b.x, 2.0) + pow(a.y - b.y, 2.0)) AS d FROM p a JOIN p b ON a.id < b.id)"


GRID = """WITH c AS (SELECT i, i // {cols} AS x, i % {cols} AS y FROM range({rows} * {cols}) t(i)), e AS (
SELECT i, x * {cols} + (y + 1) % {cols} AS j FROM c WHERE {right} UNION ALL SELECT i, ((x + 1) % {rows}) * {cols} + y FROM c WHERE {down})
SELECT least(i::VARCHAR, j::VARCHAR) AS src, greatest(i::VARCHAR, j::VARCHAR) AS dst FROM e"""
HEX = """WITH a AS (SELECT q, r, row_number() OVER (ORDER BY q, r) - 1 AS id FROM range(-{e}, {e} + 1) x(q), range(-{e}, {e} + 1) y(r) WHERE abs(q + r) <= {e}), w(dq, dr) AS (VALUES (1, 0), (0, 1), (1, -1))
SELECT least(a.id::VARCHAR, b.id::VARCHAR) AS src, greatest(a.id::VARCHAR, b.id::VARCHAR) AS dst FROM a, w, a AS b WHERE b.q = a.q + dq AND b.r = a.r + dr"""

#: Flooding from one publisher, from its closed form: first times are shortest paths of
#: processing and link latencies, and u sends to v unless v's own message is there by then.
FLOOD = f""", proc AS (SELECT id, floor({uniform(5, 'id')} * 100) + 1 AS p FROM nodes), lat AS (SELECT src, dst, floor({uniform(6, 'src', 'dst')} * 100) + 1 AS l FROM arcs),
start AS (SELECT min(id) AS id FROM nodes),
walk AS (
  SELECT 0 AS h, id, 0.0::DOUBLE AS t, id AS f FROM start
  UNION ALL
  SELECT h, id, (m).t, (m).f FROM (SELECT h + 1 AS h, dst AS id, min(ROW(t + p + l, src)::STRUCT(t DOUBLE, f VARCHAR)) AS m FROM walk w JOIN proc USING (id) JOIN lat ON src = w.id WHERE h < 25 GROUP BY 1, 2)
), first AS (SELECT id, (m).t AS t, (m).f AS f FROM (SELECT id, min(ROW(t, f)::STRUCT(t DOUBLE, f VARCHAR)) AS m FROM walk GROUP BY 1)),
timed AS (SELECT id, t + p AS s FROM first JOIN proc USING (id)),
sends AS (SELECT src, dst, u.s, u.s + l AS arrive FROM lat JOIN timed u ON u.id = src WHERE NOT EXISTS (SELECT 1 FROM lat b JOIN timed v ON v.id = b.src WHERE b.src = lat.dst AND b.dst = lat.src AND v.s + b.l <= u.s))
"""

#: One merge a step: that of the largest gain, of equal ones of the smallest pair.
GREEDY = """, e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM arcs WHERE src <> dst),
deg AS (SELECT id, count(*) AS k FROM (SELECT u AS id FROM e UNION ALL SELECT v FROM e) GROUP BY id), m AS (SELECT count(*) AS m FROM e),
rec AS (
  SELECT 0 AS step, id, id AS c FROM nodes
  UNION ALL
  SELECT step + 1, id, CASE WHEN c = b[3] THEN b[2] ELSE c END FROM rec, (
    SELECT min(ROW(s.a * t.a - 2 * m * e, x, y)) AS b FROM m,
      (SELECT least(p.c, q.c) AS x, greatest(p.c, q.c) AS y, count(*) AS e FROM e JOIN rec p ON p.id = u JOIN rec q ON q.id = v WHERE p.c <> q.c GROUP BY 1, 2)
      JOIN (SELECT c, sum(k) AS a FROM rec JOIN deg USING (id) GROUP BY c) s ON s.c = x JOIN (SELECT c, sum(k) AS a FROM rec JOIN deg USING (id) GROUP BY c) t ON t.c = y
    WHERE 2 * m * e - s.a * t.a > 2e-12 * m * m
  ) WHERE b IS NOT NULL
) SELECT id, (dense_rank() OVER (ORDER BY c) - 1)::INTEGER AS community FROM rec WHERE step = (SELECT max(step) FROM rec)"""
