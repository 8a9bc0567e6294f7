"""Settings of the metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Degree:
    mode: str = "total"  # of a directed graph: in, out or total


@dataclass(frozen=True)
class Closeness:
    wf_improved: bool = True
    reverse: bool = False  # distances out of a node rather than into it


@dataclass(frozen=True)
class Betweenness:
    normalized: bool = True


@dataclass(frozen=True)
class EdgeBetweenness:
    normalized: bool = True


@dataclass(frozen=True)
class PageRank:
    alpha: float = 0.85
    max_iter: int = 100
    tol: float = 1e-6
    personalization: DataFrame | None = None  # (id, value)
    dangling: DataFrame | None = None  # (id, value)
    reverse: bool = False


@dataclass(frozen=True)
class Eigenvector:
    max_iter: int = 100
    tol: float = 1e-6
    start: DataFrame | None = None  # (id, value)
    reverse: bool = False


@dataclass(frozen=True)
class Assortativity:
    mode: str = "projected"  # of a directed graph: out-in, out-out, in-in, in-out; projected is out-in
    ignore_loops: bool = True  # loops are passed over either way


@dataclass(frozen=True)
class Modularity:
    partition: DataFrame | None = None  # (id, community int); greedy communities if None


@dataclass(frozen=True)
class Config:
    degree: Degree = field(default_factory=Degree)
    closeness: Closeness = field(default_factory=Closeness)
    betweenness: Betweenness = field(default_factory=Betweenness)
    edge_betweenness: EdgeBetweenness = field(default_factory=EdgeBetweenness)
    page_rank: PageRank = field(default_factory=PageRank)
    eigenvector: Eigenvector = field(default_factory=Eigenvector)
    assortativity: Assortativity = field(default_factory=Assortativity)
    modularity: Modularity = field(default_factory=Modularity)
