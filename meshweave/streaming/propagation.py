"""Message propagation over a graph, in virtual time.

A peer that first gets a content waits its processing time, asks the protocol which
neighbours to send to, given who has sent it the content by then, and sends once; a
message arrives after its link's latency. All contents run at once. Which sends a peer
makes depends on what has arrived, and that on sends: starting with all arcs, first times
and sends are worked out in turn until sends no longer change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshweave.functions import rng
from meshweave.graph import Graph, GraphError
from meshweave.session import stash

#: From candidates (content, src, dst, hop, t_send, received array<string>), one row per
#: neighbour of each peer that has the content, those to send to.
Protocol = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Network:
    """peers(id, proc_ms) and links(src, dst, lat_ms)."""

    peers: DataFrame
    links: DataFrame


def network(g: Graph, processing: Column, latency: Column) -> Network:
    """processing: of id, once per peer; latency: of src and dst, once per arc; in ms."""
    if g.weighted:
        raise GraphError("an overlay is an unweighted graph")
    return Network(stash(g.nodes.select("id", processing.cast("double").alias("proc_ms"))), stash(g.arcs.select("src", "dst", latency.cast("double").alias("lat_ms"))))


def flooding(candidates: DataFrame) -> DataFrame:
    """To all neighbours that have not sent it."""
    return candidates.where(~F.array_contains("received", F.col("dst")))


def gossip(factor: float | None = None, count: int | None = None, seed: int = 0) -> Protocol:
    """To some of flooding's targets, drawn by hash: a share of them, cut to a whole
    number, or, without a share, count of them; half if neither is given."""
    if factor is None and count is None:
        factor = 0.5
    if (factor is not None and not 0 <= factor <= 1) or (count is not None and count < 0):
        raise GraphError("a share from 0 to 1, or a count of 0 or more")

    def choose(candidates: DataFrame) -> DataFrame:
        of = W.partitionBy("content", "src")
        ranked = flooding(candidates).withColumn("rank", F.row_number().over(of.orderBy(rng.uniform(seed, "content", "src", "dst"), "dst"))).withColumn("of", F.count("*").over(of))
        most = F.floor(F.col("of") * factor) if factor is not None else F.lit(count)
        return ranked.where(F.col("rank") <= most).drop("rank", "of")

    return choose


def _first_times(net: Network, published: DataFrame, sends: DataFrame) -> DataFrame:
    """Rows (content, id, t, hop, from): each peer's first reception under given sends."""
    wait = sends.join(net.peers.select(F.col("id").alias("src"), "proc_ms"), "src").join(net.links, ["src", "dst"]).select("content", "src", "dst", (F.col("proc_ms") + F.col("lat_ms")).alias("w"))
    wait = stash(wait)
    key = F.struct("t", "from", "hop")
    best = stash(published.select("content", F.col("peer").alias("id"), key_of(F.col("t"), F.col("peer"), F.lit(0)).alias("k")).groupBy("content", "id").agg(F.min("k").alias("k")))
    fresh = best
    while True:
        reached = fresh.select("content", F.col("id").alias("src"), "k").join(wait, ["content", "src"]).groupBy("content", F.col("dst").alias("id")).agg(F.min(key_of(F.col("k.t") + F.col("w"), F.col("src"), F.col("k.hop") + 1)).alias("k2"))
        fresh = stash(reached.join(best, ["content", "id"], "left").where("k is null or k2 < k").select("content", "id", F.col("k2").alias("k")))
        if fresh.isEmpty():
            return best.select("content", "id", "k.*")
        best = stash(best.unionByName(fresh).groupBy("content", "id").agg(F.min("k").alias("k")))


def key_of(t: Column, sender: Column, hop: Column) -> Column:
    return F.struct(t.cast("double").alias("t"), sender.alias("from"), hop.cast("int").alias("hop"))


def simulate(net: Network, published: DataFrame, protocol: Protocol = flooding, most_rounds: int = 200) -> DataFrame:
    """Of published(content, peer[, t]): the event log, rows (content, id, t, type, from,
    to, first, hop) of recv and send events. An unknown peer is an error."""
    if "t" not in published.columns:
        published = published.withColumn("t", F.lit(0.0))
    if not published.join(net.peers, F.col("peer") == F.col("id"), "left_anti").isEmpty():
        raise GraphError("an unknown peer publishes")
    contents = published.select("content").distinct()
    sends = stash(contents.join(net.links.select("src", "dst")))  # a row per content and link
    for _ in range(most_rounds):
        first = stash(_first_times(net, published, sends))
        timed = first.join(net.peers, "id").select("content", F.col("id").alias("src"), (F.col("t") + F.col("proc_ms")).alias("t_send"), "hop")
        arrived = sends.join(timed, ["content", "src"]).join(net.links, ["src", "dst"]).select("content", "src", F.col("dst").alias("at"), (F.col("t_send") + F.col("lat_ms")).alias("t_in"))
        arrived = arrived.unionByName(published.select("content", F.col("peer").alias("src"), F.col("peer").alias("at"), F.col("t").alias("t_in")))
        in_time = arrived.join(timed.select("content", F.col("src").alias("at"), "t_send"), ["content", "at"]).where("t_in <= t_send")
        received = in_time.groupBy("content", F.col("at").alias("src")).agg(F.array_sort(F.collect_set(F.col("src"))).alias("received"))
        candidates = timed.join(received, ["content", "src"]).join(net.links.select("src", "dst"), "src").select("content", "src", "dst", "hop", "t_send", "received")
        new = stash(protocol(candidates).select("content", "src", "dst"))
        live = sends.join(timed.select("content", "src"), ["content", "src"], "left_semi")
        if new.count() == live.count() and new.join(live, ["content", "src", "dst"], "left_anti").isEmpty():
            return _log(net, published, first, timed, new)
        sends = new
    raise GraphError(f"sends still change after {most_rounds} rounds")


def _log(net: Network, published: DataFrame, first: DataFrame, timed: DataFrame, sends: DataFrame) -> DataFrame:
    sent = sends.join(timed, ["content", "src"]).join(net.links, ["src", "dst"])
    arrivals = sent.select("content", F.col("dst").alias("id"), (F.col("t_send") + F.col("lat_ms")).alias("t"), F.col("src").alias("from"), (F.col("hop") + 1).alias("hop"))
    arrivals = arrivals.unionByName(published.select("content", F.col("peer").alias("id"), F.col("t").cast("double").alias("t"), F.col("peer").alias("from"), F.lit(0).alias("hop")))
    marked = arrivals.join(first.select("content", "id", F.col("t").alias("t1"), F.col("from").alias("f1")), ["content", "id"])
    recv = marked.select("content", "id", "t", F.lit("recv").alias("type"), "from", F.col("id").alias("to"), ((F.col("t") == F.col("t1")) & (F.col("from") == F.col("f1"))).alias("first"), "hop")
    send = sent.select("content", F.col("src").alias("id"), F.col("t_send").alias("t"), F.lit("send").alias("type"), F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(False).alias("first"), "hop")
    return stash(recv.unionByName(send))


# ---- what a log says


def reachability(net: Network, log: DataFrame, content: str) -> float:
    """Share of peers that got the content; NaN without peers."""
    n = net.peers.count()
    return log.where((F.col("content") == content) & F.col("first")).select("id").distinct().count() / n if n else float("nan")


def first_receptions(log: DataFrame) -> DataFrame:
    """Rows (content, peer_id, from, timestamp)."""
    return log.where("first").select("content", F.col("id").alias("peer_id"), "from", F.col("t").alias("timestamp"))


def first_times(log: DataFrame) -> DataFrame:
    return log.where("type = 'recv'").groupBy("content", "id").agg(F.min("t").alias("timestamp"))


def duplicates(log: DataFrame) -> DataFrame:
    """Rows (content, duplicates): over peers, distinct senders less one."""
    per = log.where("type = 'recv'").groupBy("content", "id").agg((F.count_distinct("from") - 1).alias("d"))
    return per.groupBy("content").agg(F.sum("d").alias("duplicates"))


def message_info(net: Network, log: DataFrame, peer: str, content: str) -> DataFrame:
    """One row (received, sent, seen, first_from) of a peer; an unseen content has no
    times and senders."""
    if net.peers.where(F.col("id") == peer).isEmpty():
        raise GraphError(f"no peer {peer}")
    mine = log.where((F.col("id") == peer) & (F.col("content") == content))
    recv = F.col("type") == "recv"
    return mine.agg(F.array_sort(F.collect_set(F.when(recv, F.col("from")))).alias("received"), F.array_sort(F.collect_set(F.when(~recv, F.col("to")))).alias("sent"), F.min(F.when(recv, F.col("t"))).alias("seen"), F.max(F.when(F.col("first"), F.col("from"))).alias("first_from"))


def peer_log(log: DataFrame, peer: str, content: str | None = None) -> DataFrame:
    mine = log.where(F.col("id") == peer)
    return mine if content is None else mine.where(F.col("content") == content)


def log_time(t: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """Virtual ms as the text of a log."""
    return F.date_format(F.timestamp_millis(F.unix_millis(F.lit(origin).cast("timestamp")) + F.floor(t)), "yyyy-MM-dd HH:mm:ss.SSS")


def expire(log: DataFrame, expiration: float, timeout: float) -> DataFrame:
    """log up to each content's end: `expiration` after the last first reception before a
    longer silence, or `timeout` after its start. Receptions are summed up in steps of
    the expiration time; a longer silence can only lie between steps."""
    step = F.floor(F.col("t") / expiration)
    steps = log.where("first").groupBy("content", step.alias("step")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    ahead = F.lead("lo").over(W.partitionBy("content").orderBy("step"))
    gaps = steps.select("content", "lo", "hi", ahead.alias("next"))
    ends = gaps.groupBy("content").agg(F.min("lo").alias("start"), F.min(F.when(F.col("next").isNull() | (F.col("next") - F.col("hi") > expiration), F.col("hi"))).alias("last"))
    stop = F.least(F.col("last") + expiration, F.col("start") + timeout)
    return log.join(ends.select("content", stop.alias("stop")), "content").where("t <= stop").drop("stop")
