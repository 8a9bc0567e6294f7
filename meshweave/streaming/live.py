"""Propagation logs as streams: the same questions, asked of events as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meshweave.session import shared_dir


def first_receptions(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Of a stream of receptions (content, id, from, ts): the first of each peer and
    content. State is kept for the time that events may be late."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["content", "id"])


def forwards(events: DataFrame, links: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Flooding as a stream: each first reception is sent to all neighbours but the one it
    came from. links(src, dst) is static."""
    first = first_receptions(events, lateness)
    return first.join(links, F.col("id") == F.col("src")).where("dst <> `from`").select("content", "src", "dst", "ts")


def reached(events: DataFrame, window: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Rows (content, window, peers, receptions) per tumbling window."""
    return events.withWatermark("ts", lateness).groupBy("content", F.window("ts", window)).agg(F.approx_count_distinct("id").alias("peers"), F.count("*").alias("receptions"))


def sessions(events: DataFrame, expiration: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Rows (content, session, receptions): a content's life ends with a silence of the
    expiration time."""
    return events.withWatermark("ts", lateness).groupBy("content", F.session_window("ts", expiration).alias("session")).agg(F.count("*").alias("receptions"))


EPISODES = "content string, id string, began long, ended long, first_from string, receptions long, duplicates long"


def episodes(events: DataFrame, gap: float, lateness: str = "1 minute") -> DataFrame:
    """Of a stream (content, id, from, ts): what each peer heard of each content, an
    episode ending with a silence of more than `gap` seconds. Rows tell when it began and
    ended, who was first (of equal times the smallest name), how many receptions there were
    and how many senders beside one. Receptions may come out of order within the lateness:
    they are kept until the watermark has passed the silence behind them, when a timer of
    the peer and content fires, so state holds open episodes only."""
    silence = int(gap * 1000)

    def heard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, senders = (list(x) for x in state.get) if state.exists else ([], [])
        for batch in batches:
            times += batch["us"].tolist()
            senders += batch["from"].tolist()
        order = sorted(range(len(times)), key=lambda i: (times[i], senders[i] is not None, senders[i] or ""))
        done, open_, mark = [], [], state.getCurrentWatermarkMs()
        for i in order:
            if open_ and times[i] // 1000 - times[open_[-1]] // 1000 > silence:
                done.append(open_)
                open_ = []
            open_.append(i)
        if open_ and times[open_[-1]] // 1000 + silence < mark:
            done.append(open_)
            open_ = []
        # An episode before the open one is over only once nothing can come in between.
        while done and times[done[-1][-1]] // 1000 + silence >= mark:
            open_ = done.pop() + open_
        if open_:
            state.update(([times[i] for i in open_], [senders[i] for i in open_]))
            over = next((times[a] for a, b in zip(open_, open_[1:], strict=False) if times[b] // 1000 - times[a] // 1000 > silence), times[open_[-1]])
            state.setTimeoutTimestamp(max(over // 1000 + silence, mark + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame([(*key, times[e[0]], times[e[-1]], senders[e[0]], len(e), len({senders[i] for i in e}) - 1) for e in done], columns=["content", "id", "began", "ended", "first_from", "receptions", "duplicates"])

    kept = events.withWatermark("ts", lateness).select("content", "id", "from", "ts", F.unix_micros("ts").alias("us"))
    out = kept.groupBy("content", "id").applyInPandasWithState(heard, EPISODES, "times array<long>, senders array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("began", "ended")})


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that is there now: it runs until that is used up, its
    progress and results in the shared folder, and is read back."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/drained-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def receptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of receptions: users are peers, kinds of events are
    contents, and the key in an event's properties is who it came from."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern may be a file or a folder
    return rows.select(F.col("event_type").alias("content"), F.col("user_id").cast("string").alias("id"), F.get_json_object("props", "$.k").alias("from"), F.col("ts").cast("timestamp").alias("ts"))
