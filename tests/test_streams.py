"""Episodes of receptions over several batches, out of order, against plain code."""

import datetime

from meshweave.streaming import live

ROWS = "content string, id string, `from` string, ts timestamp"


def plain(rows, gap, end):
    """Episodes that are over when nothing before `end` can come any more."""
    out, of = [], {}
    for content, peer, sender, ts in sorted(rows, key=lambda r: (r[3], r[2] is not None, r[2] or "")):
        mine = of.setdefault((content, peer), [])
        if not mine or (ts - mine[-1][-1][1]).total_seconds() > gap:
            mine.append([])
        mine[-1].append((sender, ts))
    for key, every in of.items():
        out += [(*key, e[0][1], e[-1][1], e[0][0], len(e), len({s for s, _ in e}) - 1) for e in every if (end - e[-1][1]).total_seconds() > gap]
    return sorted(out, key=repr)


def test_episodes(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    batches = [
        [("x", "a", "p", 10), ("x", "a", "q", 12), ("x", "b", None, 11), ("y", "a", "p", 15)],
        [("x", "a", "q", 9), ("x", "a", "r", 40), ("x", "b", "s", 11), ("x", "b", "t", 18)],  # one comes late
        [("x", "a", "r", 41), ("y", "a", "p", 80), ("y", "b", "z", 79)],
        [("x", "a", "p", 200), ("y", "b", "z", 78)],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame([(*r[:3], at(r[3])) for r in rows], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = live.drained(live.episodes(stream, 10, "20 seconds"))
    want = plain([(*r[:3], at(r[3])) for rows in batches for r in rows], 10, at(180))
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 4
