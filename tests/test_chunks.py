import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from textfix.streaming.chunks import idle_chunks, stop_chunks, stop_chunks_stream

ROW = "who string, ts timestamp, text string"
START = dt.datetime(2024, 1, 1)
STOPS = "length(text) - length(replace(text, '.', ''))"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def by_hand(rows, gap, limit=2):
    """One key after another, one moment after another."""
    out = []
    for who in {r[0] for r in rows}:
        moments = {}
        for w, ts, text in rows:
            if w == who:
                n, s = moments.get(ts, (0, 0))
                moments[ts] = (n + 1, s + (text or "").count("."))
        chunk, last, seen = None, None, 0
        for ts in sorted(moments):
            if last is not None and (ts - last).total_seconds() > gap:
                if chunk:
                    out.append((who, *chunk, "idle"))
                chunk, seen = None, 0
            n, s = moments[ts]
            chunk = [chunk[0] if chunk else ts, ts, (chunk[2] if chunk else 0) + n, (chunk[3] if chunk else 0) + s]
            if (seen + s) // limit > seen // limit:
                out.append((who, *chunk, "stops"))
                chunk = None
            seen, last = seen + s, ts
        if chunk:
            out.append((who, *chunk, "idle"))
    return sorted(out, key=str)


def typed(seed, n=400):
    rng, rows = random.Random(seed), []
    for who in ("a", "b", "c"):
        clock = 0.0
        for _ in range(n):
            clock += rng.choice([0, 0.1, 0.3, 0.6, 0.7, 0.8, 5, 300])
            rows.append((who, at(clock), rng.choice(["x", "y z", ".", "e.g.", "...", "", None])))
    return rows


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_chunks_equal_a_walk_by_hand(spark, limit):
    rows = typed(1) + [(None, at(1), "."), (None, at(1.2), "."), (None, at(1.3), "x")]
    df = spark.createDataFrame(rows, ROW).repartition(5)
    want = by_hand(rows, 0.7, limit)
    for micros in (86_400_000_000, 2_000_000):  # also with stretches that go over many slices
        got = stop_chunks(df, ["who"], "ts", F.expr(STOPS), 0.7, limit, micros)
        assert got.columns == ["who", "chunk_start", "chunk_end", "n", "stops", "closed_by"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert {w[-1] for w in want} == {"idle", "stops"}


def test_without_stops_only_gaps_count(spark):
    df = spark.createDataFrame(typed(2), ROW)
    idle = idle_chunks(df, ["who"], "ts", 0.7)
    got = stop_chunks(df, ["who"], "ts", F.lit(0), 0.7).drop("stops", "closed_by")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, idle.collect()), key=str)
    assert stop_chunks(df.limit(0), ["who"], "ts", F.expr(STOPS), 0.7).collect() == []


def test_stream_closes_the_same_chunks_under_late_rows(spark, tmp_path):
    rows = sorted(typed(3, 150), key=lambda r: r[1])
    rng = random.Random(5)
    # Rows arrive up to eight seconds late, in five files; some come far too late and are dropped.
    arrival = sorted(rows, key=lambda r: (r[1] - START).total_seconds() + rng.random() * 8)
    step = len(arrival) // 5 + 1
    files = [arrival[k : k + step] for k in range(0, len(arrival), step)]
    reached = [max(r[1] for f in files[: k + 1] for r in f) for k in range(len(files))]
    assert all(r[1] > seen - dt.timedelta(seconds=10) for f, seen in zip(files[1:], reached) for r in f)
    too_late = [("a", at(-500), "."), ("b", at(-400), "..")]
    end = reached[-1] + dt.timedelta(days=1)
    files[3] = files[3] + too_late
    files += [[("z", end, "x")], [("z", end + dt.timedelta(days=1), "x")]]
    folder = tmp_path / "in"
    for k, some in enumerate(files):
        spark.createDataFrame(some, ROW).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        folder.mkdir(exist_ok=True)
        made = next((tmp_path / f"part{k}").glob("*.parquet"))
        (folder / f"{k}.parquet").write_bytes(made.read_bytes())
        time.sleep(0.02)
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(folder))
    chunks = stop_chunks_stream(stream, ["who"], "ts", F.expr(STOPS), 0.7, "10 seconds")
    run = chunks.writeStream.format("memory").queryName("stop_chunks").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(240)
    got = [tuple(r) for r in spark.table("stop_chunks").where("who != 'z'").collect()]
    batch = stop_chunks(spark.createDataFrame(rows, ROW), ["who"], "ts", F.expr(STOPS), 0.7)
    assert sorted(got, key=str) == sorted(map(tuple, batch.collect()), key=str) == by_hand(rows, 0.7)
