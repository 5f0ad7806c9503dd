"""Chunks of activity that end after an idle gap or some full stops; each is one correction request."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textfix.operators.ordering import previous_value

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY_MICROS = 86_400_000_000


def idle_chunks(
    df: DataFrame, keys: list[str], ts: str, gap_seconds: float, slice_micros: int = DAY_MICROS
) -> DataFrame:
    """Rows (keys, chunk_start, chunk_end, n) of a bounded table.

    Time is cut into slices, so that the rows of a very active key are spread over many tasks.
    """
    timed = _timed(df, keys, ts, F.lit(0))
    marked = _with_begin(timed, keys, gap_seconds, slice_micros)
    return (
        marked.groupBy(*keys, "_begin")
        .agg(
            F.min(ts).alias("chunk_start"), F.max(ts).alias("chunk_end"), F.sum("_n").alias("n")
        )
        .drop("_begin")
    )


def _timed(df: DataFrame, keys: list[str], ts: str, stops: Column) -> DataFrame:
    """One row per key and moment."""
    at = F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")
    return df.groupBy(*keys, at).agg(
        F.min(ts).alias(ts), F.count(F.lit(1)).alias("_n"), F.sum(stops).cast("long").alias("_stops")
    )


def _with_begin(timed: DataFrame, keys: list[str], gap_seconds: float, slice_micros: int) -> DataFrame:
    """Add ``_begin``, the first moment of the stretch without an idle gap."""
    gap = int(gap_seconds * 1_000_000)
    linked = previous_value(timed, "_at", F.col("_at"), "_last", keys, slice_micros)
    opens = F.when(F.col("_last").isNull() | (F.col("_at") - F.col("_last") > gap), F.col("_at"))
    opened = linked.withColumn("_open", opens)
    marked = previous_value(opened, "_at", F.col("_open"), "_since", keys, slice_micros)
    return marked.withColumn("_begin", F.coalesce("_open", "_since")).drop("_last", "_open", "_since")


def stop_chunks(
    df: DataFrame, keys: list[str], ts: str, stops: Column, gap_seconds: float, limit: int = 2,
    slice_micros: int = DAY_MICROS,
) -> DataFrame:
    """Rows (keys, chunk_start, chunk_end, n, stops, closed_by) of a bounded table.

    ``stops`` is the number of full stops that a row brings. A chunk ends with the row that brings the
    ``limit``-th full stop, counted from the last idle gap on (``closed_by`` is ``stops``; what a row
    brings beyond it counts for the next chunk), or before a gap of more than ``gap_seconds`` (``idle``).
    Rows of one key and moment are one. Full stops are added up in slices of time, so that no window
    holds all rows of a key.
    """
    marked = _with_begin(_timed(df, keys, ts, F.coalesce(stops, F.lit(0))), keys, gap_seconds, slice_micros)
    # A struct of the keys: NULL keys equal themselves in joins.
    sliced = marked.withColumns({
        "_g": F.struct(F.lit(0).alias("_0"), *keys, "_begin"), "_slice": F.floor(F.col("_at") / slice_micros),
    })
    front = Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("_g", "_slice").agg(F.sum("_stops").alias("_sum"))
    sums = sums.select("_g", "_slice", F.coalesce(F.sum("_sum").over(front), F.lit(0)).alias("_carried"))
    local = Window.partitionBy("_g", "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counted = sliced.withColumn("_local", F.coalesce(F.sum("_stops").over(local), F.lit(0)))
    counted = counted.join(sums, ["_g", "_slice"]).withColumn("_before", F.col("_carried") + F.col("_local"))
    chunks = counted.groupBy("_g", *keys, F.floor(F.col("_before") / limit).alias("_no")).agg(
        F.min(ts).alias("chunk_start"), F.max(ts).alias("chunk_end"), F.sum("_n").alias("n"),
        F.sum("_stops").alias("stops"), F.min("_before").alias("_first"),
    )
    full = F.floor((F.col("_first") + F.col("stops")) / limit) > F.col("_no")
    closed = F.when(full, "stops").otherwise("idle").alias("closed_by")
    return chunks.select(*keys, "chunk_start", "chunk_end", "n", "stops", closed)


def idle_chunks_stream(
    df: DataFrame, keys: list[str], ts: str, gap: str, lateness: str
) -> DataFrame:
    """The same over a stream; rows later than ``lateness`` are dropped and counted by Spark."""
    windows = df.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap))
    closed = windows.agg(F.max(ts).alias("chunk_end"), F.count(F.lit(1)).alias("n"))
    return closed.select(
        *keys, F.col("session_window.start").alias("chunk_start"), "chunk_end", "n"
    )


STATE = (
    "start long, last long, n long, stops long, before long, "
    "at array<long>, rows array<long>, marks array<long>"
)


def stop_chunks_stream(
    df: DataFrame, keys: list[str], ts: str, stops: Column, gap_seconds: float, lateness: str, limit: int = 2
) -> DataFrame:
    """The chunks of :func:`stop_chunks` over a stream.

    Rows wait until the watermark has passed them, so that they are counted in the order of their times
    however they arrive; rows later than ``lateness`` are dropped and counted by Spark. A chunk comes
    out once its last full stop, or the gap behind it, has been passed. The state of a key is its open
    chunk and the rows that wait. Keys must not be NULL.
    """
    gap = int(gap_seconds * 1_000_000)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, first long, last long, n long, stops long, closed_by string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n, marks, before, *waits = state.get if state.exists else (None, None, 0, 0, 0, [], [], [])
        waiting = {a: (r, m) for a, r, m in zip(*waits)}
        for batch in batches:
            summed = batch.groupby("_at").agg(rows=("_stops", "size"), marks=("_stops", "sum"))
            for a, r, m in zip(summed.index.tolist(), summed["rows"].tolist(), summed["marks"].tolist()):
                old = waiting.get(a, (0, 0))
                waiting[a] = (old[0] + r, old[1] + m)
        passed = state.getCurrentWatermarkMs() * 1000
        out = []

        def close(why: str) -> None:
            nonlocal start, n, marks
            if start is not None:
                out.append((*key, start, last, n, marks, why))
            start, n, marks = None, 0, 0

        for a in sorted(a for a in waiting if a <= passed):
            rows, stopped = waiting.pop(a)
            if last is not None and a - last > gap:
                close("idle")
                before = 0
            start, last = a if start is None else start, a
            n, marks = n + rows, marks + stopped
            if (before + stopped) // limit > before // limit:
                close("stops")
            before += stopped
        if last is not None and passed - last >= gap:
            close("idle")
            last, before = None, 0
        if last is None and not waiting:
            if state.exists:
                state.remove()
        else:
            order = sorted(waiting)
            state.update((start, last, n, marks, before, order, *[[waiting[a][k] for a in order] for k in (0, 1)]))
            due = min(([last + gap] if last is not None else []) + order[:1])
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*key_names, "first", "last", "n", "stops", "closed_by"])

    key_names = list(keys)
    timed = df.withWatermark(ts, lateness).select(
        *keys, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"),
        F.coalesce(stops, F.lit(0)).cast("long").alias("_stops"),
    )
    found = timed.groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        *keys, F.timestamp_micros("first").alias("chunk_start"), F.timestamp_micros("last").alias("chunk_end"),
        "n", "stops", "closed_by",
    )
