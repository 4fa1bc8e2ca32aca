"""Online versions of the event operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, size: str = "10 minutes", late: str = "3 minutes", *keys: str) -> DataFrame:
    """Events of every tumbling window; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Sessions by gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_result(results: DataFrame, ident: str, time: str, late: str) -> DataFrame:
    """The first result of repeated work wins."""
    return results.withWatermark(time, late).dropDuplicatesWithinWatermark([ident])


def stretches(crossings: DataFrame, outside_gap_s: float = 180.0, shortest_s: float = 20.0, late: str = "3 minutes") -> DataFrame:
    """Stretches inside from in/out crossings (person, ts, kind), one stream state for each person.

    An "in" within ``outside_gap_s`` of the last "out" re-opens the stretch; an "out" after an "out" replaces it. A stretch
    is final once the watermark is ``outside_gap_s`` past its end; stretches shorter than ``shortest_s`` are dropped. An
    "out" without an "in" is a stretch of its own and unknown start. An unfinished stretch is never emitted.
    """
    schema = "person string, start double, end double, complete boolean"

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end = state.get if state.exists else (None, None)
        rows, fold = [], []
        if not state.hasTimedOut:
            for f in frames:
                fold += [(t.timestamp(), k) for t, k in zip(f["ts"], f["kind"], strict=True)]
        for t, kind in sorted(fold):
            if kind == "in":
                if end is not None and t - end > outside_gap_s:
                    rows.append((start, end))
                    start = end = None
                start, end = t if start is None else start, None
            elif end is None or t - end <= outside_gap_s:
                end = t
            else:
                rows.append((start, end))
                start, end = None, t
        if state.hasTimedOut and end is not None:
            rows.append((start, end))
            start = end = None
        if start is None and end is None:
            if state.exists:
                state.remove()
        else:
            state.update((start, end))
            if end is not None:
                state.setTimeoutTimestamp(max(int((end + outside_gap_s) * 1000), state.getCurrentWatermarkMs() + 1))
        rows = [(key[0], s, e, s is not None) for s, e in rows if s is None or e - s >= shortest_s]
        yield pd.DataFrame(rows, columns=["person", "start", "end", "complete"])

    return crossings.withWatermark("ts", late).groupBy("person").applyInPandasWithState(run, schema, "start double, end double", "append", GroupStateTimeout.EventTimeTimeout)
