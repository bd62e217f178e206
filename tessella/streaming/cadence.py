"""Streams: outputs at a cadence as tumbling windows, append-only histories, votes in a row as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cadence(events: DataFrame, ts: str, dt: str, *aggregates: Column, late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of each period of ``dt``; on a stream, rows later than ``late`` are dropped and periods come once complete."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, dt), *by).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(c for c in out.columns if c != "window"))


def votes_in_a_row(tagged: DataFrame, block: str, order: str, tag: str, count: int) -> DataFrame:
    """``block``, ``order``, ``act`` of each vote: 1 at once, -1 after ``count`` votes of -1 in a row, with the run as state.

    A block's rows come in order from batch to batch; within a batch they are sorted here. The state is one number a block.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        acts = []
        for vote in rows[tag]:
            run = run + 1 if vote == -1 else 0
            acts.append(1 if vote == 1 else -1 if run >= count else 0)
        state.update((run,))
        yield pd.DataFrame({block: rows[block].to_numpy(), order: rows[order].to_numpy(), "act": acts})

    schema = f"{block} long, {order} long, act int"
    return tagged.groupBy(block).applyInPandasWithState(update, schema, "run int", "append", GroupStateTimeout.NoTimeout)
