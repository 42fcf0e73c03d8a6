"""Ordered event logs: each stream goes on at its next position, in time that does not run back.

There is no watermark: a late event is refused and said so. An exact retry does nothing; a conflicting one is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = T.StructType([T.StructField("stream", T.StringType()), T.StructField("position", T.LongType()), T.StructField("event_id", T.StringType()), T.StructField("visibility_time", T.LongType()), T.StructField("content", T.StringType())])
DECIDED = T.StructType([*EVENT.fields, T.StructField("outcome", T.StringType())])
STATE = T.StructType([T.StructField("next_position", T.LongType()), T.StructField("visibility_time", T.LongType()), T.StructField("recent", T.StringType())])
#: Digests of this many last events are kept per stream: a retry from before them cannot be told and is refused.
RECENT = 256


@dataclass
class Frontier:
    next_position: int = 0
    visibility_time: int = -1
    recent: dict[int, str] = field(default_factory=dict)  # position -> digest

    def offer(self, position: int, event_id: str, visibility_time: int, content: str | None) -> str:
        """committed, retry, conflict, gap or late; only a committed event changes anything."""
        digest = hashlib.sha256(json.dumps([position, event_id, visibility_time, content]).encode()).hexdigest()
        if position < self.next_position:
            return "retry" if self.recent.get(position) == digest else "conflict"
        if position > self.next_position:
            return "gap"
        if visibility_time < max(self.visibility_time, 0):
            return "late"
        self.next_position, self.visibility_time = position + 1, visibility_time
        self.recent[position] = digest
        self.recent.pop(position - RECENT, None)
        return "committed"


def decide(rows: list[tuple], frontier: Frontier) -> list[str]:
    """Outcomes of rows (position, event_id, visibility_time, content), offered by position as they stand."""
    return [frontier.offer(*row) for row in rows]


def _outcomes(key, batches: Iterator, state: GroupState) -> Iterator:
    import pandas as pd

    held = state.get if state.exists else (0, -1, "{}")
    frontier = Frontier(held[0], held[1], {int(k): v for k, v in json.loads(held[2]).items()})
    pdf = pd.concat(list(batches), ignore_index=True).sort_values("position", kind="stable")
    columns = ["position", "event_id", "visibility_time", "content"]
    pdf["outcome"] = decide([(int(p), e, int(v), c) for p, e, v, c in pdf[columns].itertuples(index=False, name=None)], frontier)
    state.update((frontier.next_position, frontier.visibility_time, json.dumps(frontier.recent)))
    yield pdf[[f.name for f in DECIDED]]


def commits(events: DataFrame) -> DataFrame:
    """A streaming (or batch) frame of events with the outcome of each."""
    if events.isStreaming:
        return events.groupBy("stream").applyInPandasWithState(_outcomes, DECIDED, STATE, "append", GroupStateTimeout.NoTimeout)
    return events.groupBy("stream").applyInPandas(_batch, DECIDED)


def _batch(pdf):
    pdf = pdf.sort_values("position", kind="stable")
    columns = ["position", "event_id", "visibility_time", "content"]
    pdf["outcome"] = decide([(int(p), e, int(v), c) for p, e, v, c in pdf[columns].itertuples(index=False, name=None)], Frontier())
    return pdf[[f.name for f in DECIDED]]


LOAD = T.StructType([T.StructField("key", T.StringType()), T.StructField("step", T.LongType()), T.StructField("load", T.DoubleType())])


def decayed_counts(hits: DataFrame, decay: float) -> DataFrame:
    """(key, step, load) after each micro-batch of hits (key, step): counters that decay by ``decay`` per step."""

    def fold(key, batches, state):
        import pandas as pd

        load, last = state.get if state.exists else (0.0, 0)
        pdf = pd.concat(list(batches), ignore_index=True)
        for step, n in sorted(pdf.groupby("step").size().items()):
            step = max(int(step), last)
            load, last = load * decay ** (step - last) + int(n), step
        state.update((load, last))
        yield pd.DataFrame({"key": [key[0]], "step": [last], "load": [load]})

    state = T.StructType([T.StructField("load", T.DoubleType()), T.StructField("step", T.LongType())])
    return hits.groupBy("key").applyInPandasWithState(fold, LOAD, state, "update", GroupStateTimeout.NoTimeout)
