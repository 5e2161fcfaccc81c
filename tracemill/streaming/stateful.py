"""Rounds and steps of running sessions as streams with state.

`rounds` merges the segments of a round as they arrive: state is kept for each (source, request) and is the open round, so
it has the size of one round whatever the log's.  Whenever a batch brings segments of a round the whole round goes out again,
its `segments` telling how many it holds; the one with the most takes the place of the others (`latest_rounds`, or an upsert
by (source, round_id)).  Its usage is the last one reported.  Any cut of a log into batches that keeps its order ends in
the rounds of the batch parse.

`steps` numbers the steps of a session: an event of the closing type ends one.  State is the number of the open step, its
first event and how many it has.  A step goes out when it closes; one that stays open longer than `idle` goes out as it is,
marked as not closed, and goes on growing if more arrives.

Defined results: lines without a request share the key null and begin a round each time the chain changes, as in the batch
parse; events of equal order count in the order of arrival; state that was idle for longer than `forget` is dropped, and a
later segment begins a new round.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.sources import logs

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

ROUND = "source string, round_id long, agent string, ts string, model string, attribution_skill string, stop_reason string, u_in long, u_out long, u_cache_w long, u_cache_r long, text string, thinking string, segments long"
STEP = "step long, first_at long, last_at long, events long, closed boolean"


def rounds(lines: DataFrame, forget: str | None = None) -> DataFrame:
    """Updates of rounds from a stream of (source, line_no, raw)."""
    seg = logs.segments(logs.classify(lines)).select("source", "key", "line_no", "is_side", "agent", "ts", "model", "skill", "stop", *(F.col(f"usage.{n}").alias(f"u_{n}") for n in ("in", "out", "cache_w", "cache_r")), F.col("usage").isNotNull().alias("reported"), "text", "thinking")
    wait = _millis(forget)

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else None
        done = []
        rows = pd.concat(list(frames)).sort_values("line_no", kind="stable")
        for r in json.loads(rows.to_json(orient="records")):
            if now is None or now["is_side"] != r["is_side"]:  # the other chain uses the same key: another round
                if now is not None and now.pop("changed", False):
                    done.append(now)
                now = {"round_id": r["line_no"], "is_side": r["is_side"], "agent": r["agent"], "ts": r["ts"], "model": r["model"], "skill": None, "stop": None, "usage": [0, 0, 0, 0], "text": "", "thinking": "", "segments": 0}
            now["skill"] = now["skill"] or r["skill"]
            now["stop"] = r["stop"] or now["stop"]
            if r["reported"]:
                now["usage"] = [r[f"u_{n}"] for n in ("in", "out", "cache_w", "cache_r")]
            now["text"] += r["text"] or ""
            now["thinking"] += r["thinking"] or ""
            now["segments"] += 1
            now["changed"] = True
        if now.pop("changed", False):
            done.append(now)
        state.update((json.dumps(now),))
        if wait:
            state.setTimeoutDuration(wait)
        out = [[key[0], d["round_id"], d["agent"], d["ts"], d["model"], d["skill"], d["stop"], *d["usage"], d["text"], d["thinking"], d["segments"]] for d in done]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROUND.split(", ")])

    return seg.groupBy("source", "key").applyInPandasWithState(merge, ROUND, "round string", "update", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def latest_rounds(updates: DataFrame) -> DataFrame:
    """Of the updates of each round the last, which has the most segments."""
    return updates.groupBy("source", "round_id").agg(F.max_by(F.struct(*updates.columns), "segments").alias("r")).select("r.*")


def steps(events: DataFrame, by: str, order: str, closing: str, idle: str | None = None) -> DataFrame:
    """Steps (by, step, first_at, last_at, events, closed) from a stream of events with `by`, a whole-number `order` and `type`."""
    wait = _millis(idle)

    def assemble(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, first, last, n = state.get if state.exists else (0, None, None, 0)
        out = []
        if state.hasTimedOut:
            out = [(step, first, last, n, False)]
            state.update((step, first, last, n))  # without a timeout: it goes out once, until more arrives
        else:
            rows = pd.concat(list(frames)).sort_values(order, kind="stable")
            for at, kind in zip(rows[order].tolist(), rows["type"].tolist(), strict=True):
                first, last, n = at if first is None else first, at, n + 1
                if kind == closing:
                    out.append((step, first, last, n, True))
                    step, first, last, n = step + 1, None, None, 0
            state.update((step, first, last, n))
            if n and wait:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=[by, *(c.split()[0] for c in STEP.split(", "))])

    kind = events.schema[by].dataType.simpleString()
    rows = events.select(by, F.col(order).cast("long").alias(order), "type")
    return rows.groupBy(by).applyInPandasWithState(assemble, f"`{by}` {kind}, {STEP}", "step long, first long, last long, n long", "update", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


def _millis(duration: str | None) -> int:
    if not duration:
        return 0
    n, unit = duration.split()
    return int(n) * {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.removesuffix("s")]
