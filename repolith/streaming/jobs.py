"""Job states over a stream of events (job_id, ts, ord, status): state per job, admission with a cooldown, expiry of ended jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from repolith.operators.jobs import COOLDOWN_MINUTES, KEEP_HOURS, decisions

STATE = "status string, created_at timestamp"
DECISIONS = "job_id long, ts timestamp, ord long, decision string"


def _decide(minutes: int, keep_ms: int):
    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame([], columns=["job_id", "ts", "ord", "decision"])
        if state.hasTimedOut:
            state.remove()
            yield none
            return
        events = pd.concat(list(batches)).sort_values(["ts", "ord"])
        out, job = decisions(key[0], list(zip(events["ts"], events["ord"], events["status"], events["cached"])), state.get if state.exists else None, minutes)
        if job:
            state.update(job)
            if job[0] in ("completed", "failed"):
                ended = int(events["ts"].iloc[-1].timestamp() * 1000)
                state.setTimeoutTimestamp(max(ended + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "ts", "ord", "decision"]) if out else none

    return decide


def admissions(events: DataFrame, minutes: int = COOLDOWN_MINUTES, keep_hours: float = KEEP_HOURS, delay: str = "1 hour") -> DataFrame:
    """A decision for each queued event (perhaps with ``cached``, from ``operators.jobs.with_cache``), as ``operators.jobs.admitted`` makes it.

    State is one row per job; that of an ended job goes once the watermark, ``delay`` behind the latest event, is ``keep_hours`` past
    its last event. That is longer than any cooldown, so a request that comes then is decided as before. Events later than
    the watermark are dropped.
    """
    if "cached" not in events.columns:
        events = events.withColumn("cached", F.lit(False))
    decide = _decide(minutes, max(int(keep_hours * 3_600_000), minutes * 60_000))
    return events.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(decide, DECISIONS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
