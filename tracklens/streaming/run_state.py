"""Progress of runs, kept current by the stream of what happens to their stages.

Events are (run_id, stage_id, seq, status, retryable, attempt_count, lease_expires_at, at). State is kept for each run: of
each stage the event with the greatest seq, and the run's counts, which change by what a stage was and is; so an
event costs the same however many stages a run has. Repeated events and those that come after a newer one change
nothing. A running stage whose lease ends before it says anything else, by event time, is failed for good if it has had
all its attempts and is queued again otherwise; a timer for each lease sees to that.

The state store must be RocksDB (``STATE_STORE`` names the setting). Defined results: events without run, stage, seq or time
are left out; a null status counts as queued, a null ``retryable`` as false, null attempts as 0; a running stage
without a lease never expires; events later than the watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

C = F.col
EVENT = "run_id string, stage_id string, seq long, status string, retryable boolean, attempt_count int, lease_expires_at timestamp, at timestamp"
PROGRESS = "run_id string, total long, done long, running long, failed long, eligible long, version long"
COUNTED = ["total", "done", "running", "failed", "eligible"]
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def counted(status: str, retryable: bool, attempts: int, max_attempts: int) -> tuple[int, ...]:
    """What a stage adds to COUNTED."""
    again = status == "failed" and retryable and attempts < max_attempts
    done = status in ("succeeded", "skipped") or (status == "failed" and not again)
    return 1, int(done), int(status == "running"), int(status == "failed"), int(status == "queued" or again)


class RunProgress(StatefulProcessor):
    def __init__(self, max_attempts: int = 3):
        self.max_attempts = max_attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage_id string", "seq long, status string, retryable boolean, attempts int, lease long")
        self.counts = handle.getValueState("counts", ", ".join(f"{c} long" for c in [*COUNTED, "version"]))

    def _put(self, stage: str, new: tuple, counts: list) -> None:
        """Stores (seq, status, retryable, attempts, lease) and moves the counts from what the stage was."""
        if self.stages.containsKey((stage,)):
            _, status, retryable, attempts, _ = self.stages.getValue((stage,))
            for i, v in enumerate(counted(status, retryable, attempts, self.max_attempts)):
                counts[i] -= v
        self.stages.updateValue((stage,), new)
        for i, v in enumerate(counted(*new[1:4], self.max_attempts)):
            counts[i] += v

    def _told(self, key, counts: list):
        import pandas as pd

        counts[-1] += 1
        self.counts.update(tuple(counts))
        return pd.DataFrame([(key[0], *counts)], columns=["run_id", *COUNTED, "version"])

    def _now(self) -> list:
        return list(self.counts.get()) if self.counts.exists() else [0] * (len(COUNTED) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        counts, moved = self._now(), False
        for pdf in rows:
            for stage, seq, status, retryable, attempts, lease in pdf.sort_values("seq")[["stage_id", "seq", "status", "retryable", "attempts", "lease"]].itertuples(index=False):
                if self.stages.containsKey((stage,)) and self.stages.getValue((stage,))[0] >= seq:
                    continue
                self._put(stage, (int(seq), status, bool(retryable), int(attempts), int(lease)), counts)
                moved = True
                if status == "running" and lease >= 0:
                    self.handle.registerTimer(int(lease))
        if moved:
            yield self._told(key, counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now, counts, moved = expiredTimerInfo.getExpiryTimeInMs(), self._now(), False
        for (stage,), (seq, status, retryable, attempts, lease) in list(self.stages.iterator()):
            if status == "running" and 0 <= lease <= now:
                spent = attempts >= self.max_attempts
                self._put(stage, (seq, "failed" if spent else "queued", False if spent else retryable, attempts, -1), counts)
                moved = True
        if moved:
            yield self._told(key, counts)

    def close(self) -> None:
        pass


def run_progress(events: DataFrame, late: str = "1 hour", max_attempts: int = 3) -> DataFrame:
    """The stream of PROGRESS: a row for a run whenever its counts change; the row of the greatest version holds."""
    known = events.where("run_id IS NOT NULL AND stage_id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    lease = F.coalesce(F.unix_millis("lease_expires_at"), F.lit(-1))
    rows = known.select("run_id", "stage_id", "seq", F.coalesce("status", F.lit("queued")).alias("status"), F.coalesce("retryable", F.lit(False)).alias("retryable"), F.coalesce("attempt_count", F.lit(0)).alias("attempts"), lease.alias("lease"), "at")
    return rows.groupBy("run_id").transformWithStateInPandas(RunProgress(max_attempts), PROGRESS, "Update", "EventTime")
