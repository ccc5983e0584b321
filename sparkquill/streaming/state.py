"""State over event streams: what jobs have come to, and limits of hits. Job states work on static frames too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingestion import STAGES


def job_states(log: DataFrame, first: str = STAGES[0]) -> DataFrame:
    """job, seq, stage, status, attempts from (job, seq, stage, status): the last event of each job, and how often ``first`` began.

    Events may come in any order, since the greatest seq decides. As a stream it is written in update mode.
    """
    last = F.max(F.struct("seq", "stage", "status")).alias("last")
    rows = log.groupBy("job").agg(last, F.count_if(F.col("stage") == first).alias("attempts"))
    return rows.select("job", "last.seq", "last.stage", "last.status", "attempts")


def limited(hits: DataFrame, limit: int, seconds: float, late: str = "10 minutes") -> DataFrame:
    """key, hit, allowed for a stream (key, hit, ts): a hit is allowed while under ``limit`` allowed ones lie in the seconds before it.

    Hits of one key are judged in order of (ts, hit) within an Arrow batch, and batches as they come. The state of a key is
    its last ``limit`` allowed times at most; it goes when the watermark has passed the last of them by ``seconds``.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.assign(at=frame["ts"].map(pd.Timestamp.timestamp)).sort_values(["at", "hit"])
            verdicts = []
            for at in frame["at"]:
                times = [t for t in times if t > at - seconds]
                verdicts.append(len(times) < limit)
                if verdicts[-1]:
                    times.append(at)
            yield pd.DataFrame({"key": frame["key"], "hit": frame["hit"], "allowed": verdicts})
        state.update((times,))
        over = int((max(times, default=0) + seconds) * 1000)
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))

    rows = hits.select("key", "hit", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(judge, "key long, hit long, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


class _Stages(StatefulProcessor):
    """One job's events in the order of (ts, seq), however they come in.

    Events wait in a map by seq until the watermark has passed them, for which each sets a timer; the value state is the
    number of the last stage handed on. An event that comes again while it waits replaces itself, and one that comes again
    after it was handed on lies behind the watermark or is known by its seq.
    """

    def __init__(self, stages: list[str]):
        self.stages = stages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "stage string, at long")
        self.last = handle.getValueState("last", "number int, at long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        handed = self.last.get() if self.last.exists() else (0, -1, -1)
        for frame in rows:
            for seq, stage, ts in zip(frame["seq"], frame["stage"], frame["ts"]):
                at = int(ts.timestamp() * 1000)
                if (at, int(seq)) > (handed[1], handed[2]):
                    self.waiting.updateValue((int(seq),), (stage, at))
                    self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((at, seq[0], stage) for seq, (stage, at) in self.waiting.iterator() if at <= upto)
        number = self.last.get()[0] if self.last.exists() else 0
        out = []
        for at, seq, stage in due:
            here = self.stages.index(stage) + 1 if stage in self.stages else 0
            out.append((key[0], seq, stage, here == 1 or (here > 1 and here == number + 1)))
            number = here
            self.waiting.removeKey((seq,))
        if due:
            self.last.update((number, due[-1][0], due[-1][1]))
        if out:
            yield pd.DataFrame(out, columns=["job", "seq", "stage", "valid"]).astype({"stage": object})

    def close(self) -> None:
        pass


def checked_stages(log: DataFrame, stages: list[str] = STAGES, late: str = "10 minutes") -> DataFrame:
    """job, seq, stage, valid of a stream (job, seq, stage, ts): what ``ingestion.transitions`` gives for the whole log.

    ``ts`` ascends with ``seq`` in a job; events may come in any order within ``late``, and more than once. The state of a job is
    what waits for the watermark and one row. It needs the state store on RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = log.select("job", "seq", "stage", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("job").transformWithStateInPandas(_Stages(stages), "job long, seq long, stage string, valid boolean", "append", "EventTime")
