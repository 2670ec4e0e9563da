"""The recurring jobs as Structured Streaming queries."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitecast.operators import notebook as N


def upsert_stream(hours: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, late: str | None = None, keys: Sequence[str] = ("site_id", "ts")):
    """Every micro-batch of hourly rows goes to ``write``, an upsert that may run twice for one batch.

    With ``late``, rows further behind the newest event time (column ``ts``, a timestamp) than that are
    left out, and a row with the ``keys`` of one that came within that time is passed on once.
    """
    if late:
        hours = hours.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
    return hours.writeStream.foreachBatch(lambda batch, _: write(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_summary(hours: DataFrame, late: str = "6 days", offset: str = "23 hours") -> DataFrame:
    """Highs and lows of observed hours by local winter day and site; the window starts at 23:00 UTC."""
    rows = hours.where("not is_forecast").withWatermark("ts", late)
    return rows.groupBy("site_id", F.window("ts", "1 day", "1 day", offset).alias("day")).agg(F.min("temp_c").alias("temp_min"), F.max("temp_c").alias("temp_max"), F.count("*").alias("n_hours"))


class _EmailLimits(StatefulProcessor):
    """The limits that are kept by email, for one email.

    State: how many failures each second and address had since the email's last success, back to the widest window;
    a million attempts a second take one entry.  It expires by a timer when the watermark has passed the last failure's windows.
    """

    def __init__(self, limits: Sequence[tuple]):
        self.limits = [(name, "ip" in keys, most, width) for name, keys, most, width in limits]
        self.widest = max(width for *_, width in limits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "ip array<string>, ts array<long>, n array<long>")

    def _decide(self, rows: pd.DataFrame, held: dict[tuple, int]) -> tuple[list[tuple], dict[tuple, int]]:
        """One pass in the order of time with a deque and a count for each rule and address."""
        decided: list[tuple] = []
        queues: dict[tuple, deque] = {}
        counts: dict[tuple, int] = {}
        clear = lambda: (queues.clear(), counts.clear(), held.clear())

        def push(ip: str | None, ts: int, n: int) -> None:
            for name, by_ip, *_ in self.limits:
                if not by_ip or ip is not None:
                    key = (name, ip if by_ip else None)
                    queue = queues.setdefault(key, deque())
                    if queue and queue[-1][0] == ts:
                        queue[-1][1] += n
                    else:
                        queue.append([ts, n])
                    counts[key] = counts.get(key, 0) + n

        for (ip, ts), n in sorted(held.items(), key=lambda x: x[0][1]):
            push(ip, ts, n)
        ordered = rows[["attempt_id", "ip", "epoch", "ok"]].sort_values(["epoch", "attempt_id"]).itertuples(index=False)
        for ts, second in itertools.groupby(ordered, key=lambda r: r[2]):
            own = [(attempt, None if pd.isna(ip) else str(ip), ok) for attempt, ip, _, ok in second]
            success = max((i for i, r in enumerate(own) if r[2]), default=-1)
            if success >= 0:
                clear()
            for attempt, ip, ok in own:  # failures of one second aren't earlier than each other
                for name, by_ip, most, width in () if ok else self.limits:
                    key = (name, ip if by_ip else None)
                    queue = queues.get(key)
                    if not queue or by_ip and ip is None:
                        continue
                    while queue and queue[0][0] < ts - width:
                        counts[key] -= queue.popleft()[1]
                    if counts[key] >= most:
                        decided.append((attempt, name, queue[0][0] + width - ts))
                        break
            for _, ip, _ in own[success + 1 :]:
                push(ip, ts, 1)
                held[ip, ts] = held.get((ip, ts), 0) + 1
        return decided, held

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.live.get() if self.live.exists() else None
        held = {(ip, ts): n for ip, ts, n in zip(*old, strict=True)} if old else {}
        decided, held = self._decide(pd.concat(list(rows)), held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            newest = max(ts for _, ts in held)
            held = {k: n for k, n in held.items() if k[1] >= newest - self.widest}
            self.live.update(tuple(list(c) for c in zip(*((ip, ts, n) for (ip, ts), n in held.items()), strict=True)))
            self.handle.registerTimer(max((newest + self.widest + 1) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        elif old:
            self.live.clear()
        yield pd.DataFrame(decided, columns=["attempt_id", "rule", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.live.clear()
        yield pd.DataFrame(columns=["attempt_id", "rule", "retry_after"])

    def close(self) -> None:
        pass


#: The store that timers and expiring state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limiter_stream(attempts: DataFrame, limits: Sequence[tuple] = N.LIMITS, late: str = "1 hour") -> DataFrame:
    """(attempt_id, rule, retry_after) of the failed attempts that find a limit kept by email breached, as they come.

    attempts: attempt_id, email, ip, ts (timestamp), epoch (its seconds), ok.  Decisions fall at once, in the
    order of time within a batch, a second's successes before its failures; attempts that come later than newer ones are decided on what is held, and don't change
    what was decided (``limiter_upserts`` does, and also keeps the limits by address alone).  The session needs
    ``STATE_STORE`` as its state store.
    """
    own = [x for x in limits if "email" in x[1]]
    rows = attempts.where("email is not null").withWatermark("ts", late).select("email", F.col("ip").cast("string").alias("ip"), "attempt_id", "epoch", "ok", "ts")
    return rows.groupBy("email").transformWithStateInPandas(_EmailLimits(own), "attempt_id long, rule string, retry_after long", "Append", "EventTime")


def limiter_upserts(attempts: DataFrame, store: str, decisions: str, checkpoint: str, limits: Sequence[tuple] = N.LIMITS):
    """All the rules of ``limiter`` over a stream of attempts (attempt_id, email, ip, ts, ok).

    Attempts go to ``store`` by batch and day.  Each batch decides again on the failed attempts from its earliest on, with
    what the store holds of the widest window before them, so attempts that come late correct the
    decisions they touch.  A batch that runs twice overwrites its own files.  ``standing`` reads the result.
    """
    widest = max(width for *_, width in limits)
    columns = ("attempt_id", "email", "ip", "ts", "ok")

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns, F.lit(number).alias("batch"), F.floor(F.col("ts") / 86400).alias("day"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(store)
        first = rows.agg(F.min("ts")).first()[0]
        if first is None:
            return
        known = spark.read.parquet(store).where((F.col("day") >= (first - widest) // 86400) & (F.col("ts") >= first - widest) & (F.col("batch") <= number))
        known = known.groupBy("attempt_id").agg(F.max_by(F.struct(*columns[1:]), "batch").alias("r")).select("attempt_id", "r.*")  # of two deliveries the newest
        due = known.where(~F.col("ok") & (F.col("ts") >= first)).select("attempt_id")
        found = due.join(N.limiter(known, limits), "attempt_id", "left").withColumn("batch", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(decisions)

    return attempts.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(decisions: DataFrame) -> DataFrame:
    """The newest decision on each attempt that found a rule breached."""
    last = decisions.groupBy("attempt_id").agg(F.max_by(F.struct("rule", "retry_after"), "batch").alias("d"))
    return last.select("attempt_id", "d.rule", "d.retry_after").where("rule is not null")


def silence_stream(hours: DataFrame, limit_s: int = 6 * 3600, late: str = "1 hour") -> DataFrame:
    """A row (site_id, last_epoch) for every observed hour that none followed within ``limit_s``, by event time.

    An alarm is raised when the watermark has passed the end of the silence, so no later batch can refute
    it; hours further behind than ``late`` don't count.  State holds the hours that aren't settled.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = set(state.get[0]) if state.exists else set()
        if not state.hasTimedOut:
            held |= {int(x) for b in batches for x in b["epoch"]}
        now = state.getCurrentWatermarkMs() / 1000
        times = sorted(held)
        silent = [a for a, b in zip(times, [*times[1:], float("inf")], strict=True) if a + limit_s <= now and b > a + limit_s]
        rest = [t for t in times if t + limit_s > now]
        if rest:
            state.update((rest,))
            state.setTimeoutTimestamp(max((rest[0] + limit_s) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"site_id": [key[0]] * len(silent), "last_epoch": silent}).astype("int64")

    rows = hours.where("not is_forecast").withWatermark("ts", late).select("site_id", "ts", "epoch")
    return rows.groupBy("site_id").applyInPandasWithState(step, "site_id long, last_epoch long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
