"""Sessions as a stream: openings and renewals in the order of event time, whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.access import RENEW_S

DAY_S = 86_400


class Renewal(StatefulProcessor):
    """The state of a token: when its session ends, and the events that wait until the watermark has passed them, so that
    earlier ones that come later are counted first. A timer goes off for each waiting second, and one when the session has
    ended, which clears it: state is as large as the sessions that live and the events within the watermark's delay."""

    def __init__(self, days: int):
        self.length = days * DAY_S

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "expires long")
        self.waiting = handle.getMapState("waiting", "at long", "opens boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            at = int(row.at)
            known = self.waiting.containsKey((at,)) and self.waiting.getValue((at,))[0]
            self.waiting.updateValue((at,), (bool(row.opens or known),))
            self.handle.registerTimer(at * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        end = self.expires.get()[0] if self.expires.exists() else None
        for (at,) in sorted(k for k in self.waiting.keys() if k[0] <= now):
            (opens,) = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            new = at + self.length
            if opens or end is not None and end >= at and new - end > RENEW_S:
                end = new
                self.expires.update((end,))
                self.handle.registerTimer((end + 1) * 1000)
                yield Row(token=key[0], at=at, expires=end)
        if end is not None and end < now:
            self.expires.clear()

    def close(self) -> None:
        pass


def session_renewals(events: DataFrame, days: int = 90, late: str = "1 day") -> DataFrame:
    """(token, at, expires) of each opening and renewal of sessions, of a stream of events (token, ts, opens): what
    access.renewals() gives of them at once, once the watermark, `late` behind the newest event, has passed. Needs the
    RocksDB state store."""
    rows = events.select("token", F.col("ts").cast("timestamp").alias("ts"), "opens").withWatermark("ts", late)
    rows = rows.select("token", "ts", F.unix_seconds("ts").alias("at"), F.coalesce("opens", F.lit(False)).alias("opens"))
    return rows.groupBy("token").transformWithState(Renewal(days), "token string, at long, expires long", "Append", "EventTime")
