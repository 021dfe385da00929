"""State machines as streams: friend requests by pair, and invites by code.

The state of a key holds what the fold of its events needs and no event itself, so any split of the log
into batches gives what one batch gives. Friend requests fold in any order. Signups compete by time, so
each waits until the watermark has passed it; timers then decide them in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.functions.shipping import ship

ship(__name__)

#: The state store that timers and map states need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Friends(StatefulProcessor):
    """The earliest request of a pair, and whether the other side asked too or one was accepted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pair = handle.getValueState("pair", "created_at string, id long, requester long, addressee long, sides int, said boolean, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.pair.get() if self.pair.exists() else None
        first, sides, said, n = (tuple(old[:4]), old[4], old[5], old[6]) if old else (None, 0, False, 0)
        for frame in rows:
            for at, i, a, b, status in zip(*(frame[c] for c in ("created_at", "id", "requester", "addressee", "status")), strict=True):
                asked = (at, int(i), int(a), int(b))
                first = min(first, asked) if first else asked
                sides |= 1 if a < b else 2
                said = said or status == "accepted"
                n += 1
        self.pair.update((*first, sides, said, n))
        state = "accepted" if sides == 3 or said else "pending"
        yield pd.DataFrame([(first[2], first[3], first[0], state, n)], columns=["requester", "addressee", "created_at", "status", "n"])

    def close(self) -> None:
        pass


def friend_states(requests: DataFrame) -> DataFrame:
    """(requester, addressee, created_at, status, n) of each pair that a batch touched; the row with the greatest ``n`` counts.

    ``requests`` has id, requester, addressee, status and created_at (text). A request in return accepts,
    asking again changes nothing.
    """
    paired = requests.where("requester <> addressee").withColumns({"lo": F.least("requester", "addressee"), "hi": F.greatest("requester", "addressee")})
    return paired.groupBy("lo", "hi").transformWithStateInPandas(Friends(), "requester long, addressee long, created_at string, status string, n long", "Update", "None")


class Invites(StatefulProcessor):
    """Whether a code's invite is there, used, and until when; signups wait for the watermark in a map by time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.invite = handle.getValueState("invite", "used boolean, expires_at string")
        self.waiting = handle.getMapState("waiting", "ms long", "signups string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for kind, i, ms, at, used, end in zip(*(frame[c] for c in ("kind", "id", "ms", "at", "used", "expires_at")), strict=True):
                if kind == "invite":
                    self.invite.update((bool(used), None if pd.isna(end) else end))
                else:
                    before = self.waiting.getValue((int(ms),))[0] if self.waiting.containsKey((int(ms),)) else ""
                    self.waiting.updateValue((int(ms),), (f"{before}{int(i)} {at}\n",))
                    self.handle.registerTimer(int(ms))
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "refusal": pd.Series([], dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Signups of a moment whose time has come, in the order of their ids; timers come in the order of their times."""
        ms = expiredTimerInfo.getExpiryTimeInMs()
        told = []
        if self.waiting.containsKey((ms,)):
            own = sorted((int(i), at) for i, at in (line.split(" ", 1) for line in self.waiting.getValue((ms,))[0].splitlines()))
            self.waiting.removeKey((ms,))
            for i, at in own:
                if not self.invite.exists():
                    told.append((i, "no such invite"))
                    continue
                used, end = self.invite.get()
                refusal = "used" if used else "expired" if end is not None and end <= at else None
                if refusal is None:
                    self.invite.update((True, end))
                told.append((i, refusal))
        yield pd.DataFrame(told, columns=["id", "refusal"]).astype({"id": "int64", "refusal": "object"})

    def close(self) -> None:
        pass


def signup_outcomes(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(id, refusal) of each signup once the watermark has passed it.

    ``events`` has kind (invite or signup), id, code, ts (timestamp), at (its text), used and expires_at. Of
    several signups with one code the first valid one takes it. An invite counts if it stands in the log
    before the watermark passes the signup; signups later than the watermark are dropped.
    """
    timed = events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("code").transformWithStateInPandas(Invites(), "id long, refusal string", "Append", "EventTime")
