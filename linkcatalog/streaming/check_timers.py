"""The check machine on keyed state with timers: checks may come late and out of order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "link long, checks long, status string, attempts int, flips int"
_FOLDED = "checks long, status string, before string, attempts int, flips int"
_START = (0, "", "", 0, 0)
CLAIMED = "checking"


def fold(state: tuple, statuses: Iterable[str]) -> tuple:
    """(checks, status, status before the claim, attempts, changes of validity) after more checks in their order.

    ``checking`` is a claim: what stood before it is the baseline of the result that follows, which counts on
    where it repeats the baseline and starts at 1 where it doesn't. A claim upon a claim means that the first
    was lost: it counts an attempt itself, and the result, which has no baseline then, counts none.
    """
    checks, status, base, attempts, flips = state
    for new in statuses:
        checks += 1
        if new == CLAIMED:
            attempts += status == CLAIMED
            base = CLAIMED if status == CLAIMED else status
        else:
            base = base if status == CLAIMED else status
            attempts = attempts if base == CLAIMED else attempts + 1 if new == base else 1
            flips += (new == "valid") != (base == "valid")
        status = new
    return checks, status, base, attempts, flips


class _Checks(StatefulProcessor):
    """Checks wait as a list until the watermark has passed them; a timer then folds them, in order, into the state
    and lets them go. Each batch also tells what all checks so far come to, waiting ones included."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", _FOLDED)
        self.waiting = handle.getListState("waiting", "at long, id long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for frame in rows:
            found = list(zip(frame["checked_at"].astype("int64"), frame["check_id"].astype("int64"), frame["status"]))
            self.waiting.appendList([(int(a), int(i), s) for a, i, s in found])
            latest = max(latest, *(int(a) for a, _, _ in found))
        self.handle.registerTimer(latest * 1000)
        state = fold(self._state(), [s for _, _, s in sorted(self.waiting.get())])
        yield pd.DataFrame({"link": [key[0]], "checks": [state[0]], "status": [state[1]], "attempts": [state[3]], "flips": [state[4]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000
        waiting = sorted(self.waiting.get())
        self.folded.update(fold(self._state(), [s for at, _, s in waiting if at <= until]))
        later = [x for x in waiting if x[0] > until]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        yield pd.DataFrame(columns=["link", "checks", "status", "attempts", "flips"])

    def _state(self) -> tuple:
        return tuple(self.folded.get()) if self.folded.exists() else _START

    def close(self) -> None:
        pass


def check_timers(checks: DataFrame, late: str = "1 day") -> DataFrame:
    """Per link, after each batch that has checks of it: checks, last status, attempts, changes of validity, as if all
    checks so far had come in order. Checks that come after the watermark has passed them are dropped; waiting
    checks take state for the time ``late`` alone.

    ``checks``: link, check_id, checked_at (seconds), at (the same as a time stamp), status. Needs the RocksDB state
    store.
    """
    rows = checks.withWatermark("at", late).select("link", "check_id", "checked_at", "status", "at")
    return rows.groupBy("link").transformWithStateInPandas(_Checks(), OUTPUT, "update", "EventTime")
