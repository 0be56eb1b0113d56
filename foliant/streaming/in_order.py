"""Stateful streams whose answer doesn't depend on how the stream is cut: rows wait until the watermark has passed them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that wait in one value of the state, as JSON: each value goes to the state store and back by itself, which costs far more than a row's own work.
PACKED = 1_000


def packed(rows: list) -> list[tuple[str]]:
    """Rows of numbers, strings and nulls as few values of a list state."""
    return [(json.dumps(rows[k : k + PACKED]),) for k in range(0, len(rows), PACKED)]


class InOrder(StatefulProcessor):
    """Rows of a key wait in a list, which a timer wakes up: once a second has passed they are handled in order of time, and so is what falls due between them.

    Subclasses name the columns of a row (rows, of numbers and strings; its first is at, in seconds, and the first three tell rows apart), and say what their state is.
    """

    rows: str

    def variables(self, handle: StatefulProcessorHandle) -> None:
        """Makes the state variables."""
        raise NotImplementedError

    def load(self) -> Any:
        raise NotImplementedError

    def save(self, state: Any) -> None:
        raise NotImplementedError

    def due(self, state: Any) -> int | None:
        """The second in which something happens if no row comes before."""
        raise NotImplementedError

    def move(self, state: Any, row: tuple) -> tuple[Any, list]:
        """The state after a row, and what is to be told."""
        raise NotImplementedError

    def pass_time(self, state: Any, now: int) -> tuple[Any, list]:
        """The state when a second has come and all rows before it are handled, and what is to be told."""
        raise NotImplementedError

    def output(self, key: Any, told: Any) -> Row:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.names = handle, [c.split()[0] for c in self.rows.split(", ")]
        self.waiting = handle.getListState("packed", "rows string")
        self.variables(handle)

    def rearm(self, state: Any, first: int | None, watermark: int) -> None:
        """One timer for a key: when the second of the first row that waits is over or, if that is sooner, when something is due."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        times = [t for t in (None if first is None else first + 1, self.due(state)) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times) * 1000, watermark + 1))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [[r[c] for c in self.names] for r in rows]
        self.waiting.appendList(packed(new))
        at, armed = max((min(r[0] for r in new) + 1) * 1000, timerValues.getCurrentWatermarkInMs() + 1), list(self.handle.listTimers())
        if not armed or at < min(armed):  # else what waits or is due comes first already
            for old in armed:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        watermark, state, told, left = timerValues.getCurrentWatermarkInMs(), self.load(), [], []
        for row in sorted((tuple(r) for value in self.waiting.get() for r in json.loads(value[0])), key=lambda r: r[:3]):
            if (row[0] + 1) * 1000 > watermark:
                left.append(row)
            else:
                state, more = self.move(state, row)
                told += more
        state, more = self.pass_time(state, watermark // 1000)
        told += more
        self.save(state)
        if left:
            self.waiting.put(packed(left))
        else:
            self.waiting.clear()
        self.rearm(state, left[0][0] if left else None, watermark)
        for t in told:
            yield self.output(key, t)

    def close(self) -> None:
        pass
