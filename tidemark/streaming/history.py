"""A card's history as the stream keeps it: a log of cumulative totals per second, in blocks.

Entry (t, n, cents, hi, lo) of the log holds the totals of all transactions up to and including second t; the sum of
squared cents is hi * 2**32 + lo. A block starts with the entry before its first, so any block that is left tells what
came before it. What a window holds is then the difference of two entries, and a transaction in order changes the last
block alone, however long the week before it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Entries of a block.
BLOCK = 256
#: Time of the entry before all others.
NEVER = -(1 << 62)
WIDTH = 5
NOTHING = np.array([NEVER, 0, 0, 0, 0], np.int64)


def to_bytes(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.int64).tobytes()


def to_rows(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, WIDTH)


class CardLog:
    """The log over a store of blocks. ``starts``: the first second of each block kept, the last being block ``tail``;
    ``last``: the last entry ever. ``load(number)`` gives a block's rows, or None if the store has let it expire."""

    def __init__(self, starts: np.ndarray, tail: int, last: np.ndarray, load: Callable, store: Callable, drop: Callable):
        self.starts, self.tail, self.last = starts, tail, last
        self._load, self._store, self._drop = load, store, drop
        self._seen: dict[int, np.ndarray | None] = {}

    def _rows(self, i: int) -> np.ndarray | None:
        """Rows of the i-th block kept."""
        number = self.tail - len(self.starts) + 1 + i
        if number not in self._seen:
            self._seen[number] = self._load(number)
        return self._seen[number]

    def before_all(self) -> int:
        """The last second that the log only knows as part of a total; nothing at or before it can be put in."""
        for i in range(len(self.starts)):
            rows = self._rows(i)
            if rows is not None:
                return int(rows[0, 0])
        return int(self.last[0]) if len(self.starts) else NEVER if self.last[0] == NEVER else int(self.last[0])

    def put(self, seconds: np.ndarray, totals: np.ndarray) -> None:
        """Adds ``totals`` (n, cents, hi, lo) of distinct sorted ``seconds``. Seconds in order touch the last block and new
        ones; earlier ones also every block after them."""
        at = max(0, int(np.searchsorted(self.starts, seconds[0], side="right")) - 1)
        kept = [rows for i in range(at, len(self.starts)) if (rows := self._rows(i)) is not None]
        if kept:
            old = np.concatenate([kept[0], *(rows[1:] for rows in kept[1:])])
        else:
            old = self.last[None, :]
            at = len(self.starts)
        every = np.unique(np.concatenate([old[1:, 0], seconds]))
        added = np.zeros((len(every), WIDTH - 1), np.int64)
        added[np.searchsorted(every, old[1:, 0])] += np.diff(old[:, 1:], axis=0)
        added[np.searchsorted(every, seconds)] += totals
        rows = np.concatenate([old[:1], np.column_stack([every, old[0, 1:] + np.cumsum(added, axis=0)])])
        first = self.tail - len(self.starts) + 1 + at  # number of the first block written
        starts = [self.starts[:at]]
        for k, a in enumerate(range(1, len(rows), BLOCK)):
            block = rows[a - 1 : a + BLOCK]
            self._seen[first + k] = block
            self._store(first + k, block)
            starts.append(block[1:2, 0])
        self.starts = np.concatenate(starts)
        self.tail = first + len(starts) - 2
        self.last = rows[-1]

    def before(self, times: np.ndarray) -> np.ndarray:
        """The entry before each of ``times``: totals of all earlier seconds."""
        out = np.empty((len(times), WIDTH), np.int64)
        if not len(self.starts):
            out[:] = self.last
            return out
        block = np.maximum(np.searchsorted(self.starts, times, side="left") - 1, 0)
        for i in np.unique(block).tolist():
            own = block == i
            rows = self._rows(i)
            if rows is None:  # expired: what followed tells
                later = next((r for j in range(i + 1, len(self.starts)) if (r := self._rows(j)) is not None), None)
                out[own] = self.last if later is None else later[0]
            else:
                out[own] = rows[np.searchsorted(rows[1:, 0], times[own], side="left")]
        return out

    def trim(self, horizon: int) -> None:
        """Lets go the blocks that no entry before ``horizon`` or later is in."""
        gone = int(np.searchsorted(self.starts, horizon, side="left")) - 1
        for i in range(gone):
            number = self.tail - len(self.starts) + 1 + i
            self._drop(number)
        if gone > 0:
            self.starts = self.starts[gone:]
