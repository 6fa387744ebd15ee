"""Results by key in bounded memory."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """compute(key) for each key asked for, kept for at most about twice `limit` keys; the ones in use stay.

    Keys of more than LONGEST characters are not kept. Results must not be None.
    """

    LONGEST = 64

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(key) > self.LONGEST:
            return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def of(self, keys: list) -> list:
        """The results of keys: one pass of plain look-ups, and one over those that have to be computed."""
        found = list(map(self.get, keys))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self[keys[i]]
        return found
