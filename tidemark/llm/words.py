"""Feature rows of words, computed once for each distinct word that a worker meets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordTable:
    """word -> row of `width` numbers. Bounded: when it holds `limit` words, it forgets them and starts anew."""

    def __init__(self, rows_of: Callable[[list[bytes]], np.ndarray], limit: int = 250_000):
        self.rows_of, self.limit = rows_of, limit
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((0, 0), np.float32)

    def take(self, words: list[bytes]) -> np.ndarray:
        """(len(words), width)"""
        at = list(map(self.at.get, words))
        if None in at:
            if len(self.at) > self.limit:
                self.at, at = {}, [None] * len(words)
            new = list({w for w, i in zip(words, at, strict=True) if i is None})
            rows, n = self.rows_of(new), len(self.at)
            if n + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), n + len(new), 4096), rows.shape[1]), np.float32)
                if n:
                    grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n : n + len(new)] = rows
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
            at = list(map(self.at.__getitem__, words))
        return self.rows[at]
