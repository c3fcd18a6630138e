"""Token ids of many words through a bounded memo.

Most words of a text have been seen before, so a tokenizer that treats words on their own only has to encode the
new ones.  The memo lives in the Python worker, starts afresh once it holds more than ``limit`` words (so it never
holds more than that and the words of one chunk):
its size does not grow with the data and its content never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from weftline.llm.tasks import ranges

MEMO_WORDS = 400_000


class _Slots(dict):
    """Slot numbers of words; a word asked for the first time gets the next number and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word):
        self[word] = slot = len(self)
        self.new.append(word)
        return slot


class WordIds:
    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = MEMO_WORDS):
        self.encode = encode
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)

    @staticmethod
    def _room(array: np.ndarray, needed: int) -> np.ndarray:
        if needed <= len(array):
            return array
        grown = np.zeros(max(needed, 2 * len(array)), array.dtype)
        grown[: len(array)] = array
        return grown

    def lookup(self, words: list) -> np.ndarray:
        """Slots of the words, valid until the next call."""
        if len(self.slots) > self.limit:
            self._clear()
        first = len(self.slots)
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        if new := self.slots.new:
            self.slots.new = []
            ids, sizes = self.encode(new)
            last = first + len(new)
            self.flat = self._room(self.flat, self.used + len(ids))
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts, self.sizes = self._room(self.starts, last), self._room(self.sizes, last)
            self.sizes[first:last] = sizes
            self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
        return slots

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slots end to end, and the number of ids of each."""
        sizes = self.sizes[slots]
        return self.flat[ranges(self.starts[slots], sizes)], sizes


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive groups of the given sizes (groups may be empty)."""
    totals = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=totals[1:])
    ends = np.cumsum(counts)
    return totals[ends] - totals[ends - counts]
