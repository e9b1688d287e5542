"""What a task has worked out for words, in flat arrays of a bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ..."""
    out = np.repeat(begin - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class Column:
    """A run of values for each word, one after the other."""

    def __init__(self, kind):
        self.flat, self.begin, self.size, self.used = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, n: int, flat: np.ndarray, size: np.ndarray) -> None:
        """Values of the words from number n on."""
        self.flat = _room(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin, self.size = _room(self.begin, n + len(size)), _room(self.size, n + len(size))
        self.begin[n : n + len(size)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(size)] = size
        self.used += len(flat)

    def keep(self, numbers: np.ndarray) -> None:
        size = self.size[numbers]
        self.flat = self.flat[ranges(self.begin[numbers], size)]
        self.begin, self.size, self.used = np.cumsum(size) - size, size, len(self.flat)

    def of(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of words in order, and where those from each bound on begin."""
        size = self.size[numbers]
        return self.flat[ranges(self.begin[numbers], size)], np.concatenate([[0], np.cumsum(size)])[bounds]


class Remembered:
    """Numbers of words; ``learn`` gives, for new words, flat values and their sizes for each column.

    When there are more than ``most``, the half that most calls have met stays.
    """

    def __init__(self, kinds: list, learn: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], most: int, at_once: int = 20_000):
        self.columns, self.learn, self.most, self.at_once = [Column(k) for k in kinds], learn, most, at_once
        self.at: dict[str, int] = {}
        self.seen = np.zeros(0, np.int32)

    def _forget(self) -> None:
        n = len(self.at)
        keep = np.sort(np.argsort(-self.seen[:n], kind="stable")[: self.most // 2])
        number = np.full(n, -1)
        number[keep] = np.arange(len(keep))
        self.at = {w: k for w, k in zip(self.at, number.tolist(), strict=True) if k >= 0}
        self.seen = self.seen[keep] // 2
        for c in self.columns:
            c.keep(keep)

    def numbers(self, words: pa.StringArray) -> np.ndarray:
        """The number of each word; they hold until the next call."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.at) > self.most:
            self._forget()
        new = [w for w in names if w not in self.at]
        for i in range(0, len(new), self.at_once):
            part, n = new[i : i + self.at_once], len(self.at)
            for column, (flat, size) in zip(self.columns, self.learn(part), strict=True):
                column.add(n, flat, size)
            self.at.update(zip(part, range(n, n + len(part)), strict=True))
        self.seen = _room(self.seen, len(self.at))
        number = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))
        self.seen[number] += 1
        return number[coded.indices.to_numpy()]


def blocks(texts: pa.Array, at_once: int):
    """Runs of texts (null: empty) of about so many bytes together: the texts, their UTF-8 end to end, and where each begins and the last ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + at_once, "right")) - 1)
        yield texts.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
