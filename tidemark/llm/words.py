"""Words of whole texts as numpy arrays, through a bounded table of the Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words and characters that a table holds before it starts anew (between batches).
WORDS = 200_000
CHARS = 8_000_000
MARKS = ".,;:!?\"'()[]{}<>|*#$%&“”‘’«»…-–—_/\\"
_FACTOR = 0x9E3779B97F4A7C15


def bare(word: str) -> str:
    """A word in lower case without marks around it; a word of marks alone stays."""
    return word.strip(MARKS).lower() or word


class WordTable(dict):
    """Numbers words in order of first sight; ``column(k)`` is an array of what ``describe`` gives."""

    def __init__(self, describe: Callable[[str], tuple], dtypes: tuple):
        super().__init__()
        self.describe, self.dtypes = describe, dtypes
        self.pending: list[tuple] = []
        self.chars = self.filled = 0
        self.columns = [np.empty(1024, dtype=d) for d in dtypes]

    def __missing__(self, word: str) -> int:
        k = self[word] = self.filled + len(self.pending)
        self.pending.append(self.describe(word))
        self.chars += len(word)
        return k

    def trim(self) -> None:
        """Start anew once the bounds are passed; earlier numbers are void then."""
        if len(self) > WORDS or self.chars > CHARS:
            self.clear()
            self.__init__(self.describe, self.dtypes)

    def codes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def column(self, k: int) -> np.ndarray:
        if self.pending:
            upto = self.filled + len(self.pending)
            for n, values in enumerate(zip(*self.pending, strict=True)):
                if upto > len(self.columns[n]):
                    self.columns[n] = np.resize(self.columns[n], 2 * upto)
                self.columns[n][self.filled : upto] = values
            self.filled = upto
            self.pending.clear()
        return self.columns[k]


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` hashes (none if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(_FACTOR)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * factor + hashes[j : j + n]
        return (out ^ (out >> np.uint64(29))) * factor
