"""Per-task memory of what a function gave for a word."""

from collections.abc import Callable, Iterable

import numpy as np


class Memo(dict):
    """A dict that fills itself by ``make`` and starts anew when it holds ``most`` words."""

    def __init__(self, make: Callable, most: int = 1 << 17):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value

    def array(self, words: Iterable, count: int, kind) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), kind, count)
