"""Words, hashes and shared small helpers of the text operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that one Python worker keeps hashes of; beyond it the memory is emptied and filled again.
HASHED_WORDS = 250_000


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: A-Z in lower case, split at space and the controls 9 to 13, as UTF-8 (null: none)."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that sums of products spread over all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input, whatever their names, cannot clash."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in columns])
