"""How often each word occurs in all texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrace.llm.texts import give_back, slices


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sum of their counts."""
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def word_counts(docs: DataFrame, *, split: Callable[[bytes | None], list[bytes]], text: str = "text") -> DataFrame:
    """How often each word, by its 64-bit hash, occurs in all texts: h, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        held: tuple[list, list] = ([], [])
        size = 0
        for b in slices(batches, 0):
            h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *[hashes.of(split(t)) for t in b.column(0).to_pylist()]]), return_counts=True)
            held[0].append(h)
            held[1].append(n)
            size += len(h)
            if size > 4_000_000:
                h, n = add_up(*held)
                held, size = ([h], [n]), len(h)
        hashes.clear()
        if held[0]:
            h, n = add_up(*held)
            for a in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 100_000]), pa.array(n[a : a + 100_000])], ["h", "n"])
            del h, n
        del held
        give_back(collect=False)

    source = docs.select(F.col(text).cast("binary").alias("_text"))
    return source.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = int.from_bytes(xxhash.xxh3_64_digest(word), "little", signed=True)
        return h

    def of(self, of_words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, of_words), np.int64, len(of_words))
