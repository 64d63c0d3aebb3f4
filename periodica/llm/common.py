"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable
from contextlib import suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of words, about, that a Python worker remembers the values of.
CACHE_BYTES = 32 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it on their path; once for an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if root.parent.suffix != ".zip":
        archive = Path(tempfile.mkdtemp(), f"{root.name}.zip")  # on the driver, which serves it
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """A 64-bit name of a text; a null text has the name of no other text."""
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(text), F.octet_length(F.col(text))))


class WordCache(dict):
    """Remembers what a function gave for a word; a full cache keeps the words it has, others are computed each time."""

    def __init__(self, make: Callable, most: int = CACHE_BYTES):
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, word):
        value = self.make(word)
        if self.held < self.most:
            self.held += len(word) + 150  # the word, its value and their place
            self[word] = value
        return value

    def clear(self) -> None:
        """Give the memory back: a worker goes on to tasks of other stages, which have caches of their own."""
        super().clear()
        self.held = 0


_HASHES = WordCache(xxhash.xxh3_64_intdigest)


def word_hashes(words: list) -> np.ndarray:
    """64-bit hashes of words (str or bytes); they are the same in every process."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


#: What forgets the words of an operator whose caches outlive its tasks.
FORGETTERS: list[Callable[[], object]] = [_HASHES.clear]


def forget_words() -> None:
    """Empty the caches of all operators: a worker goes on to tasks of other stages, and what it holds stands beside their memory."""
    for forget in FORGETTERS:
        forget()
    give_back()


def give_back() -> None:
    """Return to the system what Arrow and the C library hold free; without glibc, only Arrow's part goes."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
