"""Word tables for executors: in memory while they are small, beyond that sorted files that are searched in place, so that no word is left out."""

from __future__ import annotations

import atexit
import mmap
import shutil
import tempfile
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words looked up that a process remembers.
REMEMBERED = 200_000


class SortedWords:
    """Different words with a number each, sorted by their bytes in a file that every executor fetches and maps into memory; it reads like a dictionary."""

    def __init__(self, rows: DataFrame):
        """``rows``: (word, number), each word once. They pass the driver one partition at a time."""
        folder = Path(tempfile.mkdtemp(prefix="actlens-"))
        atexit.register(shutil.rmtree, folder, True)
        self.path, self.size = str(folder / f"words-{uuid.uuid4().hex}"), 0
        word, number = rows.columns
        at = 0
        with open(f"{self.path}.w", "wb") as words, open(f"{self.path}.n", "wb") as numbers:
            array("q", [0, 0]).tofile(numbers)
            for r in rows.where(F.col(word).isNotNull()).select(word, F.col(number).cast("bigint")).orderBy(word).toLocalIterator():
                at += words.write(r[0].encode())
                array("q", [at, r[1]]).tofile(numbers)
                self.size += 1
        for end in "wn":
            rows.sparkSession.sparkContext.addFile(f"{self.path}.{end}")
        self._memo: dict[str, int | None] = {}
        self._words = self._numbers = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "size": self.size, "_memo": {}, "_words": None, "_numbers": None}

    def _map(self, end: str) -> mmap.mmap:
        path = f"{self.path}.{end}"
        with open(path if Path(path).exists() else SparkFiles.get(Path(path).name), "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def _word(self, i: int) -> bytes:
        return self._words[self._numbers[2 * i] : self._numbers[2 * i + 2]]

    def _place(self, key: bytes) -> int:
        """Index of the first word that isn't less."""
        if self._numbers is None:
            self._numbers = memoryview(self._map("n")).cast("q")
            self._words = self._map("w") if self._numbers[2 * self.size] else b""
        return bisect_left(range(self.size), key, key=self._word)

    def get(self, word: str, default=None):
        if word in self._memo:
            found = self._memo[word]
        else:
            key = word.encode()
            i = self._place(key)
            found = self._numbers[2 * i + 3] if i < self.size and self._word(i) == key else None
            if len(self._memo) >= REMEMBERED:
                self._memo.clear()
            self._memo[word] = found
        return default if found is None else found

    def __contains__(self, word: str) -> bool:
        return self.get(word) is not None

    def __getitem__(self, word: str) -> int:
        found = self.get(word)
        if found is None:
            raise KeyError(word)
        return found

    def starting(self, prefix: str) -> Iterator[str]:
        """The words that begin with ``prefix``, in order."""
        key = prefix.encode()
        i = self._place(key)
        while i < self.size and (word := self._word(i)).startswith(key):
            yield word.decode()
            i += 1


def word_counts(rows: DataFrame, most: int) -> dict | SortedWords:
    """(word, number) as a dictionary if there are at most ``most``, else as a sorted file. ``rows`` is read twice."""
    return SortedWords(rows) if rows.count() > most else {r[0]: r[1] for r in rows.toLocalIterator()}


def word_set(rows: DataFrame, most: int) -> frozenset | SortedWords:
    """The words of a table of one column as a set if there are at most ``most``, else as a sorted file."""
    found = word_counts(rows.select(F.col(rows.columns[0]), F.lit(1).alias("_n")), most)
    return frozenset(found) if isinstance(found, dict) else found
