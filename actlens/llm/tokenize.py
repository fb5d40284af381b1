"""Byte-level BPE over a whole corpus by a pair occurrence index.

Each partition collects its distinct pre-tokens once, lays their bytes out as one linked list of symbols, and keeps for every
active merge rank the positions at which its pair occurs. Ranks are applied in ascending order; a merge updates only the
neighbouring pairs and files them under their own ranks. All steps on positions are numpy vector operations, so the cost follows
the number of distinct pre-tokens, not the number of tokens.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.session import ship

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The pre-token pattern that belongs to the public vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that one round of the index holds; bounds a task's memory whatever the partition's size.
ROUND_CHARS = 24_000_000
#: Pre-tokens that a task remembers between rounds before it starts afresh.
MEMO = 2_000_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            table[chr(spare)] = b
            spare += 1
    return table


class PairIndexEncoder:
    """Merge table of one vocabulary and the vectorised encoder of lists of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbols = model["vocab"], _byte_symbols()
        self.of_byte = np.zeros(256, np.int64)
        for sign, byte in symbols.items():
            self.of_byte[byte] = vocab[sign]
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        wanted = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (a >= 0) & (b >= 0), self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words laid end to end, and the number of ids of each."""
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        # every word is followed by a barrier of symbol -1, so that no pair crosses two words
        total = len(raw) + len(words)
        sym = np.full(total + 1, -1, np.int64)
        word_of = np.repeat(np.arange(len(words)), lengths)
        sym[np.arange(len(raw)) + word_of] = self.of_byte[raw]
        nxt = np.arange(1, total + 2)
        nxt[-1] = total
        prv = np.arange(-1, total)
        prv[0] = total
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(positions: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks >= 0
            positions, ranks = positions[keep], ranks[keep]
            if not len(ranks):
                return
            by = np.argsort(ranks, kind="stable")
            positions, ranks = positions[by], ranks[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            starts = [0, *cuts.tolist(), len(ranks)]
            for k, rank in enumerate(ranks[starts[:-1]].tolist()):
                part = positions[starts[k] : starts[k + 1]]
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        file(np.arange(total), self.ranks(sym[:total], sym[1:]))
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            after = nxt[at]
            ok = (sym[at] == a) & (sym[after] == b)
            if not ok.all():
                at, after = at[ok], after[ok]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                # runs of one symbol: from the left, every second position of a run
                linked = after[:-1] == at[1:]
                begins = np.flatnonzero(np.concatenate(([True], ~linked)))
                offset = np.arange(len(at)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(at)]))))
                even = offset % 2 == 0
                at, after = at[even], after[even]
            beyond, before = nxt[after], prv[at]
            sym[at] = made
            sym[after] = -2
            nxt[at] = beyond
            prv[beyond] = at
            file(np.concatenate((before, at)), np.concatenate((self.ranks(sym[before], sym[at]), self.ranks(sym[at], sym[beyond]))))
        live = sym[:total] >= 0
        owner = np.repeat(np.arange(len(words)), lengths + 1)
        return sym[:total][live].astype(np.int32), np.bincount(owner[live], minlength=len(words))


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


class _Memo(dict):
    """Number of each pre-token in order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def encode_batches(batches: Iterator[list[str | None]], path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each list of texts: all ids end to end, and the offsets of the texts in them."""
    model, split = encoder(path), regex.compile(PATTERN).findall
    memo, flat, start, size = _Memo(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for texts in batches:
        if len(memo) > MEMO:
            memo, flat, start, size = _Memo(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = len(memo)
        number, used, counts = memo.__getitem__, [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                words = np.fromiter(map(number, split(text)), np.int64)
                used.append(words)
                counts[k] = len(words)
        if len(memo) > known:
            fresh = [w.encode("utf-8", "replace") for w in list(memo)[known:]]
            ids, lengths = model.encode(fresh)
            start = np.concatenate((start, len(flat) + np.cumsum(lengths) - lengths))
            size, flat = np.concatenate((size, lengths)), np.concatenate((flat, ids))
        words = np.concatenate(used) if used else np.zeros(0, np.int64)
        sizes = size[words]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.repeat(start[words] - (ends - sizes), sizes) + np.arange(total)]
        word_ends = np.cumsum(counts)
        bounds = np.concatenate(([0], np.concatenate(([0], ends))[word_ends])).astype(np.int64)
        yield out, bounds


def _rounds(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    chars = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(column).nbytes
        step = max(1, batch.num_rows * ROUND_CHARS // max(size, 1))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            held.append(part)
            chars += min(size, ROUND_CHARS) * part.num_rows // min(step, batch.num_rows)
            if chars >= ROUND_CHARS:
                yield pa.Table.from_batches(held)
                held, chars = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = DEFAULT_TOKENIZER, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` array<int> (or ``n_tokens`` bigint if ``counts_only``) and the columns ``keep``.

    Texts are encoded whole, without special tokens; the strings of special tokens are ordinary text. Null and empty texts give an empty
    list (0 tokens); a blank text is encoded like any other. Repeated rows give repeated results, an empty table an empty one;
    other columns of the input are ignored, whatever their names. ``tokenizer`` is the path of the vocabulary file.
    """
    if not os.path.isabs(tokenizer):
        raise ValueError("tokenizer must be an absolute path")
    ship(df.sparkSession)
    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    value = "n_tokens bigint" if counts_only else "ids array<int>"
    schema = ", ".join([f"`{id_col}` {kinds['_id']}", value, *(f"`{k}` {kinds[k]}" for k in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[pa.Table] = []

        def texts() -> Iterator[list[str | None]]:
            for t in _rounds(batches, "_text"):
                first.append(t)
                yield t.column("_text").to_pylist()

        for ids, bounds in encode_batches(texts(), tokenizer):
            t = first.pop()
            if counts_only:
                value_array: pa.Array = pa.array(np.diff(bounds))
            else:
                value_array = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            columns = [t.column("_id").combine_chunks(), value_array, *(t.column(k).combine_chunks() for k in keep)]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, value.split()[0], *keep])

    return picked.mapInArrow(run, schema)

