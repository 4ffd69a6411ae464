"""Packing token streams into fixed windows by multiway differencing.

A document's ids and its end id are cut into full windows and a rest. A rest of more than PIECE ids is cut once more, into
PIECE ids and what is left. Rests are gathered into blocks; each block is dealt over its windows by the Karmarkar-Karp
method for many parts: every piece starts as a partial partition of its own, and the two partitions of the largest spread
are merged so that the fullest window of one meets the emptiest of the other, until one is left. If its fullest window
exceeds the capacity, the block is dealt again over one window more.
"""

from __future__ import annotations

import bisect
import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from marlstone.llm.session import map_texts, stored
from marlstone.llm.units import UnitCache

#: Ids in a window; windows in a block; ids in a piece of a rest.
WINDOW, BLOCK, PIECE = 1024, 128, 512
#: Ids of a block's windows left free at first, for the windows to differ a little.
SLACK = 64

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
)


def _join(a: tuple[list, list], b: tuple[list, list], windows: int) -> tuple[list, list]:
    """Two partial partitions merged, the fullest window of each with the emptiest of the other."""
    if len(b[0]) > 1 and len(a[0]) == 1:
        a, b = b, a
    sums, own = a
    if len(b[0]) == 1:  # one piece goes to the emptiest window
        size, members = b[0][0], b[1][0]
        if len(sums) == windows:
            size, members = sums.pop(0) + size, own.pop(0) + members
        at = bisect.bisect_left(sums, size)
        sums.insert(at, size)
        own.insert(at, members)
        return a
    (x, xs), (y, ys) = (([0] * (windows - len(s)) + s, [[]] * (windows - len(o)) + o) for s, o in (a, b))
    order = sorted(((p + q, k) for k, (p, q) in enumerate(zip(x, reversed(y), strict=True)) if p + q))
    return [n for n, _ in order], [xs[k] + ys[-1 - k] for _, k in order]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``sizes`` dealt over ``windows`` near-equal windows by multiway differencing.

    A partition is two lists, the sums of its windows in rising order and the indexes in each; windows that hold nothing
    are not listed. Pieces not yet merged wait in ``single``, largest last; a piece's spread is its size.
    """
    if not sizes:
        return [[] for _ in range(windows)]
    single = sorted(range(len(sizes)), key=lambda i: (sizes[i], -i))
    heap: list[tuple[int, int, tuple[list, list]]] = []

    def largest() -> tuple[list, list]:
        if single and (not heap or sizes[single[-1]] > -heap[0][0]):
            i = single.pop()
            return [sizes[i]], [[i]]
        return heapq.heappop(heap)[2]

    for made in range(len(sizes) - 1):
        sums, own = merged = _join(largest(), largest(), windows)
        heapq.heappush(heap, (-(sums[-1] - (sums[0] if len(sums) == windows else 0)), made, merged))
    got = largest()[1]
    return got + [[] for _ in range(windows - len(got))]


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: differencing over as few windows as can hold all, and more while any exceeds it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        got = difference(sizes, windows)
        if max(sum(sizes[i] for i in w) for w in got) <= capacity:
            return [w for w in got if w]
        windows += 1


class Packer:
    """Windows for a stream of (key, ids); ``add`` and ``finish`` give rows (key, start, length, crc32, total, sequence, offset, sequence length)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.next, self.window = first_sequence, window
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, key, ids: bytes) -> list[tuple]:
        view, window = memoryview(ids), self.window
        total, rows, at = len(ids) // 4, [], 0
        while total - at >= window:
            rows.append((key, at, window, zlib.crc32(view[4 * at : 4 * (at + window)]), total, self.next, 0, window))
            self.next += 1
            at += window
        piece = PIECE * window // WINDOW or 1
        while at < total:
            n = min(piece, total - at)
            if self.held + n > BLOCK * window - SLACK:
                rows += self.finish()
            self.waiting.append((key, at, n, zlib.crc32(view[4 * at : 4 * (at + n)]), total))
            self.held += n
            at += n
        return rows

    def finish(self) -> list[tuple]:
        rows = []
        for w in deal([p[2] for p in self.waiting], self.window) if self.waiting else []:
            offset, whole = 0, sum(self.waiting[i][2] for i in w)
            for i in sorted(w):
                rows.append((*self.waiting[i], self.next, offset, whole))
                offset += self.waiting[i][2]
            self.next += 1
        self.waiting, self.held = [], 0
        return rows


class LibraryWords:
    """Ids of words by the tokenizers library, as bytes. Words that a space begins are encoded as one text: the split cuts
    before each space, and of a word's tokens the first alone begins with one."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.opens = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        self.opens[[i for t, i in tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True  # the byte alphabet's space

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode(self, words: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        spaced = [w for w in words if w[0] == " " and not w[1:2].isspace() and len(w) > 1]
        if len(spaced) > 1:
            ids = self._ids("".join(spaced))
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(spaced):
                flat, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                known = {w: flat[i:j] for w, i, j in zip(spaced, at, at[1:], strict=False)}
        return [known[w] if w in known else self._ids(w).tobytes() for w in words]


@lru_cache(maxsize=2)
def library_ids(path: str) -> UnitCache:
    """Ids by the tokenizers library, word by word: the split's words are encoded apart from each other anyway."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    t = Tokenizer.from_file(path)
    special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    t.no_truncation()
    t.no_padding()
    return UnitCache(LibraryWords(t).encode, special)


def pack_documents(
    docs: DataFrame, vocabulary_path: str, end_id: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    Every id of a document (its text's and ``end_id`` after them) lies in exactly one piece, and the pieces of a sequence
    fill it from 0 without gaps. Each task packs the rows it reads, without a shuffle; a sequence id holds the task's
    number in its upper bits, so the pieces are written once to the shared folder. At most one block per task is not full.
    A null text counts as empty: its one id is ``end_id``. Rows of null or equal ids, and equal rows, are packed as documents of their own; an empty table gives
    no piece; other columns are not read.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        encode = library_ids(vocabulary_path).ids_of
        packer = Packer(TaskContext.get().partitionId() << 36, window)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for b in batches:
            rows: list[tuple] = []
            for i, ids in zip(b["doc_id"], encode(b["text"]), strict=True):
                rows += packer.add(None if pd.isna(i) else int(i), ids + end)
            if rows:
                yield frame(rows)
        if rows := packer.finish():
            yield frame(rows)

    # Stored, as then a batch has 8 MB of text at most: all words of a batch are in a worker's memory at once.
    return stored(map_texts(docs, run, SCHEMA, id_col, text_col), "packed")
