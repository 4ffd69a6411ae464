"""Ids of texts by byte-level BPE, a batch of texts at a time, so that each different word is encoded once.

The split into words is computed over the code points of all texts together; the words are then numbered by an Arrow
dictionary, only words that the worker does not remember are encoded, and ids are gathered by word number.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from marlstone.llm.characters import WHITE, character_classes

#: Words of the current generation; when there are so many, they become the old one, whose words return when met.
KEPT = 200_000
#: Longer words are not kept.
KEPT_LENGTH = 48
#: Characters of texts that are split at once (some 20 bytes of memory each), and a place where a longer text may be cut: a
#: space that begins a word.
AT_ONCE = 1_000_000
SAFE = regex.compile(rf"(?<=[\p{{L}}\p{{N}}]) (?=[\p{{L}}\p{{N}}])")


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` and of each text their number.

    A word is a run of letters, of numbers or of other characters, each with a space before it if there is one; or one of
    's 't 're 've 'm 'll 'd where no other word has taken the apostrophe; or white space, of which the last character is
    left to what follows.
    """
    joined = "".join(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    if not joined:
        return pa.array([], pa.large_string()), np.zeros(len(texts), dtype=np.int64)
    data = joined.encode()
    n = len(joined)
    points = np.frombuffer(data, dtype="u1") if len(data) == n else np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    kind = character_classes()[points]
    opens = np.zeros(n + 3, dtype=bool)  # the first character of a text; so are places beyond the last
    opens[np.r_[0, ends[ends < n]]] = opens[n:] = True
    edge = opens.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    last = np.flatnonzero(white & ~opens[1 : n + 1] & np.r_[~white[1:], False])
    edge[last] = True
    edge[last[points[last] == 32] + 1] = False
    marks = np.flatnonzero(points == 39)
    marks = marks[edge[marks] & ~opens[marks + 1]]
    if marks.size:
        after = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = after[marks + 1], np.where(opens[marks + 2], 0, after[marks + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        edge[marks[short | long] + 1] = False
        edge[marks[short] + 2] = edge[marks[long] + 3] = True
    starts = np.flatnonzero(edge[:n])
    if len(data) == n:
        offsets = np.r_[starts, n]
    else:
        sizes = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8)
        offsets = np.r_[0, np.cumsum(np.add.reduceat(sizes, starts, dtype=np.int64))]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return words, np.diff(np.r_[0, np.searchsorted(starts, ends)])


def words(text: str) -> list[str]:
    return split_words([text])[0].to_pylist()


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class UnitCache:
    """Ids of texts as little-endian unsigned 32-bit integers. ``encode_words`` gives these bytes for each of some words."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], special: dict[str, int]):
        self.encode_words, self.special = encode_words, special
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def _look_up(self, asked: list[str]) -> list[bytes]:
        """Ids of different words; unknown ones are encoded together."""
        if len(self.known) > KEPT:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        parts = list(map(known.get, asked))
        missing = [k for k, p in enumerate(parts) if p is None]
        fresh = []
        for k in missing:
            w = asked[k]
            p = parts[k] = old.get(w)
            if p is None:
                fresh.append(k)
            else:
                known[w] = p
        for k, p in zip(fresh, self.encode_words([asked[k] for k in fresh]) if fresh else [], strict=True):
            parts[k] = p
            if len(asked[k]) <= KEPT_LENGTH:
                known[asked[k]] = p
        return parts

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts of AT_ONCE characters or so together."""
        found, counts = split_words(texts)
        numbered = found.dictionary_encode()
        codes = numbered.indices.to_numpy()
        parts = self._look_up(numbered.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        of_word = sizes[codes]
        ends = np.r_[0, np.cumsum(of_word)]
        shift = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        places = np.arange(ends[-1])
        places += np.repeat(shift, of_word)
        ids = flat[places]
        at = ends[np.r_[0, np.cumsum(counts)]].tolist()
        for a, b in zip(at, at[1:], strict=False):
            yield ids[a:b].tobytes()

    def _parts(self, text: str) -> list[str | int]:
        """Pieces of a text that are encoded apart, and special ids between them."""
        out: list[str | int] = []
        pieces = self.cut.split(text) if self.cut is not None and any(s in text for s in self.special) else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(self.special[piece])
                continue
            at = 0
            while len(piece) - at > AT_ONCE and (m := SAFE.search(piece, at + AT_ONCE)):
                out.append(piece[at : m.start()])
                at = m.start()
            out.append(piece[at:])
        return out

    def ids_of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in turn."""
        waiting: list[list[str | int]] = []
        held = 0
        for text in texts:
            waiting.append(self._parts(text))
            held += len(text)
            if held >= AT_ONCE:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[str | int]]) -> Iterator[bytes]:
        pieces, size = [[]], 0
        for p in (p for parts in waiting for p in parts if isinstance(p, str)):
            if size and size + len(p) > 2 * AT_ONCE:
                pieces.append([])
                size = 0
            pieces[-1].append(p)
            size += len(p)
        ids = (x for group in pieces for x in self._plain(group))
        for parts in waiting:
            yield b"".join([next(ids) if isinstance(p, str) else p.to_bytes(4, "little") for p in parts])

    def ids(self, text: str) -> bytes:
        return next(self.ids_of([text]))
