"""Token counts by a finite-state transducer over characters whose transitions carry emitted-token counts.

The transducer is deterministic and compiled on demand. A state holds where the scan stands in the word split, and for
each vocabulary entry that may still be completed the last token before it: enough to know the unique last token of
every longer prefix. A long text is cut into chunks. White space leads every state back to the start, so a chunk's state
map is a head, which depends on the state that comes in, and a constant rest. The head is the scan from a word's start and
the states that it meets: a scan from any other state falls in with it after a few characters. Maps of neighbouring
chunks compose, and a parallel prefix scan gives state and count at each chunk's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

from marlstone.llm.bpe import Vocabulary, vocabulary
from marlstone.llm.characters import LETTER, NUMBER, RUN, character_classes, fold
from marlstone.llm.session import map_texts

#: Characters in a chunk of a long text.
CHUNK = 65_536
#: States kept at most; when there are more, compilation starts anew, within a text too.
STATES = 250_000
#: Remembered runs of the current generation; when there are so many, they become the old one, whose runs return when met.
RUNS, RUN_LENGTH = 400_000, 48

#: Characters after which two scans of one text have nearly always met.
MEETING = 128

#: Control characters that Python splits at though they are no white space.
CONTROL = regex.compile("[\x1c-\x1f]")
KINDS = {LETTER: "letters", NUMBER: "digit"}
#: Word endings that the vocabulary's split takes after an apostrophe (fixed values).
SHORT, LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}
NOTHING = ()


class Transducer:
    """Lazily compiled; state 0 is the start of a word. ``step[q][c]`` is (next state, tokens emitted)."""

    def __init__(self, words: Vocabulary):
        self.compatible = words.merges.compatible
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        # Symbols: the 256 bytes, and 256 more for a byte that ends a word.
        for i in words.tokens:
            symbols = list(words.bytes[i])
            if words.ends_word[i]:
                symbols[-1] += 256
            at = 0
            for s in symbols:
                if s not in self.trie[at]:
                    self.trie[at][s] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                at = self.trie[at][s]
            self.token[at] = i
        self.marks_end = bool(words.suffix)
        self.kinds: dict[str, str] = {}
        self.runs: dict[str, int] = {}  # counts of runs don't depend on state numbers
        self.old: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.step: list[dict[str, tuple[int, int]]] = []
        self.end: list[int | None] = []
        self._state(("", None, -1))

    def _state(self, key: tuple) -> int:
        q = self.number.get(key)
        if q is None:
            q = self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
            self.end.append(None)
        return q

    # The open entries of a prefix are (trie node, last token before it, tokens before it less those of the prefix).
    _FRESH = ((0, -1, 0),)

    def _feed(self, live: tuple | None, symbol: int) -> tuple[tuple, int]:
        """Open entries after one more symbol, and the change of the prefix's token count."""
        grown, last, count = [], None, 0
        for node, before, tokens in self._FRESH if live is None else live:
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            t = self.token[child]
            if t is not None and last is None and (before == -1 or self.compatible(before, t)):
                last, count = t, tokens + 1
            if self.trie[child]:
                grown.append((child, before, tokens))
        return ((0, last, 0), *((n, b, k - count) for n, b, k in grown)), count

    def _bytes(self, live: tuple | None, pending: int, c: str) -> tuple[tuple | None, int, int]:
        """A further character of a word. The last byte waits, as it may end the word."""
        out = 0
        for b in c.encode():
            if pending >= 0:
                live, k = self._feed(live, pending)
                out += k
            pending = b
        return live, pending, out

    def _close(self, live: tuple | None, pending: int) -> int:
        """Tokens that the end of the word adds."""
        return self._feed(live, pending + 256 * self.marks_end)[1] if pending >= 0 else 0

    def _word(self, text: str) -> int:
        live, pending, out = self._bytes(None, -1, text)
        return out + self._close(live, pending)

    def _compile(self, q: int, c: str) -> tuple[int, int]:
        mode, live, pending = self.states[q]
        out = 0
        if mode[:1] == "'":  # an apostrophe that begins a word, perhaps with one letter after it
            if len(mode) == 1 and c in SHORT or len(mode) == 2 and LONG[mode[1]] == c:
                return self._arc(q, c, ("", None, -1), self._word(mode + c))
            if len(mode) == 1 and c in LONG:
                return self._arc(q, c, ("'" + c, None, -1), 0)
            if len(mode) == 2:
                out += self._word("'")
                live, pending, k = self._bytes(None, -1, mode[1])
                out, mode = out + k, "letters"
            else:
                live, pending, _ = self._bytes(None, -1, "'")
                mode = "others"
        kind = self.kinds.get(c)
        if kind is None:
            kind = self.kinds[c] = KINDS.get(int(character_classes()[ord(c)]), "others")
        if mode and mode != kind or kind == "digit":
            out += self._close(live, pending)
            mode, live, pending = "", None, -1
        if kind == "digit":
            return self._arc(q, c, ("", None, -1), out + self._word(c))
        if not mode and c == "'":
            return self._arc(q, c, ("'", None, -1), out)
        live, pending, k = self._bytes(live, pending, c)
        return self._arc(q, c, (kind, live, pending), out + k)

    def _arc(self, q: int, c: str, key: tuple, out: int) -> tuple[int, int]:
        arc = self.step[q][c] = (self._state(key), out)
        return arc

    def _finish(self, q: int) -> int:
        mode, live, pending = self.states[q]
        if mode[:1] == "'":
            k = self._word("'") + (self._word(mode[1]) if len(mode) == 2 else 0)
        else:
            k = self._close(live, pending)
        self.end[q] = k
        return k

    def advance(self, q: int, text: str) -> tuple[int, int]:
        """State and emitted tokens after ``text``, which has no white space. When there are too many states, compilation
        starts anew from the one that the scan is in."""
        step, out = self.step, 0
        for c in text:
            arc = step[q].get(c)
            if arc is None:
                if len(self.states) > STATES:
                    key = self.states[q]
                    self.reset()
                    step, q = self.step, self._state(key)
                arc = self._compile(q, c)
            q, k = arc
            out += k
        return q, out

    def close(self, q: int) -> int:
        """Tokens emitted by white space or the end of text in state ``q``."""
        k = self.end[q]
        return self._finish(q) if k is None else k

    def run(self, text: str) -> int:
        """Tokens of a run from white space to white space: the composed map of its characters, remembered."""
        k = self.runs.get(text)
        if k is None:
            k = self.old.get(text)
            if k is None:
                q, k = self.advance(0, text)
                k += self.close(q)
            if len(text) <= RUN_LENGTH:
                self.runs[text] = k
        return k

    def tidy(self) -> None:
        """Between texts: keep what is remembered within its bounds."""
        if len(self.states) > STATES:
            self.reset()
        if len(self.runs) > RUNS:
            self.old, self.runs = self.runs, {}

    # State maps of chunks name states by their keys, which outlive the numbers.

    def after(self, key: tuple, text: str) -> tuple[tuple, int]:
        q, k = self.advance(self._state(key), text)
        return self.states[q], k

    def closed(self, key: tuple) -> int:
        return self.close(self._state(key))


START = ("", None, -1)


class Stretch:
    """The state map of a text without white space: the scan from a word's start, and the states on its first characters.

    A scan from another state takes the same states after a few characters; from where the two meet on, the rest is known.
    """

    def __init__(self, machine: Transducer, text: str):
        self.text, self.met = text, []
        key, total = START, 0
        for c in text[:MEETING]:
            key, k = machine.after(key, c)
            total += k
            self.met.append((key, total))
        self.exit, k = machine.after(key, text[MEETING:])
        self.total = total + k

    def apply(self, machine: Transducer, key: tuple) -> tuple[tuple, int]:
        if key == START:
            return self.exit, self.total
        out = 0
        for c, (usual, before) in zip(self.text, self.met, strict=False):
            key, k = machine.after(key, c)
            out += k
            if key == usual:
                return self.exit, out + self.total - before
        key, k = machine.after(key, self.text[len(self.met) :])
        return key, out + k


def stretches(head: Stretch | tuple) -> Iterator[Stretch]:
    """The stretches of a head in order. Composing pairs two heads, which copies none of them."""
    stack = [head]
    while stack:
        top = stack.pop()
        if isinstance(top, Stretch):
            yield top
        else:
            stack.extend(reversed(top))


@dataclass(frozen=True)
class ChunkMap:
    """The state map of one or several chunks: ``head`` maps the text before the first white space. If there is any white
    space (``resets``), ``count`` tokens follow after the head's last word has been closed, and the state is ``exit``.
    ``start`` is the head's state and count from a word's start."""

    head: Stretch | tuple
    start: tuple[tuple, int]
    resets: bool
    count: int
    exit: tuple

    def _through_head(self, machine: Transducer, key: tuple) -> tuple[tuple, int]:
        if key == START:
            return self.start
        out = 0
        for stretch in stretches(self.head):
            key, k = stretch.apply(machine, key)
            out += k
        return key, out

    def apply(self, machine: Transducer, key: tuple) -> tuple[tuple, int]:
        key, out = self._through_head(machine, key)
        return (self.exit, out + machine.closed(key) + self.count) if self.resets else (key, out)


def chunk_map(machine: Transducer, text: str) -> ChunkMap:
    found = list(RUN.finditer(text))
    if len(found) == 1 and len(found[0][0]) == len(text):
        whole = Stretch(machine, text)
        return ChunkMap(whole, (whole.exit, whole.total), False, 0, START)
    if not text:
        return ChunkMap((), (START, 0), False, 0, START)
    head = Stretch(machine, found.pop(0)[0]) if found and found[0].start() == 0 else ()
    tail = found.pop()[0] if found and found[-1].end() == len(text) else ""
    state, k = machine.after(START, tail)
    return ChunkMap(head, (head.exit, head.total) if head else (START, 0), True, sum(machine.run(m[0]) for m in found) + k, state)


def compose(machine: Transducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of a's text followed by b's."""
    if a.resets:
        key, k = b.apply(machine, a.exit)
        return ChunkMap(a.head, a.start, True, a.count + k, key)
    key, k = b._through_head(machine, a.start[0])
    return ChunkMap((a.head, b.head), (key, a.start[1] + k), b.resets, b.count, b.exit)


def prefix_scan(machine: Transducer, maps: list[ChunkMap]) -> list[ChunkMap]:
    """Inclusive scan: pairs are composed, the half as many results scanned, and the odd places filled in."""
    if len(maps) < 2:
        return maps
    halves = prefix_scan(machine, [compose(machine, maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(halves[i // 2] if i % 2 else compose(machine, halves[i // 2 - 1], maps[i]))
    return out


class Counter:
    def __init__(self, path: str):
        words = vocabulary(path)
        self.machine = Transducer(words)
        self.special = sorted(words.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens emitted up to the end of each chunk of ``text``, of which the last word is not yet closed, and of the whole."""
        text = fold(text)
        machine = self.machine
        maps = prefix_scan(machine, [chunk_map(machine, text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])
        ends = [m.apply(machine, START) for m in maps]
        return [k for _, k in ends] + [ends[-1][1] + machine.closed(ends[-1][0])] if ends else [0]

    def _plain(self, text: str) -> int:
        machine = self.machine
        machine.tidy()
        if len(text) > CHUNK:
            return self.prefix_counts(text)[-1]
        # One chunk: the sum over its runs, each mapped from a word's start to the white space after it.
        text = fold(text)
        runs = text.split() if text.isascii() and CONTROL.search(text) is None else RUN.findall(text)
        known = list(map(machine.runs.get, runs))
        for k in [k for k, n in enumerate(known) if n is None]:
            known[k] = machine.run(runs[k])
        return sum(known)

    def count(self, text: str) -> int:
        """Tokens of ``text``; each special string in it is one token and separates the texts around it."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No shuffle. A null text counts as empty: 0 bytes, 0 tokens. Null or repeated ids keep their rows; an empty table
    gives an empty result; other columns are not read. Texts of any length take time in proportion to it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(vocabulary_path)
        for b in batches:
            n = [c.count(t) for t in b["text"]]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in b["text"]], "n_tokens": n, "over_limit": [k > limit for k in n]}
            )

    return map_texts(docs, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)
