"""Byte-pair vocabularies: merge ranks, the pair-compatibility test and per-prefix encoding.

A sequence of tokens is what byte-pair merging gives exactly when each two neighbours are: the merging of their joint
text never joins across their seam. Which tokens meet at a seam over time is known from the merges that made both
tokens, so the test needs a few look-ups. Every prefix of a word thus has a single possible last token.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick

NEVER = 1 << 60

#: White space by the Unicode property of that name, as the body of a character class (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and that byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merges of a vocabulary over integer ids: ``made[t]`` is (left, right) of a merged token."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(pairs)}
        self.made = {t: (a, b) for a, b, t in pairs}
        self.birth = {t: k for k, (_, _, t) in enumerate(pairs)}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._known: dict[int, bool] = {}

    def _spine(self, token: int, side: int, cache: dict) -> list[tuple[int, int]]:
        """Tokens at that edge of ``token`` over the merging, each with the rank of the merge that ends it."""
        got = cache.get(token)
        if got is None:
            got, ends, t = [(token, NEVER)], NEVER, token
            while t in self.made:
                ends, t = self.birth[t], self.made[t][side]
                got.append((t, ends))
            cache[token] = got
        return got

    def _seam_joins(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of rank below ``before`` joins across the seam of a and b; at equal rank the left one goes first."""
        rank = self.rank
        for x, x_ends in self._spine(a, 1, self._right):
            for y, y_ends in self._spine(b, 0, self._left):
                k = rank.get((x, y))
                if k is not None and k < before and k < x_ends and k <= y_ends:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self._known.get(key)
        if got is None:
            if len(self._known) > 2_000_000:
                self._known.clear()
            got = self._known[key] = not self._seam_joins(a, b, NEVER)
        return got

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own text gives that token."""
        todo = [token]
        while todo:
            t = todo.pop()
            if t in self.made:
                a, b = self.made[t]
                if self._seam_joins(a, b, self.birth[t]):
                    return False
                todo += [a, b]
        return True


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        ids = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        special_ids = set(self.special.values())
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        strip = len(self.suffix)
        # With a word-end suffix, the left side of a merge never carries it and the result keeps the right side's.
        self.merges = Merges([(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        #: Of each token: its bytes, and whether it ends a word.
        self.bytes: dict[int, bytes] = {}
        self.ends_word: dict[int, bool] = {}
        for text, i in ids.items():
            if i in special_ids:
                continue
            ends = bool(strip) and text.endswith(self.suffix) and len(text) > strip
            body = text[:-strip] if ends else text
            self.bytes[i] = bytes(alphabet[c] for c in body)
            self.ends_word[i] = ends
        self.tokens = [i for i in self.bytes if self.merges.reachable(i)]


class PrefixEncoder:
    """Encodes words: all vocabulary entries that end at each position come from a suffix automaton (Aho-Corasick); the
    one that is compatible with the last token before it is stored as the prefix's last token; following these back from
    the end gives the ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.compatible = vocabulary.merges.compatible
        self.automaton = ahocorasick.Automaton()
        self.length = {}
        for i in vocabulary.tokens:
            text = vocabulary.bytes[i].decode("latin-1")
            self.automaton.add_word(text, (i, len(text)))
            self.length[i] = len(text)
        self.automaton.make_automaton()

    def encode(self, word: bytes) -> list[int]:
        text, n = word.decode("latin-1"), len(word)
        last: list[int | None] = [None] * (n + 1)
        last[0] = -1
        compatible, done = self.compatible, -1
        for end, (token, length) in self.automaton.iter(text):
            if end > done:
                before = last[end + 1 - length]
                if before == -1 or before is not None and compatible(before, token):
                    last[end + 1] = token
                    done = end
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= self.length[last[at]]
        return ids[::-1]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(vocabulary(path))
