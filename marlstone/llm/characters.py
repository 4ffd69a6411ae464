"""Character classes and case folding as the tokenizers library has them.

The library's tables of characters are of another Unicode version than Python's and the regex module's. The classes are
therefore asked of the library's own split, once in each worker, and characters that Python folds otherwise are found by
comparing both; runs of text with such a character are folded by the library. This holds for any version of the library.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Regex, normalizers, pre_tokenizers

from marlstone.llm.bpe import SPACE

LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 4
#: Code points asked: planes 0 to 3 and the special plane. Unicode has assigned no letter, number or mark elsewhere.
ASKED = (range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE1000))
#: Code points in one call.
STEP = 8192
#: Marks of the second highest and the lowest combining class: a combining character beside them moves or stays by its class.
HIGH, LOW = "ͅ", "̴"

RUN = regex.compile(f"[^{SPACE}]+")
FOLD = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def _steps() -> Iterator[range]:
    for points in ASKED:
        for at in range(points.start, points.stop, STEP):
            yield range(at, min(at + STEP, points.stop))


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for points in _steps():
            for _, (a, b) in split.pre_tokenize_str("".join(map(chr, points))):
                out[points.start + a : points.start + b] = kind
    return out


def _python_fold(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _lines(form: normalizers.Normalizer, texts: list[str]) -> list[str]:
    return form.normalize_str("\n".join(texts)).split("\n")


@lru_cache(maxsize=1)
def folded_otherwise() -> regex.Pattern | None:
    """Matches a character that the library composes, orders or lowers otherwise than Python; None if there is none."""
    found: set[str] = set()
    nfd = normalizers.NFD()
    for points in _steps():
        chars = [chr(c) for c in points if c >= 0x80]
        if not chars:
            continue
        for c, theirs in zip(chars, _lines(FOLD, chars), strict=True):
            if theirs != _python_fold(c):
                found.add(c)
        for c, theirs in zip(chars, _lines(nfd, chars), strict=True):
            ours = unicodedata.normalize("NFD", c)
            if theirs != ours:
                found.update(p for p in c + theirs + ours if p >= "\x80")
        marks = [c for c in chars if unicodedata.category(c) in ("Mn", "Mc", "Me", "Cn")]
        if marks:
            for c, theirs in zip(marks, _lines(nfd, [HIGH + c + LOW for c in marks]), strict=True):
                if theirs != unicodedata.normalize("NFD", HIGH + c + LOW):
                    found.add(c)
    return regex.compile("[" + "".join(map(regex.escape, sorted(found))) + "]") if found else None


def fold(text: str) -> str:
    """Normal form C in lower case, white space as it is (the library's split takes any of it alike)."""
    if text.isascii():
        return text.lower()
    odd = folded_otherwise()
    if odd is None or odd.search(text) is None:
        return _python_fold(text)
    return RUN.sub(lambda m: FOLD.normalize_str(m[0]) if odd.search(m[0]) else _python_fold(m[0]), text)
