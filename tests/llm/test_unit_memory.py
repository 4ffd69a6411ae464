"""Ids of many texts are made with a bounded amount of memory beside the texts."""

import tracemalloc

import pytest

from marlstone.llm.characters import character_classes
from marlstone.llm.units import UnitCache


@pytest.mark.parametrize("text", ["the quick brown fox 42 ", "größe und maß 42 "])
def test_memory_of_a_batch(text):
    cache = UnitCache(lambda words: [b"\1\0\0\0" * len(w) for w in words], {})
    given = [text * 2000] * (8_000_000 // (2000 * len(text)))
    character_classes()
    tracemalloc.start()
    sizes = [len(x) // 4 for x in cache.ids_of(given)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [len(text) * 2000] * len(given)
    assert peak < 80e6, peak
