"""Statistics of a very long text take little memory beside it, and don't depend on how it is cut into pieces."""

import random
import tracemalloc

import pytest

from marlstone.llm import quality


def test_peak_of_a_long_text():
    rng = random.Random(1)
    text = " ".join(f"w{rng.getrandbits(12):x}" for _ in range(600_000))
    quality.statistics(text[:1000])
    tracemalloc.start()
    quality.statistics(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_pieces(monkeypatch, piece):
    rng = random.Random(piece)
    texts = ["".join(rng.choices("aB.C1 \n\t\x1c\x85　éß中_-!̀\x00", k=rng.randint(0, 60))) for _ in range(500)]
    whole = [quality.statistics(t) for t in texts]
    monkeypatch.setattr(quality, "PIECE", piece)
    assert [quality.statistics(t) for t in texts] == whole


def test_counts():
    got = quality.statistics("AB cd AB cd! 12\n\n \nx\nx")
    n, m, lines = 22, 7, 3
    assert got == pytest.approx([
        quality.math.log1p(n), quality.math.log1p(m) - quality.math.log1p(lines), quality.logit(10 / n, n), quality.logit(1 / n, n), quality.logit(2 / m, m),
        quality.logit(1 / m, m), quality.logit(1 / m, m), quality.logit(2 / n, n), quality.logit(1 - 5 / m, m), quality.logit(1 - 6 / 6, 6),
        quality.logit(1 - 2 / 3, lines), quality.logit(2 / m, m), quality.math.log1p(13 / m),
    ])
