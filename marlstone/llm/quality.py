"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.labelled import known_labels, labelled_sample
from marlstone.llm.session import giving_back, map_texts, scored, stored_where, storing

#: Labelled rows of each class that are used to fit, at most.
ROWS_PER_CLASS = 12_000
#: Shares of the pooled and of the spherical covariance in each class's covariance.
POOLED, SPHERICAL = 0.15, 0.02
#: Part of the log densities' difference that counts: the statistics have heavier tails than the densities, which makes the
#: whole difference too sure of itself.
TEMPER = 0.5
#: Characters of a text that are made words at once.
PIECE = 1 << 20
SPACE = re.compile(r"\s")
LETTER = re.compile(r"[^\W\d_]")
ODD = re.compile(r"[^\w\s.,;:'\"()?-]")
UPPER_WORD = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{2,}\b")


def logit(share: float, n: float) -> float:
    """Log odds of a share of ``n`` things, drawn to the middle where they are few."""
    k = share * n
    return math.log((k + 0.5) / (n - k + 0.5))


def _pieces(text: str) -> Iterator[str]:
    """``text`` cut at white space into pieces of PIECE characters and the rest of a word."""
    at = 0
    while at < len(text):
        end = at + PIECE
        space = SPACE.search(text, end) if end < len(text) else None
        to = space.end() if space else len(text)
        yield text[at:to]
        at = to


def _matches(pattern: re.Pattern, text: str) -> int:
    """How many characters of ``text`` match a pattern of one character."""
    return sum(len(pattern.findall(text[at : at + PIECE])) for at in range(0, len(text), PIECE))


def _lines(text: str) -> tuple[int, int]:
    """Lines that aren't blank, and how many of them differ."""
    n, seen, at = 0, set(), 0
    while at <= len(text):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        if line.strip():
            n += 1
            seen.add(line)
        at = end + 1 if end >= 0 else len(text) + 1
    return n, len(seen)


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; the empty text has finite ones too. Words are taken a piece of the text at a time
    and kept by number, eight bytes each."""
    n = len(text)
    number: defaultdict[str, int] = defaultdict(count().__next__)
    runs, shouted, ends, length = [], 0, 0, 0
    for piece in _pieces(text):
        words = piece.split()
        runs.append(np.array([number[w] for w in words], dtype=np.int64))
        shouted += sum(1 for _ in UPPER_WORD.finditer(piece))
        ends += sum(1 for w in words if w[-1] in "!#$%&*|@~^+=<>/\\")
        length += sum(map(len, words))
    own = np.concatenate([np.empty(0, dtype=np.int64), *runs])
    del runs
    m, distinct = own.size, len(number)
    counts = np.bincount(own).tolist()
    pair = own[:-1] * distinct
    pair += own[1:]
    pair.sort()
    pairs = np.count_nonzero(pair[1:] != pair[:-1]) + 1
    lines, own_lines = _lines(text)
    letters, odd = _matches(LETTER, text), _matches(ODD, text)
    bare = sum(c for w, c in zip(number, counts, strict=True) if not LETTER.search(w))
    digits = sum(map(text.count, "0123456789"))
    top = max(counts, default=0)
    return [
        math.log1p(n),
        math.log1p(m) - math.log1p(lines),
        logit(letters / n if n else 0, n),
        logit(odd / n if n else 0, n),
        logit(shouted / m if m else 0, m) if shouted <= m else logit(1, m),
        logit(ends / m if m else 0, m),
        logit(bare / m if m else 0, m),
        logit(digits / n if n else 0, n),
        logit(1 - distinct / m if m else 0, m),
        logit(1 - pairs / (m - 1) if m > 1 else 0, max(m - 1, 0)),
        logit(1 - own_lines / lines if lines else 0, lines),
        logit(top / m if m else 0, m),
        math.log1p(length / m if m else 0),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, cached inverse Cholesky factors and log determinants of both classes, and the log prior odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    prior: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of log densities, half the Mahalanobis distances' difference."""
        z = (x - self.centre) / self.scale
        densities = []
        for k in (0, 1):
            d = (z - self.means[k]) @ self.factors[k].T
            densities.append(-0.5 * (d * d).sum(axis=1) - 0.5 * self.log_dets[k])
        odds = self.prior + self.temper * (densities[1] - densities[0])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, spherical: float = SPHERICAL) -> Discriminant:
    """Each class's covariance is shrunk to the pooled one and to a multiple of the unit matrix. A class without rows gets
    the other's mean and covariance, so scores then tell nothing."""
    x = x.astype(float)
    if not len(x):
        x, y = np.zeros((1, x.shape[1] if x.ndim == 2 else len(statistics("")))), np.array([1])
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - centre) / scale
    d = z.shape[1]
    groups = [z[y == k] if (y == k).any() else z for k in (0, 1)]
    means = [g.mean(axis=0) for g in groups]
    covs = [(g - m).T @ (g - m) / max(1, len(g)) for g, m in zip(groups, means, strict=True)]
    both = sum(len(g) * c for g, c in zip(groups, covs, strict=True)) / sum(map(len, groups))
    factors, log_dets = [], []
    for g, c in zip(groups, covs, strict=True):
        own = pooled + (1 - pooled - spherical) * d / (d + len(g))  # fewer rows, more pooling
        c = (1 - own - spherical) * c + own * both + spherical * max(np.trace(both) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * float(np.log(np.diag(low)).sum()))
    prior = math.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1))
    return Discriminant(centre, scale, tuple(means), tuple(factors), tuple(log_dets), prior, TEMPER)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, fold_of: int | None = None) -> Discriminant:
    """Fit on at most ``rows_per_class`` labelled documents of each class; their statistics are computed in Spark.

    Without labels every text scores 0.5; with labels of one class alone all score as the labels' prior has it."""
    n = len(statistics(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [statistics(t) for t in b["text"]], "y": b["y"]})

    sample = labelled_sample(docs, labels, "quality", rows_per_class, fold_of)
    with storing(docs.sparkSession):
        got = sample.mapInPandas(giving_back(run), "doc_id long, x array<double>, y int").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, n)
    model = fit(x, got["y"].to_numpy())
    # The prior of all labels that may be used, not of the balanced sample; each document counts once.
    count = known_labels(labels, "quality", fold_of).agg(F.sum(F.col("y").cast("double")), F.count("y")).first()
    good, total = count[0] or 0.0, count[1]
    return Discriminant(**{**model.__dict__, "prior": math.log((good + 1) / (total - good + 1))})


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``: probability of good quality from the whole text.

    A null text counts as empty and gets the empty text's score. Rows of null or equal ids keep their rows; an empty table
    gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]], dtype=float).reshape(len(b), -1)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(x) if len(b) else []})

    return map_texts(docs, run, "doc_id long, score double", id_col, text_col)


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with all their columns, whatever these are called.

    A null text counts as empty. Each row is judged by its text alone, so rows of null or equal ids and equal rows go or
    stay as their texts do; an empty table gives an empty result. The rows are stored.
    """

    def quality_scores(texts: list[str]) -> np.ndarray:
        return model.score(np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), -1))

    return stored_where(docs, scored(quality_scores, F.col(text_col)) >= threshold, "good")
