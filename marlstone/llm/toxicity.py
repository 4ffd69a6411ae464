"""Toxicity by a classifier chain.

The labels tell only whether a document is toxic. A lexicon of words and word beginnings that toxic documents use in many
different contexts is learned from a bounded sample and split into categories of terms that occur together. The chain
predicts the categories one after another and toxicity last; each link is a linear (logistic) model over the terms of the
document and the probabilities of the categories before it, which in training are out-of-fold predictions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.labelled import labelled_sample
from marlstone.llm.session import cut, giving_back, map_texts, scored, stored_where, storing

#: Labelled rows of each class that are used to fit, at most; terms in the lexicon; categories; folds.
ROWS_PER_CLASS, TERMS, CATEGORIES, FOLDS = 6_000, 400, 4, 5
#: A term needs this log-likelihood ratio (more when many terms compete: twice the log of their number), this ratio of
#: rates, and as many different contexts in toxic documents.
LEAST_RATIO, LEAST_RATE, LEAST_CONTEXTS = 10.0, 8.0, 4
PREFIXES = (4, 5, 6)
#: Rows that a fit makes doubles of at once.
ROWS_AT_ONCE = 1_000
#: Terms that a task counts before it hands their counts on.
COUNTED_AT_ONCE = 50_000
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def terms(text: str) -> set[str]:
    """The words of a text, each with a $ at its end, and their beginnings."""
    words = set(WORD.findall(text.lower()))
    out = {w + "$" for w in words}
    for n in PREFIXES:
        out.update([w[:n] for w in words if len(w) > n])
    return out


def contexts(text: str) -> dict[str, int]:
    """Of each term, a 64-bit mask of hashes of the words around its occurrences."""
    words = WORD.findall(text.lower())
    out: dict[str, int] = {}
    for k, w in enumerate(words):
        around = f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}"
        bit = 1 << (zlib.crc32(around.encode()) & 63)
        for t in (w + "$", *(w[:n] for n in PREFIXES if len(w) > n)):
            out[t] = out.get(t, 0) | bit
    return out


def logistic(x: np.ndarray, held: np.ndarray, y: np.ndarray, rows: np.ndarray, penalty: float = 0.05, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the intercept) of penalised logistic regression on the columns of ``x`` and ``held``, by Newton's
    method. ``rows``: the numbers of the rows that count; ROWS_AT_ONCE of them are made doubles together."""
    n = x.shape[1] + held.shape[1] + 1
    ridge = np.full(n, penalty)
    ridge[-1] = 1e-3
    w = np.zeros(n)
    good = y[rows].sum()
    w[-1] = math.log((good + 0.5) / (len(rows) - good + 0.5)) if len(rows) else 0.0
    for _ in range(rounds):
        h, slope = np.diag(ridge), ridge * w
        for at in range(0, len(rows), ROWS_AT_ONCE):
            own = rows[at : at + ROWS_AT_ONCE]
            x1 = np.c_[x[own], held[own], np.ones(len(own))]
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            h += (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1
            slope += x1.T @ (p - y[own])
        step = np.linalg.solve(h, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass(frozen=True)
class Chain:
    """``lexicon``: the terms, by column. ``links``: weights of each category's model in order, and of toxicity's."""

    lexicon: dict[str, int]
    links: tuple[np.ndarray, ...]

    def matrix(self, found: list[list[int]], kind: type = float) -> np.ndarray:
        x = np.zeros((len(found), len(self.lexicon)), dtype=kind)
        for row, own in enumerate(found):
            x[row, own] = 1
        return x

    def present(self, text: str) -> list[int]:
        lexicon, out = self.lexicon, []
        for w in set(WORD.findall(text.lower())):
            for t in (w + "$", *(w[:n] for n in PREFIXES if len(w) > n)):
                k = lexicon.get(t)
                if k is not None:
                    out.append(k)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each link; the last is toxicity."""
        done = np.zeros((len(x), 0))
        for w in self.links:
            done = np.c_[done, probability(np.c_[x, done], w)]
        return done


def categories_of(x: np.ndarray, toxic: np.ndarray, most: int = CATEGORIES) -> list[np.ndarray]:
    """Columns of each category: a seed that most toxic documents not yet covered have, and terms often seen with it."""
    bad = x[toxic == 1] > 0
    left, covered, out = np.ones(x.shape[1], dtype=bool), np.zeros(len(bad), dtype=bool), []
    while left.any() and len(out) < most:
        gain = (bad & ~covered[:, None]).sum(axis=0) * left
        seed = int(gain.argmax())
        if not gain[seed]:
            break
        together = (bad & bad[:, [seed]]).sum(axis=0) / np.maximum(bad.sum(axis=0), 1)
        own = left & ((together >= 0.25) | (np.arange(x.shape[1]) == seed))
        if len(out) == most - 1:
            own = left.copy()
        out.append(np.flatnonzero(own))
        covered |= bad[:, own].any(axis=1)
        left &= ~own
    return out


def fit_chain(lexicon: dict[str, int], x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """Links over categories and then toxicity; each sees the earlier ones' out-of-fold probabilities. ``x`` may be of bytes: no
    copy of it is made."""
    targets = [(y == 1) & (x[:, own] > 0).any(axis=1) for own in categories_of(x, y)] + [y == 1]
    held, links = np.zeros((len(x), 0)), []
    for target in targets:
        target = target.astype(float)
        links.append(logistic(x, held, target, np.arange(len(x))))
        out = np.zeros(len(x))
        for f in range(FOLDS):
            own = np.flatnonzero(fold == f)
            if own.size:
                w = logistic(x, held, target, np.flatnonzero(fold != f))
                for at in range(0, own.size, ROWS_AT_ONCE):
                    some = own[at : at + ROWS_AT_ONCE]
                    out[some] = probability(np.c_[x[some], held[some]], w)
        held = np.c_[held, out]
    return Chain(lexicon, tuple(links))


def _ratio(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio of a of n against b of m."""
    def part(k: float, total: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((total - k) * math.log(1 - p) if total > k else 0.0)

    if not n or not m:
        return 0.0
    p = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Chain:
    """Fit on at most ``rows_per_class`` labelled documents of each class. Texts stay on the executors: what comes to the
    driver are term counts and, of each sampled document, which terms of the lexicon it has. Labels of one class alone, or
    none, tell nothing apart: their chain has no terms and holds every document clean."""
    with storing(docs.sparkSession):
        return _train(cut(labelled_sample(docs, labels, "toxic", rows_per_class)))


def _train(sample: DataFrame) -> Chain:
    """The chain of a sample (doc_id, text, y)."""
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Chain({}, (np.array([-30.0]),))

    def count_toxic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, int] = {}
        mask: dict[str, int] = {}

        def counts() -> pd.DataFrame:
            return pd.DataFrame({"term": list(n), "n": list(n.values()), "mask": np.array([mask[t] for t in n], dtype=np.uint64).view(np.int64)})

        for b in batches:
            for text in b["text"]:
                for t, bits in contexts(text).items():
                    n[t] = n.get(t, 0) + 1
                    mask[t] = mask.get(t, 0) | bits
                if len(n) > COUNTED_AT_ONCE:
                    yield counts()
                    n, mask = {}, {}
        if n:  # a frame without rows has no column types
            yield counts()

    counted = sample.where("y = 1").select("text").mapInPandas(giving_back(count_toxic), "term string, n long, mask long")
    seen = (
        counted.groupBy("term").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("mask")).alias("contexts"))
        .where((F.col("contexts") >= LEAST_CONTEXTS) & (F.col("n") >= 3))
        .select("term", "n").collect()
    )
    candidates = {r["term"]: r["n"] for r in seen}

    def count_clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, int] = {}
        for b in batches:
            for text in b["text"]:
                for t in terms(text):
                    if t in candidates:
                        n[t] = n.get(t, 0) + 1
        if n:
            yield pd.DataFrame({"term": list(n), "n": list(n.values())})

    clean = {
        r["term"]: r["n"]
        for r in sample.where("y = 0").select("text").mapInPandas(giving_back(count_clean), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    }
    scored, least = [], max(LEAST_RATIO, 2 * math.log(max(1, len(candidates))))
    for t, n in candidates.items():
        other = clean.get(t, 0)
        if (n + 0.5) / (bad + 1) >= LEAST_RATE * (other + 0.5) / (good + 1) and (r := _ratio(n, bad, other, good)) >= least:
            scored.append((-r, t))
    lexicon = {t: k for k, (_, t) in enumerate(sorted(scored)[:TERMS])}
    empty = Chain(lexicon, ())

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "found": [empty.present(t) for t in b["text"]]})

    rows = sample.select("doc_id", "y", "text").mapInPandas(giving_back(look_up), "doc_id long, y int, found array<int>").toPandas().sort_values("doc_id")
    x = empty.matrix([list(f) for f in rows["found"]], np.int8)
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in rows["doc_id"]], dtype=int)
    return fit_chain(lexicon, x, rows["y"].to_numpy(dtype=float), fold)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxic_score, toxic, category_scores) per row of ``docs``, from the whole text.

    A null text counts as empty; it has no term and gets the intercepts' score. Rows of null or equal ids keep their
    rows; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = chain.predict(chain.matrix([chain.present(t) for t in b["text"]]))
            out = pd.DataFrame({"doc_id": b["doc_id"], "toxic_score": p[:, -1], "toxic": p[:, -1] >= threshold})
            out["category_scores"] = list(p[:, :-1])
            yield out

    return map_texts(docs, run, "doc_id long, toxic_score double, toxic boolean, category_scores array<double>", id_col, text_col)


def keep_clean(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns, whatever these are called.

    A null text counts as empty. Each row is judged by its text alone, so rows of null or equal ids and equal rows go or
    stay as their texts do; an empty table gives an empty result. The rows are stored.
    """

    def toxic_scores(texts: list[str]) -> np.ndarray:
        return chain.predict(chain.matrix([chain.present(t) for t in texts]))[:, -1]

    return stored_where(docs, scored(toxic_scores, F.col(text_col)) < threshold, "clean")
