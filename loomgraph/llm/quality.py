"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few plain measures.  Every measure is cut into bins, and the
model adds one number for each measure's bin and, for a few pairs of measures,
one for the pair of bins.  The tables are learned by cyclic boosting: round
after round, each measure in turn gets a shallow tree on the current logistic
residuals, whose leaves are added to its table; then the pairs on which the
residuals depend most get theirs.  Rounds stop when a held-back eighth of the
labelled rows stops improving.  Scoring is a look-up and an addition for each
table.

The tables are fitted on at most ``train_rows`` labelled rows, chosen by a
hash of their id; measures and scores cover every whole text.

Defined results: null and empty texts have all measures at zero and get their
score from those bins; null labels teach nothing; with labels of one kind only
every score is their smoothed share; repeated rows are scored alike; further
columns aren't read.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole

MEASURES = ("log_chars", "log_words", "word_length", "symbols", "pipes", "punctuation", "capitals", "digits", "distinct_words", "repeated_next", "top_word", "top_three", "repeated_lines", "words_per_line", "words_per_stop", "short_words", "spaces", "braces")


def _classes() -> np.ndarray:
    """For each byte, which counts it adds to: symbols, pipes, punctuation, capitals, digits, spaces, braces, line ends, stops, first bytes of characters."""
    out = np.zeros((256, 10))
    for i, chars in enumerate(("#$%&*@^~=+\\_", "|", ".,;:!?'\"-()", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "{}[]<>", "\n", ".!?")):
        out[[ord(c) for c in chars], i] = 1
    out[[b for b in range(256) if b & 0xC0 != 0x80], 9] = 1
    return out


_CLASSES = _classes()


def measures(text: str) -> list[float]:
    """The measures of one text, in the order of ``MEASURES``."""
    words = text.split()
    if not words:
        return [0.0] * len(MEASURES)
    symbols, pipes, marks, capitals, digits, spaces, braces, ends, stops, chars = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256) @ _CLASSES
    n = len(words)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(chars), math.log1p(n), (chars - spaces - ends) / n, symbols / chars, pipes / n, marks / chars, capitals / n, digits / chars,
        len(counts) / n ** 0.8, sum(map(operator.eq, words, words[1:])) / n, top[0] / n, sum(top) / n, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        math.log1p(n / (1 + stops)), sum(counts[w] for w in counts if len(w) <= 3) / n, spaces / chars, braces / chars,
    ]


@dataclass
class Model:
    """Bin edges, tables and pairs; some tens of kilobytes."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of measures: vectorised additions of bins."""
        bins = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]
        z = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins, strict=True):
            z += table[b]
        for i, j, table in self.pairs:
            z += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _leaves(g: np.ndarray, h: np.ndarray, splits: int, least: float = 2.0, ridge: float = 1.0) -> np.ndarray:
    """Values of a shallow tree over ordered bins with gradient and curvature sums: the best split, again inside the parts."""
    cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    parts = [(0, len(g))]
    for _ in range(splits):
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            lg, lh = cg[at] - cg[a], ch[at] - ch[a]
            rg, rh = cg[b] - cg[at], ch[b] - ch[at]
            gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
            gain[(lh < least) | (rh < least)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), k, int(at[gain.argmax()]))
        if not best[2]:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """Values and gain of the best tree with one cut of each of two measures, over sums by pair of bins."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    rows, cols = g.shape
    best, value = 0.0, np.zeros_like(g)
    i, j = np.arange(1, rows)[:, None], np.arange(1, cols)[None, :]
    corner = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    gs, hs = corner(cg), corner(ch)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    if gain.size and gain.max() > best:
        a, b = np.unravel_index(gain.argmax(), gain.shape)
        best = float(gain.max())
        v = [x[a, b] / (y[a, b] + ridge) for x, y in zip(gs, hs, strict=True)]
        value[: a + 1, : b + 1], value[: a + 1, b + 1 :], value[a + 1 :, : b + 1], value[a + 1 :, b + 1 :] = v
    return value, best


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 12, pairs: int = 6, rounds: int = 300, rate: float = 0.15, patience: int = 30) -> Model:
    """The model of rows of measures and labels 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
    coarse = [np.minimum(np.arange(len(e) + 1) * pair_bins // max(1, len(e) + 1), pair_bins - 1) for e in edges]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], [], coarse)
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)]
    back = np.arange(len(y)) % 8 == 7
    learn = ~back if len(y) >= 80 else np.ones(len(y), bool)
    back = ~learn if len(y) >= 80 else learn
    z = np.full(len(y), base)

    def sums() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return np.where(learn, y - p, 0), np.where(learn, p * (1 - p), 0)

    def loss() -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(z[back], -35, 35))), 1e-9, 1 - 1e-9)
        return float(-(y[back] * np.log(p) + (1 - y[back]) * np.log1p(-p)).mean())

    best, best_state, since = loss(), [t.copy() for t in model.tables], 0
    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, h = sums()
            step = rate * _leaves(np.bincount(at[i], g, len(table)), np.bincount(at[i], h, len(table)), 3)
            table += step
            z += step[at[i]]
        now = loss()
        if now < best - 1e-6:
            best, best_state, since = now, [t.copy() for t in model.tables], 0
        elif (since := since + 1) >= patience:
            break
    model.tables = best_state
    z = np.full(len(y), base) + sum(t[a] for t, a in zip(model.tables, at, strict=True))

    wide = [c[a] for c, a in zip(coarse, at, strict=True)]

    def by_pair(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(wide[i] * pair_bins + wide[j], v, pair_bins**2).reshape(pair_bins, pair_bins)

    g, h = sums()
    strength = sorted(((_quarters(by_pair(i, j, g), by_pair(i, j, h))[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((pair_bins, pair_bins))) for _, i, j in strength]
    best, best_pairs, since = loss(), [t.copy() for _, _, t in model.pairs], 0
    for _ in range(rounds):
        for i, j, table in model.pairs:
            g, h = sums()
            step = rate * _quarters(by_pair(i, j, g), by_pair(i, j, h))[0]
            table += step
            z += step[wide[i], wide[j]]
        now = loss()
        if now < best - 1e-6:
            best, best_pairs, since = now, [t.copy() for _, _, t in model.pairs], 0
        elif (since := since + 1) >= patience // 3:
            break
    model.pairs = [(i, j, t) for (i, j, _), t in zip(model.pairs, best_pairs, strict=True)]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [measures(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])


def fit(train: DataFrame) -> Model:
    """The model of labelled ``text, label`` rows, whose number the caller bounds; only their measures reach the driver."""
    rows = train.mapInArrow(_measured, "label int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(MEASURES))
    y = np.array(rows.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # whatever order the tasks came in
    order = order[np.random.default_rng(7).permutation(len(order))]
    return fit_tables(x[order], y[order])


def _scores(model: Model, texts: list[str]) -> np.ndarray:
    return model.score(np.array([measures(t) for t in texts], float).reshape(-1, len(MEASURES)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(scored, "doc_id long, score double")


def filter_rows(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = _scores(model, [t or "" for t in batch.column(at).to_pylist()]) >= threshold
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
