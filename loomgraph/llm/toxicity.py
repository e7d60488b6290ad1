"""Toxicity by maximum-scoring segment search.

Every word has a log-odds between toxic and clean texts.  Its prior is
Dirichlet, centred on the share that the words with its longest known prefix
have, and so on down to that of all words: rare and inflected words take after
their stem, unknown ones too.  Less a constant ``drift``, so that ordinary
words count against a passage, these are a text's scores.  One linear scan
finds all maximal scoring segments (Ruzzo and Tompa).  A segment of score s in
a text of n words has p-value 1 - exp(-K n exp(-lambda s)), the extreme-value
law, with lambda and K of greatest likelihood for the best segments of clean
texts.  The text's score joins its best p-value and its number of significant
segments in a logistic calibration.  Both are fitted on texts that the
log-odds used for them haven't seen: each half of the texts is scored by the
other's counts.

The model is fitted on a bounded number of labelled texts (``train_rows`` of
``labelled_texts``), chosen by a hash of their id, and holds their words and
shared prefixes, 12 bytes each; nothing of it is left out.

Defined results: null and empty texts have no segment and get the score of
such texts; rows whose label is null, or that ``teach`` excludes, teach
nothing; without any toxic or any clean label every score is the share of
toxic ones; repeated rows are scored alike; further columns aren't read.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import whole, written

_WORD = re.compile(r"\w+")


_MASK, _FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _prefix_keys(word: str, most: int | None = None) -> list[int]:
    """The number of each prefix of a word, the empty one first, up to a length."""
    out, h = [0], 0
    for c in word[:most]:
        h = ((h ^ (h >> 29)) * _FACTOR + ord(c) + 1) & _MASK
        out.append(h)
    return out


def _word_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


@dataclass
class Model:
    """Log-odds of words and prefixes, by ascending keys, and what makes scores of them."""

    keys: np.ndarray
    odds: np.ndarray
    depths: list[int] = field(default_factory=lambda: [0])  # lengths that known prefixes have, descending
    drift: float = 2.0
    scale: float = 1.0  # lambda
    k: float = 1.0
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])

    @staticmethod
    def of(words: dict[str, float], **more) -> Model:
        """A model of given words' log-odds, 0 for others."""
        found = sorted((_word_key(w), o) for w, o in words.items())
        return Model(np.array([k for k, _ in found], np.uint64), np.array([o for _, o in found], np.float32), **more)

    @functools.cached_property
    def scores(self) -> Scores:
        """Scores that the tasks of one Python worker share."""
        return Scores(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "scores"}


class Scores(dict):
    """The score of each word as it comes up, upper case as lower case."""

    #: So many words are kept, the first ones that come, as common words come early.
    MOST = 200_000

    def __init__(self, model: Model):
        self._keys, self._odds, self._drift = array("Q", model.keys.tobytes()), model.odds, model.drift
        self._depths, self._deepest = model.depths, max(model.depths)
        # Most keys that aren't there are turned down by some of their bits.
        bits = np.zeros(1 << 22, np.uint8)
        bits[(model.keys >> np.uint64(42)).astype(np.int64)] = 1
        self._bits = bits.tobytes()

    def _at(self, key: int) -> int:
        if not self._bits[key >> 42]:
            return -1
        i = bisect.bisect_left(self._keys, key)
        return i if i < len(self._keys) and self._keys[i] == key else -1

    def __missing__(self, word: str) -> float:
        low = word.lower()
        at = self._at(_word_key(low))
        if at >= 0:
            found = float(self._odds[at]) - self._drift
            if len(self) < self.MOST:
                self[word] = found
            return found
        # Words that no labelled text has are rarely met again, so they aren't kept.
        keys = _prefix_keys(low, self._deepest)
        at = next((i for d in self._depths if d < len(keys) and (i := self._at(keys[d])) >= 0), -1)
        return (float(self._odds[at]) if at >= 0 else 0.0) - self._drift


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first place, last place), in one pass over the positive scores.

    Each candidate keeps the sum before it and through it; a new one is joined
    with the nearest earlier one that starts lower and ends lower, until none does.
    """
    kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum through, first, last, nearest earlier one that starts lower
    total = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    for i, left, right in zip(at.tolist(), (total[at] - scores[at]).tolist(), total[at].tolist(), strict=True):
        first = i
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, first, i, j))
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(right - left, first, last) for left, right, first, last, _ in kept]


def log_p(score: float, words: int, model: Model) -> float:
    """The natural logarithm of the chance that a clean text of so many words has a segment of this score."""
    expected = math.log(model.k * max(words, 1)) - model.scale * score
    return expected if expected < -30 else math.log(-math.expm1(-math.exp(min(expected, 30.0))))


def _scored(words: list[str], scores: Scores) -> np.ndarray:
    return np.fromiter(map(scores.__getitem__, words), float, len(words))


def passages(text: str, model: Model, significant: float = 0.01) -> list[tuple[int, int, float, float]]:
    """(first character, end, score, p-value) of the significant toxic passages of a text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    found = segments(_scored([text[a:b] for a, b in spans], model.scores))
    with_p = [(spans[a][0], spans[b][1], s, math.exp(log_p(s, len(spans), model))) for s, a, b in found]
    return [x for x in with_p if x[3] <= significant]


def _features(text: str, scores: Scores, model: Model) -> tuple[float, float]:
    """How unlikely the best segment is, and how many are significant."""
    words = _WORD.findall(text)
    ps = [log_p(s, len(words), model) for s, _, _ in segments(_scored(words, scores))]
    return (min(-min(ps) / math.log(10), 20.0), math.log1p(sum(p <= math.log(0.01) for p in ps))) if ps else (0.0, 0.0)


def _score(x: tuple[float, ...], weights: list[float]) -> float:
    z = weights[0] + sum(w * v for w, v in zip(weights[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, teach: Column, train_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of at most ``train_rows`` labelled rows that ``teach`` admits, by the smallest hashes of their ids.

    The chosen ids are bounded in number, so they are broadcast and no text is shuffled.
    """
    chosen = labels.filter(teach & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    return docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "label")


_COUNTS = ("clean0", "toxic0", "clean1", "toxic1")  # by label and half


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = [Counter() for _ in _COUNTS]

    def flush() -> pa.RecordBatch:
        words = list(set().union(*counts))
        columns = [pa.array([c[w] for w in words], pa.int64()) for c in counts]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], ["word", *_COUNTS])

    for batch in batches:
        for text, label, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            counts[2 * half + (label == 1)].update({w.lower() for w in _WORD.findall(text.as_py())})
        if sum(map(len, counts)) > 300_000:
            yield flush()
    yield flush()


def _shared_prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes at which sorted ``words`` part: depth, first word, word behind the last, parent; and each word's own parent. The root is 0."""
    depth, first, end, parent, above = [0], [0], [len(words)], [0], []
    stack = [0]
    for i in range(1, len(words) + 1):
        shared = 0
        if i < len(words):
            a, b = words[i - 1], words[i]
            least = min(len(a), len(b))
            while shared < least and a[shared] == b[shared]:
                shared += 1
        top, left, child = stack[-1], i - 1, -1
        while depth[stack[-1]] > shared:
            x = stack.pop()
            end[x], left = i, first[x]
            if depth[stack[-1]] >= shared:
                parent[x] = stack[-1]
            else:
                child = x
        if depth[stack[-1]] < shared:
            depth.append(shared)
            first.append(left)
            end.append(i)
            parent.append(stack[-1])
            if child >= 0:
                parent[child] = len(depth) - 1
            stack.append(len(depth) - 1)
        above.append(top if depth[top] >= shared else stack[-1])
    return tuple(np.array(x, np.int64) for x in (depth, first, end, parent, above))


def log_odds(words: list[str], toxic: np.ndarray, clean: np.ndarray, prior: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The shared prefixes of sorted ``words``, their log-odds and those of the words, against the share of all.

    ``toxic`` and ``clean`` have a row for each set of counts, and so have the results.
    """
    depth, first, end, parent, above = _shared_prefixes(words)
    sums = [np.concatenate([np.zeros((len(c), 1)), np.cumsum(c, 1)], 1) for c in (toxic, clean)]
    t, c = ((s[:, end] - s[:, first]) for s in sums)
    share = np.zeros(t.shape)
    share[:, 0] = (t[:, 0] + 1) / (t[:, 0] + c[:, 0] + 2)
    for d in np.unique(depth[1:]):
        at = np.flatnonzero(depth == d)
        at = at[at > 0]
        share[:, at] = (t[:, at] + prior * share[:, parent[at]]) / (t[:, at] + c[:, at] + prior)
    own = (toxic + prior * share[:, above]) / (toxic + clean + prior)
    odds = lambda p: np.log(p) - np.log1p(-p)
    root = odds(share[:, :1])
    return [words[i][:d] for i, d in zip(first.tolist(), depth.tolist(), strict=True)], odds(share) - root, odds(own) - root


def extreme_value(best: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Lambda and K of greatest likelihood for best segments of texts of so many words."""

    def slope(scale: float) -> float:
        w = words * np.exp(-scale * (best - best.min()))
        return 1 / scale - best.mean() + (best * w).sum() / w.sum()

    low, high = 1e-2, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low, float(len(best) / (words * np.exp(-low * best)).sum())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> list[float]:
    """Weights of a logistic model, the constant first, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + w @ penalty @ w / 2)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step, size = np.linalg.solve(hess, x.T @ (y - p) - penalty @ w), 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w.tolist()


def fit(train: DataFrame, prior: float = 3.0, drift: float = 2.0) -> Model:
    """The model of labelled ``text, label`` rows; ``prior``: how many texts the prior of a word's share counts as."""
    spark = train.sparkSession
    train = written(train.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")).select("text", "label", "half"), "toxic-train")
    n = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n[0] or not n[1]:
        share = (n[0] + 1) / (n[0] + n[1] + 2)
        return Model.of({}, weights=[math.log(share / (1 - share)), 0.0, 0.0])
    counted = train.mapInArrow(_words, "word string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    table = counted.toArrow()  # the words of a bounded number of texts
    words = table.column("word").to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[i] for i in order]
    clean0, toxic0, clean1, toxic1 = (table.column(c).to_numpy()[order].astype(float) for c in _COUNTS)
    del table, order
    # All texts, and for each half the counts of the other one.
    prefixes, shared, own = log_odds(words, np.array([toxic0 + toxic1, toxic1, toxic0]), np.array([clean0 + clean1, clean1, clean0]), prior)
    keys = np.fromiter(itertools.chain(map(_word_key, words), (_prefix_keys(p)[-1] for p in prefixes)), np.uint64, len(words) + len(prefixes))
    by = np.argsort(keys)
    depths = sorted({len(p) for p in prefixes}, reverse=True)
    whole_model, *halves = (Model(keys[by], np.concatenate([o, s])[by].astype(np.float32), depths, drift) for o, s in zip(own, shared, strict=True))
    given = spark.sparkContext.broadcast(halves)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [m.scores for m in given.value]
        for batch in batches:
            out: list[list] = [[], []]
            for text, label, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = _WORD.findall(text.as_py())
                if label == 0 and found:
                    out[0].append(max((s for s, _, _ in segments(_scored(found, scores[half]))), default=0.0))
                    out[1].append(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in out], ["best", "words"])

    clean = train.mapInArrow(best, "best double, words double").toArrow()  # at most train_rows rows, here and below
    scale, k = extreme_value(clean.column(0).to_numpy(), clean.column(1).to_numpy()) if clean.num_rows else (1.0, 1.0)
    whole_model.scale, whole_model.k = scale, k

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [m.scores for m in given.value]
        law = Model.of({}, scale=scale, k=k)
        for batch in batches:
            x = [_features(t.as_py(), scores[half], law) for t, half in zip(batch.column(0), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array([v[i] for v in x], pa.float64()) for i in range(2)]], ["label", "a", "b"])

    got = train.mapInArrow(measured, "label int, a double, b double").toArrow()
    given.destroy()
    whole_model.weights = _logistic(np.column_stack([got.column(i).to_numpy() for i in (1, 2)]), got.column(0).to_numpy())
    return whole_model


SCORED = "doc_id long, score double, passages long"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, passages`` (the number of significant ones) of every whole text."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        scores = model.scores
        for batch in batches:
            x = [_features(t.as_py(), scores, model) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_score(v, model.weights) for v in x], pa.float64()), pa.array([round(math.expm1(v[1])) for v in x], pa.int64())], ["doc_id", "score", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(scored, SCORED)


def spans(docs: DataFrame, model: Model, significant: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each significant passage: ``doc_id, start, end, score, p_value`` in characters of the text."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for p in passages(t.as_py(), given.value, significant)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 3, *[pa.float64()] * 2], strict=True)], ["doc_id", "start", "end", "score", "p_value"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(found, "doc_id long, start long, end long, score double, p_value double")


def filter_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        scores = model.scores
        for batch in batches:
            fine = [_score(_features(t.as_py() or "", scores, model), model.weights) < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
