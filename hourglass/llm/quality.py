"""Quality classifier: weak labels by expectation-maximisation train a hashed linear scorer.

1. Heuristic labellers vote good (1), bad (0) or abstain on every document,
   from counts over its whole text. They overlap and err.
2. The vote patterns of the whole corpus are counted (at most 3^labellers
   rows). Expectation-maximisation over the pattern counts estimates each
   labeller's accuracy on either class and the share of good documents; no
   true label is used. Every pattern gets a posterior.
3. A logistic scorer over hashed features (word shapes, pairs of shapes,
   repeats) is fitted to the posteriors of a bounded sample, the
   ``train_rows`` documents with the smallest hash of their id and text, and
   scores every document by its features alone.

Defined cases: null, empty and white-space texts have no features and no
votes, score ``EMPTY_SCORE`` and are rejected; short texts lean to being kept
by a fixed share; very long texts count whole; repeated rows score alike; a
score equal to the threshold keeps; ties of the sample's hash go by id; a
null id stays null; an empty table gives no rows; other columns are ignored
by ``score_quality`` and kept by ``keep_good``. Where no labeller votes both
ways there is nothing to fit and every document with words is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import map_batches, release_memory, slices_of, texts_of
from hourglass.llm.kernels import _hash_runs, byte_words, mix, slices

TRAIN_ROWS = 6000
DIMENSIONS = 1024
THRESHOLD = 0.5
# A short text says little: its score is drawn towards keeping, as if so many
# more words had been read of which this share speaks for it. Both are fixed,
# so that a document's fate does not turn with the corpus share of good ones.
PRIOR_WORDS = 8
PRIOR_GOOD = 0.85
EMPTY_SCORE = 0.0
ABSTAIN = 2
LABELLERS = ("shouting", "symbols", "repeats", "variety", "cells", "function_words", "sentences")
# Frequent function words of the four languages.
FUNCTION_WORDS = ("the of and to in is that it on for de la le et les des en un une que el los y der die und das "
                  "ist von zu mit den ein eine por para con pas est").split()

# Classes of bytes. Letters beyond ASCII count as lower case.
_CLASS = np.full(256, 1, np.uint8)
_CLASS[65:91] = 2                        # upper case
_CLASS[48:58] = 3                        # digits
for _b in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_b] = _b                      # each mark is a class of its own
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;?")] = True


def _function_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(FUNCTION_WORDS).encode(), np.uint8)
    return np.unique(_hash_runs(data, *byte_words(data)))


class Measures:
    """Counts and word shapes of a slice of texts."""

    def __init__(self, texts: list[bytes], functions: np.ndarray):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.starts, self.ends = byte_words(data)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first)
        lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.words = _hash_runs(lower, self.starts, self.ends)
        self.text_of = np.repeat(np.arange(len(texts)), self.n_words)
        count = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offsets])
        kind = _CLASS[data]
        self.upper, self.lower = count(kind == 2), count(kind == 1)
        self.marks, self.cells = count(_PUNCT[data]), count(data == 124)
        self.solid = count(~np.isin(data, (9, 10, 11, 12, 13, 32)))
        self.same = np.r_[False, (self.words[1:] == self.words[:-1]) & (self.text_of[1:] == self.text_of[:-1])] \
            if len(self.words) else np.zeros(0, bool)
        per = lambda flags: np.bincount(self.text_of, flags, len(texts))
        self.repeats = per(self.same)
        self.functions = per(np.isin(self.words, functions))
        self.stops = per(_STOP[data[self.ends - 1]]) if len(self.words) else np.zeros(len(texts))
        order = np.lexsort((self.words, self.text_of))
        w, t = self.words[order], self.text_of[order]
        fresh = np.r_[True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])] if len(w) else np.zeros(0, bool)
        self.distinct = np.bincount(t, fresh, len(texts))
        # Shapes: the classes of a word's bytes, runs of one class counted once.
        change = np.r_[True, kind[1:] != kind[:-1]]
        change[self.starts] = True
        at = np.cumsum(change) - 1
        self.shapes = _hash_runs(kind[change], at[self.starts], at[self.ends - 1] + 1) if len(self.words) else self.words

    def votes(self) -> np.ndarray:
        """Texts x labellers; texts without words abstain throughout."""
        n = np.maximum(self.n_words, 1)
        letters = np.maximum(self.upper + self.lower, 1)
        long = self.n_words >= 12
        share = lambda part, whole: part / np.maximum(whole, 1)
        vote = lambda bad, good: np.where(bad, 0, np.where(good, 1, ABSTAIN))
        caps, marks = share(self.upper, letters), share(self.marks, self.solid)
        rep, var = self.repeats / n, self.distinct / n
        func, stop = self.functions / n, self.stops / n
        v = np.stack([
            vote(caps > 0.5, caps < 0.25),
            vote(marks > 0.06, marks < 0.03),
            vote(long & (rep > 0.15), long & (rep < 0.05)),
            vote(long & (var < np.minimum(0.35, 6 / np.sqrt(n))), long & (var > 0.4)),
            vote(share(self.cells, n) > 0.1, long & (self.cells == 0)),
            vote(long & (func < 0.02), func > 0.08),
            vote(long & ((stop > 0.6) | (stop < 0.01)), (stop > 0.03) & (stop < 0.4)),
        ], axis=1).astype(np.int8)
        v[self.n_words == 0] = ABSTAIN
        return v

    def features(self, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed features as (text, feature, value); a text's values have length 1."""
        n = len(self.n_words)
        prev = np.r_[np.uint64(0), self.shapes[:-1]] if len(self.shapes) else self.shapes
        inside = np.r_[False, self.text_of[1:] == self.text_of[:-1]] if len(self.shapes) else np.zeros(0, bool)
        pairs = mix(prev * np.uint64(3) + self.shapes)
        keys = np.concatenate([self.shapes, pairs[inside], mix(np.full(int(self.same.sum()), 77, np.uint64))])
        owner = np.concatenate([self.text_of, self.text_of[inside], self.text_of[self.same]])
        cell = owner * dimensions + (keys % np.uint64(dimensions)).astype(np.int64)
        cell, count = np.unique(cell, return_counts=True)
        text, feature = cell // dimensions, cell % dimensions
        value = count / np.maximum(self.n_words, 1)[text]
        norm = np.sqrt(np.bincount(text, value ** 2, n))
        return text, feature, value / norm[text]


def _slices(texts: list[str]):
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    functions = _function_hashes()
    for a, b in slices([len(t) for t in data]):
        yield a, b, Measures(data[a:b], functions)


def vote_patterns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pattern) with one digit per labeller."""
    def run(batch):
        out = []
        for _, _, m in _slices(texts_of(batch, text_col)):
            out += ["".join(map(str, v)) for v in m.votes().tolist()]
        return {"id": batch.column(id_col), "pattern": out}

    return map_batches(docs.select(id_col, text_col), run, f"id {dict(docs.dtypes)[id_col]}, pattern string")


def fit_labellers(counts: dict[str, int], rounds: int = 100) -> dict:
    """Expectation-maximisation over pattern counts.

    Returns ``prior`` (share of good), ``accuracy`` (labellers x classes: the
    chance of a right vote, given a vote) and ``posterior`` by pattern.
    """
    patterns = sorted(counts)
    votes = np.array([[int(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
    weight = np.array([counts[p] for p in patterns], float)
    cast = votes != ABSTAIN
    # Start: a labeller is an expert on one kind of fault, so two bad votes
    # speak against a document whatever the others say.
    faults = (votes == 0).sum(axis=1)
    good = np.select([~cast.any(axis=1), faults == 0, faults == 1], [0.5, 0.95, 0.6], 0.1)
    accuracy, prior = None, 0.5
    for _ in range(rounds):
        mass = np.stack([1 - good, good]) * weight                                   # classes x patterns
        prior = float((mass[1].sum() + 1) / (weight.sum() + 2))
        right = np.stack([[(mass[k] * (votes[:, j] == k)).sum() for k in (0, 1)] for j in range(votes.shape[1])])
        said = np.stack([[(mass[k] * cast[:, j]).sum() for k in (0, 1)] for j in range(votes.shape[1])])
        accuracy = np.clip((right + 2) / (said + 3), 0.005, 0.995)
        log = np.stack([np.log([1 - prior, prior])] * len(patterns))
        for j in range(votes.shape[1]):
            for k in (0, 1):
                a = accuracy[j, k]
                log[:, k] += np.where(cast[:, j], np.log(np.where(votes[:, j] == k, a, 1 - a)), 0.0)
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - good).max() < 1e-6:
            good = new
            break
        good = new
    return {"prior": prior, "accuracy": accuracy, "posterior": dict(zip(patterns, good.tolist()))}


def fit_linear(x: np.ndarray, target: np.ndarray, rounds: int = 400, rate: float = 4.0, ridge: float = 1e-4
               ) -> np.ndarray:
    """Weights and, last, the intercept of a logistic model of soft targets; both classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = min(max(float(target.mean()), 1e-3), 1 - 1e-3)
    weight = (target * 0.5 / share + (1 - target) * 0.5 / (1 - share)).astype(x.dtype)
    w, momentum = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        momentum = 0.9 * momentum - rate * 0.1 * (x.T @ (weight * (p - target)) / len(x) + ridge * w)
        w += momentum
    return w


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS,
          dimensions: int = DIMENSIONS) -> dict:
    """The labellers' accuracies and the scorer's weights."""
    patterns = vote_patterns(docs, id_col, text_col).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["pattern"]: r["n"] for r in patterns if set(r["pattern"]) != {str(ABSTAIN)}}
    if not counts:
        return {"labellers": None, "weights": None, "dimensions": dimensions}
    fitted = fit_labellers(counts)
    # The smallest hashes: first by a cut that leaves about twice the rows
    # wanted, so that only those are sorted.
    rank = F.xxhash64(id_col, text_col).bitwiseAND(F.lit((1 << 40) - 1))
    share = min(1.0, 2 * train_rows / sum(counts.values()))
    sample = (docs.select(id_col, text_col).filter((F.length(text_col) > 0) & (rank < int(share * (1 << 40))))
              .orderBy(rank, id_col).limit(train_rows))
    posterior = fitted["posterior"]

    def run(batch):
        out = {"target": [], "feature": [], "value": []}
        for a, b, m in _slices(texts_of(batch, text_col)):
            text, feature, value = m.features(dimensions)
            cut = np.searchsorted(text, np.arange(1, b - a))
            out["feature"] += [f.astype("i4") for f in np.split(feature, cut)]
            out["value"] += [v.astype("f4") for v in np.split(value, cut)]
            out["target"] += [posterior.get("".join(map(str, v))) for v in m.votes().tolist()]
        return out

    rows = map_batches(sample, run, "target double, feature array<int>, value array<float>").collect()
    rows = [r for r in rows if r["target"] is not None]
    x, target = np.zeros((len(rows), dimensions), np.float32), np.array([r["target"] for r in rows], np.float32)
    for i, r in enumerate(rows):
        x[i, r["feature"]] = r["value"]
    varied = len(rows) > 0 and target.max() >= 0.5 > target.min()
    return {"labellers": fitted, "weights": fit_linear(x, target) if varied else None, "dimensions": dimensions}


def _score_column(model: dict, text_col: str):
    weights, dimensions = model["weights"], model["dimensions"]
    prior = float(np.log(PRIOR_GOOD / (1 - PRIOR_GOOD)))

    def scores(batch) -> np.ndarray:
        texts = texts_of(batch, text_col)
        out = np.empty(len(texts))
        for a, b, m in _slices(texts):
            text, feature, value = m.features(dimensions)
            if weights is None:
                s = np.ones(b - a)
            else:
                z = np.bincount(text, value * weights[feature], b - a) + weights[-1]
                z = (z * m.n_words + prior * PRIOR_WORDS) / (m.n_words + PRIOR_WORDS)
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            out[a:b] = np.where(m.n_words > 0, s, EMPTY_SCORE)
        return out

    return scores


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, keep) of every document."""
    scores = _score_column(model, text_col)

    def run(batch):
        s = scores(batch)
        return {id_col: batch.column(id_col), "score": s, "keep": s >= threshold}

    return map_batches(docs.select(id_col, text_col), run,
                       f"{id_col} {dict(docs.dtypes)[id_col]}, score double, keep boolean")


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that the classifier does not reject."""
    scores = _score_column(model, text_col)

    def run(batches):
        for batch in batches:
            for part in slices_of(batch):
                yield part.filter(_mask(scores(part) >= threshold))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def _mask(flags: np.ndarray):
    import pyarrow as pa

    return pa.array(flags)
