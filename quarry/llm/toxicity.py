"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the 4- and 5-grams of the lower-cased characters, hashed to 2**BITS buckets; a text has the value
log(1 + count) in each, so that a word counts that comes again and again, whatever its language, and yet no text by its
length alone. Each bucket is scaled by r, the log of the ratio of its smoothed shares of the two classes' values. A
logistic regression over the scaled features, with an L2 penalty, is fitted on the driver on a bounded sample of either
class; no feature is left out. Outcomes of short texts are drawn to the odds of the classes' true shares, so that a text
without evidence, an empty one above all, is taken for what most are. The cut between the classes is sought by
cross-validation within the sample: the lowest of about the highest F2 at the classes' true shares, over outcomes of
rows by regressions that haven't seen them; scores are moved so that it has the score ``threshold``. The folded weights
(one float a bucket, 4 MB) go to the executors and every whole text is scored in one pass without a shuffle.

Defined cases: a null text scores as the empty text, which is never predicted 1 but where all rows are; repeated rows repeat;
an empty table gives no rows; without labelled rows of both classes every score is the share of label 1; with
a single row of a class no cut is sought, and it is where both classes are as likely.
Columns other than id and text are ignored, so labels, lang and source can't be inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import named, numbered
from quarry.llm.labelled import fold, sample
from quarry.llm.text import char_grams

BITS, GRAMS = 20, range(4, 6)
SAMPLE_ROWS, SAMPLE_CHARS = 1_500, 20_000_000  #: training rows a class at most (no more than 4,096), and about how many characters of them together
SMOOTHING, PENALTY, STEPS, RATE = 1.0, 3e-4, 60, 0.3
FOLDS = 3  #: of the training rows; the cut is sought on outcomes of regressions that haven't seen the row
BLOCK = 1 << 20  #: values worked on at once in training
SHORT = 50  #: characters of a text whose outcome counts half, the classes' shares the other half
THRESHOLD, EVIDENCE = 0.7, 0.5  #: by how much, at least, the threshold is over what an empty text has


def values(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and log(1 + count) of each."""
    ids, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
    for x in char_grams((text or "").lower(), GRAMS, bits):
        new, n = np.unique(x, return_counts=True)
        if len(ids):
            new, at = np.unique(np.concatenate([ids, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
        ids, counts = new, n
    return ids, np.log1p(counts).astype(np.float32)


class Sample:
    """Values of the training texts by row, and the regression over them."""

    def __init__(self, texts: list[str], y: np.ndarray, bits: int):
        rows = [values(t, bits) for t in texts]
        sizes = np.array([len(x) for x, _ in rows])
        flat, value = (np.concatenate(x) for x in zip(*rows, strict=True))
        del rows
        self.y, self.buckets = y, np.flatnonzero(np.bincount(flat, minlength=1 << bits))
        place = np.zeros(1 << bits, np.int32)
        place[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        at = place[flat]
        del flat
        self.rows = (at, value, np.cumsum(sizes) - sizes, sizes > 0)
        # The same by bucket: one sort of bucket << 44 | row << 31 | the value's bits (it is positive), in place.
        key = (at.astype(np.uint64) << np.uint64(44)) | value.view(np.uint32)
        key |= np.repeat(np.arange(len(y), dtype=np.uint64) << np.uint64(31), sizes)
        key.sort()
        starts = np.searchsorted(key, np.arange(len(self.buckets), dtype=np.uint64) << np.uint64(44))
        row = ((key >> np.uint64(31)) & np.uint64(0x1FFF)).astype(np.int16)
        self.columns = (row, (key & np.uint64(0x7FFFFFFF)).astype(np.uint32).view(np.float32), starts)

    @staticmethod
    def _sum(weights: np.ndarray, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The sum of weight times value from each start to the next one, in blocks."""
        out, ends = np.empty(len(starts)), np.append(starts[1:], len(at))
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, side="right")))
            part = slice(starts[a], ends[b - 1])
            out[a:b] = np.add.reduceat(weights[at[part]] * value[part], starts[a:b] - starts[a])
            a = b
        return out

    def products(self, weights: np.ndarray, power: int = 1) -> np.ndarray:
        """The sum of weight times value (to a power) over each row."""
        at, value, starts, some = self.rows
        out = np.zeros(len(starts))
        out[some] = self._sum(weights.astype(np.float32), at, value**power if power > 1 else value, starts[some])
        return out

    def sums(self, by_row: np.ndarray) -> np.ndarray:
        """The sum of ``by_row`` times value over each bucket."""
        return self._sum(by_row.astype(np.float32), *self.columns)

    def fit(self, rows: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
        """Folded weights and intercept of a regression on these rows (a mask), both classes weighing alike."""
        shares = [self.sums((rows & (self.y == c)).astype(float)) + SMOOTHING for c in (0, 1)]
        ratio = np.log(shares[1] / shares[1].sum()) - np.log(shares[0] / shares[0].sum())
        of_row = rows / np.where(self.y == 1, (rows & (self.y == 1)).sum(), (rows & (self.y == 0)).sum()) / 2
        scale = np.sqrt(self.products(ratio**2, 2) @ of_row)  # rows of length 1 at the mean
        ratio /= scale if scale else 1.0
        w, b = np.zeros(len(ratio)), 0.0
        g2w, g2b = np.full(len(ratio), 1e-8), 1e-8
        for _ in range(STEPS):  # full gradients, each coordinate by its own rate
            z = self.products(w * ratio) + b
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y) * of_row
            gw, gb = self.sums(e) * ratio + penalty * w, e.sum()
            g2w += gw * gw
            g2b += gb * gb
            w -= RATE * gw / np.sqrt(g2w)
            b -= RATE * gb / np.sqrt(g2b)
        return w * ratio, float(b)


def best_cut(z: np.ndarray, y: np.ndarray, share: float) -> float:
    """The lowest cut whose F2 (a miss weighs four times a false alarm), where label 1 has this share, is within half a
    hundredth of the highest: half way between the outcomes beside it. Among few rows the highest alone is a matter of chance."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order]) / max(1, y.sum()) * share
    false = np.cumsum(1 - y[order]) / max(1, (1 - y).sum()) * (1 - share)
    f2 = hit / (4 * share + hit + false)
    n = int(np.flatnonzero(f2 >= 0.995 * f2.max())[-1])
    return float(z[order[n : n + 2]].mean())


class Model(NamedTuple):
    """Folded weights by bucket and the intercept; the odds of label 1, to which short texts are drawn; and what is added
    so that the cut has the threshold's score."""

    weights: np.ndarray
    intercept: float
    prior: float
    shift: float

    def logit(self, text: str | None) -> float:
        ids, value = values(text)
        return float(shrunk(float((self.weights[ids] * value).sum(dtype=np.float64)) + self.intercept, len(text or ""), self.prior) + self.shift)


def shrunk(z, chars, prior: float):
    """An outcome drawn to the prior, the more the shorter its text: an empty one has no evidence, and so the prior."""
    return prior + chars / (chars + SHORT) * (z - prior)


def train(texts: list[str], y: np.ndarray, share: float, bits: int = BITS, threshold: float = THRESHOLD) -> Model:
    odds = lambda p: float(np.log(p / (1 - p)))
    prior = odds(min(max(share, 1e-6), 1 - 1e-6))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << bits, np.float32), prior, prior, 0.0)
    given, chars = Sample(texts, y, bits), np.array([len(t) for t in texts])
    cut, fold, z = 0.0, np.zeros(len(y), np.int64), np.zeros(len(y))
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    if min((y == 0).sum(), (y == 1).sum()) > 1:
        for f in range(FOLDS):
            if (fold == f).any():
                w, b = given.fit(fold != f, PENALTY)
                z[fold == f] = (given.products(w) + b)[fold == f]
        cut = best_cut(shrunk(z, chars, prior), y, share)
    w, b = given.fit(np.ones(len(y), bool), PENALTY)
    out = np.zeros(1 << bits, np.float32)
    out[given.buckets] = w
    return Model(out, b, prior, odds(threshold) - max(cut, prior + EVIDENCE))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """id (or the columns ``keep``) and the score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2**BITS bytes
    cols = keep or [id_col]
    given = docs.select(*map(named, cols), *([] if text_col in cols else [named(text_col)]))
    at, given = given.columns.index(text_col), numbered(given)
    names = [*given.columns[: len(cols)], "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            z = np.array([own.logit(t.as_py()) for t in batch.column(at)], np.float64)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(s, pa.float64())], names=names)

    schema = given.select(*names[:-1]).schema.add("score", "double")
    return given.mapInArrow(work, schema).toDF(*cols, name)


def fit(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> Model:
    return train(*sample(docs, labels, label, held_out, SAMPLE_ROWS, SAMPLE_CHARS, id_col, text_col), threshold=threshold)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, out_fold: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: labels of the held-out fold are never seen."""
    held_out = fold("doc_id", folds) == out_fold
    scored = score(docs, fit(docs, labels, held_out, threshold=threshold))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept; learns from all labelled rows."""
    model = fit(docs, labels, F.lit(False), id_col=id_col, text_col=text_col, threshold=threshold)
    name = "__toxicity"
    return score(docs, model, id_col=id_col, text_col=text_col, keep=docs.columns, name=name).where(F.col(name) < threshold).drop(name)
