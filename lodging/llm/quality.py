"""Quality classifier: positive-unlabelled learning with non-negative risk.

Learns from trusted positives (rows marked 1) and unlabelled web text alone;
rows marked 0 are unlabelled text like any other.

* *Features* of a whole text.  Shape: shares of character classes and of each
  ASCII punctuation mark, of words that repeat the word before, of distinct
  words and of words without a letter, word length and text length.  Content:
  shares of hashed words and of hashed character trigrams (A-Z in lower case).
  Features are standardised over the unlabelled sample and clipped at
  ``CLIP`` deviations, so no feature decides alone far off the sample.
* *Sample.*  ``max_positive`` positives and ``max_unlabelled`` documents on
  average, taken by a hash of the id, are all that fitting looks at: the
  fit's size doesn't grow with the corpus.  Scores cover every row.  The driver
  holds the sample's features (about 2 kB a row) no more than twice at a time.
* *Class prior* pi: a positive-against-unlabelled model is fitted on one half
  of the sample (a row's own hash says which); on the other half the share of unlabelled rows above a
  threshold, divided by that of positives, is an upper bound of pi; the
  threshold whose bound (with its sampling error) is least gives the estimate.
* *Risk* (logistic loss): ``pi * R+(P) + max(0, R-(U) - pi * R-(P))`` plus a
  ridge that shrinks with the sample.  While the second part is below zero the
  model is fitting noise in the positives, and only the first part has a
  gradient.  Full batches from zero weights at a falling rate, the weights of
  the second half averaged: the same rows give the same model, and a few rows
  more or less hardly move it.

Defined cases: a text without a word (NULL, empty, white space) holds nothing
to learn from: it is never in the sample, and its score is 0 whatever the model,
so ``good_rows`` drops it; without positives or unlabelled rows nothing can be
learned and every other score is 0.5; a label row with a NULL id or mark counts for nothing
and a document with several label rows counts once, as positive if any row
says 1; a document with a NULL id is scored but never learned from; other
columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.llm.common import fold_of, named, per_text, spare, table

MAX_POSITIVE = 12_000
MAX_UNLABELLED = 24_000
CUT = 0.3

CLIP = 3.0
LEAST_SCALE = 0.05  # a feature that hardly varies is not blown up
WORD_BUCKETS = 256
GRAM_BUCKETS = 256
DECAY = 0.1  # over the square root of the number of unlabelled rows
FEW_WORDS, FEW_BYTES = 20, 100  # added to a text's length in shares: a short one says little

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASSES = np.zeros((256, 6 + len(_PUNCTUATION)))
_CLASSES[[*range(ord("a"), ord("z") + 1)], 0] = 1
_CLASSES[[*range(ord("A"), ord("Z") + 1)], 1] = 1
_CLASSES[[*range(ord("0"), ord("9") + 1)], 2] = 1
_CLASSES[[9, 11, 12, 13, 32], 3] = 1
_CLASSES[10, 4] = 1
_CLASSES[128:, 5] = 1
for _i, _b in enumerate(_PUNCTUATION):
    _CLASSES[_b, 6 + _i] = 1
N_SHAPE = _CLASSES.shape[1] + 6
N_FEATURES = N_SHAPE + WORD_BUCKETS + GRAM_BUCKETS
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def grams(text: bytes) -> np.ndarray:
    """How many character trigrams of a text fall in each bucket."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(GRAM_BUCKETS, np.int64)
    mixed = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(0x9E3779B1)
    return np.bincount((mixed >> np.uint32(16)) % np.uint32(GRAM_BUCKETS), minlength=GRAM_BUCKETS)


def features(text: bytes | None) -> np.ndarray:
    """Features of a UTF-8 text; shares enter as square roots, so that small ones show.  All zero without a word."""
    text = text or b""
    words = text.split()
    n = len(words)
    out = np.zeros(N_FEATURES, np.float32)
    if not n:
        return out
    k = _CLASSES.shape[1]
    out[:k] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / (len(text) + FEW_BYTES)
    out[k] = sum(map(operator.eq, words, words[1:])) / (n + FEW_WORDS)
    distinct = set(words)
    out[k + 1] = 1.0 - len(distinct) / n  # grows with the length of any text
    out[k + 2] = 1.0 if len(distinct) * 4 < n else 0.0
    out[k + 3] = sum(w.isascii() and not any(map(_LETTERS.__contains__, w)) for w in distinct) / (len(distinct) + FEW_WORDS)
    out[k + 4] = min(1.0, (sum(map(len, words)) / n / 20.0) ** 2)
    out[k + 5] = min(1.0, (np.log1p(n) / 16.0) ** 2)
    lower = text.lower()
    hashed = np.fromiter(map(zlib.crc32, lower.split()), np.uint32, n) % np.uint32(WORD_BUCKETS)
    out[N_SHAPE : N_SHAPE + WORD_BUCKETS] = np.bincount(hashed, minlength=WORD_BUCKETS) / (n + FEW_WORDS)
    out[N_SHAPE + WORD_BUCKETS :] = grams(lower) / (len(text) + FEW_BYTES)
    return np.sqrt(out)


def _log1pexp(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


class _Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return w - self.rate * m / (np.sqrt(v) + 1e-8)


def _steps(grad, size: int, kind, steps: int, rate: float) -> np.ndarray:
    """Adam from zero weights with a falling rate; the mean of the second half of the steps."""
    w, adam, mean = np.zeros(size, kind), _Adam(size, rate), np.zeros(size)
    for k in range(steps):
        adam.rate = rate * (1.0 - k / steps)
        w = adam.step(w, grad(w)).astype(kind)
        if 2 * k >= steps:
            mean += w
    return mean / (steps - (steps + 1) // 2)


def _with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float | None = None) -> np.ndarray:
    """Weights (the last is the bias) that minimise the non-negative PU risk and ``decay`` times half their squares."""
    decay = DECAY / np.sqrt(len(unl)) if decay is None else decay
    pos = _with_bias(pos)
    unl = _with_bias(unl)

    def grad(w: np.ndarray) -> np.ndarray:
        zp, zu = pos @ w, unl @ w
        out = decay * np.append(w[:-1], 0.0) - prior * _sigmoid(-zp) @ pos / len(pos)
        if _log1pexp(zu).mean() >= prior * _log1pexp(zp).mean():
            out += _sigmoid(zu) @ unl / len(unl) - prior * _sigmoid(zp) @ pos / len(pos)
        return out

    return _steps(grad, pos.shape[1], pos.dtype, steps, rate)


def fit_against(pos: np.ndarray, unl: np.ndarray, steps: int = 200, rate: float = 0.05) -> np.ndarray:
    """Weights of a logistic model that tells positives from unlabelled rows."""
    pos, unl = _with_bias(pos), _with_bias(unl)

    def grad(w: np.ndarray) -> np.ndarray:
        out = _sigmoid(unl @ w) @ unl / len(unl) - _sigmoid(-(pos @ w)) @ pos / len(pos)
        return out + 0.01 * np.append(w[:-1], 0.0)

    return _steps(grad, pos.shape[1], pos.dtype, steps, rate)


def halves(rows: np.ndarray) -> np.ndarray:
    """Which rows are of the first half: decided by each row alone, whatever other rows there are."""
    return np.array([zlib.crc32(r.tobytes()) & 1 for r in rows], np.int64) == 0


def estimate_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1, first: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """The share of positives among unlabelled rows, by the best bound over thresholds."""
    p, u = first or (halves(pos), halves(unl))
    if min(p.sum(), (~p).sum(), u.sum(), (~u).sum()) < 2:
        return 0.5
    w = fit_against(pos[p], unl[u])
    sp, su = (np.sort(x @ w[:-1] + w[-1]) for x in (pos[~p], unl[~u]))
    cuts = np.unique(np.concatenate([sp, su]))
    qp = 1.0 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1.0 - np.searchsorted(su, cuts) / len(su)
    ok = qp > 0
    error = np.sqrt(np.log(4 / delta) / 2) * (len(su) ** -0.5 + len(sp) ** -0.5)
    bound = (qu[ok] + error) / qp[ok]
    best = int(bound.argmin())
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.01, 0.99))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None  # of scaled features, then the bias
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: float = 0.5

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -CLIP, CLIP)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Scores of feature rows; 0 for a row of a text without a word."""
        said = rows.any(axis=1)
        if self.weights is None:
            return np.where(said, 0.5, 0.0)
        return np.where(said, _sigmoid(self.scaled(rows) @ self.weights[:-1] + self.weights[-1]), 0.0)


def _scale_in_place(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> None:
    x -= mean
    x /= scale
    np.clip(x, -CLIP, CLIP, out=x)


def fit_rows(pos: np.ndarray, unl: np.ndarray) -> Model:
    # Copies, so what follows may write over them; one at a time, so that no more than one is there twice.
    pos = pos[pos.any(axis=1)].astype(np.float32, copy=False)
    unl = unl[unl.any(axis=1)].astype(np.float32, copy=False)
    if not len(pos) or not len(unl):
        return Model(None)
    first = halves(pos), halves(unl)
    mean = unl.mean(axis=0)
    scale = np.maximum(unl.std(axis=0), LEAST_SCALE)
    _scale_in_place(pos, mean, scale)
    _scale_in_place(unl, mean, scale)
    prior = estimate_prior(pos, unl, first=first)
    both = [unl, pos]
    del pos, unl  # fit_nnpu lets go of each as it copies it
    return Model(fit_nnpu(both.pop(), both.pop(), prior), mean, scale, prior)


def _chance(id: str) -> F.Column:
    """A number in [0, 1) that the id decides."""
    return F.pmod(F.xxhash64(id, F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Feature rows that were sent compressed (most shares are zero)."""
    out = np.empty((len(column), N_FEATURES), np.float32)
    for i, row in enumerate(column):
        out[i] = np.frombuffer(zlib.decompress(row.as_buffer()), np.float32)
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    mark: str = "quality",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """A model from ``docs`` (all of which may be learned from) and ``labels(id, mark)``."""
    trusted = labels.select(id, mark).where(F.col(id).isNotNull()).groupBy(id).agg(F.max(mark).alias("mark"))
    trusted = trusted.where("mark = 1").select(F.col(id).alias("id"))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null")
    n_rows, n_trusted = rows.count(), trusted.count()
    near = rows.withColumn("chance", _chance("id"))
    share_p = min(1.0, max_positive / max(1, n_trusted))
    share_u = min(1.0, max_unlabelled / max(1, n_rows))
    near = near.where(F.col("chance") < max(share_p, share_u))
    positive = trusted.where(_chance("id") < share_p).withColumn("trusted", F.lit(True))
    near = near.join(positive, "id", "left").where((F.col("chance") < share_u) | F.col("trusted"))
    near = near.where(F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0)

    def make():
        return lambda texts: [[zlib.compress(features(t).tobytes(), 1) for t in texts]]

    told = per_text(near.withColumn("text", F.col("text").cast("binary")), make, "f binary", keep_text=False)
    found = told.select("f", "trusted", (F.col("chance") < share_u).alias("web")).toArrow()
    x = _matrix(found.column("f"))
    trusted_rows = np.array([t is True for t in found.column("trusted").to_pylist()], bool)
    web = np.array(found.column("web").to_pylist(), bool)
    del found
    # The same rows in the same order, however Spark returns them.
    order = np.argsort(x.view(f"S{x.itemsize * N_FEATURES}").ravel(), kind="stable")
    sample = [x[order[web[order]]], x[order[trusted_rows[order]]]]
    del x
    return fit_rows(sample.pop(), sample.pop())  # no other name keeps the sample, so fitting can let go of it


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` plus the score of each whole text, 0 to 1."""

    def make():
        return lambda texts: [model.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)).astype(np.float64)]

    kind = docs.schema[text].dataType
    scored = per_text(docs.withColumn(text, named(text).cast("binary")), make, f"`{column}` double", text)
    return scored.withColumn(text, named(text).cast(kind))


def good_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more; columns and their order stay.

    Learns from the rows of ``docs`` whose fold is not held out (see ``op2_quality``).
    """
    model = fit(docs.where(~_held_out(id)), labels, id, text)
    (column,) = spare(docs, "score")
    return score(docs, model, text, column).where(F.col(column) >= cut).drop(column)


def _held_out(id: str) -> F.Column:
    return F.coalesce(fold_of(F.col(id), 5) == 0, F.lit(False))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``: doc_id, held_out, score, predicted.

    Labels come only from rows whose crc32(doc_id) mod 5 is not 0.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = docs.where(~_held_out("doc_id"))
    labels = table(spark, sf_dir, "labels").where(~_held_out("doc_id"))
    scored = score(docs, fit(learn, labels))
    return scored.select(
        "doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
