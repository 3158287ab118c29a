"""Language ID by a linear-chain conditional random field over words.

Each word of a text (a run of letters, small) is labelled with a language.  Runs
of more than ``UNIT`` letters, and of more than ``UNSPACED_UNIT`` in scripts
without spaces, count as several words of about equal length, so every letter of
a text counts; a run ends where such a script begins or ends.  A label's score at a word is the sum of the weights of the word's features
(prefixes and suffixes of 1 to 4 letters, its 2- and 3-grams, the word itself,
hashed to ``BUCKETS``; and whether it stands in each language's lexicon), plus
a learned weight of the step from the label before.  Forward-backward gives
each word's probabilities, so text that switches languages is labelled word by
word; a text's language is the one with the largest mean probability over its
words, and that mean is the score.

Fitting maximises the conditional likelihood by full-batch gradient steps on
the whole texts of a bounded sample: ``max_rows`` rows of each language on
average, by a hash of the id, and nothing else bounds it.  A text enters as
consecutive sequences of ``LENGTH`` words, the last one shorter, so no word is left out.
Some further sequences join parts of two languages, so that the step weights
learn how rare a switch is instead of never seeing one.  The lexicon of a
language holds the words that at least ``LEXICON_SHARE`` of its sampled rows
use, which bounds it.  Of more than ``max_labels`` languages those with the most
rows (of equal ones the first by name) are learned, so that a column of dirty
names can't outgrow the driver.

Scoring covers whole texts of any length and needs no shuffle: a batch's texts
go through forward-backward side by side, and a worker remembers the scores of
at most ``REMEMBERED`` words.

Defined cases: a NULL text, and one without letters, is ``und`` with score 0,
and so is every text if there is no labelled row to learn from; rows with a
NULL language, text or id are never learned from; a very long text is read whole, in the sample too; repeated rows get equal
results; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.llm.common import fold_of, named, per_text, table

MAX_ROWS = 200
MAX_LABELS = 200
LENGTH = 64
LEXICON_SHARE = 0.05
BUCKETS = 1 << 16
REMEMBERED = 300_000
CHUNK = 1 << 22  # numbers added up at a time
UNKNOWN = "und"
UNIT, UNSPACED_UNIT = 24, 8  # most letters of a word, and of a word of a script without spaces
# Thai to Tibetan, Burmese, Khmer and their neighbours, kana, Chinese characters
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_LETTERS = re.compile(rf"[^\W\d_{_UNSPACED}]+|(?:(?=[^\W\d_])[{_UNSPACED}])+")
_UNSPACED_LETTER = re.compile(f"[{_UNSPACED}]")


def _units(run: str) -> list[str]:
    """A run of letters as consecutive parts of about equal length, none longer than its script's bound."""
    parts = -(-len(run) // (UNSPACED_UNIT if _UNSPACED_LETTER.match(run) else UNIT))
    return [run[len(run) * i // parts : len(run) * (i + 1) // parts] for i in range(parts)]


def words_of(text: str | None) -> list[str]:
    """Runs of letters, small; long ones in parts, so that every letter is in one word of bounded length."""
    found = _LETTERS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):
        found = [w for w in ("".join(filter(str.isalpha, w)) for w in found) if w]
    if found and max(map(len, found)) > UNSPACED_UNIT:
        return [u for w in found for u in (_units(w) if len(w) > UNSPACED_UNIT else (w,))]
    return found


def word_features(word: str, lexicons: tuple[frozenset, ...]) -> list[int]:
    """Feature numbers: hashed ones below BUCKETS, then one per lexicon that has the word."""
    n = len(word)
    ascii_ = word.isascii()
    edges = f"^{word}$".encode() if ascii_ else f"^{word}$"  # a character is a byte: cut the bytes
    inner = edges[1:-1]
    most = min(n, 4)
    found = [(b"=" if ascii_ else "=") + inner]
    found += [edges[: k + 1] for k in range(1, most + 1)]
    found += [edges[-k - 1 :] for k in range(1, most + 1)]
    found += [inner[i : i + 2] for i in range(n - 1)]
    found += [inner[i : i + 3] for i in range(n - 2)]
    crc = zlib.crc32
    distinct = dict.fromkeys(found)
    ids = [crc(f) % BUCKETS for f in distinct] if ascii_ else [crc(f.encode()) % BUCKETS for f in distinct]
    return ids + [BUCKETS + i for i, x in enumerate(lexicons) if word in x]


def feature_rows(words: list[str], lexicons: tuple[frozenset, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one word after the other, and how many each has (at least one)."""
    rows = [word_features(w, lexicons) for w in words]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts


def feature_sums(weights: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each word's feature weights, a column per label."""
    ends = np.cumsum(counts)
    out = np.empty((len(counts), weights.shape[1]))
    most = max(1, CHUNK // weights.shape[1])
    i = 0
    while i < len(counts):
        low = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, low + most, side="right")))
        out[i:j] = np.add.reduceat(weights[flat[low : ends[j - 1]]], ends[i:j] - counts[i:j] - low, axis=0)
        i = j
    return out


class Packed:
    """Sequences side by side, longest first: step t holds the t-th word of those that have one."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-self.lengths, kind="stable")
        lengths = self.lengths[self.order]
        steps = int(lengths[0]) if len(lengths) else 0
        self.sizes = np.searchsorted(-lengths, -np.arange(steps), side="left")
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        flat = np.concatenate([sequences[i] for i in self.order]) if len(sequences) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = self.starts[step] + row
        self.values = np.empty(len(flat), np.int64)
        self.values[place] = flat
        self.row = np.empty(len(flat), np.int64)
        self.row[place] = self.order[row]


def forward_backward(scores: np.ndarray, packed: Packed, steps: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each label at each packed word, and expected counts of each step between labels.

    ``scores``: positive label scores of the packed words; ``steps``, ``start``: positive too.
    """
    sizes, at = packed.sizes, packed.starts
    forward, scale = np.empty_like(scores), np.empty(len(scores))
    for t, n in enumerate(sizes):
        here = slice(at[t], at[t] + n)
        a = (forward[at[t - 1] : at[t - 1] + n] @ steps if t else start) * scores[here]
        s = a.sum(axis=1)
        forward[here] = a / s[:, None]
        scale[here] = s
    backward, expected = np.ones_like(scores), np.zeros_like(steps)
    for t in range(len(sizes) - 1, 0, -1):
        n = sizes[t]
        here, before = slice(at[t], at[t] + n), slice(at[t - 1], at[t - 1] + n)
        ahead = scores[here] * backward[here] / scale[here][:, None]
        backward[before] = ahead @ steps.T
        expected += forward[before].T @ ahead
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), expected * steps


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    lexicons: tuple[frozenset, ...] = ()
    weights: np.ndarray | None = None  # feature x label
    steps: np.ndarray | None = None
    start: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Positive label scores, the largest 1."""
        out = np.empty((len(words), len(self.labels)))
        for i in range(0, len(words), 20_000):
            out[i : i + 20_000] = feature_sums(self.weights, *feature_rows(words[i : i + 20_000], self.lexicons))
        return np.exp(np.maximum(out - out.max(axis=1, keepdims=True), -60.0)) if len(words) else out


def fit_sequences(sequences: list[list[str]], tags: list[np.ndarray], labels: tuple[str, ...], lexicons: tuple[frozenset, ...], rounds: int = 60, rate: float = 0.1, decay: float = 2e-5) -> Model:
    """The CRF that maximises the likelihood of ``tags`` (a label number per word)."""
    number = {w: i for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
    flat, counts = feature_rows(list(number), lexicons)
    packed = Packed([np.array([number[w] for w in s], np.int64) for s in sequences])
    truth = Packed(tags).values
    k, n = len(labels), len(packed.values)
    weights, steps, start = np.zeros((BUCKETS + len(lexicons), k)), np.zeros((k, k)), np.zeros(k)
    gold = np.zeros((n, k))
    gold[np.arange(n), truth] = 1.0
    first = slice(0, packed.sizes[0])
    seen = np.zeros((k, k))
    for t in range(1, len(packed.sizes)):
        m = packed.sizes[t]
        np.add.at(seen, (truth[packed.starts[t - 1] : packed.starts[t - 1] + m], truth[packed.starts[t] : packed.starts[t] + m]), 1.0)
    params, moments = [weights, steps, start], [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, steps, start)]
    for t in range(1, rounds + 1):
        s = feature_sums(weights, flat, counts)
        s = np.exp(np.maximum(s - s.max(axis=1, keepdims=True), -60.0))
        found, expected = forward_backward(s[packed.values], packed, np.exp(steps), np.exp(start))
        miss = found - gold
        g_words = np.stack([np.bincount(packed.values, weights=miss[:, j], minlength=len(counts)) for j in range(k)], axis=1)
        g_weights = np.stack([np.bincount(flat, weights=np.repeat(g_words[:, j], counts), minlength=len(weights)) for j in range(k)], axis=1)
        grads = [g_weights / n + decay * weights, (expected - seen) / n + decay * steps, miss[first].sum(axis=0) / len(tags) + decay * start]
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return Model(labels, lexicons, weights.astype(np.float32), np.exp(steps), np.exp(start))


def _training(samples: list[tuple[int, list[list[str]]]], n_labels: int) -> tuple[list[list[str]], list[np.ndarray]]:
    """Sequences and their tags: each segment alone, and segments of two languages joined."""
    segments = [(tag, s) for tag, parts in samples for s in parts if s]
    sequences, tags = [s for _, s in segments], [np.full(len(s), tag) for tag, s in segments]
    rng = np.random.default_rng(11)
    for i in rng.permutation(len(segments))[: len(segments) // 4]:
        j = int(rng.integers(len(segments)))
        (a, x), (b, y) = segments[i], segments[j]
        if a != b:
            cut, keep = int(rng.integers(1, len(x) + 1)), int(rng.integers(1, len(y) + 1))
            sequences.append(x[:cut] + y[:keep])
            tags.append(np.concatenate((np.full(cut, a), np.full(keep, b))))
    return sequences, tags


def fit(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_rows: int = MAX_ROWS,
    max_labels: int = MAX_LABELS,
) -> Model:
    """A model from the rows of ``docs`` (all of which may be learned from)."""
    rows = docs.select(named(id).alias("id"), named(text).alias("text"), named(lang).alias("lang"))
    rows = rows.where("id is not null and text is not null and lang is not null")
    largest = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_labels)
    sizes = {r.lang: r["count"] for r in largest.collect()}
    labels = tuple(sorted(sizes))
    if not labels:
        return Model(())
    chance = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, max_rows / sizes[k]))])
    sample = rows.where(chance < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0)))

    def make():
        return lambda texts: [[words_of(t) for t in texts]]

    found = per_text(sample, make, "words array<string>", keep_text=False).select("lang", "words").collect()
    samples = sorted((labels.index(r.lang), r.words) for r in found)
    lexicons = []
    for i in range(len(labels)):
        own = [set(words) for tag, words in samples if tag == i]
        uses: dict[str, int] = {}
        for s in own:
            for w in s:
                uses[w] = uses.get(w, 0) + 1
        lexicons.append(frozenset(w for w, c in uses.items() if c >= max(2, LEXICON_SHARE * len(own))))
    parts = [(tag, [words[a : a + LENGTH] for a in range(0, len(words), LENGTH)]) for tag, words in samples]
    sequences, tags = _training(parts, len(labels))
    if not sequences:
        return Model(())
    return fit_sequences(sequences, tags, labels, tuple(lexicons))


class Tagger:
    """Labels words of whole texts, remembering the scores of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.labels)))

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list(set().union(*texts) - self.known.keys()) if texts else []
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set().union(*texts))
        low = len(self.known)
        while len(self.scores) < low + len(new):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
        self.scores[low : low + len(new)] = self.model.word_scores(new)
        self.known.update(zip(new, range(low, low + len(new))))
        get = self.known.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def probabilities(self, texts: list[list[str]]) -> tuple[np.ndarray, Packed]:
        packed = Packed(self.numbers(texts))
        found, _ = forward_backward(self.scores[packed.values], packed, self.model.steps, self.model.start)
        return found, packed

    def tag(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, probability) of each word of one text."""
        words = words_of(text)
        if not words or not self.model.labels:
            return []
        found, _ = self.probabilities([words])
        return [(w, self.model.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, found)]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels = self.model.labels
        names, means = [UNKNOWN] * len(texts), [0.0] * len(texts)
        words = [words_of(t) for t in texts]
        some = [i for i, w in enumerate(words) if w] if labels else []
        if some:
            found, packed = self.probabilities([words[i] for i in some])
            total = np.stack([np.bincount(packed.row, weights=found[:, j], minlength=len(some)) for j in range(len(labels))], axis=1)
            mean = np.clip(total / packed.lengths[:, None], 0.0, 1.0)
            for i, best, row in zip(some, mean.argmax(axis=1), mean):
                names[i], means[i] = labels[int(best)], float(row[best])
        return names, means


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``."""

    def make():
        tagger = Tagger(model)
        return lambda texts: list(tagger(texts))

    return per_text(docs, make, "lang_pred string, score double", text, keep_text)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32(doc_id) mod 4 is not 2.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    found = predict(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
