"""Secret scans: fixed patterns plus sliding-window Shannon entropy.

Base kinds (whole text, leftmost and non-overlapping per kind; offsets are
code points, end exclusive; a match that fails its length test is dropped and
the scan goes on behind it):

* ``assign``  a credential word, an optional quote, ``:`` or ``=``, a value;
  the value (group 2) has 6 characters or more;
* ``access``  ``AKIA`` and capitals or digits, 20 characters or more;
* ``hex``     a run of ``[0-9a-f]`` of 24 characters or more.

The entropy method adds spans to these.  Candidates are the maximal runs of a
character class; a window slides over each one while the counts of its
characters are updated by one character in and one out, so a step costs O(1)
whatever the window length: with ``S = sum c*log2(c)`` over the window's
character counts, its entropy is ``log2(w) - S/w``.  Windows whose entropy
reaches the class's threshold are merged into spans.  A candidate that the
allow-list knows (UUIDs, ordinary long words, headings) gives no entropy span;
a placeholder takes only its own segment (between ``/ _ = + -``) out of a
candidate, an alphabet only its own characters; the allow-list never touches base spans.  An entropy span
that lies inside a base span is that secret already and is left out.

Defined cases: a NULL text is an empty one and has no span; equal rows give
equal rows; other columns of the input are ignored.  One text costs time and
memory in proportion to its length.  Narrow: no shuffle at any size.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.llm.common import named, per_text, spare, table

BASE_KINDS = ("assign", "access", "hex")

# Fixed patterns of the base kinds.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20


@dataclass(frozen=True)
class EntropyClass:
    """A character class, the window slid over its runs, and its threshold in bits."""

    name: str
    characters: str  # body of a character set
    window: int
    threshold: float


# A window of 20 can reach log2(20) = 4.32 bits, over the 16 hex digits 4 bits.
CLASSES = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", 20, 3.1),
    EntropyClass("entropy_base64", r"A-Za-z0-9+/_=\-", 20, 3.7),
)

# A candidate that one of these matches is no secret.  Fixed values.
ALLOW = (
    r"[A-Z]?[a-z]{1,30}",  # a long word
    r"[A-Za-z]?[a-z]{1,18}(?:[A-Z][a-z]{2,18}|By|Is|Of|To|In|On|At|Or|As|Id|No){1,6}",  # words put together, each with a capital
    r"[A-Z_\-/=+]+",  # a heading, a ruled line
    r"[0-9]+",  # a number: no letters mixed in
    r"(?:[A-Za-z]{1,18}[-_/=+]+)+[A-Za-z]{0,18}",  # hyphenated words, a path of words
    r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",  # a UUID
)

# What marks the segment of a candidate that holds it, and no other, as no secret.
_MARK = re.compile("EXAMPLE|example|xxxxxx|XXXXXX|placeholder|PLACEHOLDER")
_SEGMENT = re.compile(r"[^/_=+\-]+")
# A candidate's alphabets; they end where the next character isn't the following one.
_SERIES = re.compile("0123456789|abcdefghij|ABCDEFGHIJ")


def unmarked(run: str) -> list[tuple[int, int]]:
    """[start, end) of what is left of ``run`` without its marked segments and its alphabets."""
    gone = [m.span() for m in _SEGMENT.finditer(run) if _MARK.search(m[0])] if _MARK.search(run) else []
    for m in _SERIES.finditer(run):
        end = m.end()
        while end < len(run) and ord(run[end]) == ord(run[end - 1]) + 1:
            end += 1
        gone.append((m.start(), end if end - m.end() > 2 else m.end()))  # one or two may be a key's first ones by chance
    left, at = [], 0
    for s, e in sorted(gone):
        if s > at:
            left.append((at, s))
        at = max(at, e)
    return [*left, (at, len(run))] if at < len(run) else left


def entropy_windows(run: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of ``run`` that reach ``threshold`` bits."""
    if len(run) < window:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    # entropy >= threshold  <=>  S <= window * (log2(window) - threshold)
    most = window * (math.log2(window) - threshold) + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weight[n + 1] - weight[n]
        if i >= window:
            old = run[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += weight[n - 1] - weight[n]
        start = i - window + 1
        if start >= 0 and total <= most:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


class Cover:
    """Whether a span lies inside one of the given spans, in O(log n)."""

    def __init__(self, spans: Sequence[tuple[str, int, int]]) -> None:
        ordered = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in ordered]
        self.ends = list(accumulate((e for _, e in ordered), max))

    def holds(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end


class Scanner:
    """All spans of a text: ``(kind, start, end)`` by start, then kind as listed."""

    def __init__(self, classes: Sequence[EntropyClass] = CLASSES, allow: Sequence[str] = ALLOW) -> None:
        self.classes = [(c, re.compile(rf"(?<![{c.characters}])[{c.characters}]{{{c.window},}}")) for c in classes]
        self.allow = re.compile("|".join(f"(?:{p})" for p in allow)) if allow else None
        self.order = {k: i for i, k in enumerate([*BASE_KINDS, *(c.name for c in classes)])}

    def base(self, text: str) -> list[tuple[str, int, int]]:
        spans = []
        if ":" in text or "=" in text:
            spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
        if "AKIA" in text:
            spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        spans += [("hex", *m.span()) for m in HEX.finditer(text)]
        return spans

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        spans: list[tuple[str, int, int]] = []
        for c, pattern in self.classes:
            known = Cover([*base, *spans])
            for m in pattern.finditer(text):
                for at, end in unmarked(m[0]) if self.allow else [(0, len(m[0]))]:
                    part = m[0][at:end]
                    if self.allow and self.allow.fullmatch(part):
                        continue
                    for s, e in entropy_windows(part, c.window, c.threshold):
                        s, e = s + at + m.start(), e + at + m.start()
                        if not known.holds(s, e):
                            spans.append((c.name, s, e))
        return spans

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        text = text or ""
        base = self.base(text)
        return sorted(base + self.added(text, base), key=lambda x: (x[1], self.order[x[0]], x[2]))


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _make(classes, allow):
    def make():
        scan = Scanner(classes, allow)
        return lambda texts: [[[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in texts]]

    return make


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    classes: Sequence[EntropyClass] = CLASSES,
    allow: Sequence[str] = ALLOW,
    column: str = "secrets",
) -> DataFrame:
    """``docs`` plus ``column``: array<struct<kind, start, end>> of every span; an error if there is such a column."""
    return per_text(docs, _make(classes, allow), f"{column} array<struct<kind:string,start:long,end:long>>", text)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", allow: Sequence[str] = ALLOW) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans by one mark.

    A NULL text stays NULL; columns and their order stay.
    """
    order = docs.columns

    def make():
        scan = Scanner(CLASSES, allow)

        def clean(t: str | None) -> str | None:
            spans = scan(t) if t else []
            if not spans:
                return t
            parts, at = [], 0
            for _, s, e in spans:
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            return "".join([*parts, t[at:]])

        return lambda texts: [[clean(t) for t in texts]]

    (new,) = spare(docs, "redacted")
    marked = per_text(docs, make, f"{new} string", text)
    return marked.select(*[F.col(new).alias(c) if c == text else named(c) for c in order])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``; see the module for the kinds.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans and, besides,
    n_entropy (spans that the entropy method adds).
    """

    def make():
        scan = Scanner()

        def digest(texts):
            rows = []
            for t in texts:
                spans = scan(t)
                base = [x for x in spans if x[0] in BASE_KINDS]
                n = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)]

        return digest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = per_text(
        docs,
        make,
        "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long",
        keep_text=False,
    )
    return found
