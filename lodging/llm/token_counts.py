"""Token counts: unigram forward scores over a trie of distinct pre-tokens.

How many tokens the best unigram segmentation of each text has, without
writing the tokens.  A text falls apart into pre-tokens that are segmented by
themselves (see ``pieces``); the distinct ones of a batch that the worker
hasn't counted yet are inserted in a trie.  One walk of the trie works out, for
each prefix, the best log score and number of tokens from the prefixes that it
extends: the forward step of a prefix is done once however many pre-tokens
share it.  A terminal node's count is stored for its pre-token, and a text's
count is the sum over its pre-tokens.

The trie is path-compressed: a node stands for a run of characters and refers
to a pre-token instead of holding them, and there are at most two nodes a
pre-token.  A walk carries the forward scores of the last few prefixes alone (as
many as the longest piece has characters), and takes long runs in parts.  So a
batch needs memory in proportion to its text, one copy of it, even if that
is a single pre-token of many megabytes.

Of equal scores the longer last piece wins, as in ``sentencepiece_codec``, so
the counts are exactly the lengths of its ids.  A worker remembers
``REMEMBERED`` pre-tokens of ``SHORT`` characters at most, then starts anew.  No shuffle.

Defined cases: a NULL or empty text has no tokens; repeated rows and NULL ids
pass through; other columns are ignored or, in ``count_tokens``, kept.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from lodging.llm.common import per_text, table
from lodging.llm.pieces import MARK, Vocabulary, piece_model, pre_tokens, read

REMEMBERED = 800_000
SHORT = 200  # longer pre-tokens aren't remembered beyond their batch
_RUN = 1 << 16  # characters of a node that are walked at a time


class Node:
    """Characters ``start`` to ``end`` of a pre-token; ``counts`` is the pre-token that ends here, if one does."""

    __slots__ = ("text", "start", "end", "below", "counts")

    def __init__(self, text: str, start: int, end: int, counts: str | None = None) -> None:
        self.text, self.start, self.end, self.counts = text, start, end, counts
        self.below: list[Node] = []


def shared(a: str, b: str) -> int:
    """How many characters two texts have in common at the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


class Counter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.scores = {k.decode(): s for k, (_, s) in vocabulary.scores.items()}
        self.longest = max(map(len, self.scores), default=1)
        lengths: dict[str, set[int]] = {}
        for p in self.scores:
            if len(p) > 1:
                lengths.setdefault(p[-2:], set()).add(len(p))
        #: Lengths of the pieces that end in two given characters, the longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.unknown = vocabulary.unknown_score
        self.bytes = vocabulary.byte_ids is not None
        self.known: dict[str, int] = {}

    def insert(self, words: Iterable[str]) -> Node:
        """The path-compressed trie of distinct pre-tokens, a space being a mark."""
        root = Node("", 0, 0)
        way, before = [root], ""
        for text, word in sorted((w.replace(" ", MARK), w) for w in words):
            at, last = shared(before, text), root
            while way[-1].end > at:
                last = way.pop()
            top = way[-1]
            if top.end < at:  # the path branches within a node
                middle = Node(last.text, top.end, at)
                middle.below.append(last)
                last.start = at
                top.below[-1] = middle
                way.append(middle)
                top = middle
            node = Node(text, at, len(text), word)
            top.below.append(node)
            way.append(node)
            before = text
        return root

    def forward(self, tail: str, run: str, best: list[float], count: list[int]) -> tuple[str, list[float], list[int]]:
        """Scores and counts of the prefixes that end in ``run``, after those that end in ``tail``.

        ``best`` and ``count`` are of the prefix before ``tail`` and of each of its characters;
        returned are those that the next run needs.
        """
        scores, lengths = self.scores, self.lengths
        text, best, count = tail + run, best[:], count[:]
        for end in range(len(tail) + 1, len(text) + 1):
            top = tokens = None
            if end > 1:
                for n in lengths.get(text[end - 2 : end], ()):
                    if n <= end:
                        s = scores.get(text[end - n : end])
                        if s is not None:
                            s += best[end - n]
                            if top is None or s > top:
                                top, tokens = s, count[end - n] + 1
            char = text[end - 1]
            s = scores.get(char)
            if s is not None:
                s += best[end - 1]
                if top is None or s > top:
                    top, tokens = s, count[end - 1] + 1
            else:
                s = best[end - 1] + self.unknown
                if top is None or s > top:
                    top, tokens = s, count[end - 1] + (len(char.encode()) if self.bytes else 1)
            best.append(top)
            count.append(tokens)
        keep = min(len(text), self.longest - 1)
        return text[len(text) - keep :], best[len(text) - keep :], count[len(text) - keep :]

    def walk(self, root: Node) -> Iterable[tuple[str, int]]:
        """(pre-token, number of tokens) of each terminal node, a forward step per prefix."""
        todo = [(n, "", [0.0], [0]) for n in root.below]
        while todo:
            node, tail, best, count = todo.pop()
            for at in range(node.start, node.end, _RUN):
                tail, best, count = self.forward(tail, node.text[at : min(at + _RUN, node.end)], best, count)
            if node.counts is not None:
                yield node.counts, count[-1]
            todo.extend((n, tail, best, count) for n in node.below)

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """(pre-tokens, tokens) of each text of a batch."""
        parts = [pre_tokens(t, self.vocabulary) for t in texts]
        new = set().union(*parts) - self.known.keys() if parts else set()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*parts)
        long = {}
        for word, n in self.walk(self.insert(new)):
            (self.known if len(word) <= SHORT else long)[word] = n
        known = self.known
        return [len(p) for p in parts], [sum(known[w] if len(w) <= SHORT else long[w] for w in p) for p in parts]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read(path))


def count_tokens(docs: DataFrame, model: str, text: str = "text", column: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``column``, the tokens of each whole text, and ``<column>_pre``, its pre-tokens."""

    def make():
        c = counter(model)

        def run(texts):
            pre, tokens = c(texts)
            return [tokens, pre]

        return run

    return per_text(docs, make, f"{column} long, {column}_pre long", text, keep_text)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``: doc_id, n_tokens, n_pretokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, piece_model(), keep_text=False).withColumnRenamed("n_tokens_pre", "n_pretokens")
