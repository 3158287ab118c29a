"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Encoding: spaces become marks, with one mark put before a text; the pieces of
a given model, each with its log score, are matched by a double-array trie
over UTF-8 bytes, and the segmentation with the largest sum of scores wins (of
equal ones, the one whose last pieces are longer).  A character that is no
piece is spelt by byte pieces at a penalty of 10 below the lowest score.

A text falls apart where no piece can go on (before a run of spaces, and
around punctuation that no piece joins with letters) into parts that are
solved by themselves, exactly, and a worker remembers the parts that it has
solved (``REMEMBERED`` at most, then it starts anew).  Memory is that of one batch of texts; there is no shuffle.

Decoding joins pieces, turns marks into spaces and byte pieces into bytes
(bytes that are no UTF-8 become U+FFFD) and takes the mark put in front away;
control pieces and unknown ids below 0 or beyond the vocabulary stand for
nothing.  A text that holds the mark character itself decodes to a space there.

Defined cases: a NULL or empty text has no ids and no ids decode to an empty
text; NULL ids decode to NULL; repeated rows and NULL ids of documents pass
through; other columns are ignored or, in ``encode`` and ``decode``, kept.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lodging.llm.common import per_text, table
from lodging.llm.pieces import MARK, Vocabulary, piece_model, pre_tokens, read

REMEMBERED = 800_000


class DoubleArray:
    """A trie in two arrays: the child of node s by byte c is ``base[s] + c + 1`` if ``check`` of it is s.

    The child by no byte, ``base[s]``, marks a key's end; its base is minus
    the key's value less one.
    """

    def __init__(self, keys: dict[bytes, int]) -> None:
        self.base, self.check = [1], [0]
        self._used = 1  # every slot below is taken
        ordered = sorted(keys.items())
        todo = [(0, 0, 0, len(ordered))]
        while todo:
            node, depth, low, high = todo.pop()
            groups: list[tuple[int, int, int]] = []  # label, first, last
            at = low
            if at < high and len(ordered[at][0]) == depth:
                groups.append((0, at, at + 1))
                at += 1
            while at < high:
                label = ordered[at][0][depth]
                end = at
                while end < high and ordered[end][0][depth] == label:
                    end += 1
                groups.append((label + 1, at, end))
                at = end
            if not groups:
                continue
            place = self._place([g[0] for g in groups])
            self.base[node] = place
            for label, first, last in groups:
                child = place + label
                self.check[child] = node
                if label == 0:
                    self.base[child] = -ordered[first][1] - 1
                else:
                    todo.append((child, depth + 1, first, last))

    def _place(self, labels: list[int]) -> int:
        """The lowest base at which all labels' slots are free."""
        check = self.check
        while self._used < len(check) and check[self._used] >= 0:
            self._used += 1
        place = max(1, self._used - labels[0])
        while any(place + c < len(check) and check[place + c] >= 0 for c in labels):
            place += 1
        grow = place + 257 - len(check)
        if grow > 0:
            self.base += [0] * grow
            check += [-1] * grow
        for c in labels:
            check[place + c] = 0
        return place


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        trie = DoubleArray({k: i for k, (i, _) in vocabulary.scores.items()})
        self.base, self.check = trie.base, trie.check
        self.score = [0.0] * len(vocabulary.names)
        for i, s in vocabulary.scores.values():
            self.score[i] = s
        self.spelling = [b""] * len(vocabulary.names)  # what each id stands for
        for k, (i, _) in vocabulary.scores.items():
            self.spelling[i] = k.replace(MARK.encode(), b" ")
        for b, i in enumerate(vocabulary.byte_ids or ()):
            self.spelling[i] = bytes([b])
        self.parts: dict[str, bytes] = {}

    def viterbi(self, text: bytes) -> list[int]:
        """Ids of the best segmentation of a part."""
        base, check, score, size = self.base, self.check, self.score, len(self.check)
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        start, piece = [0] * (n + 1), [-1] * (n + 1)
        unknown = self.vocabulary.unknown_score
        at = 0
        while at < n:
            first = text[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here = best[at]
            node, i, single = 0, at, False
            while i < n:
                t = base[node] + text[i] + 1
                if t >= size or check[t] != node:
                    break
                node = t
                i += 1
                end = base[node]
                if check[end] == node and base[end] < 0:
                    p = -base[end] - 1
                    s = here + score[p]
                    single = single or i - at == width
                    old = best[i]
                    if old is None or s > old:
                        best[i], start[i], piece[i] = s, at, p
            if not single:
                i = at + width
                s = here + unknown
                old = best[i]
                if old is None or s > old:
                    best[i], start[i], piece[i] = s, at, -1
            at += width
        out: list[int] = []
        i = n
        while i:
            a, p = start[i], piece[i]
            if p >= 0:
                out.append(p)
            elif self.vocabulary.byte_ids:
                out += [self.vocabulary.byte_ids[b] for b in reversed(text[a:i])]
            else:
                out.append(self.vocabulary.unknown)
            i = a
        out.reverse()
        return out

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            found = self.viterbi(part.replace(" ", MARK).encode())
            ids = self.parts[part] = np.array(found, "<u4").tobytes()
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        parts = pre_tokens(text, self.vocabulary)
        found = list(map(self.parts.get, parts))
        if None in found:
            found = [self.part(p) if f is None else f for p, f in zip(parts, found)]
        return b"".join(found)

    def decode(self, ids) -> str:
        spelt = self.spelling
        text = b"".join([spelt[i] for i in ids if i is not None and 0 <= i < len(spelt)])
        return text.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(read(path))


def encode(docs: DataFrame, model: str, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` plus ``column``: the ids of each whole text, array<int>."""

    def make():
        c = codec(model)
        return lambda texts: [[np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in texts]]

    return per_text(docs, make, f"{column} array<int>", text)


def decode(rows: DataFrame, model: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``rows`` plus ``column``: the text that each row's ids stand for."""

    def make():
        c = codec(model)
        return lambda found: [[None if x is None else c.decode(x) for x in found]]

    return per_text(rows, make, f"{column} string", ids)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again.

    Columns: doc_id, n_ids, ids_crc32 (unsigned, over little-endian unsigned
    32-bit ids), n_byte_ids (ids of byte pieces), round_trip (the decoded text
    is the text; a NULL one counts as empty).
    """
    model = piece_model()

    def make():
        c = codec(model)
        spelt = np.zeros(len(c.vocabulary.names), bool)
        spelt[list(c.vocabulary.byte_ids or ())] = True

        def told(texts):
            rows = []
            for t in texts:
                raw = c.encode(t)
                ids = np.frombuffer(raw, "<u4")
                rows.append((len(ids), zlib.crc32(raw), int(spelt[ids].sum()), c.decode(ids.tolist()) == (t or "")))
            return [list(x) for x in zip(*rows)] if rows else [[] for _ in range(4)]

        return told

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return per_text(docs, make, "n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean", keep_text=False)
