"""A vocabulary of pieces with log scores, read from a SentencePiece model file."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

MARK = "▁"  # what a space becomes


@dataclass(frozen=True)
class Vocabulary:
    """``scores``: id and log score of each ordinary piece, by its UTF-8 bytes;
    ``byte_ids``: the id of each byte's fallback piece; ``unknown``: the id for
    text that no piece and no byte piece covers; ``unknown_score``: the log
    score of a character spelt by fallback (10 below the lowest piece);
    ``parts``: finds the parts of a text that no piece crosses."""

    scores: dict[bytes, tuple[int, float]]
    byte_ids: tuple[int, ...] | None
    unknown: int
    unknown_score: float
    names: tuple[str, ...]
    parts: re.Pattern


_LETTERS = "A-Za-z\u00c0-\u024f"  # of Latin script; others are never cut


def _parts(pieces: list[str]) -> re.Pattern:
    """Cuts a text where no piece can go on, so that each part is encoded by itself, exactly.

    No piece has a mark behind another character, so a run of spaces starts
    a part.  A run of white space that no piece joins with other characters
    (but a mark in front) is a part of its own; punctuation that stands behind
    a Latin letter in no piece starts a part there.
    """
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1) if p[i] != MARK}
    alone = set("\t\n\x0b\x0c\r")
    while joined := {c for pair in pairs if (pair[0] in alone) != (pair[1] in alone) for c in pair} & alone:
        alone -= joined
    letter = re.compile(f"[{_LETTERS}]")
    cut = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") - {b for a, b in pairs if letter.match(a)}
    a, c = ("".join(map(re.escape, sorted(x))) for x in (alone, cut))
    other = f"[^ {a}{_LETTERS}]"
    word = f"[{_LETTERS}]+(?:[^ {a}{c}{_LETTERS}]{other}*)?"
    return re.compile(f" *[{a}]+|" * bool(a) + f" *(?:{other}+(?:{word})*|(?:{word})+)| +")


def vocabulary(names: list[str], scores: list[float], ordinary: list[bool], byte_ids: list[int] | None, unknown: int) -> Vocabulary:
    found = {n.encode(): (i, s) for i, (n, s, o) in enumerate(zip(names, scores, ordinary)) if o and n}
    lowest = min((s for _, s in found.values()), default=0.0)
    if any(MARK in n.lstrip(MARK) for n, o in zip(names, ordinary) if o):
        raise ValueError("a piece with a mark behind another character")
    parts = _parts([k.decode() for k in found])
    return Vocabulary(found, tuple(byte_ids) if byte_ids else None, unknown, lowest - 10.0, tuple(names), parts)


@lru_cache(maxsize=2)
def read(path: str) -> Vocabulary:
    """The vocabulary of a model file; control pieces are never matched in a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    scores = [model.get_score(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    spelt = {names[i]: i for i in range(n) if model.is_byte(i)}
    byte_ids = [spelt[f"<0x{b:02X}>"] for b in range(256)] if len(spelt) == 256 else None
    return vocabulary(names, scores, [not s for s in special], byte_ids, model.unk_id())


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pre_tokens(text: str | None, vocabulary: Vocabulary) -> list[str]:
    """The parts of a text that are encoded by themselves; none for an empty text.

    One space is put before the text; a mark in the text counts as a space.
    """
    return vocabulary.parts.findall(" " + text.replace(MARK, " ")) if text else []
