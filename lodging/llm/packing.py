"""Best-fit packing of token sequences by a grouping genetic algorithm.

A document's ids are those of the given ``tokenizers`` file plus a closing id;
a longer one than ``capacity`` is cut into pieces, all but the last full.  The
pieces are packed into as few sequences of ``capacity`` tokens as it can.

* *Shards.*  Pieces are dealt by hash into shards of about ``shard`` pieces: a
  shard is one packing problem, and as many are solved at a time as there are
  cores.
* *Islands.*  Each shard is evolved on ``islands`` islands at once.  A
  chromosome is a list of whole bins (groups).  Crossover injects well-filled
  bins of one parent into the other, drops the bins that hold a piece twice
  now, and puts the displaced pieces back by best fit, largest first, or by
  tight fit (the two pieces that fill a bin best).  Mutation empties the
  worst-filled bins and places their pieces anew.
* *Migration.*  An epoch goes on until ``generations`` children in a row bring
  no better packing; after each one every island's elite goes to the next
  island through a shuffle.  An island stops once it meets the lower bound.
* *Rounds.*  Bins that end up less than ``release`` full give their pieces
  back; those of all shards are dealt again, into fewer shards, until one
  shard is left or ``rounds`` are done.  So the waste of a shard's last bins
  doesn't add up over shards.  Where pieces over half a bin decide how many bins
  it takes, bins without one give their pieces back too: those fit beside them.  The last round keeps every bin.

No row holds more than one shard's pieces; nothing is collected.

Defined cases: a NULL text is an empty one, whose only token is the closing
id; repeated rows are documents of their own; NULL ids are carried along;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodging.llm.common import ship, stage, table

CAPACITY = 4096
CLOSING_ID = 1
SHARD = 2048
ISLANDS = 2
EPOCHS = 4
ROUNDS = 3
RELEASE = 0.97
GENERATIONS = 100  # children in a row without a better packing that end an epoch
POPULATION = 6
WORD_CACHE = 600_000  # remembered words of a Python worker; a full memory is emptied


# --- token ids --------------------------------------------------------------


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# What the shortcut below was written for: any other file's texts go through its tokenizer whole.  Fixed values.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def word_by_word(file: dict) -> bool:
    """Whether a tokenizer file's texts are the sum of their words, as ``Encoder`` takes them."""
    model = file.get("model") or {}
    plain = all(not t.get(k) for t in file.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    plain &= all(not any(c.isspace() for c in t["content"]) for t in file.get("added_tokens") or [])
    return (
        file.get("normalizer") == _NORMALIZER
        and file.get("pre_tokenizer") == _PRE_TOKENIZER
        and file.get("truncation") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and plain
    )


_ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, remembering words.

    White space ends a word for this tokenizer, so a text's ids are those of
    its words put together.  A word of Latin letters is one unit of the BPE
    model, and so are the marks that follow it; any other word goes through
    the whole tokenizer.  What is remembered never changes an id: a word's ids
    are the same in a fresh worker.  Of a file for which this doesn't hold
    (``word_by_word``) each whole text goes through the tokenizer.
    """

    MARKS = b".,!?;:"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.by_word = word_by_word(json.load(file))
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = _byte_level()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[bytes, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return b"".join([self.packed[i] for i in ids])

    def whole(self, word: bytes) -> bytes:
        return self.remember(word, self.encode(word))

    def remember(self, word: bytes, ids: bytes) -> bytes:
        if len(self.words) >= WORD_CACHE:
            self.words.clear()
        self.words[word] = ids
        return ids

    def letters(self, word: bytes) -> bytes | None:
        """Ids of a word if it is Latin letters alone."""
        text = word.decode()
        if not text.isalpha():
            return None
        if not text.isascii():
            if max(text) >= "\u0250":
                return None
            text = text.lower()
            if not text.isalpha():
                return None
            text = text.encode().decode("latin-1").translate(self.alphabet)
        else:
            text = text.lower()
        packed = self.packed
        return self.remember(word, b"".join([packed[t.id] for t in self.merge(text)]))

    def unknown(self, word: bytes) -> bytes:
        head = word.rstrip(self.MARKS)
        if len(head) == len(word):
            return self.letters(word) or self.whole(word)
        if not head:
            return self.whole(word)
        if not self.letter_end(head):
            return self.whole(word)
        ids = self.words.get(head) or self.letters(head)
        if ids is None:
            return self.whole(word)
        tail = word[len(head) :]
        return self.remember(word, ids + (self.words.get(tail) or self.whole(tail)))

    @staticmethod
    def letter_end(word: bytes) -> bool:
        """Marks after this word start a unit of their own: as the model sees it, in small letters, it ends in a letter or digit."""
        last = word[-1]
        return last in _ALNUM if last < 128 else word.decode()[-1].lower()[-1].isalpha()

    def __call__(self, text: bytes | None) -> bytes:
        text = text or b""
        if not self.by_word:
            return self.encode(text)
        if b"\xcc" not in text and b"\xcd" not in text:  # no combining marks: small letters first change nothing
            text = text.lower()
        words = text.split()
        get = self.words.get
        found = [get(w) for w in words]
        if None in found:
            found = [(get(w) or self.unknown(w)) if f is None else f for w, f in zip(words, found)]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32``."""
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in filter(len, batches):
            row, number, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = encode(t) + end
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    row.append(i)
                    number.append(k)
                    start.append(s)
                    length.append(min(capacity, n - s))
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + capacity)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


# --- the grouping genetic algorithm ------------------------------------------


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: by volume, and by pieces too large to share a bin."""
    sizes = np.sort(sizes)
    best = -(-int(sizes.sum()) // capacity)
    total = np.concatenate(([0], np.cumsum(sizes)))
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))  # sizes[half:] are over half
    for a in np.unique(sizes[:half])[:: max(1, half // 64)]:
        big = int(np.searchsorted(sizes, capacity - a, side="right"))  # sizes[big:] share with none of size a or more
        low = int(np.searchsorted(sizes, a))
        room = (big - half) * capacity - int(total[big] - total[half])
        rest = int(total[half] - total[low]) - room
        best = max(best, len(sizes) - half + max(0, -(-rest // capacity)))
    return max(best, len(sizes) - half)


class Packing:
    """A chromosome: whole bins, each a list of piece numbers, and their loads."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: list[list[int]], loads: list[int]) -> None:
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first; of as many, the ones filled less evenly."""
        return -len(self.bins), sum((x / capacity) ** 2 for x in self.loads)


def best_fit(items: list[int], sizes: list[int], capacity: int, into: Packing) -> Packing:
    """Put items, in their order, each into the bin that it fills best; a new bin if none has room."""
    bins, loads = into.bins, into.loads
    room = sorted(((capacity - x) << 32) | i for i, x in enumerate(loads))
    for item in items:
        size = sizes[item]
        at = bisect_left(room, size << 32)
        if at < len(room):
            key = room.pop(at)
            i = key & 0xFFFFFFFF
            bins[i].append(item)
            loads[i] += size
        else:
            i = len(bins)
            bins.append([item])
            loads.append(size)
        insort(room, ((capacity - loads[i]) << 32) | i)
    return into


def tight_fit(items: list[int], sizes: list[int], capacity: int, into: Packing, rng: random.Random) -> Packing:
    """Fill the bins with room, then new ones opened by the largest piece left.

    A bin takes the one or two pieces that leave the least room; while three
    more could go in and no two fill it, the largest that fits.
    """
    left = sorted(items, key=lambda i: (sizes[i], i))
    size = np.array([sizes[i] for i in left], np.int64)
    bins, loads = into.bins, into.loads

    def fill(b: int) -> None:
        nonlocal size
        while len(left) and size[0] <= (room := capacity - loads[b]):
            n = int(np.searchsorted(size, room, side="right"))
            fits = size[:n]
            with_ = np.minimum(np.searchsorted(fits, room - fits, side="right"), np.arange(n)) - 1
            total = fits + np.where(with_ >= 0, fits[with_], 0)
            most = int(total.max())
            if most < room and 3 * size[0] <= room:
                taken = [n - 1]
            else:
                ties = np.flatnonzero(total == most)
                i = int(ties[rng.randrange(len(ties))])
                taken = [i, int(with_[i])] if with_[i] >= 0 else [i]
            for i in taken:  # the larger place first
                bins[b].append(left.pop(i))
                loads[b] += int(size[i])
            size = np.delete(size, taken)

    if left:
        for b in sorted((i for i, x in enumerate(loads) if capacity - x >= size[0]), key=lambda i: -loads[i]):
            fill(b)
    while left:
        bins.append([left.pop()])
        loads.append(int(size[-1]))
        size = size[:-1]
        fill(len(bins) - 1)
    return into


def _place(items: list[int], sizes: list[int], capacity: int, into: Packing, rng: random.Random) -> Packing:
    """Either way of placing, by chance."""
    return tight_fit(items, sizes, capacity, into, rng) if rng.random() < 0.5 else best_fit(items, sizes, capacity, into)


def _largest_first(items: list[int], sizes: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-sizes[i], i))


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """``a`` with some of the best-filled bins of ``b`` injected whole."""
    full = sorted(range(len(b.bins)), key=lambda i: -b.loads[i])
    full = full[: max(1, int(len(full) * rng.uniform(0.2, 0.9)))]
    chosen = [i for i in full if rng.random() < 0.7] or full[:1]
    taken = {x for i in chosen for x in b.bins[i]}
    bins = [list(b.bins[i]) for i in chosen]
    loads = [b.loads[i] for i in chosen]
    displaced = []
    for group, load in zip(a.bins, a.loads):
        if taken.isdisjoint(group):
            bins.append(list(group))
            loads.append(load)
        else:
            displaced += [x for x in group if x not in taken]
    return _place(_largest_first(displaced, sizes), sizes, capacity, Packing(bins, loads), rng)


def mutate(p: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empty the worst-filled bins and a few others, and place their pieces anew."""
    order = sorted(range(len(p.bins)), key=lambda i: p.loads[i])
    few = 1 + int(len(order) * rng.uniform(0.0, 0.05))
    gone = {*order[:few], *rng.sample(order, min(len(order), few))}
    items = [x for i in gone for x in p.bins[i]]
    kept = [i for i in range(len(p.bins)) if i not in gone]
    items = sorted(items, key=lambda x: -sizes[x] * rng.uniform(0.8, 1.0))
    return _place(items, sizes, capacity, Packing([list(p.bins[i]) for i in kept], [p.loads[i] for i in kept]), rng)


def evolve(sizes: list[int], capacity: int, elites: list[Packing], seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> Packing:
    """The best packing, starting from ``elites`` and fresh ones.

    Goes on until it meets the lower bound or ``generations`` children in a row
    brought no better packing.
    """
    rng = random.Random(seed)
    items = list(range(len(sizes)))
    bound = lower_bound(np.array(sizes, np.int64), capacity) if sizes else 0
    people = list(elites) or [best_fit(_largest_first(items, sizes), sizes, capacity, Packing([], []))]
    key = lambda p: p.fitness(capacity)
    best = max(people, key=key)
    while len(best.bins) > bound and len(people) < population:
        if len(people) % 2:
            people.append(tight_fit(items, sizes, capacity, Packing([], []), rng))
        else:
            noisy = sorted(items, key=lambda x: -sizes[x] * rng.uniform(0.7, 1.0))
            people.append(best_fit(noisy, sizes, capacity, Packing([], [])))
        best = max(best, people[-1], key=key)
    marks = [key(p) for p in people]
    since = 0
    while len(best.bins) > bound and since < generations:
        a, b = rng.sample(people, 2) if len(people) > 1 else (best, best)
        if rng.random() < 0.5:
            a = best
        child = cross(a, b, sizes, capacity, rng) if a is not b else mutate(a, sizes, capacity, rng)
        if rng.random() < 0.3:
            child = mutate(child, sizes, capacity, rng)
        worst = min(range(len(people)), key=marks.__getitem__)
        people[worst], marks[worst] = child, key(child)
        since = 0 if marks[worst] > key(best) else since + 1
        best = max(best, child, key=key)
    return best


_ELITE = "shard long, island int, items array<long>, sizes array<long>, bins array<int>, n_bins int, filled double"


def _as_row(shard: int, island: int, items: np.ndarray, sizes: np.ndarray, p: Packing, capacity: int) -> pd.DataFrame:
    bins = np.zeros(len(items), np.int32)
    for i, group in enumerate(p.bins):
        bins[group] = i
    n, filled = p.fitness(capacity)
    return pd.DataFrame(
        {"shard": [shard], "island": [island], "items": [items], "sizes": [sizes], "bins": [bins], "n_bins": [-n], "filled": [filled]}
    )


def _as_packing(bins: np.ndarray, sizes: np.ndarray) -> Packing:
    out: list[list[int]] = [[] for _ in range(int(bins.max()) + 1 if len(bins) else 0)]
    for i, b in enumerate(bins.tolist()):
        out[b].append(i)
    return Packing(out, np.bincount(bins, weights=sizes, minlength=len(out)).astype(int).tolist())


def _solve(rows: DataFrame, shards: int, salt: int, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """(item, length) -> the best elite of each shard."""

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        sizes = pdf["length"].to_numpy(np.int64)
        best = evolve(sizes.tolist(), capacity, [], hash((shard, island, salt)), generations, population)
        return _as_row(shard, island, pdf["item"].to_numpy(np.int64), sizes, best, capacity)

    def go_on(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin")
        first = pdf.iloc[0]
        items, sizes = np.asarray(first["items"], np.int64), np.asarray(first["sizes"], np.int64)
        shard, island, epoch = int(first["shard"]), int(first["to"]), int(first["epoch"])
        elites = [_as_packing(np.asarray(b, np.int32), sizes) for b in pdf["bins"]]
        best = evolve(sizes.tolist(), capacity, elites, hash((shard, island, salt, epoch)), generations, population)
        return _as_row(shard, island, items, sizes, best, capacity)

    shard = F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(shards)).alias("shard")
    dealt = rows.select("item", "length", shard, F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
    elites = dealt.groupBy("shard", "island").applyInPandas(begin, _ELITE)
    for epoch in range(1, epochs if islands > 1 else 1):
        to = F.explode(F.array(F.col("island"), (F.col("island") + 1) % islands)).alias("to")
        moved = elites.select("shard", F.col("island").alias("origin"), to, "items", "sizes", "bins", F.lit(epoch).alias("epoch"))
        elites = moved.groupBy("shard", "to").applyInPandas(go_on, _ELITE)
    rank = F.struct((-F.col("n_bins")).alias("n"), "filled", "island")
    return elites.groupBy("shard").agg(F.max_by(F.struct("items", "sizes", "bins"), rank).alias("best"))


def _layout(best: DataFrame, capacity: int) -> DataFrame:
    """One row per piece of each shard's best packing, with its place and its bin's load and largest piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("best").to_pylist():
                items, sizes, bins = (np.array(b[k], np.int64) for k in ("items", "sizes", "bins"))
                order = np.lexsort((items, bins))
                items, sizes, bins = items[order], sizes[order], bins[order]
                first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
                of = np.cumsum(np.concatenate(([True], bins[1:] != bins[:-1]))) - 1
                ends = np.cumsum(sizes)
                before = ends - sizes
                offset = before - before[first][of]
                load = np.add.reduceat(sizes, first)[of]
                largest = np.maximum.reduceat(sizes, first)[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (items, sizes, items[first][of], offset, load, largest)],
                    names=["item", "length", "sequence_id", "offset", "load", "largest"],
                )

    return best.select("best").mapInArrow(run, "item long, length long, sequence_id long, offset long, load long, largest long")


def pack(
    rows: DataFrame,
    capacity: int = CAPACITY,
    shard: int = SHARD,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    rounds: int = ROUNDS,
    release: float = RELEASE,
    generations: int = GENERATIONS,
    population: int = POPULATION,
) -> DataFrame:
    """``rows(item, length)``, items distinct, lengths 1 to ``capacity`` -> ``item, sequence_id, offset``."""
    ship(rows.sparkSession)
    place = ["item", "sequence_id", "offset"]
    done = [rows.where(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = rows.where(F.col("length") < capacity).select("item", "length")
    for r in range(rounds):
        over_half = F.col("length") > capacity // 2
        n, volume, large = rest.agg(F.count("*"), F.sum("length"), F.count_if(over_half)).first()
        if not n:
            break
        shards = max(1, -(-n // shard))
        laid, _ = stage(_layout(_solve(rest, shards, r, capacity, islands, epochs, generations, population), capacity), f"packed-{r}")
        if shards == 1 or r == rounds - 1:
            done.append(laid.select(place))
            break
        full = F.col("load") >= release * capacity
        if large * capacity >= volume:
            full &= F.col("largest") > capacity // 2
        done.append(laid.where(full).select(place))
        rest = laid.where(~full).select("item", "length")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    found = pieces(docs, tokenizer, id, text, how.get("capacity", CAPACITY))
    rows, _ = stage(found.withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = pack(rows.select("item", "length"), **how)
    out = rows.join(placed, "item").withColumnRenamed("id", id)
    return out.select(id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 4096 tokens, a row per piece; see ``pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe())
