"""Packing: ids against the tokenizer itself, layouts checked piece by piece, the genetic steps."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lodging.llm import packing as K
from lodging.llm.common import table

SF = "/root/testdata/sf0.001"

ODD = [
    None, "", "  \n", "Hello, World!! it's 12 o'clock.", "é É̱ H̱ ÀÉÎ", "ΣΑΣ σας ΌΣΟΣ.", "İstanbul ıI", "naïve,naïve;naïve:",
    "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>y", "don't DON'T we're 'sup 's", "漢字かな 🎉🎉! ½ ² ªº ǅ ŉ", "... ,,, a... b,c", "ͅx ﬁ ﬀ",
    "z" * 30_000, "word " * 9000, "x1y2z3 " * 100, "ẛ̣ Å K",
]


def expected(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check_pieces(rows, texts, tokenizer, capacity=4096):
    """rows by (doc, row) against plain tokenization."""
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for d, text in texts.items():
        ids = expected(text, tokenizer)
        want = [(k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[d]) == want, (d, (text or "")[:80])


def check_layout(rows, capacity=4096):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_ids_and_layout_of_odd_texts(spark):
    tokenizer = Tokenizer.from_file(K.word_bpe())
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)], "doc_id long, text string, length int")
    rows = K.pack_documents(docs, K.word_bpe()).collect()
    check_pieces(rows, dict(enumerate(ODD)), tokenizer)
    check_layout(rows)
    assert K.pack_documents(docs.limit(0), K.word_bpe()).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "c")], "doc_id long, text string")
    rows = K.pack_documents(twice, K.word_bpe()).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["5", "None", "None"] and check_layout(rows) == 1


def test_op6_whole_table(spark):
    tokenizer = Tokenizer.from_file(K.word_bpe())
    docs = {d.doc_id: d.text for d in table(spark, SF, "documents").select("doc_id", "text").collect()}
    rows = K.op6_packing(spark, SF).collect()
    check_pieces(rows, docs, tokenizer)
    n = check_layout(rows)
    assert n == K.lower_bound(np.array([r.length for r in rows]), 4096)


def greedy(sizes, capacity):
    return K.best_fit(K._largest_first(range(len(sizes)), sizes), sizes, capacity, K.Packing([], []))


def valid(p, sizes, capacity):
    assert sorted(x for b in p.bins for x in b) == list(range(len(sizes)))
    assert [sum(sizes[x] for x in b) for b in p.bins] == p.loads and max(p.loads) <= capacity


def test_genetic_steps_keep_every_piece_and_beat_greedy_packing():
    rng = random.Random(1)
    sizes = []
    for _ in range(40):  # triples that fill a bin exactly: hard for best fit
        a = rng.randrange(260, 480)
        b = rng.randrange(260, 480)
        sizes += [a, b, 1000 - a - b]
    start = greedy(sizes, 1000)
    other = K.best_fit(rng.sample(range(len(sizes)), len(sizes)), sizes, 1000, K.Packing([], []))
    for p in (start, other, K.cross(start, other, sizes, 1000, rng), K.mutate(start, sizes, 1000, rng)):
        valid(p, sizes, 1000)
    best = K.evolve(sizes, 1000, [], seed=2, generations=1500, population=12)
    valid(best, sizes, 1000)
    assert K.lower_bound(np.array(sizes), 1000) == 40 <= len(best.bins) < len(start.bins)


def test_lower_bound_never_exceeds_the_best_packing():
    rng = random.Random(5)
    for _ in range(200):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 9))]
        best = min(len(K.best_fit(order, sizes, 100, K.Packing([], [])).bins) for order in (rng.sample(range(len(sizes)), len(sizes)) for _ in range(300)))
        assert K.lower_bound(np.array(sizes), 100) <= best


def test_shards_rounds_and_islands(spark):
    r = np.random.default_rng(4)
    sizes = np.concatenate([r.integers(1, 4096, 1500), r.integers(2100, 2500, 300), np.full(400, 700), np.full(20, 4096)])
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "item long, length long")
    placed = df.join(K.pack(df, shard=150), "item").collect()
    assert len(placed) == len(sizes)
    n = check_layout(placed)
    best = len(greedy([int(s) for s in sizes], 4096).bins)
    assert K.lower_bound(sizes, 4096) <= n <= best * 1.005 + 1
    assert K.pack(df.limit(0)).count() == 0


def test_tight_fit_keeps_every_piece():
    rng = random.Random(6)
    for _ in range(100):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 40))]
        some = rng.sample(range(len(sizes)), len(sizes) // 2)
        start = K.best_fit(some, sizes, 100, K.Packing([], []))
        p = K.tight_fit([i for i in range(len(sizes)) if i not in some], sizes, 100, start, rng)
        if sizes:
            valid(p, sizes, 100)


def test_pack_as_queries_call_it_beats_best_fit_on_a_shard_of_triples(spark):
    r = random.Random(1)
    sizes = []
    for _ in range(K.SHARD // 3):
        a, b = r.randrange(1065, 1966), r.randrange(1065, 1966)
        sizes += [a, b, 4096 - a - b]
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    placed = df.join(K.pack(df), "item").collect()
    assert len(placed) == len(sizes)
    n, best, bound = check_layout(placed), len(greedy(sizes, 4096).bins), K.lower_bound(np.array(sizes), 4096)
    print(f"triples: {n} sequences, best fit {best}, lower bound {bound}")
    assert bound <= n and (n - bound) * 3 <= best - bound


def test_packings_survive_migration():
    sizes = np.array([5, 6, 7, 8, 2, 3, 10])
    p = greedy(sizes.tolist(), 10)
    row = K._as_row(3, 1, np.arange(7), sizes, p, 10).iloc[0]
    q = K._as_packing(row["bins"], row["sizes"])
    assert [sorted(b) for b in q.bins] == [sorted(b) for b in p.bins] and q.loads == p.loads
    assert K._as_packing(np.zeros(0, np.int32), np.zeros(0, np.int64)).bins == []


def test_ids_never_depend_on_what_was_seen_before():
    """Letters whose small form is several characters, and many others, before marks: fresh and warm memories alike."""
    tokenizer = Tokenizer.from_file(K.word_bpe())
    several = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and len(chr(i).lower()) > 1]
    assert "\u0130" in several
    rng = random.Random(5)
    letters = several * 30 + [chr(i) for i in range(0x41, 0x250) if chr(i).isalpha()] + list("\u03a3\u0391\u0300\u0307'1-_\u00b5\u1e9e\ufb01\u212b\u0149")
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    marked = [w + "".join(rng.choice(".,!?;:") for _ in range(rng.randint(0, 3))) for w in words for _ in range(2)]
    texts = ["BELED\u0130YES\u0130, TAKS\u0130.", *(" ".join(rng.sample(marked, 4)) for _ in range(1500))]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    warm = K.Encoder(K.word_bpe())
    for t in ["BELED\u0130YES\u0130 TAKS\u0130", *words, *marked]:
        warm(t.encode())
    assert [warm(t.encode()) for t in texts] == want
    assert len(np.frombuffer(want[0], "<u4")) == 14
    for t, ids in list(zip(texts, want))[:60]:
        fresh = K.Encoder.__new__(K.Encoder)
        fresh.__dict__.update({**warm.__dict__, "words": {}})
        assert fresh(t.encode()) == ids


def test_another_tokenizer_file_gives_its_own_ids():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    encode = K.Encoder(path)
    assert not encode.by_word and K.Encoder(K.word_bpe()).by_word
    for t in filter(None, ODD):
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
