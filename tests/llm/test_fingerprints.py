"""Weighted-sampling fingerprints against a plain restatement, and their collision rate."""

import hashlib
import math
import random
import re
from collections import Counter

import xxhash

from lodging.llm import fingerprints as P
from lodging.llm.common import table

SF = "/root/testdata/sf0.001"


def _h(value, size, seed=42):
    return xxhash.xxh64_intdigest((value % (1 << 8 * size)).to_bytes(size, "little"), seed=seed % (1 << 64))


def brute(text, samples=P.SAMPLES):
    words = Counter(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    if not words:
        return "-" * 4 * samples
    out = []
    unit = lambda bits, width: (bits + 0.5) * 2.0**-width
    for i in range(samples):
        best = None
        for w, n in words.items():
            h = _h(i, 4, _h(xxhash.xxh64_intdigest(w.encode(), seed=42), 8))
            g = _h(h, 8)
            b = unit(h >> 43, 21)
            r = -math.log(unit(h >> 22 & 0x1FFFFF, 21) * unit(h >> 1 & 0x1FFFFF, 21))
            c = -math.log(unit(g >> 32, 32) * unit(g & 0xFFFFFFFF, 32))
            t = math.floor(math.log(n) / r + b)
            a = c * math.exp(r * (b - 1.0 - t))
            name = (g ^ t * 40503) & 0xFFFF
            best = min(best or (a, name), (a, name))
        out.append(f"{best[1]:04x}")
    return "".join(out)


def expected(rows):
    """[(id, text)] -> sorted rows of the contract's columns."""
    key = lambda i: -(1 << 63) if i is None else i
    signed = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), seed=42))
    stands = {}
    for i, t in rows:
        t = t or ""
        stands[key(i)] = min(stands.get(key(i), (signed(t), t)), (signed(t), t))
    order = sorted(stands, reverse=True)
    follows = {k: order[(n + 1) % len(order)] for n, k in enumerate(order)}
    near = lambda a, b: sum(a[4 * i : 4 * i + 4] == b[4 * i : 4 * i + 4] for i in range(P.SAMPLES)) / P.SAMPLES
    out = []
    for i, t in rows:
        t = t or ""
        other = stands[follows[key(i)]][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        f, e, o = brute(t), brute(edited), brute(other)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, near(f, e), near(f, o)))
    return sorted(out, key=str)


ODD = [
    (5, "one two three two"), (-7, "é ü 漢字 🎉 one"), (100, None), (101, ""), (1 << 40, " \t\n"), ((1 << 40) + 1, "x"), (None, "nulls id one two"),
    (3, "one two three two"), (3, "another text of the same id"), (3, "one two three two"), (8000, "w " * 3000 + "end"), (4096, "a\x0bb\x0cc\rd"), (4095, "z" * 5000),
]


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)


def test_odd_rows_equal_the_restatement(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 1, "y") for r in ODD], "doc_id long, text string, hash int, copies string")
    assert result(P.fingerprint_documents(docs)) == expected(ODD)
    assert P.fingerprint_documents(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")
    assert result(P.fingerprint_documents(one)) == expected([(4, "a b c d")])


def test_any_number_of_samples(spark):
    """A block may be cut or left partly unused; more samples only add digits."""
    rows = [(1, "one two three two"), (2, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 5, P.BLOCK, P.BLOCK + 3):
        got = {r.doc_id: r.fingerprint for r in P.fingerprint_documents(docs, samples=n).collect()}
        assert got == {i: brute(t)[: 4 * n] for i, t in rows}


def test_next_lower_over_gaps(spark):
    r = random.Random(2)
    ids = {r.randrange(-(1 << b), 1 << b) for b in (3, 8, 14, 30, 45, 62) for _ in range(150)}
    got = {x.id: x.lower for x in P.next_lower(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    order = sorted(ids)
    assert got == {i: (order[n - 1] if n else None) for n, i in enumerate(order)}


def test_collision_rate_is_generalised_jaccard(spark):
    a, b = Counter(), Counter()
    r = random.Random(8)
    for i in range(60):
        a[f"w{i}"] = r.randrange(1, 9)
        b[f"w{i + 15}"] = r.randrange(1, 9)
        b[f"w{i}"] = max(b[f"w{i}"], a[f"w{i}"] if i % 2 else 0)
    true = sum((a & b).values()) / sum((a | b).values())
    text = lambda c: " ".join(c.elements())
    total = n = 0
    for round_ in range(12):  # other words, same weights: independent samples
        rows = [(i, re.sub(r"w", f"r{round_}w", text(c))) for i, c in enumerate((a, b))]
        f = {x.k: x.fingerprint for x in P.signatures(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}
        total += sum(f[0][4 * i : 4 * i + 4] == f[1][4 * i : 4 * i + 4] for i in range(P.SAMPLES))
        n += P.SAMPLES
    assert abs(total / n - true) < 4 * math.sqrt(true * (1 - true) / n)


def test_op3_whole_table(spark):
    docs = [(d.doc_id, d.text) for d in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = result(P.op3_fingerprints(spark, SF))
    assert [g[:3] for g in got] == [w[:3] for w in expected_digests(docs)]
    by = {g[0]: g for g in got}
    for d, t in docs[::25]:
        assert by[d][3] == brute(t)
    texts = {}
    for d, t in docs:
        assert texts.setdefault(t, by[d][3]) == by[d][3]


def expected_digests(rows):
    order = sorted(rows, reverse=True)
    out = []
    for n, (i, t) in enumerate(order):
        half = len(t) // 2
        other = order[(n + 1) % len(order)][1]
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + other[:half]).encode()).hexdigest()))
    return sorted(out, key=str)
