"""The CRF: forward-backward by brute force, held-out accuracy, switched text."""

import itertools
import os
import subprocess
import sys
import zlib

import numpy as np

from lodging.llm import language as L
from lodging.llm.common import table

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_the_sum_over_all_labellings():
    r = np.random.default_rng(1)
    k = 3
    steps, start = r.random((k, k)) + 0.1, r.random(k) + 0.1
    lengths = [4, 1, 6, 4, 2]
    tables = [r.random((n, k)) + 0.01 for n in lengths]
    flat = np.concatenate(tables)
    at = np.concatenate(([0], np.cumsum(lengths)))
    packed = L.Packed([np.arange(at[i], at[i + 1]) for i in range(len(lengths))])
    found, expected = L.forward_backward(flat[packed.values], packed, steps, start)
    want, steps_want = np.zeros_like(flat), np.zeros((k, k))
    for i, e in enumerate(tables):
        total, own, own_steps = 0.0, np.zeros_like(e), np.zeros((k, k))
        for y in itertools.product(range(k), repeat=len(e)):
            p = start[y[0]] * np.prod([e[t, y[t]] for t in range(len(e))]) * np.prod([steps[a, b] for a, b in zip(y, y[1:])])
            total += p
            for t, a in enumerate(y):
                own[t, a] += p
            for a, b in zip(y, y[1:]):
                own_steps[a, b] += p
        want[at[i] : at[i + 1]] = own / total
        steps_want += own_steps / total
    got = np.empty_like(flat)
    got[packed.values] = found
    assert np.allclose(got, want) and np.allclose(expected, steps_want)


def test_held_out_accuracy_and_contract_columns(spark):
    rows = {r.doc_id: r for r in L.op7_language(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [d for d in docs if rows[d.doc_id].held_out]
    right = sum(rows[d.doc_id].lang_pred == d.lang for d in held)
    assert right / len(held) >= 0.95


def test_switched_text_and_odd_rows(spark, tmp_path):
    docs = table(spark, SF, "documents")
    model = L.fit(docs.select("doc_id", "text", "lang"))
    tagger = L.Tagger(model)
    by = {}
    for d in docs.where("n_chars between 300 and 600").orderBy("doc_id").collect():
        by.setdefault(d.lang, d.text)
    for a, b in (("en", "de"), ("fr", "es"), ("de", "fr")):
        x, y = " ".join(by[a].split()[:25]), " ".join(by[b].split()[:25])
        n = len(L.words_of(x))
        tags = [t for _, t, _ in tagger.tag(x + " " + y)]
        right = sum(t == a for t in tags[:n]) + sum(t == b for t in tags[n:])
        assert right / len(tags) >= 0.9
    odd = [(1, None), (2, ""), (3, "123 ... !!"), (4, "the"), (5, "² ½"), (None, by["de"]), (6, by["en"] * 300), (6, by["en"] * 300)]
    df = spark.createDataFrame([(*r, None, 1.0) for r in odd], "doc_id long, text string, lang string, score double")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op7_language(spark, str(tmp_path)).collect()  # nothing to learn from
    assert len(got) == len(odd) and all((r.lang_pred, r.score) == ("und", 0.0) for r in got)
    found = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(df.select("doc_id", "text"), model).collect()}
    assert found[1] == found[2] == found[3] == found[5] == ("und", 0.0)
    assert found[None][0] == "de" and found[6][0] == "en" and found[6][1] > 0.95
    assert L.predict(df.select("doc_id", "text").limit(0), model).count() == 0


def test_one_language_only():
    model = L.fit_sequences([["a", "b"], ["c"]], [np.zeros(2, int), np.zeros(1, int)], ("xx",), (frozenset(),), rounds=2)
    assert L.Tagger(model)(["a z", None]) == (["xx", "und"], [1.0, 0.0])


def test_no_feature_is_dropped_with_sixty_languages():
    labels = tuple(f"l{i:02d}" for i in range(60))
    word = "abcdefghijklmnop"
    hashed = L.word_features(word, ())
    lexicons = tuple(frozenset({word}) for _ in labels)
    assert len(hashed) == 38 and L.word_features(word, lexicons) == hashed + [L.BUCKETS + i for i in range(60)]
    flat, counts = L.feature_rows([word, "a"], lexicons)
    assert counts.tolist() == [98, 3] and flat[:98].tolist() == L.word_features(word, lexicons)
    r = np.random.default_rng(2)
    weights = r.random((L.BUCKETS + 60, 60))
    want = [weights[L.word_features(w, lexicons)].sum(axis=0) for w in (word, "a")]
    assert np.allclose(L.feature_sums(weights, flat, counts), want)
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    own = [["".join(r.choice(letters, 3)) for _ in range(3)] for _ in labels]  # the syllables of each language
    said = lambda i: ["".join(r.choice(own[i], 4)) for _ in range(8)]
    sequences = [said(i) for i in range(60) for _ in range(4)]
    tags = [np.full(8, i) for i in range(60) for _ in range(4)]
    tagger = L.Tagger(L.fit_sequences(sequences, tags, labels, tuple(frozenset() for _ in labels), rounds=20))
    names, _ = tagger([" ".join(said(i)) for i in range(60)])
    assert sum(a == b for a, b in zip(names, labels)) >= 57


def test_features_do_not_hang_on_the_hash_seed():
    run = lambda seed: subprocess.run(
        [sys.executable, "-c", "from lodging.llm.language import word_features as f; print(f('abcdefghijklmnopqrst', (frozenset(),) * 30))"],
        env={**os.environ, "PYTHONHASHSEED": seed}, cwd=os.path.dirname(L.__file__) + "/../..", capture_output=True, text=True, check=True,
    ).stdout
    assert run("1") == run("2")


def test_every_letter_of_long_runs_counts():
    thai, han = "กขคงจฉชซ", "漢字文章長短語言"
    assert L.words_of("ABC def") == ["abc", "def"] and L.words_of("a" * 24) == ["a" * 24]
    for run in ("abcdefghijklmnopqrstuvwxy" * 40, thai * 30, han * 30, "ab" + thai * 5 + "cd" + han * 5):
        words = L.words_of(run)
        assert "".join(words) == run and max(map(len, words)) <= 24
        assert all(len(w) <= 8 for w in words if w[0] in thai + han)
    a, b = L.words_of("donaudampfschifffahrtsgesellschaftskapitänen")
    assert a + b == "donaudampfschifffahrtsgesellschaftskapitänen" and len(b) > 16
    word = "abcdefghijklmnopqrstuvwx"
    found = set(L.word_features(word, ()))
    assert {L.zlib.crc32(f.encode()) % L.BUCKETS for f in ("uvwx$", "wx", "vwx")} <= found
    assert len(L.word_features("abcdefghijklmnopqrstuvwx", ())) == 54
    r = np.random.default_rng(3)
    said = {"x": "漢字文章長短", "y": "語言学校先生"}
    run = lambda k, n: "".join(r.choice(list(said[k]), n))
    sequences = [L.words_of(run(k, 80)) for k in "xy" for _ in range(20)]
    tags = [np.full(len(s), i // 20) for i, s in enumerate(sequences)]
    tagger = L.Tagger(L.fit_sequences(sequences, tags, ("x", "y"), (frozenset(), frozenset()), rounds=30))
    assert tagger([run("x", 40) + run("y", 200)])[0] == ["y"]
    switched = [t for _, t, _ in tagger.tag(run("x", 80) + run("y", 80))]
    assert switched == ["x"] * 10 + ["y"] * 10


def test_fitting_reads_whole_texts_and_bounds_rows_and_labels(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(L, "fit_sequences", lambda sequences, tags, labels, lexicons: seen.update(s=sequences, t=tags, l=labels, x=lexicons) or L.Model(()))
    texts = {0: " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(700)), 1: "one two three", 2: "un deux"}
    rows = [(i, t, ("de", "en", "fr")[i]) for i, t in texts.items()] + [(9, "rest", None), (None, "kein", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS words", "2 AS `a.b`")
    L.fit(df)
    assert seen["l"] == ("de", "en", "fr")
    alone = [(int(t[0]), w) for s, t in zip(seen["s"], seen["t"]) if len(set(t)) == 1 for w in s]
    for i, t in texts.items():
        assert [w for tag, w in alone if tag == i][: len(L.words_of(t))] == L.words_of(t)  # to the last word
    assert max(map(len, seen["s"])) <= 2 * L.LENGTH
    many = spark.range(3000).selectExpr("id AS doc_id", "'some words' AS text", "CASE WHEN id < 100 THEN 'xx' ELSE concat('l', id) END AS lang")
    L.fit(many, max_rows=30, max_labels=5)
    assert len(seen["l"]) == 5 and "xx" in seen["l"] and 5 < len(seen["s"]) < 100
