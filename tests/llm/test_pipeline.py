"""The pipeline, stage by stage against brute force on each stage's own input."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from lodging.llm import packing as K
from lodging.llm import secrets as S
from lodging.llm.common import table
from test_packing import check_layout, check_pieces
from test_passages import brute as brute_passages
from test_secrets import brute_base
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, rows(docs)
    outs = {}
    for name, step in C.STAGES:
        step(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outs[name] = docs
    for name in list(outs)[:-1]:
        assert outs[name].columns == columns

    marks = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    good = rows(outs["quality"])
    assert set(good) <= set(before)
    kept = {r[0] for r in good}
    assert all(i in kept for i, q in marks.items() if q)  # 36 positives teach little about junk, but good texts stay
    assert sum(i in kept for i, q in marks.items() if not q) <= 5

    ids, texts = [r[0] for r in good], {r[0]: r[1] for r in good}
    groups = brute_components(ids, [brute_fingerprint(t) for t in texts.values()])
    alone = rows(outs["near_duplicates"])
    assert alone == sorted((r for r in good if r[0] in set(groups)), key=str)

    cut = brute_passages([(r[0], r[1]) for r in alone])
    want = {r[0]: (r[1] if cut[r[0], r[1]][0] == len(cut[r[0], r[1]][1]) else " ".join(cut[r[0], r[1]][1])) for r in alone}
    passages = {r[0]: (r[1], r[4]) for r in rows(outs["passages"])}
    assert passages == {i: (t, len(t)) for i, t in want.items()}

    clean = {r[0]: r[1] for r in rows(outs["secrets"])}
    assert clean.keys() == want.keys() and not any(brute_base(t) for t in clean.values())
    assert all(clean[i] == t for i, t in want.items() if not S.Scanner()(t))

    packed = outs["packing"].collect()
    check_pieces(packed, clean, Tokenizer.from_file(K.word_bpe()))
    assert check_layout(packed) == K.lower_bound(np.array([r.length for r in packed]), 4096)


def test_run_equals_its_stages_and_odd_rows_pass(spark, tmp_path):
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", None, 0), (None, "Some words of no id at all.", None, "s", 27), (2, "", "en", None, 0), (3, "token = abcdefgh1", "en", "s", 17)],
        table(spark, SF, "documents").schema,
    )
    table(spark, SF, "documents").unionByName(odd.withColumn("doc_id", odd["doc_id"] + 10_000_000)).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    got = C.run(spark, str(tmp_path)).collect()
    check_layout(got)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in C.STAGES:
        empty = step(spark, docs.limit(0), SF)
        assert empty.count() == 0
    # A text without a word scores 0, so the first stage drops it; the others follow their scores.
    kept = {r.doc_id for r in C.keep_good(spark, docs, SF).collect()}
    assert not kept & {10_000_001, 10_000_002}
    assert {r.doc_id for r in got} <= kept
    # The later stages take such rows: a NULL and an empty text are one group, and one of them stays to the end.
    late = odd.withColumn("doc_id", odd["doc_id"] + 10_000_000).unionByName(docs.limit(20))
    for name, step in C.STAGES[1:]:
        late = step(spark, late, SF)
    ids = [r.doc_id for r in late.collect()]
    assert 10_000_001 in ids and 10_000_002 not in ids and 10_000_003 in ids and None in ids
