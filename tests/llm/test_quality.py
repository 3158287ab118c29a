"""The PU quality classifier: held-out accuracy, its prior, odd rows."""

import gc
import glob
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodging.llm import quality as Q
from lodging.llm.common import discard, stage, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract_columns(spark):
    rows = {r.doc_id: r for r in Q.op2_quality(spark, SF).collect()}
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    labels = [r for r in table(spark, SF, "labels").collect() if rows[r.doc_id].held_out]
    right = sum(rows[r.doc_id].predicted == r.quality for r in labels)
    assert right / len(labels) >= 0.95
    good = [r for r in labels if r.quality == 1]
    assert sum(rows[r.doc_id].predicted for r in good) / len(good) >= 0.98


def test_prior_and_risk_on_known_data():
    r = np.random.default_rng(3)
    for prior in (0.5, 0.8):
        pos = r.normal(1.5, 1, (4000, 3))
        unl = np.concatenate([r.normal(1.5, 1, (int(6000 * prior), 3)), r.normal(-1.5, 1, (6000 - int(6000 * prior), 3))])
        got = Q.estimate_prior(pos, unl)
        assert abs(got - prior) < 0.08
        w = Q.fit_nnpu(pos, unl, got)
        ok = unl @ w[:-1] + w[-1] > 0
        n = int(6000 * prior)
        assert ok[:n].mean() > 0.93 and ok[n:].mean() < 0.07


def test_nothing_to_learn_from_gives_one_half_and_no_word_gives_zero():
    blank = Q.fit_rows(np.zeros((0, Q.N_FEATURES)), np.ones((5, Q.N_FEATURES)))
    assert blank.score(np.vstack([np.ones((2, Q.N_FEATURES)), np.zeros((1, Q.N_FEATURES))])).tolist() == [0.5, 0.5, 0.0]
    r = np.random.default_rng(1)
    fitted = Q.fit_rows(r.random((50, Q.N_FEATURES)), r.random((80, Q.N_FEATURES)))
    assert fitted.score(np.array([Q.features(t) for t in (None, b"", b" \n\t ")])).tolist() == [0.0, 0.0, 0.0]


def sample(spark, sf):
    """(features, quality or -1, held out) of all documents."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "text", "quality").collect()
    x = np.array([Q.features((r.text or "").encode()) for r in docs])
    marks = np.array([-1 if r.quality is None else r.quality for r in docs])
    return x, marks, np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs])


def test_content_features_alone_classify_and_scores_are_stable(spark):
    """Held-out accuracy without the shape features; decisions on perturbed samples."""
    x, marks, held = sample(spark, SF)
    content = x[:, Q.N_SHAPE :]
    told = Q.fit_rows(content[(marks == 1) & ~held], content[~held]).score(content) >= Q.CUT
    seen = held & (marks >= 0)
    assert (told == (marks == 1))[seen].mean() >= 0.9
    before = Q.fit_rows(x[(marks == 1) & ~held], x[~held]).score(x)
    for seed in range(3):
        some = np.random.default_rng(seed).random(len(x)) < 0.8
        after = Q.fit_rows(x[(marks == 1) & ~held & some], x[~held & some]).score(x)
        assert ((before >= Q.CUT) != (after >= Q.CUT)).mean() <= 0.02 and abs(before - after).mean() <= 0.05


def test_odd_rows_leave_other_decisions_unchanged(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", None, 0), (None, "Some words of no id at all.", None, "s", 27), (2, "", "en", None, 0), (3, "token = abcdefgh1", "en", "s", 17)],
        docs.schema,
    )
    more = docs.unionByName(odd.withColumn("doc_id", odd["doc_id"] + 10_000_000))
    before = {r.doc_id for r in Q.good_rows(docs, labels).select("doc_id").collect()}
    after = {r.doc_id for r in Q.good_rows(more, labels).select("doc_id").collect()}
    assert {i for i in after if i is not None and i < 10_000_000} == before
    assert not after & {10_000_001, 10_000_002}  # no word: score 0


def test_the_sample_is_bounded_and_zero_marks_are_never_read(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    labels = table(spark, SF, "labels")
    all_marks = Q.fit(docs, labels, max_positive=100, max_unlabelled=200)
    positives = Q.fit(docs, labels.where("quality = 1"), max_positive=100, max_unlabelled=200)
    assert np.array_equal(all_marks.weights, positives.weights) and all_marks.prior == positives.prior


def test_odd_rows_and_kept_rows(spark, tmp_path):
    base = table(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(
        [(-1, None, "x"), (-2, "", None), (None, "plain words here", None), (-3, "a " * 60_000, "en"), (-3, "a " * 60_000, "en")],
        "doc_id long, text string, lang string",
    )
    docs = base.unionByName(odd).withColumn("score", base["doc_id"] * 0)
    labels = table(spark, SF, "labels").unionByName(
        spark.createDataFrame([(None, 1, 0), (-1, None, None), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    )
    kept = Q.good_rows(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = -3").count() == 0
    assert kept.where("doc_id IN (-1, -2)").count() == 0
    truth = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(q == 1 and i not in left for i, q in truth.items()) <= 2
    assert sum(q == 0 and i in left for i, q in truth.items()) <= 2
    assert Q.good_rows(docs.limit(0), labels).count() == 0
    empty = docs.select("doc_id", "text").limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert Q.op2_quality(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text", [None, b"", b"\xc3\xa9" * 10, b"x" * 300_000])
def test_features_are_finite(text):
    f = Q.features(text)
    assert f.shape == (Q.N_FEATURES,) and np.isfinite(f).all() and (f >= 0).all() and (f <= 1).all()


def test_the_driver_holds_the_sample_twice_at_most(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', sha1(string(id)), 'word', id, sha1(string(id + 1))) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS quality")
    x = np.array([Q.features(r.text.encode()) for r in docs.orderBy("doc_id").collect()])
    Q.fit(docs, labels)  # code is shipped, modules are loaded
    peaks = []
    for run in (lambda: Q.fit(docs, labels), lambda: Q.fit_rows(x[::3], x)):
        gc.collect()
        tracemalloc.start()
        fitted = run()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert fitted.weights is not None
    sample = x.nbytes * 4 / 3  # every row is in the web sample, every third one is trusted too
    assert max(peaks) < 2.3 * sample, [p / sample for p in peaks]


def test_the_sample_reaches_the_fit_in_the_order_of_its_bytes(spark):
    """Features from several Arrow chunks, ascending by their bytes, and the caller's arrays as they were."""
    r = np.random.default_rng(5)
    x = r.random((90, Q.N_FEATURES)).astype(np.float32)
    x[::4, :3] = 0
    rows = [zlib.compress(v.tobytes()) for v in x]
    chunks = pa.chunked_array([pa.array(rows[:40], pa.binary())[7:], pa.array([], pa.binary()), pa.array(rows[40:], pa.binary())])
    assert np.array_equal(Q._matrix(chunks), x[7:])
    assert Q._matrix(pa.chunked_array([], pa.binary())).shape == (0, Q.N_FEATURES)
    before = x.copy()
    Q.fit_rows(x[::3], x)
    assert np.array_equal(x, before)

    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', sha1(string(id))) AS text").repartition(5)
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS quality")
    told = sorted((Q.features(d.text.encode()).tobytes(), d.doc_id % 3 == 0) for d in docs.collect())
    sample = np.frombuffer(b"".join(t for t, _ in told), np.float32).reshape(-1, Q.N_FEATURES)
    want = Q.fit_rows(sample[[p for _, p in told]], sample)
    got = Q.fit(docs, labels)
    assert np.array_equal(got.weights, want.weights) and got.prior == want.prior


def test_scratch_tables_have_no_marker_file(spark):
    out, path = stage(spark.range(10), "marker")
    assert out.count() == 10 and glob.glob(f"{path}/part-*") and not glob.glob(f"{path}/_SUCCESS")
    discard(spark, path)
