import random
import re
from collections import Counter

import numpy as np

from factloom.llm.langid import DIM, Encoder, predict, train
from factloom.llm.queries import QUERIES


def test_bundle_is_the_sum_of_bound_vectors():
    e = Encoder()
    got = e.bundle("Ab,  c")
    seq = [32, ord("a"), ord("b"), 32, ord("c"), 32]
    want = sum(np.roll(e.vector(x), 2) * np.roll(e.vector(y), 1) * e.vector(z) for x, y, z in zip(seq, seq[1:], seq[2:]))
    assert np.array_equal(got, want) and len(got) == DIM


def test_many_ngrams_at_once():
    rng = random.Random(1)
    e = Encoder()
    text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60_000))
    whole = e.bundle(text)
    assert np.isfinite(whole).all()
    assert np.array_equal(whole, Encoder().bundle(text))


def test_edge_rows(spark):
    rows = [(1, "hello there world", "en"), (2, "der die das und", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "de"), (6, "hello there world", "en"), (7, "hello", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in predict(df, train(df)).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert got[1].score == got[6].score and 0 <= got[7].score <= 1 and got[3].score == 0 and got[1].lang == "en"
    none = train(df.where("false"))
    assert {r.lang_pred for r in predict(df, none).collect()} == {"und"}
    assert predict(df.where("false"), train(df)).count() == 0


def test_prototypes_and_predictions_equal_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(10**6, None, "en"), (10**6 + 1, "...", "de"), (10**6 + 2, "x" * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    e, sums = Encoder(), {}

    def bundle(text):
        """Letters by Unicode, runs of all else one space, and each trigram's vectors rolled and multiplied."""
        letters = re.sub(r"[^\w]|[\d_]", " ", (text or "").lower())
        points = [ord(c) for c in " " + " ".join("".join(c if c.isalpha() else " " for c in letters).split()) + " "]
        counts = Counter(zip(points, points[1:], points[2:])) if len(points) > 2 else {}
        return sum(n * np.roll(e.vector(a), 2).astype(int) * np.roll(e.vector(b), 1) * e.vector(c) for (a, b, c), n in counts.items())

    bundles = {i: bundle(t) for i, t, _ in rows}
    for i, _, lang in rows:
        if lang and np.any(bundles[i]):
            sums[lang] = sums.get(lang, 0) + bundles[i] / np.linalg.norm(bundles[i])
    want = {lang: v / np.linalg.norm(v) for lang, v in sums.items()}
    got = train(df)
    assert set(got) == set(want) and all(np.abs(got[k] - want[k]).max() < 1e-5 for k in want)
    for r in predict(df, got).collect():
        v = bundles[r.doc_id]
        cosines = {k: float(v @ w / np.linalg.norm(v)) for k, w in want.items()} if np.any(v) else {}
        best = max(cosines.values(), default=0.0)
        assert abs(r.score - max(0.0, best)) < 1e-4
        assert r.lang_pred == "und" if not cosines else cosines[r.lang_pred] >= best - 1e-5


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "hello there", "en", "old", 5.0, 1, 2)], "doc_id long, text string, lang string, lang_pred string, score double, _judged int, `a.b` int")
    out = predict(df, train(df))
    assert out.columns == ["doc_id", "text", "lang", "_judged", "a.b", "lang_pred", "score"] and out.first().lang_pred == "en" and out.first()["a.b"] == 2


def test_held_out_accuracy(spark):
    out = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(lang, "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
