import math
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from factloom.llm.queries import PIECES
from factloom.llm import batches
from factloom.llm import sentencepiece as module
from factloom.llm.batches import portions
from factloom.llm.sentencepiece import MARK, Codec, Unigram, _fields, read_model, zipf

TEXTS = ["", " ", "  a  b ", "the on the it", "é𝜑\n\n\tx", "日本語テスト", "a" * 300 + "é" * 50, "\x00", "x" * 63 + "é", "word " * 2000, "ﬀ İ 👩‍👩‍👧"]


def varint(v):
    out = bytearray()
    while True:
        out.append(v & 127 | (128 if v > 127 else 0))
        v >>= 7
        if not v:
            return bytes(out)


def library():
    """The public library over the same file, made a Unigram model with the scores in use."""
    out, scores = b"", iter(read_model(PIECES))
    for number, value in _fields(open(PIECES, "rb").read()):
        if number == 1:
            value += varint(2 << 3 | 5) + struct.pack("<f", next(scores)[1])
        value += varint(3 << 3) + varint(1) if number == 2 else b""
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def best_total(pieces, text):
    """The highest sum of scores of a segmentation, by trying every piece at every place."""
    least = min(pieces.values()) - 10
    best = [0.0] + [float("-inf")] * len(text)
    for at in range(len(text)):
        best[at + 1] = max(best[at + 1], best[at] + pieces.get(text[at], least))
        for n in range(2, 20):
            if (p := text[at : at + n]) in pieces and at + n <= len(text):
                best[at + n] = max(best[at + n], best[at] + pieces[p])
    return best[-1]


def test_best_score_and_no_worse_than_the_library(spark):
    rows = read_model(PIECES)
    own, lib = Unigram(rows), library()
    pieces = {p: s for p, s, kind in rows if kind == 1}
    lines = [x[:120] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for x in (r.text or "").split("\n")[:2]]
    lines = [x for x in lines if x and MARK not in x][:150]
    same = 0
    for line, ids in zip(lines, own.encode_all(lines), strict=True):
        got = sum(pieces.get(rows[i][0], 0) for i in ids)
        if all(rows[i][2] == 1 for i in ids):
            assert got == pytest.approx(best_total(pieces, MARK + line.replace(" ", MARK)), abs=1e-9), line
            best = lib.nbest_encode_as_ids(line, 1)[0]
            assert got >= sum(lib.get_score(i) for i in best) - 1e-3
            same += ids.tolist() == best
        assert own.decode(ids.tolist()) == line
    assert same > 0.9 * len(lines)


def test_scores_are_log_probabilities():
    scores = [s for _, s, kind in read_model(PIECES) if kind == 1]
    assert math.fsum(map(math.exp, scores)) == pytest.approx(1)
    assert zipf([("a", -5.0, 1), ("<unk>", 0.0, 2), ("b", -1.0, 1)]) == [("a", -math.log(2) - math.log(1.5), 1), ("<unk>", 0.0, 2), ("b", -math.log(1.5), 1)]
    own = Unigram(read_model(PIECES))
    assert [own.surface[i] for i in own.encode_all(["the international community"])[0]] == [b" the", b" international", b" community"]


def test_round_trip_and_both_searches():
    own = Unigram(read_model(PIECES))
    for text, ids in zip(TEXTS, own.encode_all(TEXTS), strict=True):
        assert own.decode(ids.tolist()) == text
        assert [i for part in own.cut(text) for i in own._encode_long(part.encode()).tolist()] == ids.tolist()


def test_portions_and_memory_do_not_change_results(monkeypatch):
    whole = [x.tolist() for x in Unigram(read_model(PIECES)).encode_all(TEXTS * 3)]
    monkeypatch.setattr(batches, "CHARS", 50), monkeypatch.setattr(module, "CELLS", 100), monkeypatch.setattr(module, "REMEMBERED", 5)
    assert list(portions([60, 1, 49, 1, 0, 200, 0])) == [(0, 1), (1, 3), (3, 5), (5, 6), (6, 7)] and not list(portions([]))
    assert [x.tolist() for x in Unigram(read_model(PIECES)).encode_all(TEXTS * 3)] == whole


def test_columns(spark):
    codec = Codec(spark, PIECES)
    rows = [(i, t, "old", i * 2) for i, t in enumerate([None, *TEXTS, TEXTS[3], "x y " * 200_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, `a.b` long").repartition(2)
    coded = codec.encode(df)
    assert coded.columns == ["doc_id", "a.b", "ids"]
    got = {r.doc_id: r for r in coded.withColumn("back", codec.decode(F.col("ids"))).collect()}
    for i, text, _, twice in rows:
        assert got[i].back == text and (got[i].ids is None) == (text is None) and got[i]["a.b"] == twice
    empty = codec.encode(df.where("false"))
    assert empty.withColumn("back", codec.decode(F.col("ids"))).count() == 0
