import hashlib
import random
import zlib

import pytest

from factloom.llm.media import BITRATES, FRAME, crc16, encode, encode_bytes, header, parse, parse_bytes, stored_payload, text_media
from factloom.llm.queries import QUERIES


def test_round_trip_and_table():
    rng = random.Random(1)
    for n in (0, 1, 2, 40):
        payload = rng.randbytes(576 * n)
        media = encode_bytes(payload)
        got = parse_bytes(media)
        assert stored_payload(got) == payload
        assert (got["samples"], got["sample_rate"] if n else 48000) == (1152 * n, 48000)
        assert got["table"] == "Info" and got["table_frames"] == n and len(got["toc"]) == 100
        assert got["table_bytes"] == FRAME * (n + 1) and got["crc_bad"] == got["skipped_bytes"] == 0 and got["crc_checked"] == n
        assert got["first_samples"] == [1152 * i for i in range(n)] and got["tags"] == {"TIT2": "payload"}


def test_payload_that_looks_like_headers():
    payload = bytes((0xFF, 0xFA, 0xC4, 0x00)) * 144 * 5
    assert stored_payload(parse_bytes(encode_bytes(payload))) == payload


def test_damage_is_skipped_and_found():
    payload = random.Random(2).randbytes(576 * 10)
    media = encode_bytes(payload)
    start = parse_bytes(media)["offsets"][4]
    cut = parse_bytes(media[:start] + b"\xff\xe0 noise \xff" + media[start:])
    assert len(cut["offsets"]) == 10 and cut["skipped_bytes"] == 10 and stored_payload(cut) == payload
    lost = parse_bytes(media[:start] + media[start + 100 :])
    assert len(lost["offsets"]) == 9
    flipped = bytearray(media)
    flipped[start + 10] ^= 1
    assert parse_bytes(bytes(flipped))["crc_bad"] == 1
    tail = parse_bytes(media + b"TAG" + b"A title".ljust(125, b"\0"))
    assert tail["skipped_bytes"] == 0 and len(tail["offsets"]) == 10


def test_payload_that_looks_like_a_tag():
    for at in range(0, 576 - 2):
        payload = bytes(576) + (b"a" * at + b"TAG").ljust(576, b"b")
        assert stored_payload(parse_bytes(encode_bytes(payload))) == payload
    # behind such a payload a tag is one, and one that cuts the last frame short too
    title = b"TAG" + b"A title".ljust(125, b"\0")
    media = encode_bytes((b"a" * 506 + b"TAG").ljust(576, b"b") * 3)
    got = parse_bytes(media + title)
    assert stored_payload(got) == stored_payload(parse_bytes(media)) and len(got["offsets"]) == 3 and got["skipped_bytes"] == 0
    assert parse_bytes(title)["tags"] == {"TIT2": "A title"}
    short = parse_bytes(encode_bytes(bytes(576 * 3))[:-100] + title)
    assert len(short["offsets"]) == 2 and short["skipped_bytes"] == FRAME - 100
    # frames of 96 bytes, of which several lie in the last 128
    small = bytearray(frames(0xFFFB1464, 10, 96))
    small[-128:-125] = b"TAG"
    assert len(parse_bytes(bytes(small))["offsets"]) == 10


def test_headers_and_checksum():
    assert crc16(b"123456789") == 0xAEE7
    assert header(0xFFFB9064)[3:7] == (128, 44100, 1152, 417)
    assert header(0xFFF38064)[3:7] == (64, 22050, 576, 208)
    assert header(0xFFFFFFFF) is None and header(0) is None and len(BITRATES) == 6
    assert parse_bytes(b"")["samples"] == 0 and parse_bytes(b"\xff" * 5000)["offsets"] == []


def frames(word, n, size, body=b""):
    return b"".join(word.to_bytes(4, "big") + body.ljust(size - 4, b"\0") for _ in range(n))


def test_durations_over_a_change_of_rate():
    slow, fast = frames(0xFFFB9064, 10, 417), frames(0xFFFB9464, 10, 384)
    got = parse_bytes(slow + fast)
    assert got["rates"] == [{"frame": 0, "rate": 44100, "samples": 11520}, {"frame": 10, "rate": 48000, "samples": 11520}]
    assert got["seconds"] == pytest.approx(11520 / 44100 + 11520 / 48000, abs=1e-12) and got["first_samples"][10] == 11520 and got["skipped_bytes"] == 0


def test_checksums_of_layers():
    # layer I, 32 kbit/s at 48 kHz: 32 bytes of bit allocation for two channels, 16 for one, in between for joint stereo
    for mode, guarded in ((0, 32), (3, 16), (1, 18)):
        word = 0xFFFE1400 | mode << 6
        h = header(word)
        assert (h[1], h[2], h[6], h[9]) == (1, True, 32, guarded) or h[9] == guarded
        allocation = bytes(range(guarded))
        crc = crc16(word.to_bytes(4, "big")[2:] + allocation)
        size = header(0xFFFE5400 | mode << 6)[6]
        word = 0xFFFE5400 | mode << 6
        crc = crc16(word.to_bytes(4, "big")[2:] + allocation)
        good = frames(word, 3, size, crc.to_bytes(2, "big") + allocation)
        bad = frames(word, 1, size, (crc ^ 1).to_bytes(2, "big") + allocation)
        got = parse_bytes(good + bad)
        assert (got["crc_checked"], got["crc_bad"], got["crc_unchecked"], len(got["offsets"])) == (4, 1, 0, 4)
    second = 0xFFFC8400
    got = parse_bytes(frames(second, 3, header(second)[6]))
    assert (got["crc_checked"], got["crc_unchecked"], len(got["offsets"])) == (0, 3, 3)
    assert crc16(b"") == 0xFFFF


def test_free_format():
    got = parse_bytes(b"junk" + frames(0xFFFB0464, 5, 500, b"x" * 400))
    assert got["offsets"] == [4 + 500 * i for i in range(5)] and got["skipped_bytes"] == 4 and got["rates"][0]["rate"] == 48000


def test_tags_with_extended_header_and_unsynchronisation():
    text = b"\x03a\xff\x00b"  # unsynchronised: a zero behind each FF
    frame = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\x00a\xff\x00b"
    extended = (6).to_bytes(4, "big") + bytes(6)
    tag = extended + frame
    head = lambda flags, n: b"ID3\x03\0" + bytes((flags,)) + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    got = parse_bytes(head(0xC0, len(tag)) + tag + frames(0xFFFB9064, 2, 417))
    assert got["tags"] == {"TIT2": "a\xffb"} and len(got["offsets"]) == 2 and got["skipped_bytes"] == 0 and text


def test_empty_table_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, b"x", 2)], "doc_id long, text string, media binary, n_bytes int")
    row = text_media(df).withColumn("p", parse("media")).first()
    assert row.n_bytes == 0 and bytes(row.p.payload) == b"\xff" * 576 and text_media(df.where("false")).count() == 0
    nothing = spark.createDataFrame([(None,)], "b binary").select(encode("b").alias("m")).withColumn("p", parse("m")).first()
    assert nothing.m is None and nothing.p.offsets == [] and nothing.p.seconds == 0.0


def test_query_equals_brute_force(spark, tmp_path):
    texts = [None, "", "abc", "é𝜑" * 400, "x" * 576, "x" * 577, "abc", "long " * 40_000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, payload int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op5_mpeg_audio"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        media = encode_bytes(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    assert got[2].feature == got[6].feature


def test_query_on_tails_of_characters_and_tags(spark, tmp_path):
    texts = ["é" * 288, "𝜑" * 144, "x" * 540 + "é" * 8, "\ufffd" * 192, "a" * 506 + "TAG", "z" * 576 + "a" * 506 + "TAG" + "q" * 20]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op5_mpeg_audio"](spark, str(tmp_path)).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want
        assert f"frames={len(payload) // 576} " in r.feature and "skipped=0 " in r.feature
