"""Media columns: MPEG-1 audio, layer III.

encode() lays bytes into frames that any decoder plays as silence: header, CRC-16, side information
whose granules hold no coded samples, and the bytes as ancillary data behind it. An ID3v2 tag and an
`Info` frame with frame count, byte count and a 100-entry seek table come first.

parse() takes any bytes as an MPEG-1/2/2.5 stream of layers I to III: it reads ID3v2 tags (extended headers and unsynchronisation
included) and ID3v1 tags (behind the last frame: a last frame may hold the same bytes), finds frame headers and finds them again after damage (a header counts if the next frame's follows it or the data end), those of
free format too, whose size is the distance to the next header; checks the CRC-16 of layers I and III where a frame has one and counts those of layer II as
unchecked; reads Xing, Info and VBRI tables; and returns exact durations and the offset and first sample of every frame. The sample rate may change:
`rates` has a row for each stretch of one rate, with its first frame and its samples, and the duration is the sum of samples / rate.

Defined cases: null gives null from encode() and a parse without frames; empty input is a stream
without frames; streams may be of any length; damaged stretches are counted in `skipped_bytes`; repeated rows are coded one by one; an empty table gives an
empty one. encode() and parse() are functions of a column; text_media() reads doc_id and text alone, so no other columns clash.
"""

import math
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = 576

# Fixed values of the MPEG audio format: kilobits a second by (version 1?, layer) and index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005

#: What encode() writes: MPEG-1, layer III, with CRC, 224 kbit/s, 48 kHz, stereo: 672 bytes a frame.
HEADER = bytes((0xFF, 0xFA, 0xC4, 0x00))
FRAME, SIDE = 672, 32
BODY = 4 + 2 + SIDE


def _shifted(byte: int) -> int:
    """What eight steps of the division make of a byte alone."""
    crc = byte << 8
    for _ in range(8):
        crc = (crc << 1 ^ CRC_POLYNOMIAL) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


CRC_TABLE = [_shifted(byte) for byte in range(256)]


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFF00) ^ CRC_TABLE[crc >> 8 ^ byte]
    return crc


@lru_cache(maxsize=4096)
def _crc16(data: bytes) -> int:
    return crc16(data)


@lru_cache(maxsize=4096)
def header(word: int):
    """(version bits, layer, has_crc, bitrate, rate, samples, bytes, channels, padding, guarded) of a header word, or None.

    In free format the bitrate is 0 and bytes are 0 too. guarded: bytes behind header and CRC that the CRC covers, -1 for layer II, where they hang on
    what the frame holds.
    """
    if word >> 21 != 0x7FF:
        return None
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate_at, bits_at = word >> 10 & 3, word >> 12 & 15
    if version == 1 or layer == 4 or rate_at == 3 or bits_at == 15 or word & 3 == 2:
        return None
    family = 1 if version == 3 else 2
    kbit, rate = BITRATES[family, layer][bits_at], RATES[version][rate_at]
    samples = 384 if layer == 1 else 576 if layer == 3 and family == 2 else 1152
    pad = (word >> 9 & 1) * (4 if layer == 1 else 1)
    size = 12 * kbit * 1000 // rate * 4 + pad if layer == 1 else samples // 8 * kbit * 1000 // rate + pad
    mode, channels = word >> 6 & 3, 1 if word >> 6 & 3 == 3 else 2
    if layer == 1:
        # four bits for each of 32 bands and channel, but one for both channels above the bound of joint stereo
        both = 4 * ((word >> 4 & 3) + 1) if mode == 1 else 32
        guarded = 16 * channels if mode != 1 else (8 * both + 4 * (32 - both)) // 8
    else:
        guarded = -1 if layer == 2 else _side(version, channels)
    return version, layer, not word >> 16 & 1, kbit, rate, samples, size if kbit else 0, channels, pad, guarded


def _side(version: int, channels: int) -> int:
    return (17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)


def encode_bytes(payload: bytes, title: str = "payload") -> bytes:
    """`payload`, a multiple of 576 bytes, as an MPEG audio stream; 576 bytes to a frame."""
    if len(payload) % UNIT:
        raise ValueError("payload must be a multiple of 576 bytes")
    n = len(payload) // UNIT
    frames = np.zeros((n, FRAME), np.uint8)
    head = HEADER + struct.pack(">H", _crc16(HEADER[2:] + bytes(SIDE))) + bytes(SIDE)
    frames[:, :BODY] = np.frombuffer(head, np.uint8)
    frames[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    total = FRAME * (n + 1)
    # the seek table: 256ths of the bytes at each hundredth of the time
    toc = bytes(min(255, 256 * (FRAME + FRAME * (n * i // 100)) // total) for i in range(100))
    info = bytearray(FRAME)
    info[:BODY] = head
    body = b"Info" + struct.pack(">III", 7, n, total) + toc
    info[BODY - 2 : BODY - 2 + len(body)] = body
    # an Info frame has no CRC, so that its table starts right behind the side information
    info[:4] = bytes((HEADER[0], HEADER[1] | 1, HEADER[2], HEADER[3]))
    info[4 : 4 + SIDE] = bytes(SIDE)
    text = b"\x03" + title.encode()
    tag = b"TIT2" + struct.pack(">I", len(text)) + b"\0\0" + text
    size = len(tag)
    sync = bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127))
    return b"ID3\x03\0\0" + sync + tag + bytes(info) + frames.tobytes()


def _tags(data: bytes, version: int, flags: int) -> dict[str, str]:
    out, at = {}, 0
    if flags & 0x80:
        data = data.replace(b"\xff\0", b"\xff")
    size = len(data)
    if flags & 0x40:
        # the extended header's size holds itself in version 4, and not before
        at = int.from_bytes(data[:4], "big") + 4 if version < 4 else sum((b & 127) << 7 * (3 - i) for i, b in enumerate(data[:4]))
    while at + 10 <= size and data[at : at + 4].strip(b"\0"):
        n = int.from_bytes(data[at + 4 : at + 8], "big")
        if version == 4:
            n = sum((b & 127) << 7 * (3 - i) for i, b in enumerate(data[at + 4 : at + 8]))
        body = data[at + 10 : at + 10 + n]
        if data[at : at + 1] == b"T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            out[data[at : at + 4].decode("latin-1")] = body[1:].decode(code, "replace").rstrip("\0")
        at += 10 + n
    return out


def parse_bytes(data: bytes) -> dict:
    """What the stream holds; see the module's text. `ancillary` is what lies behind the side information."""
    out = {"tags": {}, "sample_rate": 0, "samples": 0, "offsets": [], "first_samples": [], "crc_checked": 0, "crc_bad": 0, "crc_unchecked": 0, "rates": [], "seconds": 0.0,
           "skipped_bytes": 0, "table": "", "table_frames": 0, "table_bytes": 0, "toc": [], "ancillary": b""}
    at, end, parts = 0, len(data), []
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = sum((b & 127) << 7 * (3 - i) for i, b in enumerate(data[at + 6 : at + 10]))
        out["tags"] |= _tags(data[at + 10 : at + 10 + size], data[at + 3], data[at + 5])
        at += 10 + size + (10 if data[at + 5] & 16 else 0)
    at, whole = min(at, end), end
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128

    def frame_at(pos: int):
        return header(int.from_bytes(data[pos : pos + 4], "big")) if pos + 4 <= end else None

    def size_at(pos: int, h):
        """The size of the frame there: in free format what lies before the next header of its kind, and so much again in those that follow."""
        if not h or h[3]:
            return h[6] if h else 0
        if free.get(h[:2] + h[4:5]) is None:
            step = pos + 24
            while (step := data.find(data[pos : pos + 1], step, end)) >= 0:
                n = frame_at(step)
                if n and not n[3] and n[:2] == h[:2] and n[4] == h[4]:
                    free[h[:2] + h[4:5]] = step - pos - h[8]
                    break
                step += 1
            else:
                return 0
        return free[h[:2] + h[4:5]] + h[8]

    def end_of(pos: int, kind):
        """Where frames of a kind that follow each other from there on end."""
        while (h := frame_at(pos)) and (h[:2], h[4]) == kind and (size := size_at(pos, h)):
            pos += size
        return pos

    synced, first, rate, free = False, True, 0, {}
    while at + 4 <= end:
        h = frame_at(at)
        size = size_at(at, h)
        if size and at + size > end and end < whole:
            # frames that go on to the very last byte hold these bytes themselves: then it is no ID3v1 tag
            end = whole
            end = whole if end_of(at, (h[:2], h[4])) == whole else whole - 128
        good = size and at + size <= end and (synced or at + size + 4 > end or (n := frame_at(at + size)) and n[:2] == h[:2] and n[4] == h[4])
        if not good:
            synced, free = False, {}
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out["skipped_bytes"] += step - at
            at = step
            continue
        synced = True
        version, layer, has_crc, _, rate, samples, _, channels, _, guarded = h
        body = at + 4 + 2 * has_crc
        side = _side(version, channels) if layer == 3 else 0
        if first and layer == 3:
            first = False
            table, vbri = data[at + 4 + side : at + size], data[at + 36 : at + size]
            if table[:4] in (b"Xing", b"Info"):
                flags, pos = int.from_bytes(table[4:8], "big"), 8
                out["table"] = table[:4].decode()
                for bit, name in ((1, "table_frames"), (2, "table_bytes")):
                    if flags & bit:
                        out[name], pos = int.from_bytes(table[pos : pos + 4], "big"), pos + 4
                out["toc"] = list(table[pos : pos + 100]) if flags & 4 else []
                at += size
                continue
            if vbri[:4] == b"VBRI":
                out |= {"table": "VBRI", "table_bytes": int.from_bytes(vbri[10:14], "big"), "table_frames": int.from_bytes(vbri[14:18], "big")}
                n, scale, width = (int.from_bytes(vbri[i : i + 2], "big") for i in (18, 20, 22))
                width = width or 1
                out["toc"] = [scale * int.from_bytes(vbri[26 + i * width : 26 + (i + 1) * width], "big") for i in range(n)]
                at += size
                continue
        first = False
        if has_crc and guarded < 0:
            out["crc_unchecked"] += 1
        elif has_crc:
            out["crc_checked"] += 1
            out["crc_bad"] += _crc16(data[at + 2 : at + 4] + data[body : body + guarded]) != int.from_bytes(data[at + 4 : at + 6], "big")
        if not out["rates"] or out["rates"][-1]["rate"] != rate:
            out["rates"].append({"frame": len(out["offsets"]), "rate": rate, "samples": 0})
        out["rates"][-1]["samples"] += samples
        out["sample_rate"] = out["sample_rate"] or rate
        out["offsets"].append(at)
        out["first_samples"].append(out["samples"])
        out["samples"] += samples
        parts.append(data[body + side : at + size])
        at += size
    out["skipped_bytes"] += max(0, end - at)
    if end < whole:
        out["tags"].setdefault("TIT2", data[end + 3 : end + 33].decode("latin-1").rstrip("\0 "))
    out["ancillary"] = parts
    out["seconds"] = math.fsum(s["samples"] / s["rate"] for s in out["rates"])
    return out


def stored_payload(parsed: dict) -> bytes:
    """The bytes that encode_bytes() laid into the frames, from a parse."""
    return b"".join(p[:UNIT] for p in parsed["ancillary"])


@F.pandas_udf(T.BinaryType())
def encode(payload: pd.Series) -> pd.Series:
    """A binary column of payloads, multiples of 576 bytes, as a column of MPEG audio."""
    return payload.map(lambda x: None if x is None else encode_bytes(bytes(x)))


PARSED = (
    T.StructType()
    .add("tags", T.MapType(T.StringType(), T.StringType()))
    .add("sample_rate", "integer")
    .add("samples", "long")
    .add("offsets", T.ArrayType(T.LongType()))
    .add("first_samples", T.ArrayType(T.LongType()))
    .add("crc_checked", "long")
    .add("crc_bad", "long")
    .add("crc_unchecked", "long")
    .add("rates", T.ArrayType(T.StructType().add("frame", "long").add("rate", "integer").add("samples", "long")))
    .add("seconds", "double")
    .add("skipped_bytes", "long")
    .add("table", "string")
    .add("table_frames", "long")
    .add("table_bytes", "long")
    .add("toc", T.ArrayType(T.IntegerType()))
    .add("payload", "binary")
)


@F.pandas_udf(PARSED)
def parse(media: pd.Series) -> pd.DataFrame:
    """A column of MPEG audio as structs of what it holds; the samples and rates in `rates` give the exact duration, `seconds` is it as a double,
    `sample_rate` the first rate, and frame i starts at byte offsets[i] with sample first_samples[i]."""
    rows = [parse_bytes(b"" if data is None else bytes(data)) for data in media]
    for row in rows:
        row["payload"] = stored_payload(row)
    return pd.DataFrame({name: [row[name] for row in rows] for name in PARSED.names})


def padded(data) -> F.Column:
    """A binary column with bytes 255 behind it, up to a positive multiple of 576."""
    n = F.octet_length(data)
    fill = F.when(n == 0, UNIT).otherwise((UNIT - n % UNIT) % UNIT)
    block = F.unhex(F.repeat(F.lit("FF"), UNIT))
    return F.concat(data, F.substring(block, F.lit(1), fill.cast("int")))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media of every text; a null text counts as empty."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), padded(data).alias("payload"))
    return rows.withColumn("media", encode("payload"))
