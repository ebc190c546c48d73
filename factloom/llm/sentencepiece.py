"""SentencePiece encoding and decoding with a Unigram model's search.

Pieces with log scores come from a public model file. The scores of a Unigram file are taken as they are; a file of another kind holds the rank
of each piece instead, and pieces get the log-probabilities that Zipf's law gives their ranks (tokenizers are not trained here). Pieces lie in a
double-array trie over bytes. Encoding finds the segmentation with the highest sum of scores (Viterbi); a character that no piece covers costs the
least score less 10 and comes out as byte pieces. Spaces are written U+2581 first, one more is put in front.
Decoding joins the pieces, restores bytes and spaces and takes the front one away.

Where no piece holds a marker behind another character, no segmentation crosses the place before a marker,
so texts are cut there, and at characters that are in no piece. The parts that a worker hasn't met are
encoded together, place by place, for all parts of about one length at once; long parts are encoded alone. Memory is bounded by `CELLS`,
`REMEMBERED`, the portions of a batch and the longest text.

Defined cases: null stays null, the empty text has no pieces; texts may be of any length and are encoded whole; a text's own U+2581 decodes as a
space, the format's one loss; of equal sums the one stays that ends in the piece that starts first; repeated rows are encoded one by one; an empty
table gives an empty table; a column of the name asked for is replaced by the ids, other columns stay whatever their names; invalid ids raise an
error; unknown and control pieces decode to nothing.
"""

import math
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.batches import portions, slices

MARK = "▁"
# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
UNKNOWN_PENALTY = 10.0
#: Bytes of a character by its first.
WIDE = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)

#: Parts of more characters than this are encoded alone; so many places of new parts are worked on together; so many parts are remembered.
LONG, CELLS, REMEMBERED = 64, 500_000, 200_000


def _fields(data: bytes):
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, log score, type) by id."""
    out, kind = [], UNIGRAM
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                f = dict(_fields(value))
                out.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
    return out if kind == UNIGRAM else zipf(out)


def zipf(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Normal pieces, best first, get the log of the probabilities 1/1, 1/2, 1/3, … less the log of their sum."""
    normal = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: -pieces[i][1])
    whole = math.log(sum(1 / r for r in range(1, len(normal) + 1))) if normal else 0.0
    score = {i: -math.log(r) - whole for r, i in enumerate(normal, 1)}
    return [(p, score.get(i, s), kind) for i, (p, s, kind) in enumerate(pieces)]


class DoubleArray:
    """A trie over bytes: the child of node s by byte c is t = base[s] + c if check[t] == s; value[t] is a key's number or -1."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        size, window = 1 << 17, 2048
        base, check, value = (np.full(size, x, np.int32) for x in (0, -1, -1))
        taken = np.zeros(size, bool)
        taken[0] = True
        free, dense = 1, 1
        todo = [(0, 0, len(order), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            while lo < hi and len(keys[order[lo]]) == depth:
                value[node] = order[lo]
                lo += 1
            if lo == hi:
                continue
            groups, start = [], lo
            for i in range(lo + 1, hi + 1):
                if i == hi or keys[order[i]][depth] != keys[order[start]][depth]:
                    groups.append((keys[order[start]][depth], start, i))
                    start = i
            # the first base at which all children find a free place, looked for in windows
            at = max(1, (free if len(groups) == 1 else dense) - groups[0][0])
            while True:
                while at + window + 256 >= size:
                    base, check, value = (np.append(x, np.full(size, y, np.int32)) for x, y in ((base, 0), (check, -1), (value, -1)))
                    taken = np.append(taken, np.zeros(size, bool))
                    size *= 2
                clash = np.zeros(window, bool)
                for c, _, _ in groups:
                    clash |= taken[at + c : at + c + window]
                fits = int(np.argmin(clash))
                if not clash[fits]:
                    at += fits
                    break
                at += window
            base[node] = at
            for c, a, b in groups:
                taken[at + c], check[at + c] = True, node
                todo.append((at + c, a, b, depth + 1))
            if len(groups) > 1:
                # what lies far before the last place found is too full for several children
                dense = max(dense, at + groups[0][0] - 8 * window)
            while taken[free]:
                free += 1
        self.base, self.check, self.value = base, check, value


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.size = len(pieces)
        usable = [i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED) and p]
        normal = [pieces[i][1] for i in usable if pieces[i][2] == NORMAL]
        least, most = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown = least - UNKNOWN_PENALTY
        self.ids = np.array(usable, np.int32)
        self.scores = np.array([pieces[i][1] if pieces[i][2] == NORMAL else len(pieces[i][0]) * most - 0.1 for i in usable])
        keys = [pieces[i][0].encode() for i in usable]
        self.trie = DoubleArray(keys)
        self.longest = max(map(len, keys), default=1)
        self.bytes = np.full(256, -1, np.int32)
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.surface = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
            self.surface.append(bytes((int(piece[3:5], 16),)) if kind == BYTE else b"" if kind in (UNKNOWN, CONTROL) else piece.replace(MARK, " ").encode())
        inside = any(MARK in pieces[i][0].lstrip(MARK) for i in usable)
        covered = {c for i in usable for c in pieces[i][0]}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in covered)
        if inside:
            self.parts = re.compile("(?s).+")
        else:
            other = f"{MARK}{alone}"
            self.parts = re.compile(f"{MARK}*[^{other}]+|{MARK}+" + (f"|[{alone}]+" if alone else ""))
        self._forget()

    def _forget(self) -> None:
        """The ids of all parts met lie one behind the other in `found`; memory has a part's number, `starts` and `counts` its place."""
        self.memory: dict[str, int] = {}
        self.starts, self.counts, self.found = (np.empty(0, t) for t in (np.int64, np.int64, np.int32))

    def cut(self, text: str) -> list[str]:
        return self.parts.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        out = []
        for a, b in portions([len(t or "") for t in texts]):
            ids, ends = self.encode_some(texts[a:b])
            each = np.split(ids, ends[:-1])
            out += [None if t is None else x for t, x in zip(texts[a:b], each, strict=True)]
        return out

    def encode_some(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where those of each text end."""
        parts = [self.cut(t or "") for t in texts]
        if len(self.memory) > REMEMBERED:
            self._forget()
        self._learn(list({p for some in parts for p in some if p not in self.memory}))
        at = np.fromiter(map(self.memory.__getitem__, chain.from_iterable(parts)), np.int64)
        counts = self.counts[at]
        ends = np.cumsum(counts)
        ids = self.found[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - counts), counts)]
        until = np.cumsum([len(some) for some in parts])
        return ids, np.append(0, ends)[until]

    def _learn(self, new: list[str]) -> None:
        raw = sorted((p.encode() for p in new if len(p) <= LONG), key=len)
        found = []
        while raw:
            n = len(raw) - max(1, CELLS // (len(raw[-1]) + 1))
            block = raw[max(0, n) :]
            del raw[max(0, n) :]
            found.append((block, *self._encode_short(block)))
        for p in new:
            if len(p) > LONG:
                ids = self._encode_long(p.encode())
                found.append(([p.encode()], ids, np.array([len(ids)])))
        if found:
            for name in (p.decode() for block, _, _ in found for p in block):
                self.memory[name] = len(self.memory)
            counts = np.concatenate([c for _, _, c in found])
            self.starts = np.append(self.starts, len(self.found) + np.cumsum(counts) - counts)
            self.counts = np.append(self.counts, counts)
            self.found = np.concatenate([self.found, *(ids for _, ids, _ in found)])

    def _encode_short(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi for many parts at once, a step for each place and each length of a piece: all ids, and how many each part has."""
        lens = np.array([len(r) for r in raw])
        n, width = len(raw), int(lens.max())
        text = np.ascontiguousarray(np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(n, width).T)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for j in range(width):
            rows = np.flatnonzero((lens > j) & (text[j] & 0xC0 != 0x80))
            if not len(rows):
                continue
            here, step = best[j], WIDE[text[j]]
            single = np.zeros(n, bool)
            alive, node = rows, np.zeros(len(rows), np.int64)
            for k in range(j, min(width, j + self.longest)):
                to = base[node] + text[k][alive]
                ok = (check[to] == node) & (lens[alive] > k)
                alive, node = alive[ok], to[ok]
                if not len(alive):
                    break
                v = value[node]
                has = v >= 0
                who, v = alive[has], v[has]
                single[who[step[who] == k + 1 - j]] = True
                score = here[who] + self.scores[v]
                better = score > best[k + 1][who]
                who, v = who[better], v[better]
                best[k + 1][who], back[k + 1][who], piece[k + 1][who] = score[better], j, v
            bare = rows[~single[rows]]
            for d in np.unique(step[bare]):
                who = bare[step[bare] == d]
                score = here[who] + self.unknown
                who, score = (x[score > best[j + d][who]] for x in (who, score))
                best[j + d][who], back[j + d][who], piece[j + d][who] = score, j, -1
        # from the ends of all parts back to their beginnings
        who, at, rows, ids = np.arange(n), lens, [], []
        while len(who):
            start, p = back[at, who], piece[at, who]
            covered = p >= 0
            rows.append(who[covered]), ids.append(self.ids[p[covered]])
            for w, a, e in zip(who[~covered], start[~covered], at[~covered], strict=True):
                bare = self._fallback(raw[w][a:e])
                rows.append(np.full(len(bare), w)), ids.append(bare[::-1])
            who, at = who[start > 0], start[start > 0]
        rows, ids = np.concatenate(rows)[::-1], np.concatenate(ids)[::-1]
        return ids[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=n)

    def _fallback(self, raw: bytes) -> np.ndarray:
        ids = self.bytes[np.frombuffer(raw, np.uint8)]
        return ids if (ids >= 0).all() else np.array([self.unknown_id], np.int32)

    def _encode_long(self, raw: bytes) -> np.ndarray:
        n = len(raw)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        # views give Python's numbers without a copy of the trie
        base, check, value, scores = map(memoryview, (self.trie.base, self.trie.check, self.trie.value, self.scores))
        for j in range(n):
            if raw[j] & 0xC0 == 0x80:
                continue
            step = int(WIDE[raw[j]])
            here, node, single = best[j], 0, False
            for k in range(j, min(n, j + self.longest)):
                to = base[node] + raw[k]
                if check[to] != node:
                    break
                node = to
                v = value[node]
                if v >= 0:
                    single |= k + 1 - j == step
                    if here + scores[v] > best[k + 1]:
                        best[k + 1], back[k + 1], piece[k + 1] = here + scores[v], j, v
            if not single and here + self.unknown > best[j + step]:
                best[j + step], back[j + step], piece[j + step] = here + self.unknown, j, -1
        out, at = [], n
        while at:
            start, p = back[at], piece[at]
            out.append(self.ids[p : p + 1] if p >= 0 else self._fallback(raw[start:at]))
            at = start
        return np.concatenate(out[::-1])

    def decode(self, ids: list[int]) -> str:
        if ids and (min(ids) < 0 or max(ids) >= self.size):
            raise ValueError("no such piece")
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Codec:
    """Columns of texts to columns of ids and back.

    The driver reads the model and builds the trie; tasks get it by broadcast, some 3 MB whatever the data.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.model = spark.sparkContext.broadcast(Unigram(read_model(path)))

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """`docs` with `ids` in place of the column `text`. The ids of a portion of texts leave the worker before the next are made."""
        model, names = self.model, [c for c in docs.columns if c not in (text, ids)]

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, len(names)):
                    texts = some.column(len(names)).to_pylist()
                    flat, ends = model.value.encode_some(texts)
                    bounds = pa.array(np.append(0, ends).astype(np.int32))
                    column = pa.ListArray.from_arrays(bounds, pa.array(flat, pa.int32()), mask=pa.array([t is None for t in texts]))
                    yield pa.RecordBatch.from_arrays([*some.columns[:-1], column], [*names, ids])

        kept = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`"))
        schema = T.StructType([kept.schema[c] for c in names] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
        # numbered, since names with dots don't pass
        return kept.toDF(*(f"_{i}" for i in range(len(kept.columns)))).mapInArrow(encoded, schema)

    def decode(self, ids: Column) -> Column:
        model = self.model

        @F.arrow_udf(T.StringType())
        def decoded(rows: pa.Array) -> pa.Array:
            # the numbers of all rows lie one behind the other
            ids, ends, null = rows.values.to_numpy(), rows.offsets.to_numpy(), rows.is_null().to_numpy(zero_copy_only=False)
            texts = (None if n else model.value.decode(ids[a:b].tolist()) for a, b, n in zip(ends, ends[1:], null, strict=False))
            return pa.array(texts, pa.string())

        return decoded(ids)
