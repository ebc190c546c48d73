"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds its letters:
the product of their vectors, each rolled by its distance from the n-gram's end. A document bundles the
vectors of its n-grams, a language prototype those of its documents (each at unit length). The
prototype with the highest cosine names the language; the score is that cosine, 0 at least.

Texts are lower-cased; all that isn't a letter counts as one space, also at both ends. Sums are kept in
whole numbers, so neither the order of rows nor of tasks changes a prototype.

Defined cases: a text that is null or has no letter is `und` with score 0; without any prototype all are
`und`; equal cosines go to the smaller name; repeated rows are judged one by one; texts may be of any length and are bundled whole;
an empty table gives an empty result, and as what is trained on no prototypes; columns named lang_pred and score give way to the
operator's, all others stay whatever their names. What is trained on is the caller's choice;
rows there whose language is null or whose text has no letter are skipped. Up to `MAX_LANGUAGES` prototypes
(8 kB each) are gathered; more raise an error.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.batches import texts_of
from factloom.llm.columns import fresh

DIM, N = 1024, 3
MAX_LANGUAGES = 2000
UNIT = 2**20
#: n-gram vectors that a worker keeps, 1 kB each, and n-grams that are bundled at once.
KEPT, AT_ONCE = 32_768, 4096
SPACE = 32


class Encoder:
    """Texts to n-gram codes and n-gram codes to vectors, with a table of the n-grams met so far."""

    def __init__(self, dim: int = DIM, n: int = N):
        self.dim, self.n = dim, n
        self.letter = np.zeros(0x110000, bool)
        self.letters: dict[int, np.ndarray] = {}
        for code in range(0x110000):
            if chr(code).isalpha():
                self.letter[code] = True
        self._reset()

    def _reset(self):
        self.known = np.empty(0, np.int64)
        self.place = np.empty(0, np.int64)
        self.table = np.empty((KEPT, self.dim), np.int8)
        self.used = 0

    def codes(self, text: str) -> np.ndarray:
        """The n-grams of a text, as numbers; none if it has no letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = self.letter[points]
        if not is_letter.any():
            return np.empty(0, np.int64)
        points = np.concatenate(([SPACE], np.where(is_letter, points, SPACE), [SPACE])).astype(np.int64)
        points = points[np.append(True, (points[1:] != SPACE) | (points[:-1] != SPACE))]
        if len(points) < self.n:
            return np.empty(0, np.int64)
        out = np.zeros(len(points) - self.n + 1, np.int64)
        for i in range(self.n):
            out = out << 21 | points[i : len(out) + i]
        return out

    def vector(self, letter: int) -> np.ndarray:
        if letter not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([letter, self.dim])).integers(0, 2, self.dim, np.int8)
            self.letters[letter] = 2 * bits - 1
        return self.letters[letter]

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct n-grams, at most AT_ONCE."""
        at = np.searchsorted(self.known, grams)
        new = grams[(at >= len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != grams)] if len(self.known) else grams
        if len(new):
            if self.used + len(new) > KEPT:
                self._reset()
                new = grams
            for i, gram in enumerate(new.tolist()):
                row = self.table[self.used + i]
                row[:] = 1
                for back in range(self.n):
                    row *= np.roll(self.vector(gram >> 21 * back & 0x1FFFFF), back)
            known = np.concatenate((self.known, new))
            place = np.concatenate((self.place, np.arange(self.used, self.used + len(new))))
            order = np.argsort(known, kind="stable")
            self.known, self.place, self.used = known[order], place[order], self.used + len(new)
        return self.table[self.place[np.searchsorted(self.known, grams)]]

    def bundle(self, text: str | None) -> np.ndarray | None:
        grams, counts = np.unique(self.codes(text or ""), return_counts=True)
        if not len(grams):
            return None
        out = np.zeros(self.dim, np.float32)
        for i in range(0, len(grams), AT_ONCE):
            out += counts[i : i + AT_ONCE].astype(np.float32) @ self.rows(grams[i : i + AT_ONCE]).astype(np.float32)
        return out


_encoder: Encoder | None = None


def encoder() -> Encoder:
    global _encoder
    _encoder = _encoder or Encoder()
    return _encoder


SUMS = T.StructType().add("lang", "string").add("sums", T.ArrayType(T.LongType()))


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            v = encoder().bundle(text)
            if v is not None and (size := float(np.linalg.norm(v))):
                sums[lang] = sums.get(lang, 0) + np.rint(v * (UNIT / size)).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], SUMS.names)


def train(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes at unit length by language, from lang and text; each partition sums up its own part first."""
    parts = labelled.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(_sum_up, SUMS)
    each = parts.select("lang", F.posexplode("sums").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    whole = each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("x"))
    rows = whole.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for row in sorted(rows, key=lambda r: r.lang):
        v = np.array(row.x, np.float64)
        out[row.lang] = v / (np.linalg.norm(v) or 1.0)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """`docs` with lang_pred and score; only `text` is looked at."""
    names = list(prototypes)
    stack = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIM)

    @F.arrow_udf(T.StructType().add("lang", "string").add("score", "double"))
    def judge(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for text in texts_of(texts):
            v = encoder().bundle(text) if names else None
            size = 0.0 if v is None else float(np.linalg.norm(v))
            cosines = stack @ v / size if size else np.zeros(max(1, len(names)))
            at = int(np.argmax(cosines))
            langs.append(names[at] if size else "und")
            scores.append(min(1.0, max(0.0, float(cosines[at]))))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    judged = fresh("_judged", docs.columns)
    # said to be non-deterministic so that a filter on its results doesn't have it run twice
    return docs.withColumn(judged, judge.asNondeterministic()("text")).select(*(F.col(f"`{c}`") for c in own), F.col(f"{judged}.lang").alias("lang_pred"), F.col(f"{judged}.score").alias("score"))


def held_out(doc_id) -> F.Column:
    """True for documents that are kept from training: crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2
