"""Near-duplicate documents by DartMinHash: word shingles of five, weighted Jaccard similarity of 0.8 or more.

The weight of a shingle is 1, and 1 more each time that the number of its occurrences in a text doubles: so what differs in a line that
is repeated counts, and a line that many texts repeat doesn't make them alike. The similarity of two texts is the sum of the lesser weights over that of
the greater ones. It is also the plain similarity of their sets of (shingle, n), n going up to the weight, which is how texts are compared exactly.

Signatures. Darts are thrown at the plane of weight and rank of each element: fixed regions hold a hashed Poisson number
of them at hashed places. A dart counts if its weight lies below the element's; each belongs to one
hashed coordinate, which keeps its dart of least rank. Only ranks below a bound near (ln k + 2) k / (total weight) are looked at, so
the work depends on the signature and hardly on the text's length; a coordinate left empty doubles the bound.

Candidates. BANDS groups of ROWS coordinates give each distinct text its buckets; two texts at similarity 0.8 share none with a
probability of (1 - 0.8**7)**50 = 8e-6. Within a bucket no pairs are listed:
1. each text is compared with one text of each of its buckets, the least in one of four hashed orders;
2. in buckets that still span several classes, with the text that has most links so far, until that brings no more links;
3. texts of buckets that still span classes are joined exactly: two texts at 0.8 share one of the rarest
   elements of both (prefix filter) at places behind which enough others may follow (position filter), and only pairs of unlike
   classes and fitting sizes are compared.
All comparisons count shared elements. Classes are the connected components of the links found.

Defined cases: words are `\\w+`, lower-cased; texts of one to four words are one shingle; texts without words, and null, are
each a class of their own; texts with equal words are copies, taken together before all else; class_id is the smallest doc_id of
a class (null if all are null); texts may be of any length and are compared whole; repeated rows and doc_ids are fine, an empty table gives an empty
result. classes() reads doc_id and text alone; dedup() returns all columns, whatever their names; of rows that tie in doc_id the first read stays.
"""

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.batches import slices
from factloom.llm.columns import numbered
from factloom.llm.components import components
from factloom.session import cut

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 50, 7
ORDERS = 4

_WORD = re.compile(r"\w+")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)) * 2.0**-44


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Hashes of all shingles in order, repeated ones too."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out = mix(out ^ h[i : n + i])
    return out


def weighted(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct elements and their weights."""
    elements, counts = np.unique(every, return_counts=True)
    return elements, np.frexp(counts)[1].astype(np.int64)


def unit_elements(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash for each element and each number up to its weight."""
    ends = np.cumsum(weights)
    nth = (np.arange(ends[-1]) - np.repeat(ends - weights, weights)).astype(np.uint64)
    return mix(np.repeat(elements, weights) ^ nth * _GOLD)


@lru_cache(maxsize=None)
def _poisson(area: float) -> np.ndarray:
    """The cumulative distribution of the number of darts in a region."""
    top = int(area + 12 * math.sqrt(area) + 24)
    logs = [i * math.log(area) - area - math.lgamma(i + 1) for i in range(top)]
    return np.cumsum(np.exp(logs))


def _layers(end: float) -> Iterator[tuple[float, float]]:
    low, high = 0.0, 1.0
    while low < end:
        yield low, high
        low, high = high, high + min(high, 128.0)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k coordinates, equal in two weighted sets with the probability of their weighted Jaccard similarity."""
    bound = (math.log(k) + 2) * k / float(weights.sum())
    while True:
        ranks, marks = [], []
        for i, (low, high) in enumerate(_layers(bound)):
            for j, (light, heavy) in enumerate(_layers(float(weights.max()))):
                over = weights > light
                own, w = (elements, weights) if over.all() else (elements[over], weights[over])
                seed = mix(own ^ np.uint64((i << 16 | j) * 0x1F123BB5 + 1))
                n = np.searchsorted(_poisson((high - low) * (heavy - light)), uniform(seed))
                total = int(n.sum())
                if not total:
                    continue
                start = np.repeat(np.cumsum(n) - n, n)
                dart = mix(np.repeat(seed, n) + (np.arange(total) - start).astype(np.uint64))
                # high bits place a dart, low bits choose its coordinate
                rank = low + (high - low) * uniform(dart)
                if high > bound:
                    keep = rank < bound
                    rank, dart, w_of = rank[keep], dart[keep], np.repeat(w, n)[keep]
                else:
                    w_of = np.repeat(w, n)
                if heavy > 1 or float(weights.min()) < heavy:
                    keep = light + (heavy - light) * uniform(mix(dart)) < w_of
                    rank, dart = rank[keep], dart[keep]
                ranks.append(rank)
                marks.append(dart)
        rank, mark = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((ranks, np.float64), (marks, np.uint64)))
        coord = ((mark & np.uint64(0xFFFFF)) * np.uint64(k) >> np.uint64(20)).astype(np.int64)
        order = np.argsort(-rank)
        out, full = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[coord[order]] = mark[order]  # of several the last stays: the least rank
        full[coord] = True
        if full.all():
            return out
        bound *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        out = mix(out ^ parts[:, i])
    return out


SIGNED = T.StructType().add("row", "long").add("doc_id", "long").add("node", "long").add("n", "integer").add("bands", T.ArrayType(T.LongType())).add("sh", T.ArrayType(T.IntegerType()))


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) to node, the text's 64-bit name, and its bands and elements, sorted 32-bit hashes."""
    for whole in batches:
        for batch in slices(whole, 2):
            nodes, sizes, bands, sets = [], [], [], []
            for text in batch.column(2).to_pylist():
                every = shingles(text)
                if not len(every):
                    nodes.append(None), sizes.append(0), bands.append(None), sets.append(None)
                    continue
                some, weights = weighted(every)
                nodes.append(int(xxhash.xxh64_intdigest(every.tobytes())) - 2**63)
                bands.append(band_keys(dart_minhash(some, weights.astype(np.float64), BANDS * ROWS)).view(np.int64))
                small = np.unique((unit_elements(some, weights) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                sizes.append(len(small))
                sets.append(small)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))], SIGNED.names
            )
    _words.clear()


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of elements have a Jaccard similarity of 0.8 or more."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sh").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sh").alias("sb"))
    # sizes alone decide most of the others
    both = pairs.join(one.select("a", "na"), "a").join(two.select("b", "nb"), "b").where((F.col("na") * 5 >= F.col("nb") * 4) & (F.col("nb") * 5 >= F.col("na") * 4))
    both = both.select("a", "b").join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 9 >= (F.col("na") + F.col("nb")) * 4).select("a", "b")


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _split(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that span several classes, with the class of each node."""
    known = buckets.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # written first: a join whose sides are plain shuffles may split hot keys
    spans = cut(known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket"))
    return known.join(spans, "bucket", "left_semi")


def classes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, class_id, is_first) for each row of `docs` (doc_id, text).

    is_first marks one row of each class. `row` numbers the rows as they are read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = cut(rows.mapInArrow(sign, SIGNED))
    # equal texts are one node from here on
    sets = cut(signed.where("node is not null").groupBy("node").agg(F.min(F.struct("row", "n", "bands")).alias("x")).select("node", "x.row", "x.n", "x.bands"))
    bands = sets.select("node", F.explode("bands").alias("bucket"))
    # the widest shuffle: a bucket for each band of each text
    full = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("print"), F.min("node").alias("least")).where("size > 1")
    # buckets with the same members are one
    full = cut(full.groupBy("size", "print", "least").agg(F.min("bucket").alias("bucket")).select("bucket"))
    buckets = cut(bands.join(full, "bucket", "left_semi"))
    members = buckets.select("node").distinct()
    shingled = cut(signed.where("node is not null").select("row", "node", "n", "sh").join(sets.join(members, "node", "left_semi").select("row"), "row", "left_semi").drop("row"))

    pivots = cut(buckets.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", F.pmod("bucket", F.lit(ORDERS)))).alias("pivot")))
    first = buckets.join(pivots, "bucket").where("node <> pivot").select(*_pair(F.col("node"), F.col("pivot"))).distinct()
    links = cut(compare(first, shingled))
    labels = components(links)
    tested = cut(first)
    while True:
        open_buckets = cut(_split(buckets, labels))
        degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
        ranked = cut(open_buckets.join(degree, "node", "left").groupBy("bucket").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("node"), F.col("comp"))).alias("top")))
        more = open_buckets.join(ranked, "bucket").where("comp <> top.comp").select(*_pair(F.col("node"), F.col("top.node"))).distinct()
        more = cut(more.join(tested, ["a", "b"], "left_anti"))
        found = cut(compare(more, shingled))
        if found.isEmpty():
            break
        links, tested = cut(links.unionByName(found)), cut(tested.unionByName(more))
        labels = components(found, labels)
    # what is left: texts that share a bucket with another class
    rest = cut(_split(buckets, labels).select("node", "comp").distinct())
    each = shingled.join(rest, "node").select("node", "n", "comp", F.explode("sh").alias("s"))
    counted = cut(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"))
    w = Window.partitionBy("node").orderBy("df", "s")
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(4) / 5) + 1
    rare = cut(each.join(counted, "s", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= prefix) & (F.col("df") > 1)).select("s", "node", "n", "comp", "rank"))
    x, y = rare.alias("x"), rare.alias("y")
    fits = (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n") * 5 >= F.col("y.n") * 4) & (F.col("y.n") * 5 >= F.col("x.n") * 4)
    # at the first shingle that both share, what lies behind it must still be enough (later ones only leave less)
    enough = (1 + F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank"))) * 9 >= (F.col("x.n") + F.col("y.n")) * 4
    last = x.join(y, (F.col("x.s") == F.col("y.s")) & fits & enough).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    found = cut(compare(last, shingled))
    if not found.isEmpty():
        labels = components(found, labels)

    of = signed.select("row", "doc_id", "node").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = of.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first"), F.count("*").alias("of"))
    # a class of one row needs no join: only the others are looked up
    named = of.join(cut(names.where("of > 1").select("comp", "class_id", F.col("first.row").alias("first"))), "comp", "left")
    alone = F.col("first").isNull()
    return named.select("row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("first") == F.col("row"))).alias("is_first"))


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class: that with the smallest doc_id.

    `docs` is read twice and must give the same rows in the same order, as a stored table does.
    """
    gone = cut(classes(docs).where("not is_first").select("row"))
    rows, named = numbered(docs)
    return rows.withColumn("row", F.monotonically_increasing_id()).join(gone, "row", "left_anti").transform(named)
