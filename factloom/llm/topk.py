"""Exact top-k by inner product over integer vectors, by MaxScore.

A vector is a document, a dimension a term. In a query of weights q, dimension d adds q[d] * x[d]. Its postings
hold the impact as a number from 0 up: x[d] less the shard's minimum for a positive weight, the shard's
maximum less x[d] for a negative one; the rest is a constant of query and shard. So each term has an upper
bound, |q[d]| * (maximum - minimum). Sorted by bound, the terms whose bounds together stay under the
lacking part of the threshold are non-essential: they alone bring no vector into the result. The
essential postings are traversed for all vectors of the shard, the others probed only for vectors that
still compete, while they do. The threshold is the k-th best score so far, which starts from the first vectors.

Shards are the batches of the candidates' partitions; their results are merged by a partial top-k in each
partition and one per query. Queries travel in blocks of fixed size, each in a job over all candidates.

Scores are whole numbers and exact at any size. Where they may pass 2**51, doubles only bound them, from both sides,
and what still competes is scored with whole numbers.

Defined cases: a vector that is null or holds null or a non-finite component takes no part, as a row
whose id is null; all others do, of any length (shorter vectors have zeros behind them, an empty one scores 0); a scaled component or a score
of the result beyond a long raises an error; rows that share the query's id are the query's own;
repeated query ids count once, with the smallest vector; repeated rows with other ids compete each; ties go to the smaller id; empty tables
give an empty result; other columns, whatever their names, are left out.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut

#: Numbers of a block of queries that go to all tasks at once: 8 bytes each.
BLOCK_NUMBERS = 2_000_000
SHARD_ROWS = 8192

HITS = T.StructType().add("query_id", "long").add("vec_id", "long").add("score", "long")


def scaled(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and x, the components as floor(scale * component); only rows that take part."""
    number = lambda v: v.cast("double") * F.lit(scale)
    large = F.raise_error(F.lit("a scaled component is beyond a long"))
    x = F.transform("embedding", lambda v: F.when(F.abs(number(v)) < 2.0**63, F.floor(number(v)).cast("long")).otherwise(large.cast("long")))
    finite = lambda v: ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    fine = F.forall("embedding", lambda v: F.coalesce(finite(v), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(rows: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix, zeros behind short ones."""
    out = np.zeros((len(rows), dims), np.int64)
    ends = np.asarray(rows.offsets)
    flat = np.asarray(rows.values.slice(ends[0], ends[-1] - ends[0]), np.int64)
    n = np.diff(ends)
    at = np.repeat(np.arange(len(rows)), n)
    col = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)
    out[at, col] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, smaller ids first among equals."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def maxscore(q: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float, slack: float = 0.0):
    """Scores and positions of a shard's vectors that may be among the k best for one query; none below `floor` need be found.

    `postings` has a row of components for each dimension; low and high are their extremes. Scores may be off by up to `slack`.
    """
    used = np.flatnonzero(q)
    weight, base = np.abs(q[used]), np.where(q[used] > 0, low[used], high[used])
    constant, bounds = float(q[used] @ base), weight * (high[used] - low[used])
    order = np.argsort(-bounds, kind="stable")
    used, rest = used[order], np.append(np.cumsum(bounds[order][::-1])[::-1], 0.0)
    first = min(len(ids), 4 * k)
    seed = q @ postings[:, :first]
    seed = seed[ids[:first] != own]
    if len(seed) >= k:
        floor = max(floor, np.partition(seed, len(seed) - k)[len(seed) - k])
    floor -= 2 * slack
    # essential: the fewest terms after which the others' bounds stay under what the threshold asks for
    essential = int(np.searchsorted(-rest, -(floor - constant), side="right"))
    essential = min(len(used), max(1, essential)) if len(used) else 0
    shift = lambda terms: float(np.where(q[terms] > 0, low[terms], high[terms]) @ q[terms])
    score = q[used[:essential]] @ postings[used[:essential]] - shift(used[:essential]) + constant if len(used) else np.zeros(len(ids))
    alive = np.flatnonzero((score + rest[essential] >= floor) & (ids != own))
    score = score[alive]
    while essential < len(used) and len(alive):
        step = used[essential : essential + 8]
        score = score + q[step] @ postings[np.ix_(step, alive)] - shift(step)
        essential += len(step)
        keep = score + rest[essential] >= floor
        if not keep.all():
            alive, score = alive[keep], score[keep]
    return score, alive


def products(q: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Exact inner products with the columns of `vectors`."""
    return [sum(map(int.__mul__, q.tolist(), x)) for x in vectors.T.tolist()]


def best_of(q: np.ndarray, whole: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int, least: int | None):
    """Exact scores and positions of the k best of a shard, of those that reach `least`. `postings` holds `whole` as doubles."""
    size = float(np.abs(q).astype(np.float64) @ np.maximum(np.abs(low), np.abs(high)))
    # doubles add whole numbers exactly up to 2**53, and a score is a sum of up to four numbers of its size
    slack = 0.0 if size < 2.0**51 else (len(q) + 8) * size * 2.0**-50
    score, alive = maxscore(q.astype(np.float64), postings, low, high, ids, own, k, -np.inf if least is None else float(least), slack)
    if slack:
        if len(alive) > k:
            near = np.partition(score, len(score) - k)[len(score) - k] - 2 * slack
            alive = alive[score >= near]
        exact = products(q, whole[:, alive])
        top = sorted(range(len(alive)), key=lambda i: (-exact[i], ids[alive[i]]))[:k]
        if any(abs(exact[i]) >= 2**63 for i in top):
            raise OverflowError("a score is beyond a long")
        return np.array([exact[i] for i in top], np.int64), alive[top]
    score = score.astype(np.int64)
    top = best(score, ids[alive], k)
    return score[top], alive[top]


def search(vec_ids: list[int], queries: np.ndarray, k: int):
    """A function of partitions of (vec_id, x): each query's k best of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = queries.shape[1]
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(vec_ids)
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_ROWS):
                shard = batch.slice(start, SHARD_ROWS)
                ids = np.asarray(shard.column(0), np.int64)
                width = max(dims, int(np.diff(np.asarray(shard.column(1).offsets)).max(initial=0)))
                whole = np.ascontiguousarray(matrix(shard.column(1), width).T[:dims])
                postings = whole.astype(np.float64)
                low, high = postings.min(axis=1), postings.max(axis=1)
                for i, own in enumerate(vec_ids):
                    had, had_ids = kept[i]
                    least = int(had[-1]) if len(had) == k else None
                    score, at = best_of(queries[i], whole, postings, low, high, ids, own, k, least)
                    both, both_ids = np.concatenate((had, score)), np.concatenate((had_ids, ids[at]))
                    top = best(both, both_ids, k)
                    kept[i] = both[top], both_ids[top]
        for start in range(0, len(vec_ids), 512):
            some = range(start, min(start + 512, len(vec_ids)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([vec_ids[i] for i in some], np.int64), [len(kept[i][0]) for i in some])),
                    pa.array(np.concatenate([kept[i][1] for i in some])),
                    pa.array(np.concatenate([kept[i][0] for i in some])),
                ],
                HITS.names,
            )

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest inner product for each query.

    Both tables have vec_id and x, an array of whole numbers.
    """
    spark = candidates.sparkSession
    queries = cut(queries.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("d", F.size("x")))
    n, dims = queries.agg(F.count("*"), F.max("d")).first()
    results = []
    if n:
        block = max(1, BLOCK_NUMBERS // max(1, dims))
        blocks = -(-n // block)
        # blocks by hash: each holds about as many numbers as the bound says
        for b in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "x").toArrow().combine_chunks()
            if not rows.num_rows:
                continue
            x = rows.column("x").combine_chunks()
            found = candidates.mapInArrow(search(rows.column("vec_id").to_pylist(), matrix(x, dims), k), HITS)
            w = F.row_number().over(_ranked())
            found = found.withColumn("rank", w).where(F.col("rank") <= k)
            results.append(cut(found) if blocks > 1 else found)
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, results).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ranked():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
