"""Mixing sources to target weights.

Words are summed per source; every source gets a target by water-filling its weight against a cap;
rate = target / size. A document is emitted floor(rate) times, plus one copy when its hash-seeded
uniform number falls below the fraction. The seed is one of `SEEDS` candidates per source: the one
whose Bernoulli copies come nearest the target, all of them summed in the same aggregation.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; a null
doc_id hashes as the string `null`; rows that repeat a doc_id decide alike; an empty table gives an
empty result; a source without words gets target 0 and no copies; texts may be of any length and are counted whole; of seeds that
come as near the first is taken. mix() reads doc_id, source and text alone; emit() returns all columns, whatever their names.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.columns import numbered
from factloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SEEDS = 32
#: More sources than this are joined by shuffle instead of broadcast (a row is a name and five numbers).
BROADCAST_SOURCES = 5_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed="mix") -> DataFrame:
    """doc_id, source, size and the two 48-bit halves a, b of the document's seeded hash, written once."""
    m = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), m.alias("m"))
    a, b = (F.conv(F.substring("m", at, 12), 16, 10).cast("long") for at in (1, 13))
    return cut(rows.select("doc_id", "source", "size", a.alias("a"), b.alias("b")))


def _uniform(k) -> F.Column:
    """The k-th uniform number of a row of sized(): its two halves, combined linearly."""
    return ((F.col("a") + k * F.col("b")) % F.lit(2**48)) / F.lit(float(2**48))


def _rank(sources: DataFrame) -> DataFrame:
    """0-based rank of each source in code point order, null last, without a one-task window."""
    ordered = cut(
        sources.withColumn("last", F.col("source").isNull())
        .repartitionByRange("last", "source")
        .sortWithinPartitions("last", "source")
        .withColumn("id", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("id", 33))
    )
    offset, offsets = 0, {}
    # one row for each partition of the exchange above
    for part, n in sorted((r.part, r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets[part], offset = offset, offset + n
    start = ordered.sparkSession.createDataFrame(list(offsets.items()) or [(0, 0)], "part long, start long")
    return ordered.join(F.broadcast(start), "part").withColumn("rank", F.col("start") + F.col("id") - F.shiftleft("part", 33)).drop("last", "id", "part", "start")


def plan_mix(sizes: DataFrame, weights=(3, 1, 2), share=1.5, cap=2) -> DataFrame:
    """Per source: source_size, weight, target, rate, whole, fraction and the chosen seed k.

    `sizes` is a table of sized(). Targets are min(cap * size, level * weight), the level such
    that they sum up to share * all sizes: what resharing the excess by weight arrives at.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = cut(_rank(totals).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))))
    limit = F.col("source_size") * F.lit(float(cap))
    level, capped = 0.0, -1
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        got = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, limit).otherwise(0.0)).alias("filled"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if got["capped"] == capped or not got["open"]:
            break
        capped, level = got["capped"], (share * got["all"] - got["filled"]) / got["open"]
    targets = (
        ranked.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("rate"))
        .withColumn("fraction", F.col("rate") - F.col("whole"))
    )
    targets = cut(targets)
    joined = join_sources(sizes.select("source", "size", "a", "b"), targets.select("source", "fraction"), targets.count())
    drawn = joined.groupBy("source").agg(
        *(F.sum(F.when(_uniform(F.lit(k)) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"k{k}") for k in range(SEEDS))
    )
    gap = lambda k: F.abs(F.col(f"k{k}") + F.col("whole") * F.col("source_size") - F.col("target"))
    t, d = targets.alias("t"), drawn.withColumnRenamed("source", "drawn_source")
    best = t.join(d, F.col("source").eqNullSafe(F.col("drawn_source")))
    best = best.withColumn("k", F.array_min(F.array(*(F.struct(gap(k).alias("gap"), F.lit(k).alias("k")) for k in range(SEEDS))))["k"])
    return cut(best.select("source", "source_size", "weight", "target", "rate", "whole", "fraction", "k"))


def join_sources(rows: DataFrame, sources: DataFrame, n_sources: int, prefix="") -> DataFrame:
    """Rows with the columns of their source, named with `prefix`; null sources meet. Broadcasts only a counted table."""
    right = sources.select(*(F.col(c).alias("_of_source" if c == "source" else f"{prefix}{c}") for c in sources.columns))
    right = F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("_of_source"))).drop("_of_source")


def mix(docs: DataFrame, seed="mix", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies (the times it is emitted) of every row."""
    return _decide(sized(docs, seed), **how)


def _decide(rows: DataFrame, **how) -> DataFrame:
    plan = plan_mix(rows, **how)
    out = join_sources(rows, plan.select("source", "source_size", "target", "rate", "whole", "fraction", "k"), plan.count())
    extra = (_uniform(F.col("k")) < F.col("fraction")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("whole") + extra).alias("copies"))


def emit(docs: DataFrame, seed="mix", **how) -> DataFrame:
    """The mixed corpus: the columns of `docs`, each row as often as mix() says.

    Texts stay where they are read: only the plan, a row for each source, is joined to them.
    """
    plan = plan_mix(sized(docs, seed), **how)
    docs, named = numbered(docs, "doc_id", "source")
    m = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    out = join_sources(docs.withColumn("_mix_m", m), plan.select("source", "whole", "fraction", "k"), plan.count(), prefix="_plan_")
    a, b = (F.conv(F.substring("_mix_m", at, 12), 16, 10).cast("long") for at in (1, 13))
    drawn = ((a + F.col("_plan_k") * b) % F.lit(2**48)) / F.lit(float(2**48)) < F.col("_plan_fraction")
    copies = (F.col("_plan_whole") + drawn.cast("long")).cast("int")
    return out.withColumn("_plan_copy", F.explode(F.array_repeat(F.lit(1), copies))).transform(named)
