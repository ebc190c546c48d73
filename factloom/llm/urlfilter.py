"""URL filters: a sort-merge range join of urls with host and path rules.

A rule is a host and a path. Its key is the host's labels from the last to the first and then the path,
so that every url below the rule has a key within one interval that starts at the rule's key. A url
has one key for each suffix of its host that a rule could name (no rule has more labels than the
longest), so rules also cover subdomains. Keys are dealt into ranges; a rule goes to each range its
interval meets. Each range is sorted and swept once: a stack holds the rules around the current key,
the innermost of them last. Over the suffixes of a url the longest rule wins.

Ranges come from a sample of keys of fixed size and only balance the work. A key that is several
bounds of ranges at once (one url in a large share of all rows) has its urls dealt over all of these.

Defined cases: a null url, or one without `://`, has empty host and path; no rule fits an empty host.
Equal rules with unlike verdicts count as block; of rules that are as long and both fit, the greater string wins. A rule with a null host or path fits nothing.
Urls may be of any length and have any number of labels. Repeated rows are judged one by one. An empty table or rule list is fine. Of the input's columns only
page_id and url are read, so no others clash.
"""

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut

#: Labels of a host, and host and path, are kept apart by these in keys.
LABEL, PATH = "\x01", "\x02"
LAST = "\U0010ffff"
#: Keys sampled for the bounds of ranges.
SAMPLE = 20_000


def split_url(url) -> tuple[F.Column, F.Column]:
    """Host, lower-cased in A-Z only, and path of a url."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _reversed(labels) -> F.Column:
    return F.concat(F.array_join(F.reverse(labels), LABEL), F.lit(PATH))


def _clean(host) -> F.Column:
    return F.translate(host, LABEL + PATH, "��")


def ranges(bounds: list[str]):
    """A function of keys: the first and the last range that may hold a key's rows."""

    @F.pandas_udf(T.StructType().add("lo", "integer").add("hi", "integer"))
    def of(low: pd.Series, high: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"lo": [bisect.bisect_left(bounds, x) for x in low], "hi": [bisect.bisect_right(bounds, x) for x in high]}, dtype="int32")

    return of


SWEPT = T.StructType().add("row", "long").add("rule", "string").add("verdict", "string").add("size", "long")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of rules and urls; out come the urls with the innermost rule around them."""
    at, stack = None, []
    for batch in batches:
        out = ([], [], [], [])
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("range", "key", "is_url", "row", "rule", "verdict", "size"))
        for part, key, is_url, row, rule, verdict, size in zip(*columns, strict=True):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, rule, verdict, size))
            elif stack:
                for to, x in zip(out, (row, *stack[-1][1:]), strict=True):
                    to.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], SWEPT.names)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url).

    `rules` has host, path, verdict. A url that no rule fits gets `default`.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col("url"))
    # written once, so that rows keep their numbers whatever the table is made of
    urls = cut(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")))
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = F.split(_clean(F.col("host")), r"\.", -1)
    rules = rules.select(
        F.concat(_reversed(labels), "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        (F.length("host") + F.length("path")).cast("long").alias("size"),
        F.size(labels).alias("labels"),
    )
    deepest = rules.agg(F.max("labels")).first()[0] or 0
    n = F.size("labels")
    own = urls.withColumn("labels", labels).withColumn("take", F.explode(F.sequence(F.lit(1), F.least(n, F.lit(max(1, deepest))))))
    own = own.select("row", F.concat(_reversed(F.slice("labels", n - F.col("take") + 1, F.col("take"))), "path").alias("key"))
    # the smallest hashes are a sample that is the same on every run
    sample = own.select("key", F.xxhash64("key", "row").alias("h")).orderBy("h", "key").limit(min(SAMPLE, 64 * parts))
    keys = sorted(r.key for r in sample.collect())
    bounds = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    deal = ranges(bounds)
    spread = F.col("at.lo") + F.pmod(F.xxhash64("row"), F.col("at.hi") - F.col("at.lo") + 1).cast("int")
    placed = own.withColumn("at", deal("key", "key")).select(
        spread.alias("range"), "key", F.lit(True).alias("is_url"), "row", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(0).cast("long").alias("size")
    )
    covers = rules.withColumn("end", F.concat("key", F.lit(LAST))).withColumn("at", deal("key", "end"))
    covers = covers.select(
        F.explode(F.sequence("at.lo", "at.hi")).alias("range"), "key", F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("row"), "rule", "verdict", "size"
    )
    # a range is a partition: none waits for another
    dealt = placed.unionByName(covers).repartitionById(parts, "range").sortWithinPartitions("range", "key", "is_url")
    found = dealt.mapInArrow(sweep, SWEPT)
    # the longest rule; of equally long ones the greater string
    best = found.groupBy("row").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    out = urls.join(best, "row", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
