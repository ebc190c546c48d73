"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

Base rules find assignments, access keys and long hexadecimal strings. Beside them every token of
`MIN_TOKEN` or more characters that may be part of a key is scored by two first-order Markov models over
ASCII characters: log P(token | random) - log P(token | identifier). Tokens whose ratio is at
least `THRESHOLD` for each step on average are secrets too, unless they touch a base span.

The models are trained from labelled samples, tables of (token, secret). labelled() makes one: identifiers are words of
`SAMPLE_DOCS` documents (those with the smallest hashes), alone and joined as identifiers are; secrets are what the base rules find
in these documents and as many hash-drawn strings in hexadecimal, base 64 and base 36.

Built-in functions only. Defined cases: a null text counts as empty, and mask() leaves it null; texts may be of any length and are scanned whole, in
time linear in them and their spans; repeated rows are scanned one by one; spans that start together are in the order of `KINDS`; an empty table
gives an empty result, with models from the hash-drawn strings alone. scan() puts its columns in place of others named base or spans;
mask() changes text and n_chars alone, whatever the other columns are called.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.columns import fresh
from factloom.llm.spans import apart, by_start, find, joined, none, replaced

KINDS = ["assign", "access", "hex", "markov"]
# The base rules. Runs are matched whole, so a minimum length stands in for the check of whole runs.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

MIN_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}+" % MIN_TOKEN
#: Documents from which a labelled sample takes words, and hash-drawn secrets of each of three alphabets.
SAMPLE_DOCS, DRAWN = 200, 2000
THRESHOLD = 1.0
CODES = 128


def base_spans(text: Column) -> Column:
    assign = F.filter(find(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= 6)
    return by_start(F.concat(assign, find(text, ACCESS, "access"), find(text, HEX, "hex")), KINDS)


def labelled(docs: DataFrame) -> DataFrame:
    """(token, secret): the labelled sample described above."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select(text.alias("text")).withColumn("h", F.xxhash64("text"))
    # the smallest distinct hashes first, so that copies take one place and texts are not shuffled to find it out
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).collect()]
    some = hashed.where(F.col("h").isin(least)).select("text").distinct()
    words = some.select(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}+"), F.lit(0)).alias("w"), "text")
    pairs = words.select(F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(F.lower(a).alias("a"), F.lower(F.coalesce(b, a)).alias("b")))).alias("p")).select("p.a", "p.b")
    shapes = F.array(F.col("a"), F.concat("a", F.lit("_"), "b"), F.concat("a", F.lit("-"), "b"), F.concat("a", F.initcap("b")), F.concat(F.initcap("a"), F.initcap("b")),
                     F.upper("a"), F.upper(F.concat("a", F.lit("_"), "b")), F.concat("a", F.lit("/"), "b"), F.concat("a", F.lit("_"), F.pmod(F.xxhash64("a", "b"), F.lit(100))))
    plain = pairs.select(F.explode(shapes).alias("token"), F.lit(False).alias("secret"))
    known = some.select(F.explode(F.transform(base_spans(F.col("text")), lambda s: s["value"])).alias("token"), F.lit(True).alias("secret"))
    h = F.sha2(F.concat(F.lit("secret:"), F.col("id")).cast("string"), 256)
    forms = F.array(F.substring(h, 1, 40), F.rpad(F.substring(F.base64(F.unhex(h)), 1, 40), 40, ""), F.concat(F.conv(F.substring(h, 1, 15), 16, 36), F.conv(F.substring(h, 16, 15), 16, 36)))
    drawn = docs.sparkSession.range(DRAWN).select(F.explode(forms).alias("token"), F.lit(True).alias("secret"))
    return plain.unionByName(known).unionByName(drawn)


def train(sample: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of steps, at 128 * code + next code; at most 128 * 128 counts of each model are gathered."""
    token = F.regexp_replace("token", r"[^\x21-\x7e]", "")
    codes = sample.where(F.length(token) > 1).select("secret", F.transform(F.split(token, ""), lambda c: F.ascii(c)).alias("c"))
    steps = codes.select("secret", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("s"))
    counts = steps.groupBy("secret", "s.a", "s.b").agg(F.count("*").alias("n"))
    n = {(r.secret, r.a, r.b): r["n"] for r in counts.collect()}
    alphabet = [c for c in range(33, 127) if chr(c).isalnum() or chr(c) in "+/_=-"]
    table = [0.0] * CODES * CODES
    total = {(s, a): sum(n.get((s, a, b), 0) for b in alphabet) for s in (True, False) for a in alphabet}
    for a in alphabet:
        for b in alphabet:
            p, q = ((n.get((s, a, b), 0) + smoothing) / (total[s, a] + smoothing * len(alphabet)) for s in (True, False))
            table[CODES * a + b] = math.log(p / q)
    return table


def ratio(token: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of a token's steps."""
    # a foldable split: the optimizer makes it one array, looked up by place
    steps = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    # characters as an array, once: a substring for each step would be quadratic in the token's length
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("before"), F.lit(0).alias("n"))
    step = lambda acc, c: F.struct((acc["sum"] + F.when(acc["before"] >= 0, F.get(steps, acc["before"] * CODES + c)).otherwise(0.0)).alias("sum"), c.alias("before"), (acc["n"] + 1).alias("n"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"] / (acc["n"] - 1))


def _found(docs: DataFrame, table: list[float], threshold: float, base: str, spans: str) -> DataFrame:
    """`docs` with two more columns: the base spans, and all spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = fresh("_tokens", [*docs.columns, base, spans])
    found = docs.withColumn(base, base_spans(text)).withColumn(tokens, find(text, TOKEN, "markov"))
    likely = lambda some: F.filter(some, lambda t: ratio(t["value"], table) >= threshold)
    added = F.when(F.size(tokens) > 0, likely(apart(F.col(tokens), F.col(base)))).otherwise(none())
    return found.withColumn(spans, by_start(F.concat(base, added), KINDS)).drop(tokens)


def _table(docs: DataFrame, sample: DataFrame | None) -> list[float]:
    return train(labelled(docs) if sample is None else sample)


def scan(docs: DataFrame, sample: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with base and spans: arrays of (start, end, kind, value), spans with what the models add."""
    return _found(docs.drop("base", "spans"), _table(docs, sample), threshold, "base", "spans")


def summary(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """The columns of `docs`, secrets put as <KIND> in text and n_chars following it."""
    base, spans = (fresh(f"_{c}", docs.columns) for c in ("base", "spans"))
    out = _found(docs, _table(docs, sample), THRESHOLD, base, spans).withColumn("text", replaced(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
