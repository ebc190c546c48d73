"""Personal data: patterns, and information-theoretic sanitisation of terms that give a protected entity away.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers. Every value found is a protected entity e.
A term t, anywhere in a text with e, reveals it as far as knowing t tells e: PMI(e; t) = log p(e | t) / p(e), with probabilities over
the distinct texts of the corpus, against the entity's own information -log p(e). A term is disclosing if ALPHA * PMI >= -log p(e) and at least
`SUPPORT` distinct texts show both: what stands in a single text can't be told from chance. Disclosing terms are spans wherever they stand:
sanitise() puts the base spans as <KIND> and generalises or removes them: a taxonomy, a table of (term, general), names broader terms; a text shows
all terms above its own too, and a disclosing term becomes the nearest one above it that isn't disclosing, or <TERM> if there is none.

Terms are words of two letters or more; Han and Kana, written without spaces, give each pair of neighbouring letters. Entities that occur in the same
texts have the same terms and are counted as one.

Built-in functions only. One pass over the texts finds base spans, entities and the terms beside them; only if some (entity, term) has the support and
passes does a second pass count the texts of these terms, and only if some term is disclosing does a third place them.

Defined cases: a null text counts as empty; texts may be of any length and are searched whole, in time linear in them and their spans (but for
sorting); repeated texts count once in all probabilities and get equal spans; of several general terms as near the first in order counts; an empty table
gives an empty result. Terms are compared in lower case. Columns named h1, h2, base, entities, terms or spans give way to the operator's; others stay.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.spans import SPAN, apart, before, by_start, find, joined, let, none, replaced
from factloom.plans.fixpoint import closure
from factloom.session import cut

KINDS = ["email", "ip", "card", "phone", "term"]
# The base rules. A run is entered at its start only, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

SUPPORT, ALPHA = 2, 1.1
#: Up to so many terms go to all tasks; more are met by shuffle. Up to so many terms of a text are compared with each of its words.
SENT, FEW = 500_000, 16
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
LETTER = rf"[\p{{L}}\p{{M}}'_\-&&[^{UNSPACED}]]"
#: Addresses and numbers, the first kind of match, are no terms.
WORD = rf"(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[@0-9][A-Za-z0-9@._%+-]*+|[\p{{L}}&&[^{UNSPACED}]]{LETTER}++"
RUN = rf"[{UNSPACED}]{{2,}}+"
PAIR = rf"(?=([{UNSPACED}]{{2}}))"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(F.ascii(c) - 48, i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans by kind as listed, then by start."""
    small = lambda part: F.length(F.regexp_replace(part, "^0+", "")) < 4
    octet = lambda part: small(part) & (F.when(small(part), F.regexp_replace(part, "^0+(?=[0-9])", "")).otherwise("999").cast("int") <= 255)
    email = find(text, EMAIL, "email")
    ip = F.filter(find(text, IP, "ip"), lambda s: F.forall(F.split(s["value"], r"\."), octet))
    card = F.filter(find(text, CARD, "card"), lambda s: F.when(F.length(_digits(s["value"])) <= 19, _luhn(_digits(s["value"]))).otherwise(False))
    phone = F.filter(find(text, PHONE, "phone"), lambda s: F.length(_digits(s["value"])).between(8, 15))
    return F.concat(email, ip, card, phone)


def _entities(base: Column) -> Column:
    entity = lambda s: F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(_digits(s["value"])))
    return F.array_distinct(F.transform(base, entity))


def _is_word(value: Column) -> Column:
    return ~value.rlike("[@0-9]")


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    words = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _is_word)
    return F.array_distinct(F.concat(F.transform(words, F.lower), F.regexp_extract_all(text, F.lit(PAIR), F.lit(1))))


def _above(taxonomy: DataFrame | None) -> DataFrame | None:
    """(term, general): all broader terms of each."""
    if taxonomy is None:
        return None
    edges = taxonomy.where("term is not null and general is not null").select(F.lower("term").alias("a"), F.lower("general").alias("b")).where("a <> b")
    return closure(edges).where("a <> b").select(F.col("a").alias("term"), F.col("b").alias("general"))


def _with_broader(words: DataFrame, above: DataFrame | None) -> DataFrame:
    """(h1, h2, term) with the terms above each."""
    return words if above is None else words.unionByName(words.join(above, "term").select("h1", "h2", F.col("general").alias("term"))).distinct()


def _generalised(told: DataFrame, taxonomy: DataFrame | None) -> DataFrame:
    """(term, general) for disclosing terms: the nearest broader term that isn't disclosing, empty if there is none."""
    if taxonomy is None:
        return told.withColumn("general", F.lit(""))
    edges = taxonomy.select(F.lower("term").alias("at"), F.lower("general").alias("up")).where("at <> up").distinct()
    told = cut(told)
    left, found = told.select("term", F.col("term").alias("at")), told.limit(0).withColumn("general", F.lit(""))
    seen = cut(left)
    while True:
        up = left.join(edges, "at").select("term", F.col("up").alias("at")).distinct().join(seen, ["term", "at"], "left_anti")
        up = cut(up.join(told.select(F.col("term").alias("at"), F.lit(True).alias("bad")), "at", "left"))
        if up.isEmpty():
            break
        found = cut(found.unionByName(up.where("bad is null").groupBy("term").agg(F.min("at").alias("general"))))
        seen = cut(seen.unionByName(up.select("term", "at")))
        left = up.where("bad").select("term", "at").join(found, "term", "left_anti")
    return told.join(found, "term", "left").select("term", F.coalesce("general", F.lit("")).alias("general"))


def _name(text: Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("pii"), text).alias("h2"))


def _disclosing(first: DataFrame, docs: DataFrame, taxonomy: DataFrame | None) -> DataFrame | None:
    """(h1, h2, terms): disclosing terms by text, with what they are generalised to, or None if there are none."""
    above = _above(taxonomy)
    seen = first.where(F.size("entities") > 0).select("h1", "h2", "entities", "terms").dropDuplicates(["h1", "h2"])
    mentions = seen.select("h1", "h2", F.explode("entities").alias("entity"))
    # entities by the texts that hold them
    held_by = mentions.groupBy("entity").agg(F.count("*").alias("of_entity"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")).where(F.col("of_entity") >= SUPPORT)
    group = F.struct("of_entity", "x1", "x2").alias("entity")
    mentions = cut(mentions.join(held_by, "entity").select("h1", "h2", group).distinct())
    if mentions.isEmpty():
        return None
    words = _with_broader(seen.select("h1", "h2", F.explode("terms").alias("term")), above)
    # counts are written before joins, so that these may split a hot term
    shared = cut(words.groupBy("term").agg(F.count("*").alias("near")).where(F.col("near") >= SUPPORT))
    pairs = mentions.join(words, ["h1", "h2"])
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).withColumn("of_entity", F.col("entity.of_entity"))
    n = first.select("h1", "h2").distinct().count()

    def telling(of_term):
        own = -F.log2(F.col("of_entity") / F.lit(float(n)))
        pmi = F.log2(F.col("texts") / F.col(of_term)) + own
        return (pmi * ALPHA >= own) & (own > 0)

    # the texts with a term and any entity are some of its texts: what fails for these fails for all
    both = cut(both.join(shared, "term").where(telling("near")).drop("near"))
    if both.isEmpty():
        return None
    wanted = both.select("term").distinct()
    wanted = F.broadcast(wanted) if both.count() <= SENT else wanted
    words = _with_broader(docs.select("h1", "h2", F.explode(_terms(F.col("text"))).alias("term")), above)
    held = cut(words.join(wanted, "term").distinct())
    of_term = cut(held.groupBy("term").agg(F.count("*").alias("of_term")))
    told = cut(_generalised(both.join(of_term, "term").where(telling("of_term")).select("term").distinct(), taxonomy))
    out = cut(held.join(told, "term").groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("term", "general"))).alias("terms")))
    return None if out.isEmpty() else out


def _term_spans(text: Column, terms: Column) -> Column:
    """The places of `terms`, (term, general), in a text, by start; value is what the term is generalised to. Pairs that overlap are one span, without it."""
    words = F.filter(find(text, WORD, "term"), lambda s: _is_word(s["value"]))
    keyed = F.transform(words, lambda s: F.struct(F.lower(s["value"]).alias("key"), s["start"].alias("start"), s["end"].alias("end")))
    pair = lambda run: F.transform(F.regexp_extract_all(run["value"], F.lit(PAIR), F.lit(1)), lambda p, i: F.struct(p.alias("key"), (run["start"] + i).alias("start"), (run["start"] + i + 2).alias("end")))
    pairs = F.flatten(F.transform(find(text, RUN, "term"), pair))

    def held(places, told):
        """A few terms are looked for one by one; of many, sorted by key, each stands before its places."""
        asked = F.transform(told, lambda t: F.struct(t["term"].alias("key"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), t["general"].alias("general")))
        here = F.transform(places, lambda s: F.struct(s["key"], s["start"], s["end"], F.lit("").alias("general")))

        def match(every):
            last = before(F.transform(every, lambda x: F.when(x["start"] < 0, F.struct(x["key"].alias("key"), x["general"].alias("general")))), F.lit(None), lambda a, b: F.coalesce(b, a), "struct<key:string,general:string>")
            hits = F.filter(F.arrays_zip(every.alias("s"), last.alias("t")), lambda x: (x["s"]["start"] >= 0) & (x["s"]["key"] == x["t"]["key"]))
            return F.array_sort(F.transform(hits, lambda x: F.struct(x["s"]["start"], x["s"]["end"], F.lit("term").alias("kind"), x["t"]["general"].alias("value"))).cast(SPAN))

        def few(names):
            hits = F.filter(places, lambda s: F.array_contains(names, s["key"]))
            general = lambda s: F.element_at(F.filter(told, lambda t: t["term"] == s["key"]), 1)["general"]
            return F.transform(hits, lambda s: F.struct(s["start"], s["end"], F.lit("term").alias("kind"), general(s).alias("value"))).cast(SPAN)

        return F.when(F.size(told) <= FEW, let(F.transform(told, lambda t: t["term"]), few)).otherwise(let(F.array_sort(F.concat(asked, here)), match))

    def merged(spans):
        reach = before(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest, "int")
        heads = F.filter(F.arrays_zip(spans.alias("s"), reach.alias("reach")), lambda x: x["s"]["start"] >= x["reach"])
        whole = F.array_max(F.transform(spans, lambda s: s["end"]))
        return let(heads, lambda h: F.zip_with(h, F.concat(F.slice(F.transform(h, lambda x: x["reach"]), F.lit(2), F.size(h)), F.array(whole)), lambda x, end: F.struct(x["s"]["start"], end.alias("end"), x["s"]["kind"], F.lit("").alias("value"))).cast(SPAN))

    runs = let(held(pairs, terms), lambda spans: F.when(F.size(spans) > 0, merged(spans)).otherwise(none()))
    return F.array_sort(F.concat(held(keyed, terms), runs))


def detect(docs: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """The columns of `docs` but text, with base and spans, arrays of (start, end, kind, value); spans is base and the disclosing terms, by kind, then start.

    The value of a term's span is what it is generalised to, empty if nothing. `taxonomy` has term and general.
    """
    # of columns with clashing names the operator's stay
    small = [c for c in docs.columns if c not in ("text", "h1", "h2", "base", "entities", "terms", "spans")]
    own = [F.col(f"`{c}`") for c in [*small, "text"]]
    texts = docs.select(*own, F.coalesce("text", F.lit("")).alias("_text"))
    named = texts.select(*own, "_text", _name(F.col("_text")).alias("_h"))
    first = named.withColumn("base", base_spans(F.col("_text"))).withColumn("entities", _entities(F.col("base"))).withColumn("terms", F.when(F.size("base") > 0, _terms(F.col("_text"))))
    first = cut(first.select(*own[:-1], "_h.h1", "_h.h2", "base", "entities", "terms"))
    plain = named.select(F.col("_text").alias("text"), "_h.h1", "_h.h2")
    terms = _disclosing(first, plain, taxonomy)
    if terms is None:
        return first.select(*own[:-1], "h1", "h2", "base", F.col("base").alias("spans"))
    # so that only texts with a disclosing term are shuffled
    hit = terms.select("h1", "h2")
    hit = F.broadcast(hit) if hit.count() <= SENT else hit
    once = plain.join(hit, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).join(terms, ["h1", "h2"])
    # few bytes but much work: dealt over all partitions, and written before the join with all rows, which may then split a hot text
    dealt = once.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h1", "h2")
    placed = cut(dealt.select("h1", "h2", _term_spans(F.col("text"), F.col("terms")).alias("found")))
    spans = F.concat("base", apart(F.coalesce("found", none()), F.col("base")))
    return first.join(placed, ["h1", "h2"], "left").select(*own[:-1], "h1", "h2", "base", spans.cast(SPAN).alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(k) for k in KINDS[:4]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """(h1, h2, text, clean): each distinct text and what it becomes, base spans put as <KIND> and terms generalised or put as <TERM>."""
    found = detect(docs.select("text"), taxonomy).dropDuplicates(["h1", "h2"]).select("h1", "h2", by_start(F.col("spans"), KINDS).alias("spans"))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", _name(F.col("text"))).select("text", "_h.h1", "_h.h2").dropDuplicates(["h1", "h2"])
    put = lambda s: F.when((s["kind"] == "term") & (s["value"] != ""), s["value"]).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    return texts.join(found, ["h1", "h2"]).select("h1", "h2", "text", replaced(F.col("text"), F.col("spans"), put).alias("clean"))
