import hashlib
import math
import random
import re
from collections import Counter

from factloom.llm import pii
from factloom.llm.pii import detect, sanitise, summary


def luhn(digits):
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m[0])]


TEXTS = [
    None,
    "",
    "a.b@c.de x@y z@w.q_r@s.t @@ a@b.c.d. +1 (555) 123-4567 1.2.3.4.5 999.1.1.1 007.1.1.1 0000300.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111 4111  111111111111 5 4111111111111111",
    "é𝜑😀 q@x.yz 10.0.0.1",
    "1 2 " * 4000 + "+" + "1" * 3000 + " " + "a" * 5000 + "@" + "b." * 3000,
    "+1 +22 +1234567 +12345678 +1(2)3.4-5 6789012345678",
]


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(TEXTS + [TEXTS[2]] * 2))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, h1 int")
    got = {r.doc_id: r for r in summary(detect(df)).collect()}
    for i, text in rows:
        want = base(text)
        assert got[i].spans == ",".join(want), i
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]
    assert summary(detect(df.where("false"))).count() == 0


def test_terms_that_give_an_entity_away(spark):
    texts = [f"note {i}: Zorblatt wrote from boss@corp.example about budget number {'x' * i}" for i in range(1, 7)]
    texts += [f"plain text {i} about the budget from nobody, number" for i in range(60)] + ["Later zorblatt came alone."] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in summary(detect(df)).collect()}
    at = texts[0].index("Zorblatt")
    assert f"term:{at}:{at + 8}" in got[0].split(",")
    assert got[66] == got[67] == "term:6:14"
    assert all(not got[i] for i in range(6, 66))
    clean = {r.text: r.clean for r in sanitise(df).collect()}
    assert clean[texts[66]] == "Later <TERM> came alone." and "<EMAIL>" in clean[texts[0]] and clean[texts[10]] == texts[10]


def test_terms_far_from_the_mention_short_names_and_two_texts(spark):
    filler = " ".join(["plain words of any letter stay here"] * 8)
    texts = [
        f"Ann and Wu {filler} write to far@corp.example {filler} first",
        f"later ann met Wu again {filler} about far@corp.example {filler} second",
        "王伟的邮箱far2@corp.example。",
        "请写信给王伟，far2@corp.example",
        "Wu alone, Annabel not. 王伟 alone",
        "one single@corp.example for Zed only",
    ] + [f"plain words of any letter stay here write to and the later again about first second one for only met alone not 的邮箱 请写信给 {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.text: r.clean for r in sanitise(df).collect()}
    assert clean[texts[0]] == f"<TERM> and <TERM> {filler} write to <EMAIL> {filler} first"
    assert clean[texts[1]] == f"later <TERM> met <TERM> again {filler} about <EMAIL> {filler} second"
    assert clean[texts[4]].startswith("<TERM> alone, Annabel not.") and clean[texts[4]].endswith("<TERM> alone")
    # one text alone shows nothing
    assert clean[texts[5]] == "one <EMAIL> for Zed only"
    assert all(clean[t] == t for t in texts[6:])


def test_disclosing_terms_equal_brute_force(spark):
    """Counts, information and the threshold recomputed over small texts of random words."""
    rng = random.Random(5)
    common, rare = [f"common{c}" for c in "abcdefgh"], [f"rare{c}{d}" for c in "abcdefgh" for d in "abcd"]
    texts = []
    for i in range(150):
        who = rng.randrange(40)
        words = rng.choices(common, k=4) + ([rare[who % 32]] if rng.random() < 0.7 else [])
        texts.append(" ".join(words) + (f" p{'abcdefghijklmnop'[who % 16]}@corp.example" if rng.random() < 0.5 else ""))
    texts += texts[:20]
    entities = {t: frozenset(re.findall(r"\S+@\S+", t)) for t in texts}
    terms = {t: frozenset(w for w in t.split() if "@" not in w) for t in texts}
    n, of_entity, of_term, both = len(entities), Counter(), Counter(), Counter()
    for t in entities:
        of_entity.update(entities[t]), of_term.update(terms[t]), both.update((e, w) for e in entities[t] for w in terms[t])
    told = set()
    for (e, w), together in both.items():
        own = -math.log2(of_entity[e] / n)
        if together >= 2 and 1.1 * (math.log2(together / of_term[w]) + own) >= own:
            told.add(w)
    assert told and not told & set(common)
    found = detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    for r in found:
        text = texts[r.doc_id]
        want = [(m.start(), m.end()) for m in re.finditer(r"[a-z]+(?![a-z]*@)(?<!@corp)", text) if m[0] in told]
        assert [(s.start, s.end) for s in r.spans if s.kind == "term"] == want, text


def test_few_and_many_terms_give_the_same(spark, monkeypatch):
    texts = [f"boss@corp.example {' '.join(f'alpha{c} Beta{c}' for c in 'abcdefghij')} 王伟的邮箱 {i}" for i in "xy"] + [f"betaa {c} alphab 王伟 的" for c in "pq"] + [f"none {i}" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.spans for r in summary(detect(df)).collect()}
    assert want[0].count("term") >= 18
    monkeypatch.setattr(pii, "FEW", 0), monkeypatch.setattr(pii, "SENT", -1)
    assert {r.doc_id: r.spans for r in summary(detect(df)).collect()} == want


def test_taxonomy_generalises(spark):
    texts = [f"the cardiologist of boss@corp.example was seen {i}" for i in range(3)] + ["a cardiologist alone"]
    texts += [f"a surgeon was seen, plain the of was {w}" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")] + ["a nobody alone"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    taxonomy = spark.createDataFrame([("Cardiologist", "specialist"), ("specialist", "doctor"), ("surgeon", "doctor"), ("doctor", "person"), ("person", "person"), (None, "x")], "term string, general string")
    assert {r.text: r.clean for r in sanitise(df).collect()}[texts[3]] == "a cardiologist alone"
    rows = [(i, t) for i, t in enumerate(texts) if i != 3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, broad = ({r.text: r.clean for r in sanitise(df, t).collect()} for t in (None, taxonomy))
    assert plain[texts[0]] == "the <TERM> of <EMAIL> was seen 0"
    assert broad[texts[0]] == "the doctor of <EMAIL> was seen 0"
    assert broad[texts[5]] == texts[5]


def test_many_terms_and_clashing_columns(spark):
    texts = [f"boss@corp.example {'Zorblatt x ' * 20_000}{i}" for i in range(2)] + [f"x {i}" for i in range(50)]
    df = spark.createDataFrame([(i, t, 1, "b", "s", "e") for i, t in enumerate(texts)], "doc_id long, text string, h2 int, base string, spans string, `found.x` string")
    found = detect(df)
    assert found.columns == ["doc_id", "found.x", "h1", "h2", "base", "spans"]
    sizes = {r.doc_id: len(r.spans) for r in found.collect()}
    assert sizes[0] == sizes[1] == 20_001 and sizes[2] == 0
