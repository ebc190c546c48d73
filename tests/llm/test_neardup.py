import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from factloom.llm.neardup import classes, dart_minhash, dedup


def shingle_counts(text):
    """Weights: 1, 2 from two occurrences on, 3 from four on, …"""
    words = re.findall(r"\w+", (text or "").lower())
    counts = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    return Counter({s: n.bit_length() for s, n in counts.items()})


def brute(rows):
    """Smallest id of the class of each (id, text), by comparing all pairs."""
    sets = [(i, shingle_counts(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and min(a.total(), b.total()) >= 0.8 * max(a.total(), b.total()):
            if (a & b).total() * 10 >= 8 * (a | b).total():
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    e = rng.integers(0, 2**63, 400, dtype=np.uint64)
    wa = rng.uniform(0.2, 5, 400)
    wb = wa * rng.uniform(0.5, 1.5, 400)
    same = dart_minhash(e, wa, 3000) == dart_minhash(e, wb, 3000)
    assert abs(same.mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04
    ones = np.ones(300)
    same = dart_minhash(e[:300], ones, 3000) == dart_minhash(e[100:], ones, 3000)
    assert abs(same.mean() - 0.5) < 0.04


def fixture():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    # a base and copies with edits at different places: like the base, not like each other
    base = [word() for _ in range(200)]
    texts.append(" ".join(base))
    for i in range(30):
        copy = list(base)
        copy[5 * i : 5 * i + 4] = [word() for _ in range(4)]
        copy[(5 * i + 90) % 190] = word()
        texts.append(" ".join(copy))
    # a chain: each is like the next only
    chain = [word() for _ in range(120)]
    for i in range(12):
        chain = chain[12:] + [word() for _ in range(12)]
        texts.append(" ".join(chain))
    # a passage that many share, too short to make them alike
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(30)]) for _ in range(60)]
    # weights decide: the same lines, but one of them 40, 36, 4 or 1 times; and unlike texts with one line in common 60 times
    line, others = " ".join(word() for _ in range(7)), [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts += [f"{others[0]} {f'{line} ' * n}" for n in (40, 36, 4, 1)] + [f"{o} {f'{line} ' * 60}" for o in others[1:3]] + [f"{o} {line}" for o in others[1:]]
    texts += [texts[0]] * 5 + ["Short text", "short TEXT!", "other", "", "", None]
    texts += ["x " * 20_000, " ".join(word() for _ in range(20_000))]
    return list(enumerate(texts))


def test_equals_brute_force_on_planted_groups(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").select("doc_id", "text")
    got = {r.doc_id: r for r in classes(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == brute(rows)
    kept = [r.doc_id for r in dedup(df).collect()]
    assert sorted(kept) == sorted(set(brute(rows).values()))


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in classes(docs).collect()} == brute(rows)


def test_edits_that_are_caught(spark):
    """A replaced word takes five shingles: copies are caught with an edit every 45 words, or one block of a tenth, and not beyond."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, want = [], {}
    for group in range(40):
        base = [word() for _ in range(450)]
        copies = {"exact": list(base), "case": [w.upper() for w in base]}
        for name, gap in (("word in 60", 60), ("word in 20", 20)):
            copies[name] = [word() if i % gap == gap // 2 else w for i, w in enumerate(base)]
        copies["block"] = base[:200] + [word() for _ in range(40)] + base[240:]
        copies["cut"] = base[: 450 * 85 // 100]
        copies["longer"] = base + [word() for _ in range(90)]
        rows.append((len(rows), " ".join(base)))
        for name, words in copies.items():
            want.setdefault(name, []).append((len(rows), group * (len(copies) + 1)))
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    recall = {name: sum(got[i] == base for i, base in pairs) / len(pairs) for name, pairs in want.items()}
    assert recall == {"exact": 1, "case": 1, "word in 60": 1, "word in 20": 0, "block": 1, "cut": 1, "longer": 1}


def test_clashing_columns_and_nulls(spark):
    rows = [(None, "a b c d e f", 1, "n", 1.0), (None, "A b c d e f", 2, "n", 2.0), (7, None, 3, None, None), (8, "z", 4, "", 0.5), (8, "z", 5, "", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, node string, `x.y` double")
    kept = dedup(df)
    assert kept.columns == df.columns and sorted(r.row for r in kept.collect()) in ([1, 3, 4], [1, 3, 5])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert classes(df).count() == 0 and dedup(df).count() == 0
