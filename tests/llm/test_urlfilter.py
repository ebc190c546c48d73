import random
import re

from factloom.llm.queries import URL_RULES
from factloom.llm.urlfilter import judge


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    size, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def urls():
    rng = random.Random(4)
    hosts = ["example.org", "a.example.org", "org", "x.com", "WWW.Example.ORG", "notexample.org", "com", "y.z.x.com", "É.org", "", "a..org", "net"]
    paths = ["", "/", "/es/1", "/en/1", "/en/12?q=/fr/", "/fr/x#y", "/de/", "/d", "#/es/", "?x"]
    out = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + ["http://hot.com/fr/1"] * 300
    return out + [None, "", "no scheme", "://", "a://b://c/d", "https://example.org/es/" + "x" * 50_000, "http://" + "a." * 5000 + "org/es"]


def check(spark, rules):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        assert got[i] == brute(u, rules), u


def test_contract_rules(spark):
    check(spark, URL_RULES)


def test_many_nested_rules(spark):
    rng = random.Random(7)
    hosts = ["org", "example.org", "a.example.org", "com", "x.com", "z.x.com", "y.z.x.com", "net"]
    rules = {(rng.choice(hosts), rng.choice(["", "/", "/e", "/es/", "/en/1", "/fr/", "/d", "/de/"])): rng.choice(["allow", "block"]) for _ in range(60)}
    check(spark, [(h, p, v) for (h, p), v in rules.items()])


def test_null_rules_and_clashing_columns(spark):
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", 1, "k"), (None, "http://a.org/x", None, None, None)], "page_id long, url string, rule string, row int, key string")
    assert {(r.page_id, r.rule, r.verdict) for r in judge(pages, rules).collect()} == {(1, "org/", "allow"), (None, "org/", "allow")}


def test_empty_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert judge(pages.where("false"), rules).count() == 0
    assert [r.verdict for r in judge(pages, rules.where("false")).collect()] == ["allow"]
