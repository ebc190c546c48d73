import math
import random
from collections import Counter, defaultdict

from factloom.llm import sitetree
from factloom.llm.sitetree import extract, low_branches, parse

MENU = '<div class="x1"><span>Home</span> <span>News</span></div>'


def page(i, body):
    return f"<html><head><title>t{i}</title></head><body>{MENU}<div class='b2'>{body}</div><div class='x3'><p>All rights reserved, {i % 2}</p></div></body></html>"


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_markup_alone():
    html = """<!DOCTYPE html><header>h</header><nav>n</nav><article><header><h1>T</h1></header><p>a &lt;b&gt;&nbsp;c<br>d <b>e</b>f<!-- x > y -->
    <aside>no</aside><script>if (a < b) "</p>"</script><p>g<div class="comments">z</div><ul><li>1<li>2</ul><form>q<p>w</form></article><div id="cookie-notice">c</div><footer>f</footer>"""
    assert [b[1] for b in parse(html)[0] if not b[2]] == ["T", "a <b> c d ef", "g", "1", "2"]
    for broken in ("", "<", "<p", "<!--", "<script>x", "<p>a<b", "a & b &amp", "</p></div>", "<a title=\"x>y", "<" * 500, "<div>" * 3000 + "deep"):
        parse(broken)
    assert parse("a &amp b &am")[0][0][1] == "a & b &am"
    assert parse("x" + "<div>" * 3000 + "deep")[0][-1][1] == "deep"


def test_depth_changes_nothing():
    for depth in (3, 250, 20_000):
        down, up = "<div>" * depth, "</div>" * depth
        html = f"<div class='x1'><article><p>a</p>{down}b<nav>n</nav><div class='ad'>s</div><form>f</form>{up}<p>c</p></article></div><nav>m</nav>"
        assert [b[1] for b in parse(html)[0] if not b[2]] == ["a", "b", "c"]
        # unclosed inline tags in one block
        html = f"<article><p>a{'<font>' * depth}<nav>n</nav>b<p>c</p></article><div>d</div>"
        assert [b[1] for b in parse(html)[0] if not b[2] and not b[5]] == ["a", "b", "c"]


def test_names_say_it_with_all_their_words():
    kept = ["share-holders", "side-by-side", "product-menu", "related-work", "footerless", "commentary", "advertisement-history", "story"]
    gone = ["share", "cookie-notice", "navBar", "site-footer", "x related", "comment-list", "ad_slot", "post-comments", "sidebar-right"]
    html = "<article>{}</article>".format("".join(f"<div class='{c}'>{c}</div><section id='{c}'>{c}</section>" for c in kept + gone))
    assert [b[1] for b in parse(html)[0] if not b[2]] == [c for c in kept for _ in (1, 2)]


def test_importances_equal_brute_force(spark):
    """Entropies over the pages of a host, recomputed from the parsed pages."""
    rng = random.Random(4)
    kinds = ["<div class='{k}'><p>{t}</p></div>", "<section><div class='{k}'>{t}<span>s</span></div></section>", "<ul class='{k}'><li>{t}<li>{u}</ul>"]
    df = []
    for host, n in (("a.org", 2), ("b.org", 5), ("c.org", 9), ("d.org", 30)):
        for i in range(n):
            parts = [rng.choice(kinds).format(k="k" + c, t=rng.choice(["same", "same", f"own {i}", f"of {i % 3}"]), u=f"x{i % 4}") for c in rng.sample("qrstvwxyz", 5)]
            html = "".join(parts[:3]) + ("<article>" + "".join(parts[3:]) + f"<p>{i}</p></article>" if rng.random() < 0.6 else "".join(parts[3:]))
            df.append((len(df), f"http://{host}/{i}", html + f"<div class='kout'>{i}</div>"))
    df += df[:3]
    want = set()
    for host in {u.split("/")[2] for _, u, _ in df}:
        nodes, found = defaultdict(lambda: {"m": 0, "styles": Counter(), "prior": [], "kids": set(), "up": None, "texts": Counter(), "outside": False}), set()
        for html in {h for _, u, h in df if u.split("/")[2] == host}:
            blocks, elements = parse(html, host)
            first, page, text = {}, {}, {}
            for o, t, off, _, content, outside in blocks:
                assert not off
                text[(o.node, t)] = text.get((o.node, t), False) or outside
                while o.up is not None:
                    first[o.node] = max(first.get(o.node, -1), 0 if outside else 1 if content else -1)
                    o = o.up
            for o in elements:
                if o.node in first:
                    page.setdefault(o.node, set()).update(o.kids)
                    nodes[o.node]["up"] = o.up.node if o.up.up else None
            for k, kids in page.items():
                x = nodes[k]
                x["m"] += 1
                x["styles"][frozenset(kids)] += 1
                x["prior"] += [first[k]] if first[k] >= 0 else []
            for (k, t), outside in text.items():
                nodes[k]["texts"][t] += 1
                nodes[k]["outside"] |= outside
        kids = {k: [j for j in nodes if nodes[j]["up"] == k] for k in nodes}
        below = lambda k: [nodes[k], *(x for j in kids[k] for x in below(j))]
        importance = {}
        for k, x in nodes.items():
            m = x["m"]
            if m < 2:
                continue
            prior = sum(x["prior"]) / len(x["prior"]) if x["prior"] else 0.5
            weight = 24 - 44 * prior if prior < 0.5 else 2
            weighed = lambda v: (prior * weight + v * m) / (m + weight)  # noqa: B023, E731
            surprise = lambda counts: sum(1 - math.log(c) / math.log(m) for c in counts) / len(counts)  # noqa: B023, E731
            content = surprise([c for y in below(k) for c in y["texts"].values()])
            look = -sum(c / m * math.log(c / m, m) for c in x["styles"].values())
            keep = 0.9 ** max(map(len, x["styles"]))
            value = (1 - keep) * look + keep * content if kids[k] else content
            value = max(value, surprise(list(x["texts"].values()))) if x["texts"] else value
            importance[k] = weighed(value)
            found |= {((k - 2**63) ^ sitetree._hash(t), True) for t, c in x["texts"].items() if c >= 2 and weighed(1 - math.log(c) / math.log(m)) < sitetree.LOW}
        best = lambda k: max([importance.get(k, -1), *map(best, kids[k])])
        want |= found | {(k - 2**63, best(k) < sitetree.LOW) for k in importance if best(k) < sitetree.LOW or nodes[k]["outside"]}
    got = {(r.key, r.low) for r in low_branches(spark.createDataFrame(df, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want and len({low for _, low in got}) == 2 and len(got) > 20


def rows():
    out = [(i, f"http://site.org/{i}", page(i, f"<p>Story {i} begins</p><p>and ends {i}</p>")) for i in range(30)]
    out += [(100 + i, f"http://small.org/{i}", page(i, f"<p>Small {i}</p>")) for i in range(3)]
    out += [(200 + i, "http://copies.org/x", page(0, "<p>the same</p>")) for i in range(20)]
    return out + [(300, None, page(1, "<p>no url</p>")), (301, "http://site.org/none", None), (302, "http://site.org/e", ""), (303, "x", "<article>" + "word " * 50_000)]


def test_repeated_branches_go(spark):
    df = spark.createDataFrame([(*r, "t") for r in rows()], "page_id long, url string, html string, text string").repartition(3)
    got = texts(extract(df))
    assert got[3] == "Story 3 begins\nand ends 3"
    assert got[101] == "Small 1\nAll rights reserved, 1"  # what differs between three pages stays
    assert got[205].split("\n")[1] == "the same" and got[300].split("\n")[1] == "no url"
    assert got[301] == got[302] == "" and len(got[303]) == 250_000 - 1


def test_joined_form_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    assert low_branches(df).count() > 0
    want = texts(extract(df))
    monkeypatch.setattr(sitetree, "SENT", -1)
    assert texts(extract(df)) == want


def in_articles(n, host):
    """A wrapper and an article with a share bar, a notice and a text of its own, and a line outside the article."""
    bar = '<div class="z1"><span>Send</span> <span>Print</span></div><div class="z2"><div class="z4"><p>Read more here</p></div></div>'
    body = '<div id="content"><article><h1>Title {i}</h1>%s<p>Body {i}</p>%s</article><div class="z3"><p>Under {i}</p><p>The same</p></div></div>' % (bar, "<p>Always so</p>")
    return [(i, f"http://{host}/{i}", "<body>" + body.replace("{i}", str(i)) + "</body>") for i in range(n)]


def test_statistics_decide_inside_articles(spark, monkeypatch):
    rows = in_articles(20, "many.org") + [(100 + i, *r) for i, *r in in_articles(4, "few.org")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for sent in (sitetree.SENT, -1):
        monkeypatch.setattr(sitetree, "SENT", sent)
        got = texts(extract(df))
        assert all(got[i] == f"Title {i}\nBody {i}\nUnder {i}" for i in range(20))
        # too few pages: by the markup
        assert all(got[100 + i] == f"Title {i}\nSend Print\nRead more here\nBody {i}\nAlways so" for i in range(4))


def test_uniform_pages_keep_their_articles(spark):
    kinds = [f"<{t} class='{c}q'>{t} {{i}} {c}</{t}>" for t in ("p", "div", "section") for c in "klmnopqrst"]
    rows = [(i, f"http://same.org/{i}", "<article>" + "".join(kinds).replace("{i}", str(i)) + "</article>") for i in range(12)]
    got = texts(extract(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert all(len(got[i].split("\n")) == 30 for i in range(12))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(df).count() == 0
