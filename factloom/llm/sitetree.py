"""HTML extraction with site style trees.

The pages of a host are merged into one tree of element nodes, named by their path of tags and classes. Each node
counts the pages it is in (m), the styles it has there (the kinds of children) and the texts of its leaves.
- presentation importance: entropy of the styles, to the base m;
- content importance: 1 less the mean entropy of the texts over pages, ln(pages with it) / ln(m);
- composite importance: (1 - 0.9**k) of the first and 0.9**k of the mean of the leaves below, k being the kinds of children.
A branch is noise if its importance and that of all branches and texts of nodes below are under `LOW`; it is removed from each page, and so is a leaf
text whose own importance is under it. A node without nodes below has the content importance alone.
What the markup switches off is removed on any page: elements made for menus, page headers and footers, sidebars, notices, adverts, forms, comments,
scripts and styles, and those of which a class or id says so with all its words (`nav`, `cookie-notice`, but not `related-work`).
Of all other branches of hosts with two or more unlike pages the statistics decide, inside articles and content wrappers too; what the markup says
there only weighs as much as some pages (`WEIGHTS`): articles and wrappers 1, what lies outside a page's article 0, all else 1/2. So what is the same
on all pages goes from 7 of them in an article, from 3 on pages without, and what lies outside an article stays if it differs on 8 or more.
Branches of a single page are judged by the markup: where a page has an article, what lies outside goes, and all else stays.

What is left is decoded, white space inside a block becomes one space, and blocks are joined by line ends.

Defined cases: null html or url counts as empty; pages without a host are judged by their markup alone; equal pages
of a host count once; pages may be of any length and elements nest to any depth; a tag, comment, script or reference cut off by the end of the page is
dropped or stays text as browsers do it; importances at `LOW` are kept; repeated rows are extracted one by one; an empty table gives an empty one; of the
input's columns only page_id, url and html are read, so no others clash.
"""

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut

LOW, LEAST_PAGES, GAMMA = 0.25, 2, 0.9
#: How many pages the first importance weighs as much as, from what is outside of articles (0) to what is inside (1).
WEIGHTS = {0.0: 24, 0.5: 2, 1.0: 2}
#: With at most so many low nodes and texts (8 bytes each) the tasks get them all; beyond, blocks are joined with them.
SENT = 500_000

# Names from the HTML standard, and names that page authors give to parts of pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "select", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"ul", "ol", "dl", "table", "select", "menu"}
NOT_TEXT = set("head nav footer aside form search button select option optgroup input label menu dialog object embed svg math canvas audio video map fieldset legend datalist".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
NAMES = set(
    "nav navbar navigation menu menubar header masthead banner footer sidebar side aside ad ads advert adverts advertisement advertisements advertising adsense "
    "sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond "
    "discussion widget widgets toolbar skip copyright topbar".split()
)
#: Words that say nothing else beside one of these names.
BESIDE = set(
    "area article bar block blog body bottom box btn button buttons button bg card center col column container content desktop entry fixed float group header hidden id inner item items "
    "js left link links list lists main mobile module outer page panel post posts primary right row secondary section site slot small sticky story sub tab tabs text title top user "
    "reader view wrap wrapper xs sm md lg form forms banner".split()
)
ARTICLE_NAMES = set("comment comments reply replies ad ads advert advertisement sponsored promo related teaser".split())
CONTENT_NAMES = set("article content post entry story main articlebody".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z|[\"'][^>]*+(?:>|\Z))|</[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class _Open:
    """An element: `node` names its path of tags and classes on its host, `block` is the place of the nearest block around on the stack."""

    __slots__ = ("tag", "node", "up", "block", "kids", "off", "article", "content", "alive", "prior", "gone")

    def __init__(self, tag, node, up, block, off, article, content):
        self.tag, self.node, self.up, self.block, self.kids, self.off, self.article, self.content = tag, node, up, block, set(), off, article, content
        self.alive, self.prior, self.gone = True, None, None


def _says(tokens: list[list[str]], names: set[str]) -> bool:
    """Whether some class or id has one of `names`, and else words that say nothing."""
    return any(not names.isdisjoint(words) and all(w in names or w in BESIDE for w in words) for words in tokens)


def parse(html: str, host: str = ""):
    """(blocks, elements): the page's (owner, text, off, article, content, outside) in order, and all its elements.

    outside: the page has an article, and this block isn't in it. Work and memory grow with the page, however deep elements nest.
    """
    blocks, elements, buffer = [], [], []
    stack = [_Open("", xxhash.xxh64_intdigest(host), None, 0, False, False, False)]
    stack[0].gone = False
    # places on the stack of the open elements, by tag
    places: dict[str, list[int]] = {}
    last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)

    def flush():
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                o = stack[stack[-1].block]
                blocks.append((o, text, stack[-1].off or o.off, o.article, o.content))

    def close(at: int):
        while len(stack) > at or not stack[-1].alive:
            o = stack.pop()
            if o.alive:
                places[o.tag].pop()

    pos, n = 0, len(html)
    while pos < n:
        m = _TAG.search(html, pos)
        end = m.start() if m else n
        if end > pos and not stack[-1].off:
            buffer.append(unescape(html[pos:end]))
        if not m:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            at = last((tag,))
            if not at:
                continue
            if tag in BLOCK:
                flush()
                close(at)
            elif stack[-1].block > at:
                # it ends, but what is open inside stays open
                stack[at].alive = False
                places[tag].pop()
            else:
                if stack[at].off and not stack[at].up.off:
                    buffer.append(" ")
                close(at)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                at = last(("p",))
                if at and stack[-1].block == at:
                    close(at)
            at = last(SIBLINGS.get(tag, ()))
            if at > last(FENCES):
                close(at)
        if tag in VOID:
            continue
        attributes = {a.lower(): unescape(b or c or d) for a, b, c, d in _ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t\r") else {}
        tokens = [[x.lower() for x in _NAME.findall(token)] for key in ("class", "id") for token in attributes.get(key, "").split()]
        names = {x for words in tokens for x in words}
        role = attributes.get("role", "").lower()
        up = stack[-1]
        off = up.off or tag in NOT_TEXT or role in ROLES or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        if tag == "article":
            off = off or _says(tokens, ARTICLE_NAMES)
        elif tag not in ("html", "body", "main"):
            off = off or _says(tokens, NAMES) and not (up.article and tag in HEADINGS)
        if tag == "header":
            off = up.off or not up.article
        article = not off and (up.article or tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articleBody")
        content = article or not off and (up.content or _says(tokens, CONTENT_NAMES) and tag not in ("html", "body"))
        label = ".".join([tag, *sorted(names)])
        up.kids.add(label)
        if tag in RAW:
            closing = re.compile(f"</{re.escape(tag)}", re.I).search(html, pos)
            pos = closing.start() if closing else n
            gone = _TAG.match(html, pos)
            pos = gone.end() if gone else pos
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, xxhash.xxh64_intdigest(label, up.node), up, len(stack) if tag in BLOCK else up.block, off, article, content))
        elements.append(stack[-1])
    flush()
    has = any(b[3] for b in blocks)
    return [(*b, has and not b[3]) for b in blocks], elements


def host_of(url: str | None) -> str:
    head, mark, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if mark else ""


def _hash(*parts: str) -> int:
    """A signed 64-bit number; a text at a node is named by the exclusive or of both numbers."""
    return xxhash.xxh64_intdigest("\0".join(parts)) - 2**63


def _key(o: _Open) -> int:
    return o.node - 2**63


SEEN = T.StructType().add("page", "long")
for _name in ("node", "up", "style"):
    SEEN.add(_name, T.ArrayType(T.LongType()))
for _name in ("kids", "prior"):
    SEEN.add(_name, T.ArrayType(T.IntegerType()))
SEEN.add("leaf", T.ArrayType(T.LongType())).add("text", T.ArrayType(T.LongType())).add("outside", T.ArrayType(T.BooleanType()))


def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html) to a page's nodes with their parents, styles and first importance (1, 0 or -1 for none), and its texts with their nodes."""
    for batch in batches:
        out = [[] for _ in SEEN.names]
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = host_of(url)
            if not host or not html:
                continue
            blocks, elements = parse(html, host)
            texts: dict[tuple, bool] = {}
            for o, text, off, _, content, outside in blocks:
                if off:
                    continue
                key = (_key(o), _hash(text))
                texts[key] = texts.get(key, False) or outside
                prior = 0 if outside else 1 if content else -1
                while o and (o.prior is None or o.prior < prior):
                    o.prior, o = prior, o.up
            # node: parent, kinds of children, first importance
            nodes: dict[int, list] = {}
            for o in elements:
                if o.prior is not None:
                    x = nodes.setdefault(o.node, [_key(o.up) if o.up.up else None, set(), -1])
                    x[2] = max(x[2], o.prior)
            for o in elements:
                if o.node in nodes:
                    nodes[o.node][1].update(o.kids)
            row = (
                _hash(host, html), [a - 2**63 for a in nodes], [x[0] for x in nodes.values()], [_hash(*sorted(x[1])) for x in nodes.values()], [len(x[1]) for x in nodes.values()],
                [x[2] for x in nodes.values()], [leaf for leaf, _ in texts], [text for _, text in texts], list(texts.values()),
            )
            for to, x in zip(out, row, strict=True):
                to.append(x)
        types = [pa.int64()] + [pa.list_(pa.int64())] * 3 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], SEEN.names)


def _upward(tree: DataFrame, fold: dict) -> DataFrame:
    """(node, columns): each column of a forest (node, up, columns) folded over the node and all below, by `fold` (aggregate, of two).

    Steps double each round, so rounds grow with the log of the depth.
    """
    at = cut(tree)
    while not at.where("up is not null").isEmpty():
        lifted = at.where("up is not null").groupBy(F.col("up").alias("node")).agg(*(whole(c).alias(f"_{c}") for c, (whole, _) in fold.items()))
        ahead = at.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        both = at.join(lifted, "node", "left").join(ahead, "up", "left")
        at = cut(both.select("node", F.col("_up").alias("up"), *(F.when(F.col(f"_{c}").isNull(), F.col(c)).when(F.col(c).isNull(), F.col(f"_{c}")).otherwise(two(F.col(c), F.col(f"_{c}"))).alias(c) for c, (_, two) in fold.items())))
    return at.drop("up")


def low_branches(pages: DataFrame, low: float = LOW, least: int = LEAST_PAGES) -> DataFrame:
    """(key, low): hashes of nodes, and of nodes with texts, that are noise; and, with low false, of nodes outside articles that are not."""
    seen = cut(pages.select("url", "html").mapInArrow(observe, SEEN).dropDuplicates(["page"]))
    styled = seen.select(F.explode(F.arrays_zip("node", "up", "style", "kids", "prior")).alias("x"))
    held = F.when(F.col("x.prior") >= 0, F.col("x.prior"))
    styled = styled.groupBy("x.node", "x.style").agg(F.count("*").alias("c"), F.max("x.up").alias("up"), F.max("x.kids").alias("kids"), F.sum(held).alias("held"), F.count(held).alias("holds"))
    pages_of = styled.groupBy("node").agg(
        F.max("up").alias("up"), F.sum("c").alias("m"), F.max("kids").alias("k"), F.sum(F.col("c") * F.log("c")).alias("clogc"), (F.sum("held") / F.nullif(F.sum("holds"), F.lit(0))).alias("prior")
    )
    texts = cut(seen.select(F.explode(F.arrays_zip("leaf", "text", "outside")).alias("x")).groupBy(F.col("x.leaf").alias("node"), "x.text").agg(F.count("*").alias("c"), F.max("x.outside").alias("outside")))
    of_leaf = texts.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.log("c")).alias("logs"), F.max("outside").alias("outside"))
    tree = cut(pages_of.join(of_leaf, "node", "left"))
    add, most = (F.sum, lambda a, b: a + b), (F.max, F.greatest)
    whole = _upward(tree.select("node", "up", F.coalesce("n", F.lit(0)).alias("all"), F.coalesce("logs", F.lit(0.0)).alias("all_logs")), {"all": add, "all_logs": add})
    inner = tree.where("up is not null").select(F.col("up").alias("node"), F.lit(True).alias("inner")).distinct()

    prior = F.coalesce("prior", F.lit(0.5))
    weight = F.when(prior < 0.5, WEIGHTS[0.0] + (WEIGHTS[0.5] - WEIGHTS[0.0]) * prior * 2).otherwise(WEIGHTS[0.5] + (WEIGHTS[1.0] - WEIGHTS[0.5]) * (prior * 2 - 1))

    def weighed(x):
        return (prior * weight + x * F.col("m")) / (F.col("m") + weight)

    judged = tree.where(F.col("m") >= least).join(whole, "node").join(inner, "node", "left")
    content = 1 - F.col("all_logs") / (F.col("all") * F.log("m"))
    # entropy of the styles to the base m
    look = (F.log("m") - F.col("clogc") / F.col("m")) / F.log("m")
    keep = F.pow(F.lit(GAMMA), "k")
    composite = F.when(F.col("inner"), (1 - keep) * look + keep * content).otherwise(content)
    # a node's own texts count like a branch below it
    composite = F.greatest(composite, F.when(F.col("n") > 0, 1 - F.col("logs") / (F.col("n") * F.log("m"))))
    judged = cut(judged.select("node", "up", "m", "prior", "outside", weighed(composite).alias("importance")))
    best = _upward(judged.select("node", "up", "importance"), {"importance": most})
    nodes = best.join(judged.select("node", "outside"), "node").withColumn("low", F.col("importance") < low)
    own = texts.where(F.col("c") >= least).join(judged.select("node", "m", "prior"), "node")
    own = own.where(weighed(1 - F.log("c") / F.log("m")) < low)
    keys = nodes.where("low or outside").select(F.col("node").alias("key"), "low")
    return cut(keys.unionByName(own.select(F.col("node").bitwiseXOR(F.col("text")).alias("key"), F.lit(True).alias("low"))).distinct())


KEYS = T.StructType().add("row", "long").add("keys", T.ArrayType(T.LongType()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text, the main text, of each row of `pages` (page_id, url, html)."""
    told = low_branches(pages)
    rows = pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("row"))
    if told.count() <= SENT:
        found = told.collect()
        low, high = frozenset(r.key for r in found if r.low), frozenset(r.key for r in found if not r.low)

        @F.pandas_udf(T.StringType())
        def main_text(url, html):
            import pandas as pd

            return pd.Series([_text(host_of(u), h, low, high) for u, h in zip(url, html, strict=True)], dtype=object)

        return rows.select("page_id", "url", main_text("url", "html").alias("text"))

    # read twice below, with the same numbers
    rows = cut(rows)

    def keys_of(batches):
        for batch in batches:
            keys = [sorted(_keys(host_of(u), h)) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], KEYS.names)

    @F.pandas_udf(T.StringType())
    def told_text(url, html, low, high):
        import pandas as pd

        sets = lambda x: frozenset(() if x is None else x)
        return pd.Series([_text(host_of(u), h, sets(a), sets(b)) for u, h, a, b in zip(url, html, low, high, strict=True)], dtype=object)

    keys = rows.select("row", "url", "html").mapInArrow(keys_of, KEYS).select("row", F.explode("keys").alias("key"))
    hit = keys.join(told, "key").groupBy("row").agg(F.collect_list(F.when(F.col("low"), F.col("key"))).alias("low"), F.collect_list(F.when(~F.col("low"), F.col("key"))).alias("high"))
    return rows.join(hit, "row", "left").select("page_id", "url", told_text("url", "html", "low", "high").alias("text"))


def _keys(host: str, html: str | None) -> set[int]:
    """What low_branches may name on a page: nodes around texts, and nodes with texts."""
    keys: set[int] = set()
    if not host:
        return keys
    for o, text, off, *_ in parse(html or "", host)[0]:
        if not off:
            keys.add(_key(o) ^ _hash(text))
            while o.up and not o.gone:
                keys.add(_key(o))
                o.gone, o = True, o.up
    return keys


def _noise(o: _Open, low: frozenset) -> bool:
    """Whether an element or one around it is low; each element of a page is looked up once."""
    chain = []
    while o.gone is None:
        chain.append(o)
        o = o.up
    gone = o.gone
    for x in reversed(chain):
        gone = x.gone = gone or _key(x) in low
    return gone


def _text(host: str, html: str | None, low: frozenset, high: frozenset) -> str:
    kept = []
    for o, text, off, *_, outside in parse(html or "", host)[0]:
        if off or outside and _key(o) not in high:
            continue
        if not host or not (_noise(o, low) or _key(o) ^ _hash(text) in low):
            kept.append(text)
    return "\n".join(kept)
