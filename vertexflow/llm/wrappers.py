"""Main-text extraction by wrappers: union-free regular expressions inferred from pages of the same host.

A page is a stream of tags (with the words of class, id and role) and texts; inline tags belong to their text. A wrapper is the
expression that all pages of a host match: at each place tags, text slots, repeated groups (the same tag again and again) and
optional groups (only some pages have them). It is inferred by alignment: streams are nested by their tags, runs of one tag fold into a
repeated group, and the children of what two pages have in common are aligned by the longest common subsequence; what only one
side has becomes optional, a run on one side takes up single occurrences on the other, and a text that differs becomes a slot. A text that
never differs stays template text; so do the first and the last of a repeated group where they never differ. Slots count
their letters, in links and outside.

All pages take part: every task aligns its pages by host and hands on one wrapper per host, and these are aligned in two levels (first
within about the root of their number), so that a host with a third of all pages is no hot key. Pages of several templates
become optional groups of one wrapper.

A page is read by aligning it with its host's wrapper. Its main part is found by what slots hold on the host's pages on average:
from the body down into the one child that holds at least SHARE of what varies, without menus and the like; an article or main
element next to it breaks ties. Within the main part template texts are dropped (unless less than half of the host's texts are different ones: copies and near copies). A wrapper of
fewer than `least` pages knows too little: the page's own texts count as slots. Tags, roles and class names mark navigation, asides,
forms, adverts, notices and comments in any case, but a class name never hides what holds the only article, nor all text of a page.

Null html gives the empty text, as do pages without content. A page without a host in its url joins the pages of the empty host.
Repeated rows get equal rows and count as one page each for the wrapper; other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_rows, drop, lean, small_side, stash, text_map

_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>script|style)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|$)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Tags whose content isn't text of the page; without a closing tag they are ignored alone.
FOREIGN = set("noscript template textarea iframe svg math object select canvas".split())
#: Tags without a closing tag; tags that do not end a block of text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Tags that end an open paragraph; tags that end an open one of their kind.
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol dl table tbody thead".split())
#: Tags that hold blocks, so that the main part may lie in them.
HOLDERS = set("html body div section main article center table tbody tr td form".split())
#: Tags, roles and nouns of class or id that mark what isn't the article.
ASIDE_TAGS = set("nav aside footer form button menu dialog head title fieldset".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored banner promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations widget pagination pager toolbar copyright disclaimer".split()
)
CONTENT_WORDS = set("content post entry story article main maincontent articlebody".split())
#: Parts of compound names that say nothing after a noun; first parts that describe a state of something else.
TAILS = set("left right top bottom primary secondary box bar area wrapper container section list links buttons posts block inner outer wrap".split())
STATES = set("has is no with format layout".split())

#: A child that holds this share of what varies in its parent is where the main part lies.
SHARE = 0.6
#: Tags nested deeper than this are passed over, their texts belong to the last one within; parts of one label beyond MANY runs count as one run.
DEPTH, MANY = 120, 64
#: How many least digests estimate the number of different texts.
DIGESTS = 64


def tokens_of(html: str | None) -> list[tuple[str, str]]:
    """(kind and signature, text): '<name words', '</name' or 'T' with its decoded text."""
    out: list[tuple[str, str]] = []
    html, last, inside = html or "", {}, ""
    for m in _TOKEN.finditer(html):
        if m["name"]:
            name = m["name"].lower()
            if inside:
                inside = "" if m["close"] and name == inside else inside
                continue
            if name in FOREIGN:
                if not m["close"] and not m["attrs"].endswith("/"):
                    if name not in last:
                        last[name] = html.lower().rfind(f"</{name}")
                    inside = name if last[name] > m.start() else ""
                continue
            if m["close"]:
                out.append((f"</{name}", ""))
            else:
                named = sorted((k.lower(), v.strip("\"'")) for k, v in _ATTR.findall(m["attrs"])) if "=" in m["attrs"] else ()
                out.append((f"<{name}" + "".join(f" {k}={v}" for k, v in named), ""))
                if name not in VOID and m["attrs"].endswith("/") and name in ("p", "div", "span", "a"):
                    out.append((f"</{name}", ""))
        elif inside:
            continue
        elif m["text"] is not None:
            if out and out[-1][0] == "T":
                out[-1] = ("T", out[-1][1] + m["text"])
            elif m["text"].strip():
                out.append(("T", m["text"]))
            elif out and out[-1][0] != " ":
                out.append((" ", " "))
    return [(k, html_lib.unescape(t) if k == "T" else t) for k, t in out]


@lru_cache(20_000)
def marks(signature: str) -> tuple[str, bool, bool]:
    """(name, set apart by its tag or role, set apart by a noun of its class or id) of an opening tag."""
    name, _, rest = signature[1:].partition(" ")
    if name in ("html", "body"):
        return name, False, False
    attrs = dict(x.split("=", 1) for x in re.findall(r"(?:class|id|role)=.*?(?= (?:class|id|role)=|$)", rest))
    plain = re.sub(r"([a-z])([A-Z])", r"\1-\2", attrs.get("class", "") + " " + attrs.get("id", ""))
    content = against = False
    for word in plain.lower().split():
        parts = re.findall(r"[a-z]+", word)
        if not parts or len(parts) > 1 and parts[0] in STATES:
            continue
        while len(parts) > 1 and parts[-1] in TAILS:
            parts.pop()
        content |= len(parts) == 1 and parts[0] in CONTENT_WORDS
        against |= parts[-1] in ASIDE_WORDS and not (parts[-1] == "header" and CONTENT_WORDS & set(parts))
    return name, name in ASIDE_TAGS or attrs.get("role", "") in ASIDE_ROLES, against and not content and name not in ("article", "main")


@lru_cache(20_000)
def label_of(signature: str) -> str:
    """A signature whose numbers do not count: post-12 and post-13 are one place of a wrapper."""
    return re.sub(r"\d+", "#", signature[1:])


class Node:
    """A tag of a page with its parts, or a text (signature T): the places of its tokens, its letters, those in links, the number of links."""

    __slots__ = ("apart", "chars", "kids", "label", "links", "mass", "name", "of", "places", "text", "tied", "worded")

    def __init__(self, signature: str):
        self.kids: list[Node] = []
        self.of = None
        if signature == "T":
            self.name = self.label = "T"
            self.apart = self.worded = False
            self.places, self.chars, self.tied, self.links, self.text = [], 0, 0, 0, []
        else:
            self.name, self.apart, self.worded = marks(signature)
            self.label = label_of(signature)


def nested(tokens: list[tuple[str, str]]) -> Node:
    """The tokens of a page as a tree; missing end tags are implied as browsers do."""
    root = Node("<html")
    stack, links, opened = [root], 0, False
    for at, (k, text) in enumerate(tokens):
        top = stack[-1]
        if k == "T":
            if not top.kids or top.kids[-1].name != "T":
                top.kids.append(Node("T"))
            leaf, plain = top.kids[-1], " ".join(text.split())
            leaf.places.append(at)
            leaf.text.append(plain)
            leaf.chars += len(plain)
            leaf.tied += len(plain) if links else 0
            leaf.links += opened
            opened = False
        elif k[0] == "<" and k[1] != "/":
            name = k[1:].split(" ", 1)[0]
            if name in INLINE or name in VOID:
                if name == "a":
                    links, opened = links + 1, True
                continue
            if name == "html" or name == "body" and any(n.name == "body" for n in stack):
                continue
            if name == "body":
                del stack[1:]  # an unclosed head ends here
            if name in ENDS_P and stack[-1].name == "p":
                stack.pop()
            if name in ENDS_OWN:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in ENDS_OWN[name]:
                        del stack[i:]
                    elif stack[i].name in LISTS:
                        break
            if len(stack) < DEPTH:
                node = Node(k)
                stack[-1].kids.append(node)
                stack.append(node)
        elif k[0] == "<":
            name = k[2:]
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
    _shape(root)
    return root


def _shape(node: Node) -> None:
    """Plain holders without class, id and role are told apart by what they begin with: a tag, a text, links alone."""
    for k in node.kids:
        _shape(k)
    if node.label in HOLDERS and node.label not in ("html", "body") and node.kids:
        tags = [k.name for k in node.kids if k.name != "T"]
        node.label += ":" + (tags[0] if tags else "links" if all(k.chars == k.tied for k in node.kids) else "text")


# --- wrappers: [label, pages that have it, repeated, children, slot]; a slot is [letters, of these in links, first, last, occurrences], ---
# --- first and last the digests of texts that never differ, else 0. A repeated group's slot has the digests of its ends ----------------------


def _digest(node: Node) -> int:
    """Of all text below."""
    parts, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.name == "T":
            parts += n.text
        todo += reversed(n.kids)
    return xxhash.xxh64_intdigest("\n".join(parts)) >> 11 or 1


def runs(kids: list) -> list[list]:
    """Runs of parts with one label; of very many runs those with one label are one."""
    out: list[list] = []
    for n in kids:
        if out and out[-1][0].label == n.label:
            out[-1].append(n)
        else:
            out.append([n])
    if len(out) <= MANY:
        return out
    by: dict[str, list] = {}
    for n in kids:
        by.setdefault(n.label, []).append(n)
    return list(by.values())


def expression(run: list[Node]) -> list:
    """The wrapper of one page's run."""
    if run[0].name == "T":
        first = last = _digest(run[0])
        return ["T", 1, 0, [], [run[0].chars, run[0].tied, first, last, 1]]
    kids: list = []
    for n in run:
        own = [expression(r) for r in runs(n.kids)]
        kids = _aligned(kids, own, True) if kids else own
    many = int(len(run) > 1)
    slot = [0, 0, _digest(run[0]), _digest(run[-1]), len(run)] if many else [0, 0, 0, 0, 1]
    return [run[0].label, 1, many, kids, slot]


def merged(a: list, b: list, same_page: bool = False) -> list:
    """The wrapper that matches what either matches."""
    x, y = a[4], b[4]
    if same_page:  # further occurrences of a run on one page
        return [a[0], max(a[1], b[1]), a[2] | b[2], _aligned(a[3], b[3], True), [x[0] + y[0], x[1] + y[1], 0, 0, x[4] + y[4]]]
    first, last = (x[2] if x[2] == y[2] else 0), (x[3] if x[3] == y[3] else 0)
    return [a[0], a[1] + b[1], a[2] | b[2], _aligned(a[3], b[3], False), [x[0] + y[0], x[1] + y[1], first, last, x[4] + y[4]]]


def pairs(a: list[str], b: list[str]):
    """Places of a longest common subsequence, and of what only one side has: (i, j), (i, None), (None, j) in order."""
    if a == b:
        yield from zip(range(len(a)), range(len(b)))
        return
    for what, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if what == "equal":
            yield from zip(range(i, j), range(k, m))
        else:
            yield from ((x, None) for x in range(i, j))
            yield from ((None, y) for y in range(k, m))


def _aligned(a: list, b: list, same_page: bool) -> list:
    out: list = []
    for i, j in pairs([n[0] for n in a], [n[0] for n in b]):
        new = merged(a[i], b[j], same_page) if i is not None and j is not None else a[i] if j is None else b[j]
        out.append(new)
    if len(out) <= 2 * MANY:
        return out
    by: dict[str, list] = {}
    for n in out:
        by[n[0]] = merged(by[n[0]], n, True) if n[0] in by else n
    return list(by.values())


def wrapper_of(html: str | None) -> list:
    """The wrapper of one page, followed by the number of its texts outside links and the least digests of them."""
    root = nested(tokens_of(html))
    texts = [_digest(x) for x in _leaves(root) if x.chars > x.tied]
    return [*expression([root]), [len(texts), sorted(set(texts))[:DIGESTS]]]


def joined(a: list, b: list) -> list:
    """The wrapper of two sets of pages."""
    return [*merged(a, b), [a[5][0] + b[5][0], sorted({*a[5][1], *b[5][1]})[:DIGESTS]]]


def mostly_copies(w: list) -> bool:
    """Whether less than half of the texts are different ones: copies and near copies, whose common texts are no template."""
    total, least = w[5]
    distinct = len(least) if len(least) < DIGESTS else (DIGESTS - 1) / (least[-1] / 2**53)
    return 2 * distinct < total


def infer(pages: list[str]) -> list | None:
    """The wrapper of the pages of one host."""
    out = None
    for page in pages:
        own = wrapper_of(page)
        out = own if out is None else joined(out, own)
    return out


def groups(wrapper: list) -> tuple[int, int]:
    """Optional and repeated groups of a wrapper."""
    optional = repeated = 0
    for kid in wrapper[3]:
        o, r = groups(kid)
        optional += o + (kid[1] < wrapper[1])
        repeated += r + kid[2]
    return optional, repeated


# --- reading ----------------------------------------------------------------------------------------


def _meet(run: list[Node], w: list | None, fixed: bool) -> None:
    """Gives each part of a run the wrapper's node, and each text its mass: what varies there on average, without links (fixed: what never differs, too)."""
    for n in run:
        n.of = w
        if n.name == "T":
            n.mass = n.chars - n.tied if w is None else 0.0 if w[4][2] and not fixed else (w[4][0] - w[4][1]) / w[4][4]
            continue
        own = runs(n.kids)
        for i, j in pairs([r[0].label for r in own], [k[0] for k in w[3]] if w else []):
            if i is not None:
                _meet(own[i], None if j is None else w[3][j], fixed)


def _leaves(node: Node) -> list[Node]:
    return [node] if node.name == "T" else [x for k in node.kids for x in _leaves(k)]


def _find(node: Node, test, out: list | None = None) -> list[Node]:
    """The outermost nodes that meet a test."""
    out = [] if out is None else out
    for k in node.kids:
        if test(k):
            out.append(k)
        else:
            _find(k, test, out)
    return out


def _linked(node: Node) -> bool:
    """Whether the texts of a block are two links or more and nothing else."""
    leaves = _leaves(node)
    return sum(x.links for x in leaves) > 1 and all(x.chars == x.tied for x in leaves)


def _template(run: list[Node], known: bool) -> set[int]:
    """Those of a run, by place, that no page of the host has otherwise."""
    w = run[0].of
    if not known or w is None or w[1] < 2:
        return set()
    out = set()
    if run[0].name == "T":
        return {0} if w[4][2] and w[4][2] == _digest(run[0]) else out
    if w[2] and w[4][2] and w[4][2] == _digest(run[0]):
        out.add(0)
    if w[2] and w[4][3] and w[4][3] == _digest(run[-1]):
        out.add(len(run) - 1)
    return out


def content(root: Node, known: bool, words: bool) -> list[Node]:
    """The texts of the main part."""
    inside = {"article", "main"}
    outer = _find(root, lambda n: n.name in inside and not n.apart)

    def hidden(n: Node, within: bool) -> bool:
        if n.apart or n.name == "header" and not within:
            return True
        if not (words and n.worded):
            return False
        held = [x for x in outer if x is n or x in set(_find(n, lambda k: k.name in inside))]
        return not held or len(held) < len(outer)  # a class name never hides the only articles

    def weigh(n: Node, within: bool = False) -> float:
        """Mass without what is hidden."""
        if n.name == "T":
            return n.mass
        within = within or n.name in inside
        n.mass = sum(0.0 if hidden(k, within) else weigh(k, within) for k in n.kids)
        return n.mass

    def shown(n: Node, test) -> list[Node]:
        out = []
        for k in n.kids:
            if not hidden(k, n.name in inside):
                out += [k] if test(k) else shown(k, test)
        return out

    weigh(root)
    main, below = root, True
    while below:
        below = [k for k in main.kids if k.name in HOLDERS and not hidden(k, main.name in inside) and k.mass >= SHARE * main.mass > 0]
        main = max(below, key=lambda k: k.mass) if below else main
    for name in ("article", "main"):
        told = shown(root, lambda n: n.name == name)
        mass = sum(n.mass for n in told)
        if told and (2 * mass >= main.mass or any(main is x for n in told for x in _find(n, lambda k: k is main))):
            return [x for n in told for x in _texts(n, hidden, known, True)]
    return _texts(main, hidden, known, main.name in inside)


def _texts(main: Node, hidden, known: bool, told: bool) -> list[Node]:
    kept: list[Node] = []

    def walk(n: Node, within: bool) -> None:
        within = within or n.name in ("article", "main")
        for run in runs(n.kids):
            gone = _template(run, known)
            for k, part in enumerate(run):
                if hidden(part, within) or not told and part.name != "T" and _linked(part):
                    continue
                if k in gone:
                    continue
                if part.name == "T":
                    if told or not (part.links > 1 and part.chars == part.tied):
                        kept.append(part)
                else:
                    walk(part, within)

    walk(main, False)
    return kept


def blocks(tokens: list[tuple[str, str]], keep: set[int]) -> str:
    """The kept texts: one line per block, white space within it as one space."""
    lines, line = [], []
    for at, (k, text) in enumerate(tokens):
        if k[0] == "<":
            if k.lstrip("</").split(" ")[0] not in INLINE:
                lines.append("".join(line))
                line = []
        elif k == " ":
            line.append(" ")
        elif at in keep:
            line.append(text)
    lines.append("".join(line))
    return "\n".join(x for x in (" ".join(s.split()) for s in lines) if x)


def read(html: str | None, wrapper: list | None, least: int = 3) -> tuple[str, bool]:
    """(main text, whether the wrapper decided)."""
    tokens = tokens_of(html)
    root = nested(tokens)
    known = wrapper is not None and wrapper[1] >= least
    copies = known and mostly_copies(wrapper)
    _meet([root], wrapper if known else None, copies)
    found: list[Node] = []
    for words, templates in ((True, known and not copies), (False, known and not copies), (False, False)):
        found = content(root, templates, words)
        if found:
            break
    return blocks(tokens, {at for leaf in found for at in leaf.places}), known


@lru_cache(500)
def _loaded(text: str | None):
    return json.loads(text) if text else None


def hosts_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(keyed: DataFrame, held: int = 20_000) -> DataFrame:
    """(host, wrapper) of all pages (host, html). A task holds about `held` tags of wrappers before it hands them on."""
    schema = pa.schema([("host", pa.string()), ("part", pa.int64()), ("wrapper", pa.string())])
    kinds = "host string, part long, wrapper string"

    def partial(batches):
        from pyspark import TaskContext

        part, known, size = TaskContext.get().partitionId(), {}, 0
        for hosts, htmls in arrow_rows(batches, "host", "html"):
            for host, html in zip(hosts, htmls):
                if html is None:
                    continue
                own = wrapper_of(html)
                if host in known:
                    known[host] = joined(known[host], own)
                else:
                    known[host], size = own, size + len(own[3])
                size += 1
            if size > held:
                yield arrow_batch(schema, list(known), [part] * len(known), [json.dumps(w) for w in known.values()])
                known, size = {}, 0
        if known:
            yield arrow_batch(schema, list(known), [part] * len(known), [json.dumps(w) for w in known.values()])

    def together(batches):
        """Rows sorted by host: one wrapper of each run of rows of one host."""
        for batch in batches:
            out: dict = {}
            for host, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
                own = json.loads(text)
                out[host] = joined(out[host], own) if host in out else own
            yield arrow_batch(schema, list(out), [0] * len(out), [json.dumps(w) for w in out.values()])

    first = stash(keyed.select("host", "html").mapInArrow(lean(partial), kinds), "partial-wrappers")
    parts = max(1, int(first.agg(F.max("part")).first()[0] or 0) + 1)

    def fit(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(together([b for b in table.combine_chunks().to_batches()])) or [], schema=schema)

    some = first.groupBy("host", F.pmod("part", F.lit(max(1, int(parts**0.5))))).applyInArrow(fit, kinds)
    done = stash(some.groupBy("host").applyInArrow(fit, kinds).select("host", "wrapper"), "wrappers")
    drop(first)
    return done


def extract(pages: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars, by_wrapper) of every page; by_wrapper: whether the wrapper of its host decided."""
    keyed = pages.select("page_id", "url", "html", hosts_of("url").alias("host"))
    found = small_side(wrappers(keyed), "host-wrappers")
    schema = pa.schema([("text", pa.string()), ("by_wrapper", pa.bool_())])
    done = keyed.join(found, "host", "left").withColumn("_read", text_map(lambda: lambda html, w: read(html, _loaded(w), least), schema, "html", "wrapper"))
    return done.select("page_id", "url", F.col("_read.text").alias("text"), F.length("_read.text").cast("long").alias("n_chars"), F.col("_read.by_wrapper").alias("by_wrapper"))
