"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree: a node is the path of block elements,
with their classes and ids, that leads to an element, and the style nodes that hold text
are its leaves. A leaf's importance is the product of three parts, over the different pages of
the host that have it:

* presentation: the share of these pages on which nothing of how the element is presented
  speaks against it. Against it are elements and roles of navigation, page headers and
  footers, side columns, forms and hidden parts, class and id names of such parts, lists of
  links outside an article, and standing outside an article that holds most of a page;
* form: one, less the cube of the share of its text that is links (two or more of them, outside articles
  and headings) where its style, the sequence of its blocks' inline parts, has no entropy. So what is links of
  one form on each page goes whatever its name and words are; some pages of other form are added, so that few pages prove little;
* content: the entropy of what it says, relative to that of as many different texts, with
  one page more that says something new, so that few pages prove little.

The importance of an inner node is the mean over the leaves below it, weighted by pages. A node
is noisy if every leaf at and below it is low by presentation and form, and the branches of noisy nodes are removed
from each page of the host; of leaves that are low for their content alone only what is
repeated goes, so that a page's own text stays. Pages that share their body count as one.

The tree is never in one place. Pages give a row per leaf, which are counted by
(host, leaf, text) and then by (host, leaf) with partial sums before they move, so a
host with a third of all pages is a few rows for each task. Only the removed branches and
repeated texts of a host go back to its pages, broadcast if they are few, else dealt by host and
a salt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut_lineage

MIN_IMPORTANCE = 0.15
MIN_PRESENTED = 0.5
PRIOR_PAGES = 1.0
PRIOR_FORMS = 4.0
MENU_LINKS = 2
SALTS = 16
BROADCAST_ENTRIES = 500_000  # 8 bytes each
MIN_SHARE = 0.01  # of a node's pages, which bounds the texts taken out of a node by 100
BODY_CHARS = 200

# Names of HTML elements and of what page parts are usually called.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("noscript template textarea iframe svg math canvas object audio video xmp".split())  # besides script and style
FLAT = frozenset("textarea xmp".split())  # up to the first close tag, whatever stands between
SKIPPED = frozenset("head nav footer aside menu dialog button select title".split())
FORMS = frozenset("form fieldset".split())
WHOLE = frozenset("html body main article".split())
NEVER = frozenset("nav footer aside title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer sidebar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login register share sharing social "
    "related recommended comment comments respond disqus reply replies pagination pager search widget toolbar hidden skip".split()
)
GENERIC_NAMES = frozenset(
    "area bar block body bottom box button center column container content count display footer form global group head header holder html inner item items label left link links list main message meta "
    "module nav outer page panel post posts right row section site slot text title top unit view wrap wrapper zone".split()
)
LEAD_NAMES = frozenset("lead lede intro introduction standfirst dek deck summary abstract excerpt subtitle subheading headline title".split())
HEADER_NAMES = frozenset("header masthead topbar".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

# What speaks against an element: its names, something weak (a form, or a name that says more than
# such a part's), or anything else. The first two give way in an element that holds an article or
# main; what is weak also gives way where it holds most of a page.
NAMED, WEAK, RULED = 1, 2, 4
OUTSIDE = "/~outside"

_SKIP = r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
_RAW = re.compile(rf"{_SKIP}|<(/?)({'|'.join(sorted(RAW))})(?=[\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)", re.S | re.I)
_TOKEN = re.compile(
    rf"{_SKIP}|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_LIST = re.compile(r"/li(?=[./]|\Z)")
_HEADING = re.compile(r"/h[1-6](?=[./]|\Z)")
_INSIDE = re.compile(r"/(?:article|main)(?=[./]|\Z)")
_NAME = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"\d+")


def _presented(tag: str, attributes: str, inside: bool) -> tuple[str, int]:
    """The element's label in a style path, and what of its presentation speaks against it (NAMED, WEAK, RULED; 0: nothing)."""
    label, out = tag, WEAK if tag in FORMS else RULED if tag in SKIPPED else NAMED if tag == "header" and not inside else 0
    if attributes and attributes.strip(" /"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), unescape(a or b or c).lower()
            if name in ("class", "id"):
                words = _NAME.findall(value)
                for one in value.split():
                    own = {w for w in _NAME.findall(one) if not w.isdigit()}
                    of_parts = own & (SKIPPED_NAMES if inside else SKIPPED_NAMES | HEADER_NAMES)
                    if of_parts:
                        out |= NAMED if own <= of_parts | GENERIC_NAMES else WEAK
                label += "." + ".".join(sorted(_DIGITS.sub("0", w) for w in words))
            elif name == "role" and value in SKIPPED_ROLES:
                out |= WEAK if value == "form" else RULED
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                out |= RULED
    return label, out & RULED if tag in WHOLE else out


def raw_ends(html: str) -> dict[int, int]:
    """Where each raw element but script and style ends, by its start; the unclosed ones are left out.

    Nested elements are matched inside out; a self-closed svg or math tag is a whole element.
    """
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _RAW.finditer(html):
        tag = (m[3] or "").lower()
        starts = opened.setdefault(tag, [])
        if not tag:
            continue
        if m[2]:
            if starts:
                ends[starts[0] if tag in FLAT else starts[-1]] = m.end()
                starts[:] = [] if tag in FLAT else starts[:-1]
        elif tag in ("svg", "math") and m[4].endswith("/>"):
            ends[m.start()] = m.end()
        else:
            starts.append(m.start())
    return ends


class Block(NamedTuple):
    """A block with text: its style path and text, whether presentation speaks against it, and whether it is inside an article or main, or an element of ``NEVER``.

    ``style`` has its inline parts in order (text outside links as ``-``), ``linked`` the characters in its links without white space, and ``links`` their number.
    """

    path: str
    text: str
    out: bool
    inside: bool
    never: bool
    style: str = ""
    linked: int = 0
    links: int = 0


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    blocks: list[tuple[str, str, bool, bool, bool, int, str, int, int]] = []  # path, text, links of a list, inside, in NEVER, element, style, linked, links
    stack: list[tuple[str, str, bool, bool, int]] = []  # tag, path, inside article or main, in NEVER, element
    above, ruled, holds = [0], [0], [True]  # of each element: its parent, what rules it out, whether it holds an article or main
    words: list[str] = []
    style: list[str] = []
    linked = total = links = solid = 0

    def flush() -> None:
        nonlocal linked, total, solid
        if words:
            text = " ".join("".join(words).split())
            if text:
                _, path, inside, never, element = stack[-1] if stack else ("", "", False, False, 0)
                blocks.append((path, text, not inside and linked > 0.8 * total and bool(_LIST.search(path)), inside, never, element, " ".join(style), solid, style.count("a")))
        words.clear()
        style.clear()
        linked = total = solid = 0

    def close(index: int) -> None:
        flush()
        del stack[index:]

    at = 0
    ends: dict[int, int] | None = None
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            piece = unescape(html[at : m.start()])
            words.append(piece)
            total += len(piece)
            if links:
                linked += len(piece)
                solid += len("".join(piece.split()))
            elif (not style or style[-1] != "-") and not piece.isspace():
                style.append("-")
        at = m.end()
        tag, attributes, closing = (m[3], m[4], m[2]) if m[3] else (m[6], m[7], m[5])
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing:
                ends = raw_ends(html) if ends is None else ends
                at = ends.get(m.start(), at)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag in ("br", "wbr"):
                words.append(" " if tag == "br" else "")
            if not closing and tag != "wbr":
                style.append(tag)
            continue
        links = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                flush()
            continue
        flush()
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0] == "p":
                    close(i)
                    break
        for same in SIBLINGS.get(tag, ()):
            if stack and stack[-1][0] == same:
                close(len(stack) - 1)
        if tag == "body":
            for i, open_ in enumerate(stack):
                if open_[0] == "head":
                    close(i)
                    break
        if tag in VOID:
            continue
        _, path, inside, never, element = stack[-1] if stack else ("", "", False, False, 0)
        label, out = _presented(tag, attributes, inside)
        if tag in ("article", "main"):
            inside, up = True, element
            while not holds[up]:
                holds[up] = True
                up = above[up]
        above.append(element)
        ruled.append(out)
        holds.append(False)
        stack.append((tag, f"{path}/{label}", inside, never or tag in NEVER, len(above) - 1))
    if at < len(html):
        words.append(unescape(html[at:]))
        total += len(html) - at
    flush()
    for i in range(1, len(above)):
        ruled[i] = ruled[above[i]] | (ruled[i] & RULED if holds[i] else ruled[i])
    outs = [ruled[b[5]] | (RULED if b[2] else 0) for b in blocks]
    size = {why: sum(len(b[1]) for b, out in zip(blocks, outs, strict=True) if out == why) for why in (0, WEAK)}
    if size[WEAK] > size[0]:
        outs = [out & ~WEAK for out in outs]
    found = [Block(b[0], b[1], bool(out), b[3], b[4], *b[6:]) for b, out in zip(blocks, outs, strict=True)]
    return _around_articles(found)


def _around_articles(blocks: list[Block]) -> list[Block]:
    """Where articles and main hold most of the text that is left, the blocks outside are ruled out too, as leaves of their own, but for a headline or lead before the first."""
    left = [b for b in blocks if not b.out]
    if 2 * sum(len(b.text) for b in left if b.inside) <= sum(len(b.text) for b in left):
        return blocks
    marked, before, headed = [], True, False
    for b in blocks:
        if not b.out:
            before = before and not b.inside
            names = b.path.replace("/", ".").split(".")
            headed = headed or "h1" in names
            if not (b.inside or (before and (headed or "p" in names or not LEAD_NAMES.isdisjoint(names)))):
                b = b._replace(path=b.path + OUTSIDE, out=True)
        marked.append(b)
    return marked


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


@lru_cache(100_000)
def chain_of(path: str) -> list[int]:
    """Digests of the nodes on a style path that can be removed with all below them, the leaf last.

    The page, its body, articles and main are never removed, nor what holds them.
    """
    elements = path.split("/")[1:]
    top = max((i for i, e in enumerate(elements) if e.split(".", 1)[0] in WHOLE), default=-1) + 1
    return [_digest("/".join(elements[: i + 1])) for i in range(min(top, len(elements) - 1), len(elements))] if elements else [_digest("")]


def _body(said: dict[str, str]) -> list[str]:
    """Style paths of a page's body, by which copies are told: its longest texts but headings, until they are most of it.

    Those in an article or main if there are some. Elsewhere a body has ``BODY_CHARS``; a page without one is its own body.
    """
    paths = [p for p in said if not _HEADING.search(p)]
    inside = [p for p in paths if _INSIDE.search(p)]
    size, taken, body = sum(len(said[p]) for p in inside or paths), 0, []
    for path in sorted(inside or paths, key=lambda p: (-len(said[p]), p)):
        if 2 * taken <= size:
            taken += len(said[path])
            body.append(path)
    return body if body and (inside or taken >= BODY_CHARS) else list(said)


def _said(blocks: list[Block]) -> dict[str, str]:
    by_path: dict[str, list[str]] = {}
    for b in blocks:
        by_path.setdefault(b.path, []).append(b.text)
    return {path: "\n".join(texts) for path, texts in by_path.items()}


def _text_digest(path: str, text: str) -> int:
    return _digest(f"{path}\n{text}")


def forms_of(blocks: list[Block]) -> dict[str, tuple[str, float]]:
    """The style of each leaf of a page, and how far it is a menu: the cube of the share of its text that is links, so that a sentence with links is none; 0 inside articles, in headings and below ``MENU_LINKS`` links."""
    own: dict[str, list[Block]] = {}
    for b in blocks:
        own.setdefault(b.path, []).append(b)
    forms = {}
    for path, of in own.items():
        plain = _HEADING.search(path) or any(b.inside for b in of) or sum(b.links for b in of) < MENU_LINKS
        forms[path] = "|".join(b.style for b in of), 0.0 if plain else (sum(b.linked for b in of) / sum(len(b.text) - b.text.count(" ") for b in of)) ** 3
    return forms


def _leaves(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("chain", pa.list_(pa.int64())), ("said", pa.int64()), ("page", pa.int64()), ("out", pa.bool_()), ("style", pa.int64()), ("linked", pa.float64())]))
    for pages in batches:
        out = []
        for html in pages:
            blocks = blocks_of(html.as_py() or "")
            texts, kept = _said(blocks), {b.path for b in blocks if not b.out}
            said = {path: _text_digest(path, text) for path, text in texts.items()}
            body = {path: text for path, text in texts.items() if path in kept}
            page = _digest(repr(sorted(said[path] for path in (_body(body) if body else texts))))
            forms = forms_of(blocks)
            out.append([{"chain": chain_of(path), "said": s, "page": page, "out": path not in kept, "style": _digest(forms[path][0]), "linked": forms[path][1]} for path, s in said.items()])
        yield pa.array(out, kind)


def text_of(html: str, low: set[int], low_said: set[int]) -> str:
    """A page's text without its host's low branches and repeated texts.

    If only headings are left, the repeated texts stay; if nothing is, all but what stands in an element of ``NEVER``.
    """
    blocks = blocks_of(html)
    branch = {path: low.isdisjoint(chain_of(path)) for path in {b.path for b in blocks}}
    standing = [b for b in blocks if branch[b.path]]
    dropped = {path for path, text in _said(standing).items() if _text_digest(path, text) in low_said} if low_said else set()
    kept = [b for b in standing if b.path not in dropped]
    if all(_HEADING.search(b.path) for b in kept):
        kept = standing
    return " ".join(b.text for b in kept or [b for b in blocks if not b.never])


def _text(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pages, low, said in batches:
        yield pa.array([text_of(html.as_py() or "", set(a.as_py() or ()), set(b.as_py() or ())) for html, a, b in zip(pages, low, said, strict=True)], pa.string())


def host_of(url_col: str) -> Column:
    """Host part of a url in lower case; null has the host ''."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)", 1))


def said_of(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, chain, said, style, n, outs, linked) of each text and style of a leaf: the different pages with it, on how many presentation speaks against it, and how far they are menus, in sum.

    Pages with equal bodies are one, with the least of what they say.
    """
    made = attach(pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")), "_n", _leaves, "array<struct<chain:array<bigint>,said:bigint,page:bigint,out:boolean,style:bigint,linked:double>>", F.col("html"))
    rows = made.select("host", F.explode("_n").alias("_n")).select("host", "_n.*").groupBy("host", "chain", "said", "page").agg(F.min("out").alias("out"), F.min("style").alias("style"), F.min("linked").alias("linked"))
    return rows.groupBy("host", "chain", "said", "style").agg(F.count("*").alias("n"), F.count_if("out").alias("outs"), F.sum("linked").alias("linked"))


def _entropies(said: DataFrame, by: str, *sums: Column) -> DataFrame:
    """(host, chain, pages, entropy) of each leaf, and more sums: how even its pages have the values of a column, from 0 to 1. A single page has the entropy 1."""
    rows = said.groupBy("host", "chain", by).agg(F.sum("n").alias("n"), *sums)
    names = [c for c in rows.columns if c not in ("host", "chain", by, "n")]
    rows = rows.groupBy("host", "chain").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log2("n")).alias("x"), *[F.sum(c).alias(c) for c in names])
    entropy = F.when(F.col("pages") > 1, (F.log2("pages") - F.col("x") / F.col("pages")) / F.log2("pages")).otherwise(1.0)
    return rows.select("host", "chain", "pages", entropy.alias("entropy"), *names)


def leaves(said: DataFrame) -> DataFrame:
    """(host, chain, pages, presented, form, content) of each leaf over the different pages of its host."""
    texts = _entropies(said, "said", F.sum("outs").alias("outs"), F.sum("linked").alias("linked"))
    styles = _entropies(said, "style").select("host", "chain", F.col("entropy").alias("styles"))
    few = lambda entropy, prior: (F.col("pages") * F.col(entropy) + prior) / (F.col("pages") + prior)
    return texts.join(styles, ["host", "chain"]).select(
        "host",
        "chain",
        "pages",
        (1 - F.col("outs") / F.col("pages")).alias("presented"),
        (1 - F.col("linked") / F.col("pages") * (1 - few("styles", PRIOR_FORMS))).alias("form"),
        few("entropy", PRIOR_PAGES).alias("content"),
    )


def nodes(leaf: DataFrame) -> DataFrame:
    """(host, node, best, importance) of every node of the tree that can be removed: of the leaves at and below it the highest presentation times form, and the mean importance weighted by pages."""
    shown = F.col("presented") * F.col("form")
    rows = leaf.select("host", "pages", shown.alias("shown"), (shown * F.col("content")).alias("importance"), F.explode("chain").alias("node"))
    return rows.groupBy("host", "node").agg(F.max("shown").alias("best"), (F.sum(F.col("pages") * F.col("importance")) / F.sum("pages")).alias("importance"))


def low_parts(said: DataFrame, min_importance: float = MIN_IMPORTANCE, min_presented: float = MIN_PRESENTED, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, nodes, said): a host's removed branches, and the repeated texts of leaves that are low for their content."""
    leaf = leaves(said)
    shown = F.col("presented") * F.col("form")
    branches = nodes(leaf).where(F.col("best") < min_presented).select("host", "node", F.lit(None).cast("bigint").alias("said"))
    poor = leaf.where((shown >= min_presented) & (shown * F.col("content") < min_importance)).select("host", "chain", "pages")
    # A leaf of a large host has many texts, so they are dealt out by a salt too.
    salted = poor.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = said.groupBy("host", "chain", "said").agg(F.sum("n").alias("n")).where("n > 1").withColumn("salt", F.pmod("said", F.lit(SALTS)).cast("int"))
    repeated = texts.join(salted, ["host", "chain", "salt"]).where(F.col("n") >= F.lit(min_share) * F.col("pages"))
    both = branches.unionByName(repeated.select("host", F.lit(None).cast("bigint").alias("node"), "said"))
    return both.groupBy("host").agg(F.collect_set("node").alias("nodes"), F.collect_set("said").alias("said"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_importance: float = MIN_IMPORTANCE, min_presented: float = MIN_PRESENTED, min_share: float = MIN_SHARE, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null or empty html: empty text. Of a leaf of low content, texts on at least ``min_share`` of
    its pages are taken out. A page that would lose all its text but headings keeps what is
    repeated, and one that would lose everything keeps all outside navigation, side columns and
    footers. A null url belongs to the host ''. Repeated pages, and pages of one body, come back
    all and count once for importance. Other columns are left out.
    """
    low = cut_lineage(low_parts(cut_lineage(said_of(pages, html_col, url_col)), min_importance, min_presented, min_share))
    entries = low.agg(F.sum(F.size("nodes") + F.size("said") + 4)).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    if entries <= broadcast_entries:
        rows = rows.join(F.broadcast(low), "host", "left")
    else:  # a host may have a third of all pages
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return attach(rows, "text", _text, "string", F.col("html"), F.col("nodes"), F.col("said")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
