"""Main text of web pages by tree scoring.

A page is read once, tag by tag, into a tree of block elements with the text blocks they hold. Parts
that never are article text (menus, headers, footers, side bars, notices, adverts, forms, comments, scripts,
styles, hidden parts) are left out by element, role, class or id. Each text block gives one point, one for
each comma and one for each 100 characters (three at most) to the element around it and half and
a quarter to those above; an element's score is discounted by the share of its characters that are links.
The best element, or the article it lies in, is kept with siblings that score near it. Where there is no article and the best element holds
less than ``SHARE`` of the page's points (sections under different parents), the lowest element around it that holds as much
takes its place, and those of its children that would be kept as siblings are kept.

Null and empty html give an empty text. Broken markup is read as far as it goes: closing tags
close what is open within them, paragraphs and list items end where the next begins. Pages are judged alone, so repeated rows get equal
texts; of elements with equal scores the one that begins first wins. A page of any length is read whole. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import text_batches

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")

#: HTML's elements by what they mean here.
RAW = set("script style noscript template textarea title iframe object svg math canvas audio video select".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary header footer nav aside form fieldset menu dialog hr center head hgroup search".split()
)
NEVER = set("nav header footer aside form fieldset menu dialog button head search".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar alertdialog form".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar side rail "
    "menu menubar nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments disqus reply replies respond widget widgets toolbar pagination pager skip paywall tooltip".split()
)
#: With these, ``header`` and the like name a part of the article itself.
OWN = set("article entry post content story main body".split())
ALONE = set("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Of a page's points, what the element that is kept holds at least.
SHARE = 0.8
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
WORD = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "up", "skip", "score", "chars", "links", "points")

    def __init__(self, tag: str, up: Node | None, skip: bool):
        self.tag, self.up, self.skip = tag, up, skip
        self.score, self.chars, self.links, self.points = 0.0, 0, 0, 0

    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0

    def value(self) -> float:
        return self.score * (1 - self.density())


def left_out(tag: str, attributes: str) -> bool:
    if tag in NEVER:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            found = set(WORD.findall(CAMEL.sub(" ", value).lower()))
            marks = found & MARKS
            if marks and not (marks <= {"header", "side", "related"} and found & OWN):
                return True
        elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?=\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes), re.I))


class Tags:
    """Where a page's tags end: at the first > that isn't in a quoted value. A quote opens a value only after an equals sign.

    If a quote is never closed, that tag and all later ones end at their first >, so a page is looked through twice at most.
    """

    def __init__(self, html: str):
        self.html, self.last, self.loose = html, html.rfind(">"), False

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at ``at``; -1 if there is none."""
        html, begin = self.html, at
        if at > self.last:
            return -1
        while not self.loose:
            m = STOP.search(html, at)
            if m and m[0] == ">":
                return m.start()
            if m:
                k = m.start() - 1
                while k >= at and html[k].isspace():
                    k -= 1
                close = html.find(m[0], m.end()) if k >= begin and html[k] == "=" else m.start()
                at = close + 1
            if not m or close < 0:
                self.loose = True
        return html.find(">", begin)


def closing_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE | re.ASCII)


CLOSING = {tag: closing_tag(tag) for tag in RAW}


def read(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """Nodes of the tree and text blocks (node, text, characters in links), in page order."""
    root = Node("", None, False)
    nodes, blocks, here = [root], [], root
    held: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            if not here.skip and (text := " ".join(unescape("".join(held)).split())):
                blocks.append((here, text, min(linked, len(text))))
            held.clear()
        linked = 0

    at, n, tags = 0, len(html), Tags(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            part = html[at:lt]
            held.append(part)
            if in_link:
                linked += len(part.strip())
            if lt == n:
                break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(html, lt)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            held.append("<")
            at = lt + 1
            continue
        at, closing, tag, attributes = end + 1, m[1], m[2].lower(), html[m.end() : end]
        if tag in RAW and not closing:
            if attributes.endswith("/") and tag in ("svg", "math", "object"):
                continue
            closed = CLOSING[tag].search(html, at)
            at = closed.start() if closed else n  # the closing tag itself is read as one that nothing opened
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            held.append(" ")
        elif tag in BLOCK or tag == "button":
            flush()
            in_link = False
            if closing:
                up = here
                while up and up.tag != tag:
                    up = up.up
                here = up.up if up and up.up else here if not up else root
            elif tag not in VOID:
                for old in (ENDS.get(tag) or ({"p"} if tag not in ("html", "head", "body") else ())):
                    if here.tag == old:
                        here = here.up
                here = Node(tag, here, here.skip or left_out(tag, attributes))
                nodes.append(here)
    flush()
    return nodes, blocks


def extract(html: str | None) -> str:
    nodes, blocks = read(html or "")
    if not blocks:
        return ""
    for node, text, links in blocks:
        points, up = 1 + text.count(",") + min(len(text) // 100, 3), node
        if node.tag in ("p", "li", "td", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt") and node.up:
            up = node.up
        part = 1.0
        while up and part >= 0.25:
            up.score += points * part
            up, part = up.up, part / 2
        up = node
        while up:
            up.points += points
            up.chars += len(text)
            up.links += links
            up = up.up
    best = max((x for x in nodes if not x.skip), key=Node.value)
    up = best
    while up:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.up
    limit = max(3.0, 0.2 * best.value())
    fits = lambda x, value: value >= limit and x.density() < 0.5 or x.tag in ALONE and x.density() < 0.25
    around = best
    while best.tag not in ("article", "main") and around.up and around.points < SHARE * nodes[0].points:
        around = around.up
    kept = {id(best)}
    if around is not best and not (around is best.up and around.tag not in ("body", "html", "")):
        kept.update(id(x) for x in nodes if x.up is around and not x.skip and fits(x, x.points * (1 - x.density())))
    elif best.up:
        for x in nodes:
            if x.up is best.up and x is not best and not x.skip and best.tag not in ("body", "html", ""):
                if fits(x, x.value()):
                    kept.add(id(x))
    out = []
    for node, text, _ in blocks:
        up, inside, menu = node, False, False
        while up:
            if up.tag in ("ul", "ol") and up.density() > 0.75:
                menu = True
            if id(up) in kept or up is node and up is around and around is not best:
                inside = True
                break
            up = up.up
        if inside and not menu:
            out.append(text)
    return "\n".join(out)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but the html, with ``text`` and ``n_chars``; columns of these names are replaced."""
    text_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pages.map(extract)

    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return pages.select(*rest, extracted(F.coalesce(html, F.lit(""))).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
