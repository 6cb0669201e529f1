"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements by role in a page, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SKIPPED = frozenset(
    "head nav footer aside script style textarea title noscript template iframe button select option input svg canvas object embed"
    " audio video dialog menu xmp noembed noframes".split()
)
# Words in class, id or role that speak for standing around an article, and those of them for readers' answers.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments commentlist reply replies respond"
    " discussion disqus sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar pagination pager login search"
    " complementary contentinfo".split()
)
# Words of AROUND that also name parts of a text: inside an article they count only where the element looks the part.
EITHER_WAY = frozenset(
    "notice notices alert social share sharing related recommended recommendations reply replies respond discussion widget widgets menu navigation header"
    " footer search overlay consent complementary banner comment comments".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
# Words that make a name tell of the layout around an element, as in has-sidebar, with-comments, no-search or ad-free.
LAYOUT = frozenset("has have with without no not non free less hide hides hidden show shows".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A start tag of CLOSES ends an open one of the same kind, but not beyond these.
SCOPE = frozenset("ul ol dl table select".split())
#: Elements that hold paragraphs; a paragraph in anything else gives its points to what is around that.
HOLDERS = frozenset("# body div article main section td form blockquote pre header fieldset center dd details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements open at once; deeper ones stand beside the deepest, as in browsers. Ancestors that a paragraph gives points to.
DEPTH, REACH = 512, 5
#: A text of so many characters counts as a paragraph; so many speak for an element whose names speak against it.
PARAGRAPH, SPEAKS = 25, 80
#: Every alternative takes all it has looked at, so the time is linear in the page: an unended tag or quote ends with it.
TOKEN = re.compile(
    r"""<!--(?:[^-]++|-(?!->))*+(?:-->)?|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"?|'[^']*+'?)?|["'])*+)>?|[^<]++|<""",
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*+=\s*+["']?true|display\s*+:\s*+none""", re.I)
WORD = re.compile(r"[a-z0-9]+")
#: What names and tags say of an element: nothing, that it may or does stand around the article, that readers wrote it,
#: that it is none of the text.
NOTHING, MAYBE, ASIDE, READERS, CERTAIN = range(5)


def _named(attrs: str) -> tuple[set[str], bool]:
    """Words of AROUND in the names of an element, and whether a name has no other words."""
    found: set[str] = set()
    pure = False
    for m in NAMES.finditer(attrs):
        for name in m[2].lower().strip("\"'").split():
            words = set(WORD.findall(name))
            if words and not words & LAYOUT:
                found |= words & AROUND
                pure = pure or words <= AROUND
    return found, pure


def _said(tag: str, attrs: str, inside: bool) -> int:
    """What tag and names say of an element. inside: in an article or main element, where a header is the article's own."""
    if tag in SKIPPED or attrs and HIDDEN.search(attrs):
        return CERTAIN
    if tag in ("html", "body", "main"):
        return NOTHING
    if tag not in BLOCK:
        return NOTHING
    found, pure = _named(attrs) if attrs else (set(), False)
    if found & COMMENTS and (pure or not inside):
        return READERS
    if tag == "form" or not inside and (tag == "header" or found):
        return ASIDE
    if found - EITHER_WAY and found - {"header"}:
        return ASIDE
    return MAYBE if found and found != {"header"} else NOTHING


class _Tree:
    """Elements as parallel lists, parents first, and text blocks (element, words, characters inside links)."""

    def __init__(self, page: str):
        self.tag, self.parent, self.inside, self.said, self.block = ["#"], [-1], [False], [NOTHING], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._build(page)

    def _build(self, page: str) -> None:
        stack, self.open = [0], Counter()
        skip = links = linked = 0
        parts: list[str] = []

        def end_block() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((self.block[stack[-1]], text, min(linked, len(text))))
                parts.clear()
            linked = 0

        def pop() -> None:
            nonlocal skip, links
            e = stack.pop()
            self.open[self.tag[e]] -= 1
            if skip:
                skip -= 1
            elif self.tag[e] == "a":
                links = max(0, links - 1)

        pos, n = 0, len(page)
        while pos < n:
            m = TOKEN.match(page, pos)
            pos = m.end()
            name = m[2]
            if name is None:
                text = m[0]
                if text[0] == "<" and len(text) > 1 or skip:
                    continue
                text = html.unescape(text)  # a reference ends where its run of text does
                parts.append(text)
                if links:
                    linked += len(text.strip())
                continue
            tag = name.lower()
            if m[1]:
                if self.open[tag]:
                    if not skip and (tag in BLOCK or self._block_above(stack, tag)):
                        end_block()
                    while self.tag[stack[-1]] != tag:
                        pop()
                    pop()
                continue
            if tag in RAW:  # its content is not markup
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, pos)
                pos = close.end() if close else n
                continue
            if tag == "br":
                parts.append(" ")
                continue
            block = tag in BLOCK
            if block:
                if not skip:
                    end_block()
                for _ in range(self._implied(stack, tag)):
                    pop()
            if tag in VOID or m[3].endswith("/") and not block:
                continue
            while len(stack) > DEPTH:
                pop()
            above = stack[-1]
            said = CERTAIN if skip else _said(tag, m[3], self.inside[above])
            e = len(self.tag)
            self.tag.append(tag)
            self.parent.append(above)
            self.inside.append(self.inside[above] or tag in ("article", "main"))
            self.said.append(said)
            self.block.append(e if block else self.block[above])
            self.open[tag] += 1
            stack.append(e)
            if said == CERTAIN:
                skip += 1
            elif tag == "a":
                links += 1
        if not skip:
            end_block()

    def _block_above(self, stack: list[int], tag: str) -> bool:
        """Whether a block element is open inside the nearest open element of an inline tag."""
        for e in reversed(stack):
            if self.tag[e] == tag:
                return False
            if self.block[e] == e:
                return True
        return False

    def _implied(self, stack: list[int], tag: str) -> int:
        """How many open elements a block start tag ends: an open paragraph with all in it; li, td and the like, their kind."""
        if self.open["p"] and self.tag[self.block[stack[-1]]] == "p":
            return len(stack) - stack.index(self.block[stack[-1]])
        kinds = CLOSES.get(tag, ())
        if any(self.open[k] for k in kinds):
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in SCOPE:
                    break
                if self.tag[stack[i]] in kinds:
                    return len(stack) - i
        return 0

    def summed(self, values: list[int]) -> list[int]:
        """Values of elements with those of all below them."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def _left(tree: _Tree, use_names: bool = True) -> list[tuple[int, str, int]]:
    """Blocks that don't stand around the article, names and tags being weighed against how much text is in an element.

    What readers wrote goes if there is a text besides it. A name inside an article that can name a part of it as well
    counts only for elements that are short or mostly links. What else is said to stand around goes unless most of the page's
    text is in it, which then is a wrapper. Lists of nothing but links are menus where they aren't in an article.
    """
    n = len(tree.tag)
    text, linked, items = [0] * n, [0] * n, [0] * n
    for at, words, in_links in tree.blocks:
        text[at] += len(words)
        linked[at] += in_links
        items[at] += 1
    text, linked, items = tree.summed(text), tree.summed(linked), tree.summed(items)
    total = text[0] - linked[0]
    gone = [False] * n
    for e in range(1, n):
        own, said = text[e] - linked[e], tree.said[e] if use_names else NOTHING
        if gone[tree.parent[e]]:
            gone[e] = True
        elif said == READERS:
            gone[e] = total - own >= SPEAKS or own < SPEAKS
        elif said == MAYBE:  # of a name in an article: links, or a line or two
            gone[e] = own < SPEAKS or linked[e] >= 0.5 * text[e]
        elif said == ASIDE:
            gone[e] = own < SPEAKS or own <= 0.7 * total
        elif tree.tag[e] in ("ul", "ol") and not tree.inside[e]:
            gone[e] = items[e] >= 3 and linked[e] >= 0.9 * text[e]
    return [b for b in tree.blocks if not gone[b[0]]]


def main_text(page: str | None) -> str:
    """The main text of one page: its blocks, one a line.

    Each block gives its container one point, one more for each comma and up to three for length (a tenth in all, if it is
    shorter than a paragraph); the next ancestor gets half, further ones a third over their distance. Points are
    discounted by the share of a container's text that is in links, and the container with the highest score is the
    best. It grows to a parent that scores three quarters of it, or that adds to a part of an article no more than it has and
    hardly any links, but not to the body. It is kept with those siblings that score a fifth of it, or are headings, long
    paragraphs, articles or elements of its own kind with a heading, and have few links.
    """
    if not page:
        return ""
    tree = _Tree(page)
    blocks = _left(tree)
    kept, every = (sum(len(words) - in_links for _, words, in_links in bs) for bs in (blocks, tree.blocks))
    if kept < SPEAKS <= every - kept and 10 * kept < every:  # names have left hardly anything
        blocks = _left(tree, use_names=False)
    if not blocks:
        return ""
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    points, chars, linked, headed = [0.0] * n, [0] * n, [0] * n, [0] * n
    for at, text, in_links in blocks:
        chars[at] += len(text)
        linked[at] += in_links
        headed[at] += len(text) * (tag[at] in HEADINGS)
        value = 1 + text.count(",") + min(len(text) // 100, 3) if len(text) >= PARAGRAPH else 0.1
        value *= 1 - in_links / len(text)
        e = at
        while e > 0 and tag[e] not in HOLDERS:
            e = parent[e]
        for level in range(REACH):
            points[e] += value / (1 if level == 0 else 2 if level == 1 else 3 * level)
            e = parent[e]
            if e < 0:
                break
    chars, linked, headed = tree.summed(chars), tree.summed(linked), tree.summed(headed)

    def score(e: int) -> float:
        return points[e] * (1 - linked[e] / chars[e]) if chars[e] else 0.0

    best = max((e for e in range(n) if chars[e]), key=lambda e: (score(e), -e))
    while parent[best] > 0 and tag[best] not in ("article", "main") and tag[parent[best]] not in ("html", "body"):
        more = chars[parent[best]] - chars[best]
        part_of_article = tree.inside[best] and more <= chars[best] and linked[parent[best]] - linked[best] <= 0.25 * more
        if not part_of_article and score(parent[best]) < 0.75 * score(best):
            break
        best = parent[best]
    keep, most, titles = {best}, score(best), []
    for e in range(1, n):
        if parent[e] == parent[best] and chars[e] and e != best and linked[e] < 0.25 * chars[e]:
            if headed[e] == chars[e] and e > best:
                titles.append(e)  # a heading after the best container counts if text under it does
            elif headed[e] == chars[e] or tag[e] == "article" or tag[e] == tag[best] and headed[e] or score(e) >= 0.2 * most or tag[e] == "p" and chars[e] >= SPEAKS:
                keep |= {e, *titles}
                titles = []
    under = [False] * n
    for e in range(n):
        under[e] = e in keep or e > 0 and under[parent[e]]
    return "\n".join(text for at, text, _ in blocks if under[at])


def extracted(pages: DataFrame) -> DataFrame:
    """Add __text, the main text, to every row of pages (html and any other columns).

    One pass over the rows and no shuffle. Null or empty html, or a page of nothing but menus and the like, gives an
    empty text. Markup that is cut off or wrongly nested is read as browsers do: open paragraphs and items end where
    the next begins, an unended tag ends with the page. A page takes time in proportion to its length. Repeated rows get
    equal texts, and columns may have any names but __text.
    """
    return pages.withColumn("__text", _main_text(F.col("html")))


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(page) for page in pages], dtype=object)
