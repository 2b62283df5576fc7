"""Main text of web pages by tree scoring.

A page becomes a tree, held as arrays in page order. Each paragraph has points
for its length and its commas, less the share of its letters that are links; it
passes them to its container, half of them to the one above, and less to those
further up. Containers add a weight for their tag and names, and are discounted
by their own link density. The best container is kept, with those siblings
whose score comes near it and with its heading. From what is kept, menus,
headers, footers, sidebars, notices, adverts, forms and reader comments are
left out, by tag, role or a word of the class or id; a name that only describes
the layout of a wrapper around the article doesn't count.

Defined results: null or empty pages, and pages without any text but such
parts, have an empty text; unclosed or crossing tags are closed as browsers do,
roughly; a page cut off inside of a tag, comment or script ends there; repeated
rows have equal results; a null id or url stays null; an empty table gives no
rows; other columns are ignored. A page is one tree in one task: time and memory
are in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose content is no markup, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
CLOSES |= {"tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})} | dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot"}, {"table"}))
#: Elements that pass their text's points to the element above.
PARAGRAPHS = HEADINGS | frozenset("p pre li td th dd dt blockquote figcaption caption address summary".split())

#: Tags, roles and words of names by which parts are left out. A wrapper's layout words don't count if it holds the article, nor do any if it holds the page's main part.
JUNK_TAGS = frozenset("nav footer aside menu dialog button select input label".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
LAYOUT = frozenset("nav navbar navigation menu menus sidebar sidebars aside header footer masthead topbar toolbar banner banners widget widgets rail skip".split())
JUNK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted comment comments commentlist commenter disqus replies reply respond discussion cookie cookies consent gdpr"
    " privacy newsletter subscribe subscription signup signin login register popup modal overlay share sharing sharer social related recommended recommendations breadcrumb breadcrumbs pagination pager paywall notice notices notification notifications alert alerts disclaimer toast hidden".split()
)
GOOD_WORDS = frozenset("article content entry main post story text body hentry blog page".split())
MAIN_WEIGHT, WORD_WEIGHT = 25, 10
TAG_WEIGHT = {"article": MAIN_WEIGHT, "main": MAIN_WEIGHT, "div": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3, "th": -5}
COMMAS = ",،、，"
#: Shares of a paragraph's points for its container and those above.
SHARES = (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12)
#: A sibling is kept from this share of the best score; lists and boxes of so many links, and so dense, are menus.
SIBLING, LEAST_POINTS, MENU_LINKS, MENU_DENSITY = 0.2, 3, 3, 0.5
#: A wrapper named for the content holds more than this share of the page's paragraphs.
MOST = 0.6

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
#: "sideBar" is both "side", "bar" and "sidebar".
PARTS, NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"[A-Za-z]+")


class Tree:
    """Elements in page order: tag, parent, attributes; and the chunks of text: element, block, text."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.attributes = ["html"], [0], [""]
        self.chunks: list[tuple[int, int, str]] = []
        self.stack, self.open, self.block = [0], Counter({"html": 1}), 0
        self.read(html)

    def text(self, raw: str) -> None:
        if raw:
            self.chunks.append((self.stack[-1], self.block, unescape(raw) if "&" in raw else raw))

    def pop_to(self, depth: int) -> None:
        for i in self.stack[depth:]:
            self.open[self.tag[i]] -= 1
        del self.stack[depth:]

    def close(self, names: set[str], stop: set[str]) -> None:
        """Closes the nearest open element of these names, if none of ``stop`` is open within it."""
        if not any(self.open[n] for n in names):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[depth]]
            if name in names:
                return self.pop_to(depth)
            if name in stop:
                return None

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body", "head") and self.open[name]:
            return
        if name in BLOCK:
            self.block += 1
            self.close({"p"}, {"td", "th", "table", "button", "caption"})
            if name in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
                self.pop_to(len(self.stack) - 1)
        if name in CLOSES:
            self.close(*CLOSES[name])
        if name == "br":
            self.text(" ")
        if name == "body":
            self.close({"head"}, set())
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.attributes.append(attributes)
        if name not in VOID:
            self.stack.append(len(self.tag) - 1)
            self.open[name] += 1

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.block += 1
        if not self.open[name] or name in ("html", "body"):
            return
        inline = name not in BLOCK
        for depth in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[depth]]
            if own == name:
                return self.pop_to(depth)
            if inline and own in BLOCK or own in ("td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                return None

    def read(self, html: str) -> None:
        at = begin = 0
        while (at := html.find("<", at)) >= 0:
            follows = html[at + 1 : at + 2]
            if follows in ("!", "?") or follows == "/" and not html[at + 2 : at + 3].isalpha():
                self.text(html[begin:at])
                if html.startswith("<!--", at):
                    end = at + 4 if html.startswith(("<!-->", "<!--->"), at) else html.find("-->", at + 4)
                    end = html.find(">", end) if end >= 0 else -1
                else:
                    end = html.find(">", at)
                if end < 0:
                    return
                at = begin = end + 1
                continue
            if not (follows == "/" or follows.isascii() and follows.isalpha()):
                at += 1
                continue
            found = TAG.match(html, at) or LOOSE_TAG.match(html, at)
            self.text(html[begin:at])
            if not found:
                return
            closing, name, attributes = found[1], found[2].lower(), found[3]
            at = begin = found.end()
            if closing:
                self.end(name)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                if attributes.rstrip().endswith("/") and name in ("svg", "math"):
                    continue
                if not end:
                    return
                at = begin = end.end()
            else:
                self.start(name, attributes)
        self.text(html[begin:])


def named(attributes: str) -> tuple[set[str], dict[str, str]]:
    """The words of an element's class and id, and its other attributes."""
    found = {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) for k, v in ATTRIBUTE.findall(attributes)}
    given = f"{found.pop('class', '')} {found.pop('id', '')}"
    return {w.lower() for pattern in (PARTS, NAMES) for w in pattern.findall(given)}, found


def below(parent: list[int], own: list) -> list:
    """Of each element, the sum over it and all within it."""
    total = list(own)
    for i in range(len(own) - 1, 0, -1):
        total[parent[i]] += total[i]
    return total


def junk(tree: Tree, names: list[set[str]], others: list[dict[str, str]]) -> list[bool]:
    """Of each element, whether it is left out, alone or with an element above it."""
    holds_main, holds_article = below(tree.parent, [t in ("main", "h1") for t in tree.tag]), below(tree.parent, [t == "article" for t in tree.tag])
    prose = [0] * len(tree.tag)
    for i, _, text in tree.chunks:
        prose[i] += len(text) * (tree.tag[i] == "p")
    prose = below(tree.parent, prose)
    out = [False] * len(tree.tag)
    inside = [False] * len(tree.tag)  # of an article
    for i in range(1, len(tree.tag)):
        tag, up = tree.tag[i], tree.parent[i]
        inside[i] = inside[up] or tag in ("article", "main")
        if out[up] or tag == "head":
            out[i] = True
            continue
        if tag == "body":
            continue
        words, other = names[i], others[i]
        unseen = "hidden" in other or other.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", other.get("style", "").lower()) is not None
        by_tag = tag in JUNK_TAGS or tag == "header" and not inside[i] or tag == "form" and not (holds_main[i] or holds_article[i])
        wraps = holds_article[i] or words & GOOD_WORDS and (prose[i] > MOST * prose[0] or inside[i] and "header" in words)
        by_name = not holds_main[i] and (words & JUNK_WORDS or words & LAYOUT and not wraps)
        out[i] = bool(unseen or by_tag or other.get("role", "").lower() in JUNK_ROLES or by_name)
    return out


def main_text(html: str | None) -> str:
    """The blocks of a page's article, joined by empty lines."""
    if not html:
        return ""
    tree = Tree(html)
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    names, others = zip(*[named(a) if a else (set(), {}) for a in tree.attributes], strict=True)
    dropped = junk(tree, names, others)
    linked, block = [False] * n, [0] * n
    for i in range(1, n):
        linked[i] = linked[parent[i]] or tag[i] == "a"
        block[i] = i if tag[i] in BLOCK else block[parent[i]]

    letters, links = [0] * n, [0] * n
    paragraphs: dict[int, list] = {}  # by block: element, letters, letters of links, commas
    for i, b, text in tree.chunks:
        size = len("".join(text.split()))
        if size and not dropped[i]:
            letters[i] += size
            links[i] += size * linked[i]
            p = paragraphs.setdefault(b, [block[i], 0, 0, 0])
            p[1] += len(text)
            p[2] += len(text) * linked[i]
            p[3] += sum(map(text.count, COMMAS))
    letters, links = below(parent, letters), below(parent, links)
    n_links = below(parent, [t == "a" and not d for t, d in zip(tag, dropped, strict=True)])
    density = lambda i: links[i] / letters[i] if letters[i] else 0.0

    points = [0.0] * n
    for i, size, of_links, commas in paragraphs.values():
        if tag[i] in HEADINGS:
            continue
        worth = ((size >= 25) + commas + min(size / 100, 3)) * (1 - of_links / size)
        at = parent[i] if tag[i] in PARAGRAPHS else i
        for share in SHARES:
            points[at] += worth * share
            if at == 0:
                break
            at = parent[at]

    def score(i: int) -> float:
        weight = TAG_WEIGHT.get(tag[i], 0) + WORD_WEIGHT * bool(names[i] & GOOD_WORDS and tag[i] != "body") + MAIN_WEIGHT * (others[i].get("itemprop") == "articleBody" or others[i].get("role", "").lower() == "main")
        return (points[i] + weight) * (1 - density(i))

    scored = {i: score(i) for i in range(n) if points[i] > 0 and not dropped[i] and (tag[i] in BLOCK or i == 0)}
    if scored:
        best = max(scored, key=lambda i: (scored[i], -i))
    else:
        best = next((i for i in range(n) if tag[i] in ("article", "main")), next((i for i in range(n) if tag[i] == "body"), 0))
    def beside(i: int) -> bool:
        """Whether a sibling of the best container belongs to the article: its heading, another part, or a paragraph."""
        if tag[i] in ("h1", "h2"):
            return i < best and density(i) < 0.5
        if tag[best] in ("article", "main"):
            return tag[i] == tag[best] and i in scored
        if tag[i] in ("p", "blockquote", "pre"):
            return letters[i] >= 80 and density(i) < 0.25
        return i in scored and points[i] * (1 - density(i)) >= max(LEAST_POINTS, SIBLING * points[best])

    kept = [False] * n
    for i in range(n):
        sibling = best and i and parent[i] == parent[best] and beside(i)
        menu = tag[i] in ("ul", "ol", "dl", "div", "section", "table") and i != best and n_links[i] >= MENU_LINKS and density(i) > MENU_DENSITY
        kept[i] = not dropped[i] and not menu and (i == best or bool(sibling) or i > 0 and kept[parent[i]])

    blocks: dict[int, list[str]] = {}
    for i, b, text in tree.chunks:
        if kept[i]:
            blocks.setdefault(b, []).append(text)
        elif dropped[i] and b in blocks:
            blocks[b].append(" ")
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(filter(None, lines))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches):
        for part in batches:
            text = pa.array([main_text(h.as_py()) for h in part.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], names=["page_id", "url", "text"])

    read = pages.select("page_id", "url", "html").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", text string")
    return read.withColumn("n_chars", F.length("text").cast("long"))
