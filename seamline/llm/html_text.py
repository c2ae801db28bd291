"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup; all but a title's is dropped, and a title isn't main text.
RAW = frozenset("script style title textarea xmp iframe noframes noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of these kinds, up to the nearest of the stops.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: An end tag doesn't reach over these, but for its own kind.
FENCES = frozenset("article aside blockquote body div footer form header html li main nav ol section table td th tr ul".split())
DROPPED = frozenset("nav footer aside form head title script style noscript iframe button select textarea input svg math template object embed canvas dialog menu audio video map applet frame frameset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|banners?|cookies?|consent|gdpr|notices?|popups?|modals?|overlay|newsletter|subscribe|subscription|signup|login|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|aside|widgets?|footer|foot|masthead|comments?|commentlist|disqus|respond|replies|reply|social|share|sharing|related|recommended|recommendations|pagination|pager|toolbar|skip)(?=$|[\s_-])",
    re.IGNORECASE,
)
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.IGNORECASE)
WANTED = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|text|blog|story)(?=$|[\s_-])", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
PARAGRAPHS = frozenset("p pre td blockquote li dd figcaption".split())
#: Points that an element has of its own kind.
KIND_POINTS = {"article": 10, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "table": -3, "th": -5}
#: Characters from which a paragraph passes points on; share of the best score that makes a sibling part of the text.
SHORT, SIBLING = 25, 0.2

#: A comment, a declaration, or a tag, whose attributes may hold > in quotes. Nothing is tried twice: parts are possessive.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ROOT = 0


class Page:
    """The tree of a page: nodes in document order, each after its parent, and the events of its text."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.attrs = ["#root"], [-1], [{}]
        #: (node, text), or (node, None) where a block begins or ends
        self.events: list[tuple[int, str | None]] = []
        #: open nodes; for each the places of the nearest fence and of the nearest paragraph that no fence shuts off
        self.stack, self.fence, self.paragraph = [ROOT], [0], [0]
        #: places of the open nodes of each kind; headings are of one kind
        self.places: dict[str, list[int]] = {}
        self._parse(source)

    def _parse(self, source: str) -> None:
        at, end, last_close = 0, len(source), source.rfind(">")
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                self._text(self.stack[-1], source[at:])
                break
            if lt > at:
                self._text(self.stack[-1], source[at:lt])
            after = source[lt + 1 : lt + 2]
            # behind the last > there are no tags
            m = TAG.match(source, lt) if lt < last_close or after in ("!", "?") else None
            if m is None:
                # an unclosed tag ends at the next >, another < is text
                close = source.find(">", lt) if lt < last_close and (after.isalpha() or after == "/") else -1
                if close < 0:
                    self._text(self.stack[-1], "<")
                    at = lt + 1
                else:
                    at = close + 1
                continue
            at = m.end()
            name = (m.group(2) or "").lower()
            if not name:
                continue
            if m.group(1):
                self._close(name)
                continue
            self._open(name, m.group(3))
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, at)
                stop_at = stop.start() if stop else end
                if name == "title":
                    self._text(self.stack[-1], source[at:stop_at])
                at = stop_at
            elif name in VOID or m.group(3).rstrip().endswith("/") and name not in BLOCK:
                self._pop()

    def _text(self, node: int, text: str) -> None:
        self.events.append((node, text))

    def _nearest(self, kinds: Iterable[str]) -> int:
        """Place of the innermost open node of these kinds; 0 if there is none."""
        return max((found[-1] for k in kinds if (found := self.places.get(k))), default=0)

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCK and (place := self.paragraph[-1]):
            self._cut(place)
        if name in CLOSES:
            kinds, stops = CLOSES[name]
            while (place := self._nearest(kinds)) > self._nearest(stops):
                tag = self.tag[self.stack[place]]
                self._cut(place)
                if name != "tr" or tag == "tr":
                    break
        found = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.attrs.append(found)
        place = len(self.stack)
        self.stack.append(len(self.tag) - 1)
        self.fence.append(place if name in FENCES else self.fence[-1])
        self.paragraph.append(place if name == "p" else 0 if name in FENCES else self.paragraph[-1])
        self.places.setdefault(_kind(name), []).append(place)
        if name in BLOCK:
            self.events.append((self.stack[-1], None))
        elif name in ("br", "td", "th"):
            self._text(self.stack[-1], " ")

    def _pop(self) -> None:
        node = self.stack.pop()
        self.fence.pop()
        self.paragraph.pop()
        self.places[_kind(self.tag[node])].pop()
        if self.tag[node] in BLOCK:
            self.events.append((node, None))

    def _cut(self, place: int) -> None:
        while len(self.stack) > place:
            self._pop()

    def _close(self, name: str) -> None:
        place = self._nearest((_kind(name),))
        if place and (name in FENCES or place > self.fence[-1]):
            self._cut(place)


def _kind(name: str) -> str:
    return "h1" if name in HEADINGS else name


def _space(s: str) -> str:
    return " ".join(html.unescape(s).split())


def unwanted(page: Page) -> list[bool]:
    """Nodes that lie in what isn't main text by its kind, role, name or visibility."""
    has_title = [False] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):
        has_title[page.parent[i]] |= has_title[i] or page.tag[i] in ("h1", "h2")
    out, in_article = [False] * len(page.tag), [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        tag, a, up = page.tag[i], page.attrs[i], page.parent[i]
        in_article[i] = in_article[up] or tag in ("article", "main")
        if out[up]:
            out[i] = True
            continue
        name = f"{a.get('class', '')} {a.get('id', '')}"
        bad = tag in DROPPED or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(a.get("style", "")))
        if tag not in ("html", "body") and not bad:
            bad = bool(UNWANTED.search(name)) and not (tag in ("article", "main") and WANTED.search(name) and "comment" not in name.lower())
        if not bad and (tag == "header" or tag not in ("html", "body") and HEADER.search(name)):
            # the head of an article is text, that of a page isn't
            bad = not (in_article[up] and has_title[i])
        out[i] = bad
    return out


def main_text(source: str | None) -> str:
    """The blocks of the best container and of its siblings that are alike, one a line."""
    page = Page(source or "")
    n = len(page.tag)
    bad = unwanted(page)
    parent, tag = page.parent, page.tag
    # the nearest block of each node takes its text; links count apart
    block, link = list(range(n)), [False] * n
    for i in range(1, n):
        if tag[i] not in BLOCK:
            block[i] = block[parent[i]]
        link[i] = link[parent[i]] or tag[i] == "a"
    own, own_links, commas = [0] * n, [0] * n, [0] * n
    for node, text in page.events:
        if text and not bad[node]:
            size = len(_space(text))
            own[block[node]] += size
            own_links[block[node]] += size * link[node]
            commas[block[node]] += text.count(",") + text.count("、") + text.count("，")
    total, linked = own[:], own_links[:]
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
        linked[parent[i]] += linked[i]
    density = [linked[i] / total[i] if total[i] else 0.0 for i in range(n)]
    scores: dict[int, float] = {}
    for i in range(1, n):
        if own[i] >= SHORT and not bad[i] and (tag[i] in PARAGRAPHS or tag[i] in ("div", "section", "article", "main", "body", "center")):
            points = (1 + commas[i] + min(own[i] / 100, 3)) * (1 - (own_links[i] / own[i]))
            # a container's own text counts for the container itself
            up = parent[i] if tag[i] in PARAGRAPHS else i
            for share in (1.0, 0.5, 0.25):
                if up < 0:
                    break
                scores[up] = scores.get(up, 0.0) + points * share
                up = parent[up]
    for i in scores:
        name = f"{page.attrs[i].get('class', '')} {page.attrs[i].get('id', '')}"
        scores[i] = (scores[i] + KIND_POINTS.get(tag[i], 0) + 5 * bool(WANTED.search(name))) * (1 - density[i])
    chosen = [False] * n
    if scores:
        best = max(scores, key=lambda i: (scores[i], -i))
        least = max(10.0, scores.get(best, 0.0) * SIBLING)
        for i in range(1, n):
            if parent[i] == parent[best] and not bad[i]:
                alike = scores.get(i, 0.0) >= least
                paragraph = tag[i] in ("p", "pre", "blockquote") and (total[i] > 80 and density[i] < 0.25 or 0 < total[i] <= 80 and not density[i])
                title = tag[i] in ("h1", "h2") and i < best and density[i] < 0.5
                chosen[i] = i == best or alike or paragraph or title
        chosen[best] = True
    else:
        # no paragraph anywhere: what is left of the page
        chosen[ROOT] = True
    links = [0] * n
    for i in range(n - 1, 0, -1):
        links[i] += tag[i] == "a"
        links[parent[i]] += links[i]
    inside, cut = [False] * n, bad[:]
    inside[ROOT] = chosen[ROOT]
    for i in range(1, n):
        inside[i] = inside[parent[i]] or chosen[i]
        menu = tag[i] in ("ul", "ol", "div", "table", "section", "dl") and links[i] >= 3 and density[i] > 0.6 and not chosen[i]
        cut[i] = cut[parent[i]] or bad[i] or menu
    lines, line = [], []
    for node, text in [*page.events, (ROOT, None)]:
        if text is None:
            if joined := _space("".join(line)):
                lines.append(joined)
            line = []
        elif inside[node] and not cut[node]:
            line.append(text)
    return "\n".join(lines)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = [main_text(h.as_py()) for h in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page, whole; a null or empty html has none.

    Of containers with equal scores the first in the page is taken. Repeated rows keep a row each, null
    ids and urls pass through, an empty table gives an empty result; other columns are ignored. Nothing
    is shuffled.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
