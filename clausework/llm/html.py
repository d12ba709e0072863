"""HTML as a tree, and two operators over it.

``extract`` finds the main text by tree scoring: each paragraph passes points
for its length and commas to its parent, half of them to the grandparent and
less further up; a container's points are discounted by the share of its text
that is link text; the best container is kept with those siblings that score
well enough.  A class or id that names something else (a menu, an advert, comments)
lowers what its tree weighs and drops it only where the page's points lie
elsewhere: the tree that holds most of them stays, whatever it is called.

``sequence`` gives the ordered text and media references of a page, for the
interleaved documents of ``media.py``.

Parsing is one pass of one regular expression over the page, the tree is flat
lists, and nothing recurses, so depth and length have no limit but the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import small_batches

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SIBLING_STOP = frozenset("ul ol menu dl table select".split())
# Elements that never hold text to read, and those that hold main text only where nothing else does.
MACHINE = frozenset(
    "script style noscript template iframe button select textarea input svg canvas object embed applet head title audio video noembed noframes xmp map".split()
)
NEVER = MACHINE | frozenset("nav header footer aside dialog menu".split())
FORMS = frozenset(("form", "fieldset"))
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words of class and id that name what is not main text, always or unless a word of MAYBE stands beside.
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion comment comments "
    "commentlist disqus cookie cookies consent gdpr nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager newsletter "
    "subscribe subscription signup popup modal overlay skyscraper".split()
)
UNLESS = frozenset(
    "header footer sidebar aside banner notice notices notification alert share sharing social related recommended masthead toolbar "
    "widget widgets tags respond reply replies login search legal copyright disclaimer metadata byline toc".split()
)
MAYBE = frozenset("article main content body post entry text story".split())
#: What a tree with such a name weighs against one without, and the share of the page's points from which on it stays.
NAMED = {"always": (0.05, 1.0), "unless": (0.5, 0.6), "mixed": (0.8, 0.3), "form": (0.5, 0.3), "tag": (0.3, 1.0)}
#: Of these the heaviest comes back only where nothing else has text.
LAST = frozenset(("always", "tag"))
#: Below this share of the page's points what is left is looked at again.
LEAST = 0.1
ROOTS = frozenset("html body main".split())
PARAGRAPH = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|([^<]+|<)", re.S
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


_NEAR = SIBLING_STOP | frozenset(SIBLING)


class Tree:
    """Nodes in page order: tag, attributes as written, parent, and the pieces of text between.

    Open elements are counted by tag and blocks and list items have stacks of their own, so an end tag without a
    start, or a block inside many open inline elements, walks over nothing.
    """

    def __init__(self, page: str):
        self.tag, self.attrs, self.parent = ["#page"], [""], [-1]
        #: (node, text) where a text stands, (node, None) where a node begins
        self.flow: list[tuple[int, str | None]] = []
        self.stack, self.open = [0], {}
        #: Places in the stack of blocks, and of what may end an item.
        self.blocks: list[int] = []
        self.near: list[int] = []
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.match(page, at)
            at = m.end()
            text = m[4]
            if text is not None:
                self.flow.append((self.stack[-1], text))
                continue
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
                continue
            self._implied(tag)
            self.tag.append(tag)
            self.attrs.append(m[3] or "")
            self.parent.append(self.stack[-1])
            node = len(self.tag) - 1
            self.flow.append((node, None))
            if tag in VOID:
                continue
            if tag in RAW:
                end = _raw_end(tag).search(page, at)
                if tag in ("textarea", "title"):
                    self.flow.append((node, page[at : end.start() if end else n]))
                at = end.end() if end else n
                continue
            self._push(node, tag)

    def _push(self, node: int, tag: str) -> None:
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        if tag in _NEAR:
            self.near.append(len(self.stack))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append(node)

    def _cut(self, k: int) -> None:
        """End the element at place k and all inside it."""
        for node in self.stack[k:]:
            self.open[self.tag[node]] -= 1
        del self.stack[k:]
        for places in (self.blocks, self.near):
            while places and places[-1] >= k:
                places.pop()

    def _close(self, tag: str) -> None:
        if self.open.get(tag):
            k = len(self.stack) - 1
            while self.tag[self.stack[k]] != tag:
                k -= 1
            self._cut(k)

    def _implied(self, tag: str) -> None:
        """End what HTML ends without an end tag: a p before a block, an item before the next."""
        if tag in CLOSES_P and self.blocks and self.tag[self.stack[self.blocks[-1]]] == "p":
            self._cut(self.blocks[-1])
        if tag in SIBLING:
            for k in reversed(self.near):
                over = self.tag[self.stack[k]]
                if over in SIBLING_STOP:
                    break
                if over in SIBLING[tag]:
                    self._cut(k)
                    break

    def attributes(self, node: int) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs[node])}

    def dropped(self, node: int, last: bool = False) -> str | None:
        """Why a node is not main text: ``never`` by its tag, role or style, else the kind of ``NAMED`` by its class or id.

        In the last look tags and roles of menus and the like are names too.
        """
        tag = self.tag[node]
        if tag in NEVER:
            return "tag" if last and tag not in MACHINE else "never"
        if not self.attrs[node]:
            return "form" if tag in FORMS else None
        a = self.attributes(node)
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
            return "never" if tag not in ROOTS else None
        if tag in ROOTS:
            return None
        if a.get("role", "").lower() in NEVER_ROLE:
            return "tag" if last else "never"
        words = {w.lower() for w in _WORDS.findall(a.get("class", "") + " " + a.get("id", ""))}
        if words & ALWAYS:
            return "mixed" if words & MAYBE else "always"
        return "unless" if words & UNLESS and not words & MAYBE else "form" if tag in FORMS else None


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}[^>]*>?", re.I)


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _points(text: str, density: float) -> float:
    return (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - density)


def _measured(t: Tree, block: list[int], linked: list[bool], gone: list[bool]) -> tuple[dict[int, list[str]], list[int], list[int]]:
    """The texts of each block, and how much text and link text each node holds, of what is not gone."""
    n = len(t.tag)
    own: dict[int, list[str]] = {}
    length, link_length = [0] * n, [0] * n
    for i, text in t.flow:
        if text is None or gone[i]:
            continue
        size = len(text.strip())
        if size:
            own.setdefault(block[i], []).append(text)
            length[i] += size
            if linked[i]:
                link_length[i] += size
    for i in range(n - 1, 0, -1):
        length[t.parent[i]] += length[i]
        link_length[t.parent[i]] += link_length[i]
    return own, length, link_length


def _gone(t: Tree, block: list[int], linked: list[bool], last: bool) -> list[bool]:
    """Whether each node is out before any container is chosen.

    Each node belongs to the nearest tree around it that has a name of ``NAMED``.  Such a tree stays out unless it
    holds its share of the page's points; if hardly any are left then, the one that weighs most comes back.
    """
    n = len(t.tag)
    why = [None] + [t.dropped(i, last) for i in range(1, n)]
    gone, region = [False] * n, [0] * n
    for i in range(1, n):
        gone[i] = gone[t.parent[i]] or why[i] == "never"
        region[i] = i if why[i] in NAMED else region[t.parent[i]]
    if not any(region):
        return gone
    own, length, link_length = _measured(t, block, linked, gone)
    points: dict[int, float] = {}
    for b, pieces in own.items():
        points[region[b]] = points.get(region[b], 0.0) + _points("".join(pieces), link_length[b] / length[b] if length[b] else 0.0)
    whole = sum(points.values())
    kept = {r for r, x in points.items() if r == 0 or x > NAMED[why[r]][1] * whole}
    left = sum(points[r] for r in kept)
    weights = {r: x * NAMED[why[r]][0] for r, x in points.items() if r not in kept and (last or why[r] not in LAST)}
    if weights and left < LEAST * whole:
        best = max(weights, key=lambda r: (weights[r], -r))
        if weights[best] > left:
            kept.add(best)
    return [g or r != 0 and r not in kept for g, r in zip(gone, region, strict=True)]


def main_text(page: str | None) -> str:
    """The blocks of the best container and its siblings, joined by an empty line; from all that can be read, if nothing else has text."""
    if not page:
        return ""
    t = Tree(page)
    return _main_text(t, False) or _main_text(t, True)


def _main_text(t: Tree, last: bool) -> str:
    n = len(t.tag)
    # The block each node belongs to, and whether a link is around it.
    block, linked = [0] * n, [False] * n
    for i in range(1, n):
        block[i] = i if t.tag[i] in BLOCK else block[t.parent[i]]
        linked[i] = linked[t.parent[i]] or t.tag[i] == "a"
    gone = _gone(t, block, linked, last)
    own, length, link_length = _measured(t, block, linked, gone)
    density = lambda i: link_length[i] / length[i] if length[i] else 0.0
    # Paragraphs pass their points up.
    score = [0.0] * n
    for b, pieces in own.items():
        points = _points("".join(pieces), density(b))
        up, share = (t.parent[b], 1.0) if t.tag[b] in PARAGRAPH else (b, 1.0)
        for level in range(4):
            while up > 0 and t.tag[up] not in BLOCK:
                up = t.parent[up]
            if up < 0:
                break
            score[up] += points * share
            up, share = t.parent[up], (0.5, 1 / 6, 1 / 9, 0)[level]
    for i in range(n):
        score[i] *= 1 - density(i)
    if not own:
        return ""
    best = max(range(n), key=lambda i: (score[i], -i))
    # An article around the best container is the container; else a main is.
    up, around = best, {"article": -1, "main": -1}
    while up > 0:
        if t.tag[up] in around and around[t.tag[up]] < 0:
            around[t.tag[up]] = up
        up = t.parent[up]
    best = around["article"] if around["article"] > 0 else around["main"] if around["main"] > 0 else best
    keep = {best}
    if best > 0:
        over = t.parent[best]
        least = max(10.0, 0.2 * score[best])
        for i in range(1, n):
            if i == best or t.parent[i] != over or gone[i] or not length[i]:
                continue
            if score[i] >= least and density(i) < 0.5 and t.tag[i] not in ("html", "body"):
                keep.add(i)
            elif t.tag[i] in ("p", "h1", "blockquote", "pre") and density(i) < 0.25 and (length[i] > 80 or t.tag[i] == "h1"):
                keep.add(i)
    inside = [False] * n
    for i in range(n):
        if gone[i]:
            continue
        if i in keep:
            inside[i] = True
        elif i and inside[t.parent[i]]:
            # A list or box that is mostly links is a menu, wherever it stands.
            inside[i] = not (t.tag[i] in ("ul", "ol", "div", "section", "table", "dl") and density(i) > 0.5)
    out: list[str] = []
    pieces: list[str] = []
    current = -1

    def end() -> None:
        if pieces:
            text = _clean("".join(pieces))
            if text:
                out.append(text)
            pieces.clear()

    for i, text in t.flow:
        if not inside[i]:
            if text is None and t.tag[i] in BLOCK:
                end()
            continue
        if block[i] != current:
            end()
            current = block[i]
        if text is None:
            if t.tag[i] == "br" or t.tag[i] in BLOCK:
                pieces.append(" ")
        else:
            pieces.append(text)
    end()
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html).

    Cases: a null or empty page, or one without text, gives the empty text;
    broken markup is read as far as it goes, and a very long or deep page whole,
    in time that grows with its length; of containers with equal points the first
    counts; repeated rows each get a result; an empty table gives no rows; extra
    columns, whatever their names, are ignored.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


MEDIA = ("img", "audio", "video", "source", "embed")


def sequence(page: str | None) -> list[dict]:
    """Texts and media references of a page in order: kind, text, reference, caption.

    A text is a block; a reference is the src of img, audio, video, source or
    embed, with the caption of the figure around it, else its alt text.  The
    caption of a figure that holds no media is a text of its own.
    """
    if not page:
        return []
    t = Tree(page)
    n = len(t.tag)
    block, figure, hidden = [0] * n, [-1] * n, [False] * n
    captions: dict[int, list[str]] = {}
    shown: set[int] = set()  # figures with media
    for i in range(1, n):
        p = t.parent[i]
        block[i] = i if t.tag[i] in BLOCK else block[p]
        figure[i] = i if t.tag[i] == "figure" else figure[p]
        hidden[i] = hidden[p] or t.tag[i] in ("head", "script", "style", "template", "noscript")
    in_caption = [-1] * n
    for i in range(1, n):
        in_caption[i] = figure[i] if t.tag[i] == "figcaption" and figure[i] >= 0 else in_caption[t.parent[i]]
    for i, text in t.flow:
        if text is not None and in_caption[i] >= 0:
            captions.setdefault(in_caption[i], []).append(text)
        elif text is None and t.tag[i] in MEDIA and figure[i] >= 0 and not hidden[i] and t.attributes(i).get("src"):
            shown.add(figure[i])
    out: list[dict] = []
    pieces: list[str] = []
    current = -1

    def end() -> None:
        text = _clean("".join(pieces))
        pieces.clear()
        if text:
            out.append({"kind": "text", "text": text, "reference": None, "caption": None})

    for i, text in t.flow:
        if hidden[i] or in_caption[i] in shown:
            continue
        if block[i] != current:
            end()
            current = block[i]
        if text is not None:
            pieces.append(text)
        elif t.tag[i] in MEDIA:
            a = t.attributes(i)
            if a.get("src"):
                end()
                caption = _clean("".join(captions.get(figure[i], []))) or _clean(a.get("alt", "")) or None
                out.append({"kind": "media", "text": None, "reference": a["src"], "caption": caption})
        elif t.tag[i] == "br":
            pieces.append(" ")
    end()
    return out
