"""Main text of web pages by the distribution of text over blocks of lines.

A page's markup is stripped to lines, one per block of text. A line that is part of the page's frame (menu, header,
footer, sidebar, notice, advert, form, comments) weighs nothing, any other one as many characters as it has outside
links. The weights are summed over a sliding window of lines. The main text surges where such a sum first reaches
a threshold, and dives where the sums are back at zero; what lies between is kept, except for the lines of the frame.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines of a window, and the characters a window must hold for a surge on pages that do not mark their article.
WINDOW, SURGE = 3, 80
#: A line of which more than this share of characters are links is a list of links, on pages without a marked article.
LINK_SHARE = 0.5

#: Elements that start a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split())
#: Elements without an end.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is never read as text; of the first four it is no markup and needs no end.
HIDDEN = frozenset(
    "script style title textarea audio canvas iframe math noembed noframes noscript object select svg template video xmp".split())
RAW = frozenset("script style title textarea".split())
#: Elements that are part of a page's frame wherever they are.
FRAME = frozenset("aside button datalist dialog fieldset footer form menu nav search".split())
#: Roles that are part of a page's frame.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words in a class or id that name a part of the frame, with all that is inside.
FIRM = frozenset(
    "ad ads adbox adslot adunit adsense advert adverts advertise advertisement advertisements advertising alert breadcrumb breadcrumbs "
    "captcha comment commentlist comments consent cookie cookies disclaimer discussion disqus gdpr newsletter notice notices "
    "notification notifications pager pagination popup promo promoted promotion recommendations recommended related replies respond "
    "share sharebar sharing signup skip sponsor sponsored sponsors subscribe subscription".split())
#: Such words in the names of whole layouts too, so that an article element inside is still an article.
LOOSE = frozenset(
    "aside banner footer header login masthead menu modal nav navbar navigation overlay sidebar sidebars social toolbar topbar widget widgets".split())
#: Words after which a name does not mean the part itself, as in has-sidebar or no-ads.
DENIED = frozenset("after before has have hidden hide no not show with without".split())
#: Words in a class or id that mark an article where no element or role does.
ARTICLE = frozenset("article articlebody content entry post story".split())
#: Elements whose start ends an open one of these kinds, if that is the innermost block.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
    **{f"h{n}": tuple(f"h{m}" for m in range(1, 7)) for n in range(1, 7)},
}
#: Elements that group lines without being the element these lines share.
INNER = frozenset("blockquote dl figure ol table tbody tfoot thead tr ul".split())

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</?[A-Za-z](?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+(?:>|\Z)""", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_MARKS = re.compile(r"""\s(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in HIDDEN}
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


class Line:
    """A line of text: its characters in links, whether it is of the frame, how surely of an article, its element."""

    __slots__ = ("text", "links", "frame", "article", "home")

    def __init__(self, text: str, links: int, frame: bool, article: int, home: int):
        self.text, self.links, self.frame, self.article, self.home = text, links, frame, article, home


class _Block:
    """An open block element, with the inline elements that are open in it."""

    __slots__ = ("tag", "frame", "article", "home", "inside", "inline", "counts")

    def __init__(self, tag: str, frame: int, article: int, home: int, inside: int):
        self.tag, self.frame, self.article, self.home, self.inside = tag, frame, article, home, inside
        self.inline: list[tuple[str, int]] = []
        self.counts: Counter = Counter()


def _marks(tag: str, markup: str, in_article: int) -> tuple[int, int]:
    """How surely an element is of the frame (2: whatever is inside) and of an article (2: by element or role), by itself."""
    if tag in FRAME or tag == "article" and in_article > 1:  # an article inside an article is a comment on it
        return 2, 0
    frame, article = int(tag == "header" and not in_article), 2 * (tag in ("article", "main"))
    if tag == "main" or " " not in markup and "\n" not in markup and "\t" not in markup:
        return frame, article
    for name, *values in _MARKS.findall(markup):
        value = next(filter(None, values), "")
        if name.lower() == "role":
            if value.lower() in ROLES:
                return 2, 0
            article = max(article, 2 * (value.lower() in ("article", "main")))
            continue
        for word in value.split():
            denied, words = False, [w.lower() for w in _WORD.findall(word)]
            for w in [*words, *(["".join(words)] if len(words) == 2 and not words[0] in DENIED else [])]:
                if not denied and w in FIRM:
                    return 2, 0
                if not denied and w in LOOSE and not (w == "header" and in_article):
                    frame = 1
                denied = w in DENIED
                article = max(article, int(w in ARTICLE))
    return frame, 0 if frame and tag != "article" else article


def page_lines(html: str) -> list[Line]:
    """The lines of a page in order. White space, no-break spaces included, is one space; lines without text are left out."""
    lines: list[Line] = []
    stack = [_Block("", 0, 0, 0, 0)]
    opened: Counter = Counter()
    endless: set[str] = set()
    text: list[str] = []
    linked: list[str] = []
    blocks = at = 0
    while at < len(html):
        found = _TAG.search(html, at)
        top = stack[-1]
        if (found.start() if found else len(html)) > at and not (top.inline and top.inline[-1][1]):
            text.append(html[at:found.start()] if found else html[at:])
            if top.counts["a"]:
                linked.append(text[-1])
        if not found:
            break
        at, markup = found.end(), found.group()
        name = _NAME.match(markup)
        if not name:  # a comment or a declaration
            continue
        tag, ends = name.group(1).lower(), markup[1] == "/"
        if tag in HIDDEN:
            if not ends and not markup.endswith("/>") and tag not in endless:
                end = _ENDS[tag].search(html, at)
                if end or tag in RAW:
                    at = end.start() if end else len(html)
                else:
                    endless.add(tag)
        elif tag in BLOCKS:
            _flush(lines, text, linked, top)
            if tag in ("html", "head", "body", "hr"):
                continue
            if ends:
                if opened[tag]:
                    while stack[-1].tag != tag:
                        opened[stack.pop().tag] -= 1
                    opened[stack.pop().tag] -= 1
                continue
            if top.tag == "p":
                opened[stack.pop().tag] -= 1
            while stack[-1].tag in CLOSES.get(tag, ()):
                opened[stack.pop().tag] -= 1
            above = stack[-1]
            frame, article = _marks(tag, markup, above.article)
            if not (article == 2 and above.frame < 2):
                frame = max(frame, above.frame)
            blocks += 1
            inside = above.inside if tag in INNER else blocks
            stack.append(_Block(tag, frame, 0 if frame else max(article, above.article), above.inside, inside))
            opened[tag] += 1
        elif tag == "br":
            text.append(" ")
        elif tag not in VOID:
            if not ends:
                if not markup.endswith("/>"):
                    frame = _marks(tag, markup, 1)[0] if tag == "button" or " " in markup else 0
                    top.inline.append((tag, max(frame, top.inline[-1][1] if top.inline else 0)))
                    top.counts[tag] += 1
            elif top.counts[tag]:
                while top.inline[-1][0] != tag:
                    top.counts[top.inline.pop()[0]] -= 1
                top.counts[top.inline.pop()[0]] -= 1
    _flush(lines, text, linked, stack[-1])
    return lines


def _flush(lines: list[Line], text: list[str], linked: list[str], block: _Block) -> None:
    shown = " ".join(unescape("".join(text)).split())
    if shown:
        links = len(" ".join(unescape("".join(linked)).split())) if linked else 0
        lines.append(Line(shown, links, block.frame > 0, block.article, block.home))
    text.clear()
    linked.clear()


def surges(weights: Sequence[int], window: int, least: int) -> list[tuple[int, int]]:
    """The stretches (from, to) of lines between a surge and the dive after it.

    The sum at a line is that of the ``window`` lines from there on. A run of sums above zero with one that reaches
    ``least`` is a stretch, from its first line with weight to its last one.
    """
    sums, total = [0] * len(weights), 0
    for n in range(len(weights) - 1, -1, -1):
        total += weights[n] - (weights[n + window] if n + window < len(weights) else 0)
        sums[n] = total
    found, n = [], 0
    while n < len(sums):
        start = n
        while n < len(sums) and sums[n]:
            n += 1
        if n > start and max(sums[start:n]) >= least:
            held = [k for k in range(start, n) if weights[k]]
            found.append((held[0], held[-1] + 1))
        n += n == start
    return found


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The blocks of a page's main text in page order.

    On a page that marks its article, by element or role or else by a class or id, only lines of it have weight, and
    text surges with their first character. Elsewhere a window needs ``surge`` characters, lines made of links or
    stating rights have no weight, and lines that share their element with a stretch are kept with it, so that a short
    paragraph after an advert is not lost. A line without weight is as wide as a window: text does not run across it.
    """
    lines = page_lines(html)
    marked = max((line.article for line in lines if not line.frame), default=0)
    places: list[int] = []
    weights: list[int] = []
    for n, line in enumerate(lines):
        out = line.frame or line.article < marked or not marked and (
            line.links > LINK_SHARE * len(line.text) or _RIGHTS.match(line.text))
        places.extend([n] * (window if out else 1))
        weights.extend([0] * window if out else [len(line.text)])
    kept = {places[k] for start, end in surges(weights, window, 1 if marked else surge) for k in range(start, end) if weights[k]}
    if not marked:
        homes = {lines[n].home for n in kept}
        kept |= {n for n, w in zip(places, weights) if w and lines[n].home in homes}
    return [lines[n].text for n in sorted(kept)]


def extract(
    pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), html: str = "html", window: int = WINDOW, surge: int = SURGE,
) -> DataFrame:
    """The columns of ``keep`` with ``blocks``, an array of the texts of a page's main text; empty if there is none.

    Every page is one row, read whole, whatever its length; the work is linear in it. A null page is an empty one, equal
    pages are extracted each, other columns (also ones named as the results) are left out, an empty table gives no rows.
    """
    schema = pages.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [main_text(page or "", window, surge) for page in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(blocks, pa.list_(pa.string()))], [*keep, "blocks"])

    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, schema.add("blocks", T.ArrayType(T.StringType())))
