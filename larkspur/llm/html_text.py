"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags by a scanner that passes over the page once. The first pass decides each
block by itself from three figures: its length, the share of its characters that are links, and the share of stop words
among its words. Long blocks with a natural share of stop words are content, blocks of links and long blocks of other
words are boilerplate, medium ones with stop words and short sentences are near content, and the rest (short blocks,
headings, medium blocks without a natural share) is undecided. In the second pass those take the label of their nearest
decided neighbours: a heading that of the next one, a near-content paragraph is content unless both sides are boilerplate,
any other block that of the nearer side.

Markup is one input beside the figures. Navigation, page headers, footers, sidebars, forms, notices, adverts and reader
comments are boilerplate by their element, role or a class or id all of whose words say so. An article or main element
bounds the neighbours that its blocks look at, keeps long blocks of few stop words undecided, and gives its undecided
blocks where nothing in it is content by itself. A page in a language that the stop words do not know is decided by length
and links alone, and a page of undecided blocks only is kept.

Defined results: null or empty html gives an empty text; a tag, comment or script that is never closed ends with the page;
a quote that is never closed is part of its tag's attributes; rows are independent, so repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import text_slices

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in is a that for it with as was on be by at or from this are an not have has had were which their",
    "de": "der die das und in zu den von mit ist auf für nicht ein eine dem des sich auch als an es war aus bei nach wie",
    "fr": "le la les de des du et un une en que qui dans pour sur est pas par au avec ce il elle plus ne se son",
    "es": "el la los las y de en que del se con por su para un una lo como más al es o pero sus",
    "it": "il di che è per non una con del della i da sono si al le la un in",
    "pt": "o a os as do da de e em um uma não com por mais dos no na para que",
    "nl": "de het een en van is dat op te in zijn met voor niet aan er",
    "ru": "и в не на я что он с как а то все она так его но к у же вы за бы по от из это был для",
}
#: Characters that do the work of stop words in scripts without spaces.
STOP_CHARACTERS = frozenset("的了是在不和有这为之与以而也就的のはをにがでともへや")
STOPS = frozenset(" ".join(STOP_WORDS.values()).split())
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+")

#: A tag from its name to its end: attributes with quoted, unquoted or no values. Possessive, so nothing is scanned twice.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?>[\s/]++|[^\s/>=]++(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?>\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?<![^\s\"'])hidden(?=[\s=/]|$)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements whose content is not markup, and elements whose content is never text.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style title textarea iframe noembed noframes xmp".split()}
_SILENT = frozenset("noscript template svg math object select button canvas audio video".split())
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody
    td tfoot th thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p blockquote pre".split())
_REPEATED = frozenset("li td th tr dt dd option".split())
_BOILER_TAGS = frozenset("nav footer aside menu dialog fieldset".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that say boilerplate, and words that may stand beside them.
_BOILER_NAMES = frozenset(
    """nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs pagination pager footer sidebar sidebars
    rail ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin share
    sharing social related recommended recommendations trending widget widgets comment comments commentlist respond reply
    replies discussion disqus skip copyright legal disclaimer masthead search form tags""".split()
)
_NEUTRAL_NAMES = frozenset(
    """site page main global left right top bottom upper lower primary secondary box list wrapper wrap container area section
    block inner outer item items bar links link posts post body text content header slot unit panel group row column col
    message module title form buttons icons media thread reader user js c id""".split()
)
_CONTENT_NAMES = frozenset("content article story entry prose post".split())
LINK_DENSITY = 0.4
STOP_DENSITY = 0.2
LOW_STOP_DENSITY = 0.08
SHORT_CHARS = 60
LONG_CHARS = 160
#: A page's language is known where this share of all its words are stop words.
KNOWN_LANGUAGE = 0.04

SENTENCE_ENDS = ".!?…。！？"

GOOD, NEAR, BAD = "good", "near", "bad"


@dataclass
class Block:
    text: str
    tag: str
    boiler: bool
    article: int  # number of the article or main element around it, 0 outside
    link_chars: int
    words: int = 0
    stops: int = 0
    label: str | None = None  # None: undecided

    @property
    def density(self) -> float:
        return self.stops / max(1, self.words)


def _named(value: str, in_article: bool) -> bool:
    """Whether a class or id attribute says boilerplate: some name of which every word does, beside neutral words."""
    names = [[re.sub(r"\d+$", "", w) for w in re.split(r"[-_]+", n) if w] for n in value.lower().split()]
    if any(len(n) == 1 and n[0] in _CONTENT_NAMES for n in names):
        return False
    for n in names:
        if any(w in _BOILER_NAMES for w in n) and all(w in _BOILER_NAMES or w in _NEUTRAL_NAMES or not w for w in n):
            return True
        if n and n[-1] == "header" and not in_article and all(w in _NEUTRAL_NAMES for w in n):
            return True
    return False


def _hidden(attributes: str) -> bool:
    """Whether an element's own attributes take it off the page."""
    low = attributes.lower()
    if "hidden" not in low and "display" not in low:
        return False
    if _HIDDEN.search(_QUOTED.sub('""', low)):
        return True
    for m in _ATTRIBUTE.finditer(low):
        name, value = m[1], m[2] or m[3] or m[4] or ""
        if name == "aria-hidden" and value.strip() == "true" or name == "style" and _UNSEEN.search(value):
            return True
    return False


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _BOILER_TAGS or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main"):
        return False
    if _hidden(attributes):
        return True
    if "=" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in _BOILER_ROLES or name in ("class", "id") and _named(value, in_article):
            return True
    return False


class _Blocks:
    """Collects the blocks of a page while tags and text go by."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, str, int, bool]] = []  # open elements: tag, why boilerplate ("", "form", "yes"), article, silent
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.links = self.articles = 0
        self.in_link = False
        self.tag = ""

    def state(self) -> tuple[str, str, int, bool]:
        return self.stack[-1] if self.stack else ("", "", 0, False)

    def text(self, piece: str) -> None:
        if self.state()[3]:
            return
        piece = unescape(piece)
        self.parts.append(piece)
        if self.in_link:
            self.links += len(piece.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            _, boiler, article, _ = self.state()
            self.blocks.append(Block(text, self.tag, bool(boiler), article, min(self.links, len(text))))
        self.links = 0

    def push(self, name: str, boiler: str, article: int, silent: bool) -> None:
        self.stack.append((name, boiler, article, silent))
        self.open[name] += 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        return name

    def start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = True
        elif name == "br" and not self.state()[3]:
            self.parts.append(" ")
        if name in _SILENT and not attributes.endswith("/"):
            _, boiler, article, _ = self.state()
            self.push(name, boiler, article, True)
        if name not in _BLOCK:
            if name not in _SILENT and name not in _VOID and not attributes.endswith("/") and _hidden(attributes):
                _, boiler, article, _ = self.state()
                self.push(name, boiler, article, True)
            return
        self.flush()
        self.in_link = False
        top = self.state()[0]
        if top == "p" or name in _HEADINGS and top in _HEADINGS or top == name and name in _REPEATED:
            self.pop()
        self.tag = name
        if name in _VOID:
            return
        _, boiler, article, silent = self.state()
        inside = bool(article)
        if name in ("article", "main") and not article:
            self.articles += 1
            article = self.articles
            boiler = "" if boiler == "form" else boiler  # a form around the whole page
        if not boiler:
            boiler = "form" if name == "form" else "yes" if _boilerplate(name, attributes, inside) else ""
        self.push(name, boiler, article, silent)

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name not in _BLOCK and name not in _SILENT and not self.open[name]:
            return
        if name in _BLOCK:
            self.flush()
            self.in_link = False
        if self.open[name]:
            while self.pop() != name:
                pass
        if name in _BLOCK:
            self.tag = self.state()[0]


def page_blocks(html: str) -> list[Block]:
    """The blocks of a page in order, with what encloses them; one pass over the page."""
    page, at, n = _Blocks(), 0, len(html)
    while at < n:
        to = html.find("<", at)
        if to < 0:
            to = n
        if to > at:
            page.text(html[at:to])
        if to + 1 >= n:
            if to < n:
                page.text("<")
            break
        after = html[to + 1]
        if html.startswith("<!--", to):
            end = html.find("-->", to + 4)
            at = n if end < 0 else end + 3
        elif after in "!?" or after == "/" and not html[to + 2 : to + 3].isalpha():
            end = html.find(">", to)
            at = n if end < 0 else end + 1
        elif after == "/" or after.isascii() and after.isalpha():
            m = _TAG.match(html, to)
            if m is None:  # the tag ends with the page, or its name is none
                if after == "/" and not html[to + 2].isascii():
                    page.text("<")
                    at = to + 1
                    continue
                break
            at, name = m.end(), m[1].lower()
            if after == "/":
                page.end(name)
            elif name in _RAW:
                end = _RAW[name].search(html, at)
                at = n if end is None else end.start()
            else:
                page.start(name, m[2])
        else:
            page.text("<")
            at = to + 1
    page.flush()
    return page.blocks


def decide(blocks: list[Block], stops: frozenset[str] = STOPS) -> None:
    """First pass: each block by its length, links and stop words, beside what its markup says."""
    for b in blocks:
        unspaced = len(_UNSPACED.findall(b.text))
        if 2 * unspaced > len(b.text):
            b.words, b.stops = -(-unspaced // 2), sum(c in STOP_CHARACTERS for c in b.text) if stops else 0
        else:
            words = _WORD.findall(b.text.lower())
            b.words, b.stops = len(words), sum(w in stops for w in words)
    known = sum(b.stops for b in blocks) >= KNOWN_LANGUAGE * sum(b.words for b in blocks if not b.boiler)
    for b in blocks:
        size = len(b.text)
        if b.boiler or "©" in b.text and size < LONG_CHARS and not b.article:
            b.label = BAD
        elif b.link_chars > LINK_DENSITY * size:
            # A sentence that is one link may belong to the text around it; a list of links does not.
            sentence = b.tag not in ("li", "td") and b.density >= LOW_STOP_DENSITY and b.text[-1] in SENTENCE_ENDS
            b.label = None if sentence else BAD
        elif b.tag in _HEADINGS or size < SHORT_CHARS and b.words < SHORT_CHARS // 3:
            b.label = None
        elif size >= LONG_CHARS or 2 * b.words >= LONG_CHARS:
            b.label = GOOD if b.density >= LOW_STOP_DENSITY or not known else None if b.article else BAD
        elif b.density >= STOP_DENSITY or not known:
            b.label = NEAR
        if b.label is None and b.tag in _PARAGRAPHS and not b.link_chars and size < SHORT_CHARS and b.text[-1] in SENTENCE_ENDS:
            b.label = NEAR


def inherit(blocks: list[Block]) -> list[bool]:
    """Second pass: whether each block is content; undecided and near ones by their nearest decided neighbours."""
    n = len(blocks)
    good = {b.article for b in blocks if b.label == GOOD}
    if not good:  # no long block on the page: the near ones stand for them, those of an article first
        near = {b.article for b in blocks if b.label == NEAR}
        take = {max(near)} if near and max(near) else near
        for b in blocks:
            if b.label == NEAR and b.article in take:
                b.label = GOOD
        good = take
    if not good:  # nothing is content by itself: what nothing says is boilerplate, in an article or as a paragraph
        inside = any(b.article and b.label is None for b in blocks)
        alone = all(b.label is None for b in blocks)
        return [b.label is None and (alone or (bool(b.article) if inside else b.tag in _PARAGRAPHS or b.tag in _HEADINGS)) for b in blocks]
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        seen: dict[int, int] = {}
        for i in order:  # the nearest decided block of the same article, or of the page outside articles
            b = blocks[i]
            side[i] = seen.get(b.article)
            if b.label in (GOOD, BAD) and not (b.article and b.boiler):
                seen[b.article] = i
    content = []
    for i, b in enumerate(blocks):
        p, q = before[i], after[i]
        left, right = (None if x is None else blocks[x].label == GOOD for x in (p, q))
        if b.label in (GOOD, BAD):
            content.append(b.label == GOOD)
        elif b.article and b.article not in good:  # a teaser beside the article; kept where no article has decided content
            content.append(not any(good))
        elif p is None and q is None:
            content.append(bool(b.article))
        elif b.tag in _HEADINGS:
            content.append(bool(right if right is not None else b.article and left))
        elif b.label == NEAR and b.tag in _PARAGRAPHS:
            content.append(bool(left or right))
        elif left is None or right is None or left == right:
            content.append(bool(right if left is None else left))
        else:
            content.append(left if i - p <= q - i else right)
    return content


def main_text(html: str, stops: frozenset[str] = STOPS) -> str:
    blocks = page_blocks(html)
    decide(blocks, stops)
    return "\n".join(b.text for b, keep in zip(blocks, inherit(blocks), strict=True) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    schema = f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(extract, schema)
