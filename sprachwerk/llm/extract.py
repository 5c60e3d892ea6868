"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. What a menu, footer, advert, form, script or reader's
comment holds by its tag, role or class is out before any rule. The first pass decides a block from its
length, its share of function words and its share of link text; short blocks and those that are near
the line stay open. The second pass gives an open block the label of its nearest decided neighbours.
Inside an article or main element, text is presumed to belong unless it is mostly links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sprachwerk.llm.common import carried, table

#: Code points below which a block is short, and above which many function words decide it alone.
SHORT, LONG = 70, 200
#: Shares of function words, and the share of link text that rules a block out.
FEW_STOPS, MANY_STOPS, LINKS = 0.15, 0.25, 0.4

STOPS = frozenset(
    "the of and to in a is that it for on as with are be by this was not or an at from but have has his her they you which their all we can will one been more if no so "
    "der die das und in zu den mit von ist im für auf des ein eine dem nicht sich es auch als an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis "
    "le la les de des du et un une en que qui dans pour par sur pas au plus ne se ce il sont avec est son sa ou mais nous vous aux cette "
    "el los las del y que en un una por con no su para es al lo como más o pero sus se este ya entre cuando".split()
)

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav footer aside form menu dialog button select header datalist object audio video canvas map".split())
#: Elements whose end tag may be left out: the start tags that end them, and the elements at whose start or end they cannot go on.
_P_ENDERS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
_ROW_ENDERS = frozenset("td th tr tbody thead tfoot".split())
_ENDED_BY = {
    "p": _P_ENDERS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "optgroup": frozenset(["optgroup"]),
    "td": _ROW_ENDERS,
    "th": _ROW_ENDERS,
    "tr": frozenset("tr tbody thead tfoot".split()),
    "tbody": frozenset(["tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]),
    "tfoot": frozenset(["tbody"]),
}
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar alert alertdialog dialog form tablist tooltip status".split())
#: What a part of a page is called that is no article: alone, as the last word of a name, or before a word for a holder.
_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination paywall popup promo promos promotion recommended related replies reply respond share sharing sidebar signup social "
    "sponsor sponsored sponsors subscribe subscription taboola teaser teasers toolbar topbar widget widgets".split()
)
_HOLDERS = frozenset("area bar block blocks body bottom box button buttons container content form group holder inner item items left link links list message outer overlay panel posts right row section slot text thread title top unit wrap wrapper".split())
#: Words that only say whether such a part is there, and what an article's own header is called after.
_TELLING = frozenset("disabled enabled has hide hidden is no not off on open show toggle with without".split())
_OWN_HEADER = frozenset("article content entry headline news page post section story title".split())
_WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style)\b(?:[^>]*[^>/])?>.*?(?:</\1\s*>|\Z)"
    # these are taken out with what they hold only if they end
    r"|<(noscript|template|svg|iframe|textarea|title|noframes|xmp|annotation|annotation-xml)\b(?:[^>]*[^>/])?>.*?</\2\s*>"
    r"|<[!?][^>]*>",
    re.I | re.S,
)
_PAGE_PARTS = re.compile(r"<(?:article|main|h1)\b|</form\s*>", re.I)
_INLINE = frozenset("a abbr b cite code em i kbd q s samp small span strong sub sup u var".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("parts", "linked", "inside", "heading", "good")

    def __init__(self, inside: bool, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.inside, self.heading = inside, heading
        self.good: bool | None = None


@lru_cache(1 << 16)
def _named_out(name: str, inside: bool) -> bool:
    """Whether a class or id names a part that is no article: site-footer does, with-sidebar and comments-enabled don't."""
    words = [w.lower() for w in _WORDS_OF_NAME.findall(name)]
    if not words or not _TELLING.isdisjoint(words):
        return False
    if words[-1] == "header" and (inside or words[0] in _OWN_HEADER):
        return False
    return words[-1] in _NAMES or "".join(words) in _NAMES or words[-1] in _HOLDERS and not _NAMES.isdisjoint(words[:-1])


def _out(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element is no part of an article, by its tag or what it is called."""
    if tag in OUT:
        return True
    if not attributes.strip() or tag in ("html", "body", "main", "article") and "comment" not in attributes.lower():
        return False
    own = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(attributes)}
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    return own.get("role", "").lower() in _ROLES or any(_named_out(name, inside) for k in ("class", "id") for name in own.get(k, "").split())


def _page_form(page: str, at: int) -> bool:
    """Whether the form that begins before `at` holds an article or a headline, as where one form is a whole page."""
    first = _PAGE_PARTS.search(page, at)
    return first is not None and first[0][1] != "/"


def _ended(open_: list[str], tag: str) -> int:
    """How many of the open elements go on when tag begins."""
    on = len(open_)
    for i in range(len(open_) - 1, -1, -1):
        if tag in _ENDED_BY.get(open_[i], ()):
            on = i
        elif open_[i] == "table" or tag not in _ROW_ENDERS and open_[i] in BLOCKS and open_[i] not in ("address", "div", "p"):
            break
    return on


def _blocks(page: str) -> list[tuple[str, Block]]:
    """(text, block) of each block outside excluded elements, in page order; empty ones are left out."""
    page = _RAW.sub(" ", page)
    found: list[Block] = []
    skip: list[str] = []  # an excluded element and the open ones inside it; where end tags are needed, those of its name alone
    inside = heading = link = 0
    in_header: list[str] = []
    block: Block | None = None
    at = 0

    def text(piece: str) -> None:
        nonlocal block
        if skip or not piece:
            return
        if block is None:
            if not piece.strip():
                return
            block = Block(inside > 0, heading > 0)
            found.append(block)
        block.parts.append(piece)
        if link:
            block.linked += len(piece.strip())

    for m in _TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if attributes and not close and tag in _INLINE and "=" not in attributes and attributes.strip(" /") and not skip and tag != "a":
            text(m[0])  # as in `if a <b and c> d`: no such element has attributes without a value
            continue
        if skip:
            if skip[0] not in _ENDED_BY:
                if tag == skip[0] and not attributes.rstrip().endswith("/"):
                    skip.pop() if close else skip.append(tag)
                continue
            if close and tag in skip:
                del skip[len(skip) - 1 - skip[::-1].index(tag) :]
                continue
            if tag not in BLOCKS or close and tag == "p":
                continue
            ended = 0 if close else _ended(skip, tag)
            if ended:
                del skip[ended:]
                if tag not in VOID and not attributes.rstrip().endswith("/"):
                    skip.append(tag)
                continue
            skip.clear()  # a sibling begins, or an element around it ends: this tag counts as any other
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS:
            block = None
        if close:
            if tag in ("article", "main"):
                inside = max(0, inside - 1)
            elif tag[:1] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
                heading = 0
            elif tag == "a":
                link = 0
            elif in_header and tag == "header":
                in_header.pop()
            continue
        if tag not in VOID and not (tag == "header" and inside) and not (tag == "form" and _page_form(page, at)) and _out(tag, attributes, inside > 0):
            if not attributes.rstrip().endswith("/"):
                skip.append(tag)
            block = None if tag in BLOCKS else block
            continue
        if tag in ("article", "main"):
            inside += 1
        elif tag[:1] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
            heading = 1
        elif tag == "a":
            link = 1
        elif tag == "header":
            in_header.append(tag)
    text(page[at:])
    out = []
    for b in found:
        t = " ".join(html.unescape("".join(b.parts)).split())
        if t:
            out.append((t, b))
    return out


def _decide(blocks: list[tuple[str, Block]]) -> None:
    """First pass: what a block's own words tell. good stays None where they don't."""
    article = any(b.inside for _, b in blocks)
    few: list[Block] = []
    covered = False  # whether a block shows that the page's language is one of the list
    for t, b in blocks:
        links = b.linked / len(t)
        if links > LINKS:
            b.good = False
        elif b.inside:
            b.good = True
        elif article:
            b.good = False
        else:
            words = _WORD.findall(t.lower())
            stops = sum(w in STOPS for w in words) / len(words) if words else 0.0
            if b.heading or len(t) < SHORT:
                b.good = False if b.linked else None
            elif stops >= MANY_STOPS:
                covered = True
                b.good = True if len(t) > LONG else None
            elif stops < FEW_STOPS:
                few.append(b)
    for b in few:  # function words tell nothing in another language: there the length decides
        b.good = not covered
    # second pass: blocks near the line first, bad only between bad ones; then the short ones
    near = [i for i, (t, b) in enumerate(blocks) if b.good is None and not b.heading and len(t) >= SHORT]
    _inherit(blocks, near, mixed=True)
    _inherit(blocks, [i for i, (_, b) in enumerate(blocks) if b.good is None], mixed=None)


def _inherit(blocks: list[tuple[str, Block]], open_: list[int], mixed: bool | None) -> None:
    """Labels of the nearest decided blocks on either side; where they differ, `mixed` or the nearer one's.

    A heading goes with what follows it. On a page without any decision every block is kept.
    """
    n = len(blocks)
    left: list[int | None] = [None] * n
    right: list[int | None] = [None] * n
    for side, order in ((left, range(n)), (right, range(n - 1, -1, -1))):
        last = None
        for i in order:
            side[i] = last
            if blocks[i][1].good is not None:
                last = i
    labels = []
    for i in open_:
        a, c = left[i], right[i]
        one, two = (None if x is None else blocks[x][1].good for x in (a, c))
        if one is None and two is None:
            labels.append(None if mixed else True)
        elif one is None or two is None or one == two:
            labels.append(bool(one if two is None else two))
        elif mixed is not None:
            labels.append(mixed)
        elif blocks[i][1].heading:
            labels.append(two)
        else:
            labels.append(one if i - a <= c - i else two)
    for i, label in zip(open_, labels, strict=True):
        blocks[i][1].good = label


def main_text(page: str) -> str:
    """The article of a page: its blocks joined by line ends, empty if there is none.

    Markup that never ends costs nothing but itself, scripts and styles apart, which go to the end. A page
    is held whole, however long; equal pages give equal texts.
    """
    blocks = _blocks(page)
    _decide(blocks)
    return "\n".join(t for t, b in blocks if b.good)


def extract(pages: DataFrame, out: str = "text") -> DataFrame:
    """pages(html, …) with string column `out`, the main text of the whole html.

    Null and empty html give the empty text; bytes that are no UTF-8 are replaced. Repeated rows each
    get theirs. A column that is already called `out` is replaced, other columns stay, whatever their
    names. An empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (out, "html")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_buffer().to_pybytes().decode("utf-8", "replace")) if x.is_valid else "" for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, out])

    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(out, T.StringType())])
    return pages.select(*carried(kept), F.col("html").cast("binary").alias("_sw_html")).mapInArrow(run, schema)


def op5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length in code points, over the whole table; edge cases as in `extract`."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
