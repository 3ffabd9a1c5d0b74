"""Main text of HTML pages by two passes of block rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.llm.common import map_texts

# Limits of the block rules, in characters and shares.
SHORT = 70
LONG = 200
STOP_HIGH = 0.30
STOP_LOW = 0.15
LINKS_HIGH = 0.33
# Share of a page's words that one language's stop words must reach, or shares of stop words say nothing about the page.
STOP_FITS = 0.20
# An article or main element vouches for its blocks if it holds this share of the text of the page's largest section.
VOUCH = 0.25

# Frequent function words of English, French, German and Spanish.
_STOP_LISTS = tuple(
    frozenset(words.split())
    for words in (
        """
        a about after all also an and any are as at be because been but by can could did do for from had has have he her
        his how i if in into is it its more most no not of on one only or other our out she so some such than that the
        their them then there these they this to up was we were what when which who will with would you your
        """,
        """
        au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me nous on ou par
        pas plus pour qu que qui sa se ses son sont sur un une vous
        """,
        """
        aber als am an auch auf aus bei bin bis das dass dem den der die doch ein eine einem einen einer es hat ich ihr
        im in ist mit nach nicht noch nur oder sich sie sind so und von vor war was wie wir zu zum zur über
        """,
        """
        a al como con de del desde donde el ella ellos en entre era es esta este fue ha hay la las lo los muy más ni no
        nos o para pero por porque que se según si sin sobre son su sus también tiene todo un una unos y ya
        """,
    )
)
STOP_WORDS = frozenset().union(*_STOP_LISTS)
# Elements, roles and class or id words.
_BLOCKS = frozenset(
    """
    address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1
    h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul
    """.split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILERPLATE_TAGS = frozenset("aside dialog footer form menu nav".split())
_BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form navigation search".split())
_BOILERPLATE_WORDS = frozenset(
    """
    ad ads adsbygoogle adslot adunit advert advertisement advertising adverts adverb banner breadcrumb breadcrumbs comment comments consent cookie
    cookies copyright disclaimer disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter
    notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond
    search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets
    """.split()
) - {"adverb"}
# Words that mark a class name they begin, whatever follows; the others mark it if only words of structure follow.
_MARKING = frozenset(
    """
    ad ads advert advertisement adverts breadcrumb breadcrumbs comment comments cookie cookies disqus footer gdpr masthead
    modal nav navbar navigation newsletter pager pagination popup promo sidebar signup sponsored toolbar topbar widget widgets
    """.split()
)
_STRUCTURE = frozenset(
    """
    area articles bar block body box btn button buttons col column container content footer form group header icon icons inner
    item items left link links list main notice outer panel posts right row section slot stories text thread toggle top
    unit wrap wrapper zone
    """.split()
)
# Words that mark a class name they end.
_HEADS = frozenset(
    """
    ad ads advert adverts banner breadcrumb breadcrumbs comment comments consent cookies footer form menu modal nav navbar
    navigation newsletter pager pagination popup promo promos share sharing sidebar signup sponsor sponsors toolbar topbar
    widget widgets
    """.split()
)
# Before such a head the name tells of a topic, and words of a title make any name a slug.
_TOPICS = frozenset("free long short market wave fair".split())
_TITLE = frozenset("a an and are as at by for from how in is it its of on or our that the their this to we what why with you your".split())
_PLACES = frozenset("article bottom entry global left main mobile page post primary right secondary site sticky top".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|noscript|template|svg|math|iframe|object|select|button|textarea|canvas|title)\b
        (?:[^>"']|"[^"]*"|'[^']*')*+>
      | <[!?][^>]*(?:>|\Z)
      | <(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)
      | <(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)
      | (?P<text>[^<]+|<)""",
    re.DOTALL | re.IGNORECASE | re.VERBOSE,
)
# Elements whose content is never markup: they have no self-closed form and run to the page's end if nothing ends them.
_RAW_TEXT = frozenset("script style textarea title".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    tag: str
    boilerplate: bool  # inside a menu, footer, form, advert and so on
    article: int  # number of the enclosing article, 0 for none
    main: bool
    label: str = ""


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, bool, int, bool]] = field(default_factory=list)  # tag, boilerplate, article, main
    text: list[str] = field(default_factory=list)
    tag: str = "body"
    links: int = 0
    in_link: bool = False
    articles: int = 0

    def end_block(self, tag: str) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, boilerplate, article, main = self.stack[-1] if self.stack else ("", False, 0, False)
            self.blocks.append(Block(text, self.links, self.tag, boilerplate, article, main))
        self.text, self.links, self.tag = [], 0, tag

    def open(self, tag: str, attributes: str) -> None:
        _, boilerplate, article, main = self.stack[-1] if self.stack else ("", False, 0, False)
        words, roles, hidden = _marks(attributes, tag) if attributes else ((), (), False)
        if tag == "article" or "article" in roles:
            self.articles += 1
            article = self.articles
        main = main or tag == "main" or "main" in roles
        if tag not in ("html", "body", "main", "article"):
            boilerplate = (
                boilerplate
                or hidden
                or tag in _BOILERPLATE_TAGS
                or (tag == "header" and not article and not main)
                or any(w in _BOILERPLATE_WORDS or w in _HEADS or (w == "header" and not article and not main) for w in words)
                or any(r in _BOILERPLATE_ROLES for r in roles)
            )
        elif tag == "article":
            boilerplate = boilerplate or any(w in ("comment", "comments", "reply", "ad", "advert", "promo", "related") for w in words)
        self.stack.append((tag, boilerplate, article, main))

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            # A stray end tag does not close what surrounds its section.
            if self.stack[k][0] in ("article", "main", "body") and tag in ("p", "span", "li", "div"):
                return


def _marked(name: str) -> str:
    """The word that makes a class name or id one of boilerplate (or of a header), empty if none does."""
    parts = [p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if p]
    whole = "".join(parts)
    if whole in _BOILERPLATE_WORDS or whole == "header":
        return whole
    if any(p in _TITLE for p in parts):
        return ""
    if len(parts) > 1 and parts[-1] in _HEADS and parts[-2] not in _TOPICS:
        return parts[-1]
    while len(parts) > 1 and parts[0] in _PLACES:
        del parts[0]
    if not parts or (parts[0] not in _BOILERPLATE_WORDS and parts[0] != "header"):
        return ""
    structure = all(p in _STRUCTURE or p in _BOILERPLATE_WORDS or p.isdigit() for p in parts[1:])
    return parts[0] if structure or parts[0] in _MARKING else ""


def _marked_id(name: str) -> str:
    """The marking word of a section's id: of one word, or of words of structure and boilerplate alone; else it is a title."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name.lower()) if p]
    known = all(p in _STRUCTURE or p in _PLACES or p in _BOILERPLATE_WORDS or p.isdigit() for p in parts)
    marking = [p for p in parts if p in _MARKING or (len(parts) > 1 and p in ("banner", "related", "share", "sponsor"))]
    return marking[0] if known and marking else ""


def _marks(attributes: str, tag: str) -> tuple[list[str], list[str], bool]:
    """Boilerplate words of the class names and the id, roles, and whether the element is hidden.

    A class name marks by its first word, if words of structure follow or the word
    marks whatever follows, or by its last; a name with words of a title marks nothing.
    The id of a heading or section is mostly made from its title: a heading's says
    nothing, a section's only what ``_marked_id`` finds.
    """
    words: list[str] = []
    roles: list[str] = []
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "role":
            roles += value.lower().split()
        elif name == "hidden":
            hidden = True
        elif name == "class":
            words += filter(None, map(_marked, value.split()))
        elif tag in ("section", "article"):
            words += filter(None, map(_marked_id, value.split()))
        elif tag not in _HEADINGS:
            words += filter(None, map(_marked, value.split()))
    return words, roles, hidden


def _behind(html: str, tag: str, at: int, unended: set[str]) -> int:
    """Where the page goes on behind a skipped element whose start tag ends at ``at``; ``unended`` is kept over a page."""
    if tag not in _RAW_TEXT and (tag in unended or html[at - 2] == "/"):
        return at
    if end := re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at):
        return end.end()
    unended.add(tag)
    return len(html) if tag in _RAW_TEXT else at


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order with what the rules look at."""
    page = _Page()
    skip_to = 0
    body = re.search(r"</head\s*>|<body\b", html, re.IGNORECASE)
    if body and re.match(r"\s*(<!doctype[^>]*>|<html\b[^>]*>|<!--.*?-->|\s)*<head\b", html[: body.start()], re.IGNORECASE | re.DOTALL):
        skip_to = body.start()
    at, unended = skip_to, set()
    while m := _TOKEN.match(html, at):
        at = m.end()
        if m["raw"]:
            at = _behind(html, m["raw"].lower(), at, unended)
        text = m["text"]
        if text is not None:
            text = unescape(text)
            page.text.append(text)
            if page.in_link:
                page.links += len(text.strip())
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        closing = m["close"] if m["tag"] else m["close2"]
        if not tag:
            if m["raw"] and m["raw"].lower() in ("button", "select", "textarea"):
                page.text.append(" ")
            continue
        if tag == "br":
            page.text.append(" ")
        elif tag == "a":
            page.in_link = not closing
        elif tag in _BLOCKS:
            page.end_block("body" if closing else tag)
            page.in_link = False
            while page.stack and page.stack[-1][0] == "p" and (not closing or tag != "p"):
                page.stack.pop()
            if closing:
                page.close(tag)
            elif tag not in _VOID:
                page.open(tag, m["attrs"] or m["attrs2"] or "")
        elif tag not in _VOID:
            attributes = m["attrs"] or m["attrs2"] or ""
            if closing:
                if any(s[0] == tag for s in page.stack):
                    page.end_block(page.tag)
                    page.close(tag)
            elif attributes and any(w in _BOILERPLATE_WORDS for w in _marks(attributes, tag)[0]):
                page.end_block(page.tag)
                page.open(tag, attributes)
    page.end_block("body")
    return page.blocks


def _section(block: Block) -> tuple[bool, int]:
    """Innermost article, else main, else the rest of the page."""
    return (bool(block.article) or block.main, block.article)


def _fits(blocks: list[Block]) -> bool:
    """Whether the page is in a language of the stop-word lists."""
    plain = [b for b in blocks if not b.boilerplate and b.links / len(b.text) <= LINKS_HIGH]
    words = _LETTERS.findall(" ".join(b.text for b in plain if len(b.text) >= SHORT).lower())
    known = [w for w in words if w in STOP_WORDS]
    return any(sum(w in own for w in known) >= STOP_FITS * len(words) for own in _STOP_LISTS) and bool(words)


def _judge(block: Block, fits: bool) -> str:
    """Label of a block that nothing vouches for, empty if ambiguous."""
    if block.boilerplate or block.links / len(block.text) > LINKS_HIGH:
        return "bad"
    # A character of a script without spaces stands for about three letters.
    if len(block.text) + (0 if fits else 2 * len(_WIDE.findall(block.text))) < SHORT:
        return "bad" if block.text[0] in "©" or block.text.lower().startswith("copyright") else ""
    if not fits:
        return "good"
    words = _LETTERS.findall(block.text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if share >= STOP_HIGH or (share >= STOP_LOW and len(block.text) > LONG):
        return "good"
    return "bad" if share < STOP_LOW else ""


def classify(blocks: list[Block]) -> None:
    """Label every block good or bad.

    First pass, block by block: boilerplate sections and link-heavy blocks are
    bad; blocks of ``SHORT`` characters or more are good if their share of stop
    words is high, or fair and the block is long, bad if it is low. On a page in
    none of the four languages all such blocks are good. The rest is
    ambiguous. An article or main element whose text outside links reaches
    ``VOUCH`` of that of the largest section (for the rest of the page, of its
    good blocks) vouches for its blocks, whatever their share of stop words or
    links; smaller ones, such as teasers, are judged like the rest.
    Second pass: an ambiguous block takes the label of the nearest decided block
    of its own section; between two equally near ones a heading follows the next
    block and others are good if either is.
    """
    own: dict[tuple[bool, int], int] = {}
    fits = _fits(blocks)
    for block in blocks:
        block.label = _judge(block, fits)
        section = _section(block)
        if not block.boilerplate and (section[0] or block.label == "good"):
            own[section] = own.get(section, 0) + len(block.text) - block.links
    largest = max(own.values(), default=0)
    inside = [_section(b)[0] and own.get(_section(b), 0) >= VOUCH * largest for b in blocks]
    for block, within in zip(blocks, inside, strict=True):
        if within and not block.boilerplate:
            block.label = "good" if len(block.text) >= SHORT and block.links / len(block.text) <= LINKS_HIGH else ""
    _inherit(blocks, inside)


def _inherit(blocks: list[Block], inside: list[bool]) -> None:
    n = len(blocks)
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[tuple[bool, int], tuple[int, str]] = {}
        for k in order:
            section = _section(blocks[k])
            found[k] = last.get(section)
            # What a menu or an advert inside the section says is no evidence for its neighbours.
            if blocks[k].label and not (inside[k] and blocks[k].boilerplate):
                last[section] = (k, blocks[k].label)
    for k, block in enumerate(blocks):
        if block.label:
            continue
        a, b = before[k], after[k]
        if a and b:
            near_a, near_b = k - a[0], b[0] - k
            if near_a == near_b:
                label = b[1] if block.tag in _HEADINGS else "good" if "good" in (a[1], b[1]) else "bad"
            else:
                label = a[1] if near_a < near_b else b[1]
        else:
            label = (a or b or (0, "good" if inside[k] else "bad"))[1]
        block.label = label


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = blocks_of(html)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page from its whole HTML: page_id, url, text, n_chars.

    Blocks are joined in page order by a line end; inside a block character
    references are decoded and white space is one space. One map over the rows.
    Defined cases: null or empty HTML and pages without a good block give an
    empty text; null urls and ids stay; repeated rows stay; an empty table gives
    no rows; other columns are not read.
    """

    def work(ids: pa.Array, texts: list[bytes | None]):
        yield {
            "page_id": ids.field("page_id"),
            "url": ids.field("url"),
            "text": [main_text(t.decode("utf-8", "replace")) if t else "" for t in texts],
        }

    rows = pages.select(
        F.struct(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url")).alias("doc_id"),
        F.col(html_col).cast("string").alias("text"),
    )
    return map_texts(rows, work, "page_id bigint, url string, text string").withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
