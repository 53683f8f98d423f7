"""Main text of HTML pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precepta.llm.common import in_python

#: Articles are teasers where the prose outside is more than so many times their text; then the whole page is judged.
TEASER = 3
#: A block of fewer characters is short; one is link text beyond this share, and prose from this share of stop words on.
SHORT_CHARS, LONG_CHARS, LINK_DENSITY, STOP_DENSITY = 70, 200, 0.5, 0.1
# Common function words of four languages, elements and names of what is not the article.
STOP_WORDS = frozenset(
    """a about an and are as at be been but by can for from had has have he her his i if in is it its more not of on one or she so
    than that the their there they this to was we were what when which who will with would you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous
    aber als auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich im ist mit nach nicht noch oder sich sie sind so
    und von vor war wie wir zu zum zur
    al como con del el ella era esta este fue ha hay la las lo los más me mi no nos o para pero por se sin sobre su sus también todo y ya""".split()
)
BLOCKS = frozenset("address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 head hr html li main ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("aside button canvas dialog footer form head header iframe menu nav object select svg".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements that hold others of their kind apart: end tags and implied ends inside don't reach beyond them.
CELLS, LISTS = frozenset("button caption object table td th".split()), frozenset("dir menu ol ul".split())
ROWS = frozenset("caption tbody td tfoot th thead tr".split())
#: What a start tag ends, and what keeps it from doing so; paragraphs are ended by blocks besides.
ENDED = {
    "li": (("li",), LISTS | CELLS),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), CELLS | {"dl"})),
    **dict.fromkeys(("option", "optgroup"), (("option",), CELLS | {"select"})),
    **dict.fromkeys(("td", "th"), (("td", "th"), frozenset(("table",)))),
    "tr": (("tr",), frozenset(("table",))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot"), frozenset(("table",)))),
}
P_ENDS = BLOCKS - frozenset("body br head html option tbody td tfoot th thead title tr".split()) | frozenset("aside dialog footer form header hgroup menu nav search".split())
# Words of class and id names of reader comments and of what isn't the article, and words with which a
# name tells a state or a kind of page instead (has-sidebar, comments-open, search-result-page).
COMMENTS = frozenset("comment comments commentlist disqus replies respond review reviews userreviews".split())
OTHERS = frozenset(
    """ad ads advert adverts advertisement advertisements adsense alert banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header
    login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promotion related
    search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split()
)
#: Words that may stand beside those of OTHERS in a name that means the element itself (footer-links); inside an article a
#: name with any other word (cookie-recipe, related-work) is one of its subject.
PARTS = frozenset(
    """area bar block bottom box button buttons col column container content cta desktop form global group icon icons inner inline item items left
    link links list main media mobile module nav outer page panel post posts primary right row secondary section shell site slot stories
    strip sub top unit wrap wrapper""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STATES, KINDS = frozenset("has is no not with without".split()), frozenset("closed disabled enabled layout open page template".split())
ROLES = re.compile(r"(?i)role\s*=\s*[\"']?(?:alert|banner|complementary|contentinfo|dialog|form|menu|menubar|navigation|search)\b")
NAMES = re.compile(r"(?i)(?<![\w-])(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b[^>]*+(?:>|\Z).*?(?:</\1\s*+>|\Z)"
    r"|<(/?+)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?+)([a-zA-Z][\w:-]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
WORD = re.compile(r"[^\W\d_]+")


class _Open:
    """The elements that are open, each with its place; each step takes constant time on average.

    Both steps return the place of the outermost element they end, or one past all places.
    """

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.blocks: list[int] = []
        self.places: dict[str, list[int]] = {}

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def end(self, place: int) -> int:
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()
        return place

    def start_tag(self, tag: str, left_out: int) -> int:
        """Ends what the tag implies and opens it. A block in the left-out element doesn't end a paragraph around that."""
        ended = len(self.tags)
        if tag in ENDED:
            tags, keep = ENDED[tag]
            if (place := self.last(tags)) > self.last(keep):
                ended = self.end(place)
        if tag in P_ENDS and (place := self.last(("p",))) > self.last(CELLS) and (tag == "p" or place >= left_out):
            ended = min(ended, self.end(place))
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.tags))
            if tag in BLOCKS or tag in DROPPED:
                self.blocks.append(len(self.tags))
            self.tags.append(tag)
        return ended

    def end_tag(self, tag: str, left_out: int) -> int:
        """Ends the nearest element of the tag with all in it, but not from inside of what holds elements apart."""
        place = self.last((tag,))
        if tag in MAIN or tag in ("body", "html", "table") or place == left_out:
            keep = -1
        elif tag in ROWS:
            keep = self.last(("table",))
        elif tag in BLOCKS or tag in DROPPED:
            keep = self.last((CELLS | LISTS if tag == "li" else CELLS) - {tag})
        else:
            keep = self.blocks[-1] if self.blocks else -1
        return self.end(place) if place > keep else len(self.tags)


def _named(name: str, article: bool) -> int:
    """What a class or id name says: 2 for reader comments, 1 for anything else that isn't the article, 0 for neither."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    if not words or STATES.intersection(words) or words[-1] in KINDS:
        return 0
    if COMMENTS.intersection(words):
        return 2
    others = [w in OTHERS or w.endswith("sidebar") for w in words]
    return int(any(others) and (not article or all(o or w in PARTS for o, w in zip(others, words, strict=True))))


def _unwanted(tag: str, attributes: str, article: bool) -> int:
    """0 for an element that may be main text, 1 for others, 2 for reader comments.

    The header of an article is part of it, and headings are what stands around them, whatever their names.
    """
    if tag in DROPPED and not (tag == "header" and article):
        return 1
    if not attributes or tag in ("html", "body") or tag in HEADINGS:
        return 0
    names = [_named(name, article) for found in NAMES.findall(attributes) for name in found.strip("\"'").split()]
    worst = max(names, default=0)
    if worst == 2 or tag in MAIN:
        return worst if worst == 2 else 0
    return int(worst > 0 or bool(ROLES.search(attributes)))


@dataclass
class _Region:
    """An unwanted element: where it is open, and what has been read of its last block. The page itself is one, number 0."""

    number: int
    place: int
    kind: int
    tag: str
    link: bool = False
    links: int = 0
    parts: list[str] = field(default_factory=list)


def blocks(page: str) -> tuple[list[tuple[str, int, int, int]], list[_Region]]:
    """(text, characters in links, number of the article it lies in or 0, region) of the blocks of a page, and its regions.

    Blocks come in order. Region 0 is the page; each element that isn't the article by its name or class is a region of
    its own. One without an end tag ends with its parent, at the next sibling that implies its end, or where an article
    begins; void elements hold nothing. A comment that is never closed ends with its first >.
    """
    if (tail := page.rfind("-->") + 1) < len(page):
        page = page[:tail] + page[tail:].replace("<!--", "<!")
    found: list[tuple[str, int, int, int]] = []
    article = articles = depth = inside = 0
    opened, regions = _Open(), [_Region(0, -1, 0, "")]
    stack = [regions[0]]

    def close() -> None:
        top = stack[-1]
        text = " ".join(html.unescape("".join(top.parts)).split())
        if text:
            found.append((text, top.links, article, top.number))
        top.parts.clear()
        top.links = 0

    def leave(place: int) -> None:
        while stack[-1].place >= place:
            close()
            stack.pop()

    def add(text: str) -> None:
        if text:
            stack[-1].parts.append(text)
            if stack[-1].link:
                stack[-1].links += len(" ".join(html.unescape(text).split()))

    for token in TOKEN.finditer(page):
        add(page[inside : token.start()])
        inside = token.end()
        shut, tag, attributes = token[2] or token[5], token[3] or token[6], token[4] or token[7] or ""
        if not tag:
            continue
        tag = tag.lower()
        holds = tag in VOID or not attributes.endswith("/")
        left_out = stack[1].place if len(stack) > 1 else -1
        ended = opened.end_tag(tag, left_out) if shut else opened.start_tag(tag, left_out) if holds else len(opened.tags)
        unwanted = 0 if shut else _unwanted(tag, attributes, bool(article))
        if left_out >= 0:
            own = shut and any(r.place == ended for r in stack[1:])
            in_main = stack[1].tag in MAIN
            leave(max(ended, 0))
            if own:
                continue
            if len(stack) > 1:
                if shut or tag not in MAIN or in_main or unwanted:
                    if unwanted:
                        if tag in BLOCKS or tag in DROPPED:
                            close()
                        if tag not in VOID and holds:
                            regions.append(_Region(len(regions), len(opened.tags) - 1, max(unwanted, stack[-1].kind), tag))
                            stack.append(regions[-1])
                    elif tag in BLOCKS:
                        close()
                    elif tag == "a":
                        stack[-1].link = not shut
                    continue
                leave(0)
        if unwanted:
            if tag in BLOCKS or tag in DROPPED:
                close()
            if tag not in VOID and holds:
                regions.append(_Region(len(regions), len(opened.tags) - 1, unwanted, tag))
                stack.append(regions[-1])
            continue
        if tag in BLOCKS or tag == "header":
            close()
        if tag == "a":
            stack[-1].link = not shut
        elif tag in MAIN:
            depth = max(0, depth + (-1 if shut else 1))
            if not shut and depth == 1:
                articles += 1
            article = articles if depth else 0
    add(page[inside:])
    leave(0)
    close()
    return found, regions


def _is_prose(text: str, links: int) -> bool:
    """Whether enough of text's words are stop words and not links; words of other scripts than theirs count as known."""
    words = WORD.findall(text.lower())
    if sum(w[0] > "\u024f" for w in words) > len(words) / 2:
        return links <= LINK_DENSITY * len(text)
    return bool(words) and links <= LINK_DENSITY * len(text) and sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words)


def classify(page_blocks: list[tuple[str, int, int]]) -> list[bool]:
    """Whether each block (text, characters in links, article) is main text.

    First pass: a block mostly of links is not; one that isn't short and has the stop words of prose is, and so is a long
    one without links; any other is left open. Second pass: an open block takes the label of the nearest decided blocks
    before and after it, of the same article or of the page outside: where they differ, main text inside an article, and
    outside the nearer one's, ties being main text. Where no block is decided, it is main text. If a page has an
    article, what lies outside is none.
    """
    has_article = any(article for _, _, article in page_blocks)
    labels: list[bool | None] = []
    for text, links, article in page_blocks:
        if has_article and not article or links > LINK_DENSITY * len(text):
            labels.append(False)
        elif len(text) < SHORT_CHARS:
            labels.append(None)
        else:
            long = len(text) >= LONG_CHARS
            labels.append(long and bool(article) or _is_prose(text, links) or (links == 0 if long else None))
    near: list[list[tuple[int, bool]]] = [[] for _ in labels]
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last: dict[int, int] = {}
        for i in order:
            article = page_blocks[i][2]
            if labels[i] is not None:
                last[article] = i
            elif article in last:
                near[i].append((abs(last[article] - i), not labels[last[article]]))
    return [label if label is not None else not min(n)[1] if n and not page_blocks[i][2] else not n or not all(x[1] for x in n) for i, (label, n) in enumerate(zip(labels, near, strict=True))]


def extract(page: str | None) -> tuple[str, int, int]:
    """(main text, blocks, kept blocks) of a page.

    Regions are left out, unless a form or an element unwanted by its class holds the page's prose: half of it where no
    block of prose is left without, else three quarters, in two blocks or more. Reader comments always are. Where articles
    are mere teasers of the page's prose (see TEASER), they don't shut out what lies outside.
    """
    found, regions = blocks(page or "")
    prose = [0 if regions[r].kind == 2 else len(text) - links for text, links, _, r in found]
    taken, whole = {0}, sum(prose)
    own = dict.fromkeys((r.number for r in regions), 0)
    for (*_, r), n in zip(found, prose, strict=True):
        own[r] += n
    wrappers = [r.number for r in regions[1:] if r.kind == 1 and 2 * own[r.number] > whole and (r.tag == "form" or r.tag not in DROPPED)]
    if wrappers:  # one at most, as it holds more than half
        dense = [r for text, links, _, r in found if len(text) >= SHORT_CHARS and r in (0, *wrappers) and _is_prose(text, links)]
        if dense.count(wrappers[0]) >= 2 and (0 not in dense or 4 * own[wrappers[0]] > 3 * whole):
            taken.add(wrappers[0])
    held = [b[:3] for b in found if b[3] in taken]
    dense = [(len(text), article) for text, links, article in held if len(text) >= SHORT_CHARS and _is_prose(text, links)]
    outside = sum(n for n, article in dense if not article)
    if outside >= LONG_CHARS and outside > TEASER * sum(len(text) for text, _, article in held if article):
        held = [(text, links, 0) for text, links, _ in held]
    kept = [b[0] for b, label in zip(held, classify(held), strict=True) if label]
    return " ".join(kept), len(held), len(kept)


def _extractor(batches):
    for batch in batches:
        rows = [extract(x) for x in batch.column(2).to_pylist()]
        texts = [r[0] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of each row of pages (page_id, url, html): page_id, url, text, n_chars, n_blocks, n_kept.

    Blocks are classified by length, link density and stop words, and ambiguous short ones by their neighbours (see
    classify). Character references are decoded; white space within a block is one space, and blocks are joined by one.
    Null or empty html gives an empty text. Broken markup is read as far as it goes. Nothing is shuffled; repeated rows
    and null ids are kept; further columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_python(pages, _extractor, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
