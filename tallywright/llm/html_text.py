"""Main text of web pages by block rules in two passes.

The first pass cuts a page into blocks and decides each by its container, link density, stop-word density
and length; blocks too short or too plain to decide stay open. In the second pass an open block takes the
label of its nearest decided neighbours; what no neighbour decides goes by whether an article holds it. Stop
words speak against a block only where the page is in their languages, and a page without an article and
without a block decided as text keeps all that is open.
The scan is linear in the page, whatever is left unclosed: open elements are counted, never searched.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame

from .tables import map_rows

# Frequent function words of the languages that pages are in.
STOP_WORDS = frozenset(
    """the of and to a in is was that for it with as be on by at this are from or an have not which but he his they
    der die das und ist von den mit zu ein eine des dem im nicht auf als auch es sich für bei aus nach wird sind oder
    le la les de des et un une en du que est pour dans qui sur par plus au pas avec ce il sont ou se
    el los las y del que en un una por con para su es lo como más al se no""".split()
)
# Names of HTML elements and of the classes that sites give to what isn't the article.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead title tr ul""".split()
)
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg object canvas audio video select annotation annotation-xml".split())
# Of these, left unclosed, the rest of the page is their contents; of the others only the tag goes.
SWALLOWING = frozenset("script style textarea xmp noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form head dialog menu button search".split())
NAMES = frozenset(
    """ad ads adv advert advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments comment-list
    consent cookie cookies cookie-notice disclaimer disqus footer gdpr header login masthead menu nav navbar navigation
    newsletter notice notices notification pagination popup promo promoted promotion related reader-comments replies
    respond share sharing sidebar signup site-footer site-header social sponsor sponsored subscribe subscription
    toolbar widget widgets complementary contentinfo""".split()
)
# Words that say where such a part is, not what it holds.
PLACES = frozenset("area bar block bottom box button buttons container global inner left link links list main mobile outer primary right secondary section site slot sticky top unit wrap wrapper".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAX_LINKS, STOP_HIGH, STOP_LOW, LONG, SHORT = 0.4, 0.25, 0.1, 160, 60

_STOP_OR_END = re.compile(r"[>\"']")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_EMPTY = re.compile(r"[\s\"']/$")
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


@functools.lru_cache(64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>?", re.I)


def _attrs(attrs: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'")) for name, value in _ATTR.findall(attrs)]


def _named_outside(attrs: str) -> int:
    """2 for what is hidden or named as not the article, 1 for what is so only outside an article, else 0."""
    most = 0
    for key, value in _attrs(attrs):
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _UNSEEN.search(value)):
            return 2
        for name in value.lower().split() if key in ("class", "id", "role") else ():
            parts = _PARTS.split(name)
            # a compound counts whole: "footer-links" does, "social-policy" and "entry-header" don't
            if name in NAMES or ((parts[0] in NAMES or parts[-1] in NAMES) and all(x in NAMES or x in PLACES or x[:1].isdigit() for x in parts)):
                most = max(most, 1 if all(x == "header" or x not in NAMES for x in parts) and name not in NAMES - {"header"} else 2)
    return most


class Block:
    __slots__ = ("article", "heading", "links", "outside", "text")

    def __init__(self, text: str, links: int, outside: bool, article: bool, heading: bool):
        self.text, self.links, self.outside, self.article, self.heading = text, links, outside, article, heading


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, references decoded and white space squeezed."""
    out: list[Block] = []
    text: list[str] = []
    linked = 0  # characters inside links of the open block
    stack: list[tuple[str, bool]] = []  # open block elements and whether what they hold is outside
    opened: Counter[str] = Counter()  # of these, how many by name, and how many
    n_outside = n_article = n_heading = 0  # are outside, articles, and headings
    in_link, gone, unclosed = False, set(), set()
    last_close: dict[str, int] = {}
    spans, depth = False, 0  # whether the open link is closed by its own tag, and the elements that hold it
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(joined, min(linked, len(joined)), n_outside > 0, n_article > 0, n_heading > 0))
        text.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(" ".join(piece.split()))

    def push(name: str, outside: bool) -> None:
        nonlocal n_outside, n_article, n_heading
        stack.append((name, outside))
        opened[name] += 1
        n_outside, n_article, n_heading = n_outside + outside, n_article + (name in ARTICLES), n_heading + (name in HEADINGS)

    def pop() -> str:
        nonlocal n_outside, n_article, n_heading
        name, outside = stack.pop()
        opened[name] -= 1
        n_outside, n_article, n_heading = n_outside - outside, n_article - (name in ARTICLES), n_heading - (name in HEADINGS)
        return name

    def closes_later(name: str, at: int) -> bool:
        if name not in last_close:
            last_close[name] = max((m.start() for m in re.finditer(rf"</{name}\b", page, re.I)), default=-1)
        return last_close[name] >= at

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        put(page[at:lt])
        follows = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if follows in ("!", "?"):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        closing = follows == "/"
        named = _NAME.match(page, lt + 1 + closing)
        if not named:
            if closing:
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                put("<")
                at = lt + 1
            continue
        name, i = named[0].lower(), named.end()
        while True:  # to the end of the tag, over quoted values
            m = _STOP_OR_END.search(page, i)
            if not m or m[0] == ">":
                break
            close = -1 if m[0] in gone else page.find(m[0], m.end())
            if close < 0:
                gone.add(m[0])
            i = m.end() if close < 0 else close + 1
        if not m:
            break  # the page ends inside a tag
        attrs, at = page[named.end() : m.start()], m.end()
        if name == "a":
            in_link = not closing and not _EMPTY.search(attrs) and any(key == "href" for key, _ in _attrs(attrs))
            if in_link:
                after = _ANCHOR.search(page, at)
                spans, depth = bool(after and after[1]), len(stack)
        elif name == "br":
            text.append(" ")
        elif name in RAW and not closing:
            if name in BLOCKS:
                flush()
            if not attrs.endswith("/") and name not in unclosed:
                over = _closing(name).search(page, at)
                if over:
                    at = over.end()
                elif name in SWALLOWING:
                    break
                else:
                    unclosed.add(name)
        elif name in BLOCKS or (name not in VOID and not closing and attrs and _named_outside(attrs)):
            flush()
            in_link = in_link and spans
            if closing:
                if opened[name]:
                    while pop() != name:
                        pass
                    in_link = in_link and len(stack) >= depth
            elif name not in VOID:
                if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in HEADINGS:
                    if stack and (stack[-1][0] == name or stack[-1][0] == "p"):
                        pop()
                elif name in BLOCKS and stack and stack[-1][0] == "p":
                    pop()
                in_link = in_link and len(stack) >= depth
                inside = n_article > 0
                named = 0 if name in ("body", "html", "main") else _named_outside(attrs)
                outside = name in OUTSIDE or (name == "header" and not inside) or named > inside
                if name in ARTICLES and not outside:
                    # an element left open before the article doesn't hold it
                    while stack and stack[-1][1] and stack[-1][0] in OUTSIDE and not closes_later(stack[-1][0], at):
                        pop()
                if not attrs.endswith("/"):
                    push(name, outside)
        elif closing and opened[name]:
            flush()
            while pop() != name:
                pass
    flush()
    return out


def classify(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    first: list[bool | None] = [None] * len(found)
    stops = {}
    for i, b in enumerate(found):
        size = len(b.text)
        if b.outside or b.links > MAX_LINKS * size or (b.text.startswith(("©", "Copyright")) and not b.article):
            first[i] = False
        elif size >= SHORT and not b.heading:
            words = b.text.lower().split()
            stops[i] = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words), len(words)
    held = any(label is None and b.article for label, b in zip(first, found, strict=True))
    # a page is in the languages of the stop words if half of its text has as many as running text
    listed = sum(len(found[i].text) * (1 if n >= STOP_HIGH * of else -1) for i, (n, of) in stops.items()) >= 0
    for i, (n, of) in stops.items():
        b, size = found[i], len(found[i].text)
        if n >= STOP_HIGH * of and (size >= LONG or b.article):
            first[i] = True
        elif not listed and size >= LONG and (b.article or not held):  # there length decides
            first[i] = True
        elif listed and n < STOP_LOW * of and not b.article and size >= LONG:
            first[i] = False
    if not held and True not in first:
        return [label is None for label in first]
    # in one sweep each way: the nearest decided label and its distance; an article's blocks look inside it only
    n = len(found)
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        near: list[tuple[int, bool] | None] = [None] * n
        last: tuple[int, bool] | None = None
        before = None
        for i in order:
            if before is not None and found[before].article != found[i].article:
                last = None
            near[i] = last and (abs(i - last[0]), last[1])
            if first[i] is not None and not (found[i].article and found[i].outside):
                last = (i, bool(first[i]))
            before = i
        sides.append(near)
    out = []
    for i, b in enumerate(found):
        if first[i] is not None:
            out.append(bool(first[i]))
            continue
        decided = sorted(x for x in (sides[0][i], sides[1][i]) if x)
        if b.article:
            out.append(True if not decided else any(label for _, label in decided) or all(d > 1 for d, _ in decided) or len(decided) < 2)
        elif len(decided) == 2 and decided[0][1] != decided[1][1]:
            # between text and boilerplate a heading goes with what follows, anything else with the nearer
            follows = sides[1][i]
            out.append(bool(follows and follows[1]) if b.heading else decided[0][1] and decided[0][0] < decided[1][0])
        else:
            out.append(bool(decided) and decided[0][1])
    return out


def main_text(page: str | None) -> str:
    """Main text blocks of a page, one to a line; empty for a null or empty page."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, classify(found), strict=True) if keep)


def extract_pages(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of every page.

    A null or empty page, or one without main text, has an empty text. A page of any length is scanned whole, in
    linear time. Repeated rows stay, each with the same text, so there are no ties; an empty table gives an empty
    result; other columns are ignored, whatever their names, but ``keep`` may hold neither text nor n_chars.
    """
    types = dict(pages.dtypes)
    slim = pages.select(*[f"`{c}`" for c in keep], f"`{html_col}`")

    def run(cols):
        texts = [main_text(p) for p in cols[html_col]]
        yield {**{c: cols[c] for c in keep}, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(slim, run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "text string, n_chars bigint"]))


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
