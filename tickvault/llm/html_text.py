"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its word
count, its link density and those of its neighbours, and by what encloses it. A decision
tree, grown on the labelled blocks below, says which blocks are the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickvault.llm.common import map_arrow, query, table

DEPTH = 8
MIN_ROWS = 2

# Element names of HTML by their role here.
UNSEEN = frozenset("script style noscript template svg math iframe object embed canvas audio video head title "
                   "select option datalist textarea button".split())
# Their contents are text up to the end tag, or to the end of the page without one.
RAW = frozenset("script style textarea title iframe".split())
# Skipped up to their own end tag; one without an end tag is passed over and the page goes on.
SKIPPED = UNSEEN - RAW - {"head", "option", "embed"}
# What may stand in a head; any other tag, and text, ends it, as its end tag is optional.
IN_HEAD = frozenset("html head title meta link style script base basefont bgsound noscript noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark "
                   "q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FRAMES = frozenset("nav footer aside form menu dialog fieldset address".split())
CONTENT = frozenset("article main".split())
# Words in class, id and role names that tell what a part of a page is for.
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner bar billboard bottom breadcrumb breadcrumbs "
    "comment comments commentlist complementary consent contentinfo cookie cookies copyright credits dialog discussion "
    "disqus drawer follow foot footer footnav form gdpr head header hidden links login masthead menu menubar message "
    "modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup popular "
    "privacy promo promotion promoted rail recommend recommended related reply replies respond responses search share "
    "sharing sidebar sidenav signup skip social sponsor sponsored subscribe tags teaser toolbar topbar topnav trending "
    "warning widget widgets".split())
CONTENT_WORDS = frozenset("article body content entry main maincontent post story text".split())
HAVING = frozenset("has have having is no not show shows with without".split())
STATES = frozenset("open opened closed enabled disabled visible".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD_BREAK = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_PAIRS = {tag: re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)\b.*?(?:</\1\b|\Z)"
                          rf"|<(/?){tag}(?=[\s/>]|\Z)([^>]*)(?:>|\Z)", re.S | re.I) for tag in SKIPPED}

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after",
            "framed", "in_content", "in_header", "heading", "item", "paragraph", "ends"]


def _names(attributes: str) -> tuple[bool, bool]:
    """Whether the names in class, id and role tell of a frame, and of content.

    In a name of several words, one that says what the part has, or whether that is open,
    does not count. A name of content words outweighs frame words in the other names.
    """
    framed = content = False
    for m in _NAMES.finditer(attributes):
        for name in next(g for g in m.groups() if g is not None).split():
            words = [w for w in _WORD_BREAK.split(_CAMEL.sub(" ", name).lower()) if w]
            frame = any(w in FRAME_WORDS and not (i and words[i - 1] in HAVING or words[i + 1:i + 2] and words[i + 1] in STATES)
                        for i, w in enumerate(words))
            framed |= frame
            content |= not frame and not CONTENT_WORDS.isdisjoint(words)
    return framed and not content, content


class _Element:
    """An open element and what is known of its place."""
    __slots__ = ("tag", "strong", "weak", "rescued", "content", "header", "unseen", "link", "item", "paragraph",
                 "heading", "named", "whole", "words")

    def __init__(self, tag: str, names: tuple[bool, bool], up: _Element | None):
        by_name, content = names
        self.tag = tag
        self.content = tag in CONTENT or content or bool(up and up.content)
        # The page's own body is not framed by a word in its class.
        self.named = by_name and tag not in HEADINGS | CONTENT | {"body", "html"}
        # Names and forms frame weakly: they may stand around the whole page.
        self.strong = bool(up and up.strong) or tag in FRAMES and tag != "form"
        self.weak: tuple[_Element, ...] = up.weak if up else ()
        self.rescued = up.rescued if up else ""
        self.whole, self.words = False, 0
        if tag in CONTENT and self.weak and not by_name:
            self.weak, self.rescued = (), tag
        if content:
            # Content in a plain form.
            self.weak = tuple(w for w in self.weak if w.named)
        if tag in CONTENT and not by_name or tag == "h1" or tag == "nav":
            for w in self.weak or (up.weak if up else ()):
                w.whole |= tag != "nav" or not w.named
        if self.named or tag == "form":
            self.weak += (self,)
        self.header = tag not in CONTENT and bool(up and up.header) or (tag == "header" and not self.content)
        self.unseen = bool(up and up.unseen) or tag in UNSEEN
        self.link = bool(up and up.link) or tag == "a"
        self.item = bool(up and up.item) or tag in ("li", "td", "th", "dt", "dd")
        self.paragraph = bool(up and up.paragraph) or tag in ("p", "blockquote", "pre")
        self.heading = bool(up and up.heading) or tag in HEADINGS


def _end_tags(page: str, tag: str) -> dict[int, int]:
    """Where each ``tag`` element of a page that has an end tag begins and ends."""
    out: dict[int, int] = {}
    begun: list[int] = []
    for m in _PAIRS[tag].finditer(page):
        if m.group(2):
            if begun:
                out[begun.pop()] = m.end()
        elif m.group(2) is not None and not m.group(3).rstrip().endswith("/"):
            begun.append(m.start())
    return out


def _frame(blocks: list[tuple[str, list[float]]], places: list[_Element]) -> None:
    """Mark the blocks that weak frames frame.

    A weak frame around a heading of the page, a main or an article does not frame if it is
    a plain form, or has most words of the page. An article in a weak frame is free of it
    unless more words stand in content that no frame is around; a main is free of it.
    """
    loose = free = total = 0
    for (_, f), p in zip(blocks, places):
        total += 0 if p.strong else f[0]
        for w in p.weak:
            w.words += f[0]
        if not p.strong and not p.weak and p.content:
            if p.rescued == "article":
                loose += f[0]
            else:
                free += f[0]
    for (_, f), p in zip(blocks, places):
        f[6] = (p.strong or p.rescued == "article" and loose < free
                or any(not w.whole or w.named and 2 * w.words <= total for w in p.weak))


def text_blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """(text, own features) of the flat blocks of a page in order; text is decoded, with
    each run of white space as one space. An unfinished tag or comment at the end is markup."""
    page = page or ""
    blocks: list[tuple[str, list[float]]] = []
    places: list[_Element] = []
    stack: list[_Element] = [_Element("", (False, False), None)]
    parts: list[str] = []
    linked, blank = 0, True
    place = stack[0]

    def flush() -> None:
        nonlocal linked, blank
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            n = len(text.split())
            places.append(place)
            blocks.append((text, [n, min(1.0, linked / n), 0, 0, 0, 0, place.strong, place.content, place.header,
                                  place.heading, place.item, place.paragraph, text[-1] in ".!?:;\"'”’…)"]))
        parts.clear()
        linked, blank = 0, True

    def say(raw: str) -> None:
        nonlocal linked, blank, place
        while stack[-1].tag == "head" and raw.strip():
            stack.pop()
        if stack[-1].unseen or not raw:
            return
        if blank and raw.strip():
            place, blank = stack[-1], False
        parts.append(raw)
        if stack[-1].link:
            linked += len(raw.split())

    ends: dict[str, dict[int, int]] = {}
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        close, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            say(" ")
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        while (stack[-1].tag == "head" and tag not in IN_HEAD
               or stack[-1].tag == "option" and tag not in INLINE):
            stack.pop()
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if tag not in INLINE:
            # A new block ends an open paragraph and what is inline in it.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or (tag == "li" and stack[i].tag == "li"):
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in SKIPPED:
            if tag not in ends:
                ends[tag] = _end_tags(page, tag)
            at = ends[tag].get(m.start(), at)
            continue
        stack.append(_Element(tag, _names(attributes), stack[-1]))
    flush()
    _frame(blocks, places)
    for i, (_, f) in enumerate(blocks):
        if i:
            f[2:4] = blocks[i - 1][1][:2]
        if i + 1 < len(blocks):
            f[4:6] = blocks[i + 1][1][:2]
    return blocks


# The labelled table: pages in several layouts; blocks marked + are the article's.
LABELLED = [
    "<nav><ul><li><a>-Home</a></li><li><a>-World news</a></li><li><a>-Sport</a></li></ul></nav><div class=ad>-Buy two now and save a lot of money.</div>"
    "<article><h1>+A storm is coming</h1><p>+The storm will reach the coast by the end of the week, experts say.</p><p>+Stay.</p><p>+It may rain for days in the north and the <a>west</a> of the land.</p></article>"
    "<footer>-(c) example.com - all rights reserved.</footer>",
    "<header>-The Daily Page<p>-News for all of us.</p></header><div id=sidebar><h3>-Popular</h3><ul><li><a>-Ten tricks for a better sleep</a></li><li><a>-More</a></li></ul></div>"
    "<div class=content><h2>+How bread is made</h2><p>+Flour, water, salt and time are all that a good loaf needs.</p><ul><li>+Flour</li><li>+Cold water, half a litre.</li></ul><p>+Bake.</p><blockquote>+Bread is life, as they say in town.</blockquote></div>"
    "<div id=footer><p>-About us and how to write to us.</p></div>",
    "<body><h1>+Walking home</h1><p>+We went by the river and then over the old bridge, where it was quiet.</p><p>+Then we slept.</p><p>+Next day we saw <a>the mill</a> and its wheel turn in the strong wind.</p></body>",
    "<div class=cookie-notice><p>-We use cookies to give you the best site, and share data with partners you can choose.</p><a>-Accept</a></div>"
    "<main><header><h1>+The price of salt</h1><p>+By a writer of this paper</p></header><section><h2>+Why it rose</h2><p>+Salt has been cheap for a century, but the mines are running out of room to dig.</p></section>"
    "<aside><p>-Read our long report on sugar and its many uses in the home.</p></aside><p>+It will rise.</p>"
    "<div class=advertisement><p>-The best salt, now at half the price in all our shops until the end of May.</p></div><table><tr><td>+Year</td><td>+Price</td></tr></table></main>"
    "<section id=comments><h3>-Comments</h3><p>-I do not agree with this at all, as salt was never cheap where I live.</p><div class=comment><p>-Me too.</p></div></section>",
    "<div class=menu><a>-Start</a> <a>-Shop</a> <a>-Login</a></div><div class=post><h1>+My garden</h1><p>+Beans grow fast when the nights are warm, so plant them late and water them well.</p><p>+Good luck!</p></div>"
    "<form><p>-Write your mail address here to get a letter from us each week.</p><label>-Mail</label></form><div class=related><ul><li><a>-Your roses and you</a></li><li><a>-Trees</a></li></ul></div>"
    "<footer><p>-Made with care in a small town.</p><a>-Terms</a></footer>",
    "<div><a>-One</a> | <a>-Two</a> | <a>-Three</a></div><div><p>+A long walk is good for the heart and for the head, and costs nothing but time.</p><p>+Walk daily.</p></div><div><a>-Back to the top of the page</a></div>",
    "<header><nav><a>-Home</a></nav><h1>-Site name</h1></header><article><header><h1>+On owls</h1></header><p>+Owls hear a mouse under the snow from far away and fly without a sound.</p><figure><figcaption>+An owl</figcaption></figure>"
    "<div class=share><a>-Share</a><a>-Send</a></div><div class=newsletter><p>-Get owls in your mail box each week, for free and with no strings attached.</p></div><p>+They hunt at night.</p></article>"
    "<div class=sidebar><p>-A word from our sponsor, who makes warm boots for cold feet since 1900.</p></div><aside><h2>-Most read</h2><p>-Short.</p></aside>",
    "<div role=banner><p>-Save ten percent today with the code on this page.</p></div><div id=main><p>+Iron.</p><p>+Iron rusts when wet, and so a gate should be painted every other year.</p><h3>+Paint</h3><p>+Use two coats.</p></div>"
    "<div role=contentinfo><p>-Owned by a firm in the city and printed on paper.</p></div><div class=alert><p>-Your browser is old.</p></div>",
    "<nav>-Menu</nav><article><p>+One.</p><p>+Two words</p><p>+And here are three, four and more words to make a longer line of text.</p></article><div class=ad>-Ein Wort.</div><footer>-x</footer>",
    "<header>-Welcome to the site of the club.</header><p>+The club met on Monday to choose a new head, and it took all night.</p><p>+No one won.</p><form><div>-Vote here:</div></form>",
    "<div class=breadcrumbs><a>-Home</a> > <a>-News</a></div><h1>+Ice on the lake</h1><p>+The lake froze early this year and the boats were still out when it did.</p><p class=notice>-This page is shown to all, but some parts need a login.</p><p>+Be careful.</p>",
    "<article><p>+Text of the day, long enough to stand on its own in a paragraph.</p><ul><li>+<a>a source of it</a></li><li>+a second thing</li></ul></article><ul><li><a>-Imprint</a></li><li><a>-Contact us</a></li></ul>",
    "<div id=page class=search-open><nav><a>-Home</a></nav><article><h1>+The mill</h1><p>+The mill has stood by the river since the first houses were built here.</p><p>+It still turns.</p></article>"
    "<div class=comments><h3>-Two replies</h3><p>-I have seen the mill and it does not turn at all, so who wrote this?</p></div></div><footer>-All rights reserved.</footer>",
    "<form><nav><a>-Start</a></nav><div class=sidebar><p>-A long line about our shop, which sells tea and cups of all sizes to everyone.</p></div><div><h1>+Tea</h1><p>+Tea should not be boiled, and it needs three minutes in the pot to be good.</p><p>+Drink it hot.</p></div></form>",
    "<div class='post with-comments'><h1>+Snow</h1><p>+Snow fell all night and the road to the farm was closed until noon.</p><p>+It was cold.</p><div class=comment><p>-It was warm here, and we had no snow at all this winter.</p></div></div>",
]


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled table."""
    x, y = [], []
    for page in LABELLED:
        for text, features in text_blocks(page):
            x.append(features)
            y.append(text.startswith("+"))
    return np.array(x, np.float64), np.array(y)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A tree as nested (feature, threshold, below, above) with shares of the article at its
    leaves; splits lower Gini impurity most, and the earlier feature wins a tie."""
    share = float(y.mean())
    if not depth or share in (0.0, 1.0) or len(y) < 2 * MIN_ROWS:
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            n = low.sum()
            if min(n, len(y) - n) < MIN_ROWS:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-9:
                best = impurity, f, t, low
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-9:
        return (share,)
    _, f, t, low = best
    return f, float(t), grow_tree(x[low], y[low], depth - 1), grow_tree(x[~low], y[~low], depth - 1)


def article_share(tree: tuple, features: list[float]) -> float:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: tuple) -> str:
    """The blocks of the article, joined by line feeds."""
    return "\n".join(text for text, f in text_blocks(page) if article_share(tree, f) >= 0.5)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null or empty html, and pages without an article, give an empty text. Nulls in page_id
    and url stay; repeated rows are each answered; an empty table gives no rows; columns
    but page_id, url and html are not read.
    """
    tree = grow_tree(*labelled_rows())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, tree) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


@query("op2_html_text")
def op2_html_text(spark, sf_dir):
    """Main text of all pages."""
    return extract_text(table(spark, sf_dir, "pages"))
