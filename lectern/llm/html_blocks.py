"""HTML extraction: flat text blocks, each with the word count and link density
of itself and its neighbours and where it stands in the page, classified by a
decision tree that is trained on a small labelled table."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, unused, without

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HIDDEN = re.compile(r"\shidden(?=[\s/=]|\Z)|display\s*:\s*none", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")
#: Their content is plain characters up to their own end tag, and no text of the page.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
#: What these hold is no text of the page either.
UNSEEN = {"noscript", "template", "svg", "object", "canvas", "head", "select", "datalist", "math", "audio", "video", "button"}
#: Tags within a line of text; every other one ends a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: A start tag of the first kind ends what is open of the second.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}
#: What elements stay within: no end tag in a cell or list ends what is outside,
#: but for those of the table or list itself.
TABLE, LIST = {"table", "td", "th", "caption"}, {"ul", "ol", "menu", "dl"}
OF_TABLE = TABLE | {"tr", "tbody", "thead", "tfoot"}

#: A class or id names what lies beside the text if all its parts are among these
#: and one of them is in the first list: "social-links" does, "social-science" doesn't.
ASIDE_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments commentlist discussion respond replies disqus widget widgets login signup toolbar pagination pager copyright masthead".split())
MAIN_NAMES = set("article content main post entry story body text".split())
NEUTRAL_NAMES = set("area bar block box bottom btn button buttons card column container content footer form global group header holder icons inner item items left links list main module outer page panel post posts primary region right row secondary section side site slot stories threads top unit wrap wrapper zone".split())
REMARKS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
#: Headings of what follows a text: reader comments, related pages, sharing.
AFTERWORD = re.compile(
    r"(?:\d+\s+)?(?:reader |user )?comments?(?:\s*\(?\d+\)?)?|leave a (?:comment|reply)|(?:post|add|write) a comment|join the (?:discussion|conversation)|"
    r"(?:related|recommended|more) (?:articles|posts|stories|news|reading|links)|you (?:may|might) also (?:like|enjoy)|read (?:also|next)|share this(?: article| post| page| story)?|"
    r"advertisement|(?:subscribe to )?(?:our |the )?newsletter|(?:\d+\s+)?(?:kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?|ähnliche artikel|articles liés|artículos relacionados",
    re.I,
)
FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "ends", "heading", "place", "aside")

#: The labelled table, as pages: {+40} is a block of 40 words of the main text,
#: {5} one of 5 words that isn't, both ended by a full stop if one stands there.
#: With * the block's length is no sign of its kind, so it is also drawn longer
#: and shorter.
LABELLED = [
    "<header><a href=/>{2}</a></header><nav><ul><li><a href=/a>{1}</a><li><a href=/b>{2}</a><li><a href=/c>{1}</a></ul></nav><div class=ad>{9*.}</div><article><h1>{+8*}</h1><p>{+30*.}<p>{+120*.}<p>{+6*.}<p>{+3*}</article><footer>{7*.}</footer>",
    "<article><h1>{+5*}</h1><p>{+40*.}<h2>{+3*}</h2><p>{+60*.}<ul><li>{+4*}<li>{+9*.}<li>{+2*}</ul><p>{+200*.}<aside>{50*.}</aside><p>{+20*.}</article><aside><h3>{2*}</h3><p>{25*.}</p></aside><footer><a href=/>{3}</a></footer>",
    "<main><h1>{+6*}</h1><p>{+25*.}<p>{+10*}<p><a href=/x>{+4}</a><p>{+50*.}<table><tr><th>{+1}<th>{+2}<tr><td>{+3}<td>{+1}</table><p>{+70*.}</main><section><h2>{3*}</h2><p>{40*.}</p></section><form>{6*}</form>",
    "<article><p>{+90*.}<ul><li><a href=/1>{5}</a><li><a href=/2>{4}</a><li><a href=/3>{6}</a></ul><p>{+35*.}<div class=cookie-notice>{30*.}</div><p>{+15*.}</article>",
    "<article><h2>{+4*}</h2><p>{+55*.}<blockquote>{+20*.}</blockquote><p>{+9*.}<div class=related-posts><a href=/r>{6}</a></div><footer>{5*}</footer></article><div id=comments><p>{30*.}<p>{4*}</div>",
    "<nav><a href=/>{1}</a></nav><article><header><h1>{+7*}</h1><p>{+3}</header><p>{+80*.}<figure><figcaption>{+8*.}</figcaption></figure><p>{+4*.}<p>{+300*.}</article><section class=comments><article><p>{25*.}</article><article><p>{6*.}</article></section>",
    "<div class=content><h1>{+5}</h1><p>{+40.}<p>{+12.}<p>{+90.}<p>{+25.}</div><div><a href=/1>{4}</a></div><div><a href=/2>{5}</a></div><div>{6}</div>",
    "<div><a href=/>{1}</a></div><div><a href=/n>{1}</a></div><h1>{+7}</h1><p>{+45.}<p>{+30.}<h2>{+4}</h2><p>{+60.}<p>{+8.}<p>{+100.}<div><a href=/x>{3}</a></div><div><a href=/y>{4}</a></div><div>{5}</div>",
    "<table><tr><td><a href=/1>{2}</a><tr><td><a href=/2>{1}</a></table><div>{3}</div><div>{+70.}</div><div>{+40.}</div><div>{+9.}</div><div>{+55.}</div><div>{4}</div><div><a href=/t>{3}</a></div><div>{2}</div>",
    "<div>{2}</div><div><a href=/a>{6}</a></div><div><a href=/b>{8}</a></div><div><a href=/c>{7}</a></div><h2>{+6}</h2><div>{+25.}</div><div>{+18.}</div><div>{+33.}</div><div>{5}</div><div><a href=/d>{2}</a></div>",
    "<div><a href=/>{1*}</a></div><div><a href=/n>{2*}</a></div><article><h1><a href=/p>{+6*}</a></h1><p>{+90*.}<p>{+30*.}<p><a href=/x>{+4*}</a><p>{+50*.}<h2><a href=/s>{+3*}</a></h2><p>{+8*.}</article><div><a href=/u>{3*}</a></div>",
    "<div><a href=/>{1*}</a></div><p>{+60.}<p>{+20.}<div><a href=/n>{2*}</a></div><p>{+80.}<div><a href=/m>{7*}</a></div><div>{+35.}</div><div><a href=/z>{4*}</a></div>",
    "<article><p>{+70*.}<p>{+25*.}<ul><li><a href=/1>{5*}</a><li><a href=/2>{4*}</a></ul></article><div><a href=/1>{5*}</a></div><div><a href=/2>{3*}</a></div><p>{40*.}",
    "<p>{+60.}<p>{+20.}<p>{+35.}",
    "<h1>{+4}</h1><p>{+15.}",
    "<div>{3}</div><div>{2}</div><div>{4}</div><div><a href=/q>{3}</a></div>",
    "<div class=sidebar><h3>{2*}</h3><p>{40*.}<p>{20*.}</div><div>{+80.}</div><div>{+30.}</div><div>{+12.}</div><div class=newsletter-signup>{20*.}</div><div>{+45.}</div><div class=site-footer>{12*.}</div>",
]
#: Times that the lengths marked * are drawn, and by how much they differ.
DRAWS, STRETCH = 12, (0.1, 0.3, 1.0, 3.0, 20.0)


class Frame:
    """An open element: its name, whether an article or main part surrounds it,
    and whether it lies beside the text, or holds reader comments, or is unseen."""

    __slots__ = ("name", "article", "aside", "remarks", "unseen", "after")

    def __init__(self, name: str, article: bool = False, aside: bool = False, remarks: bool = False, unseen: bool = False):
        self.name, self.article, self.aside, self.remarks, self.unseen = name, article, aside, remarks, unseen
        self.after = 0  # level of a heading of AFTERWORD that was met in it


class Page:
    """Reads a page once, front to back; blocks holds its text blocks as (text,
    words, words in links, heading, in an article, beside the text)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, bool, bool, bool]] = []
        self.open = [Frame("")]
        self.counts: list[dict[str, int]] = [{}]  # open elements by name, anew within each part of a table
        self.lists: list[dict[str, int]] = [{}]  # the same for items, anew within each list
        self.pieces: list[tuple[str, bool]] = []
        self.link = 0  # number of open elements where the open link began
        self.heading = 0
        self.read(source)
        self.flush()

    def flush(self) -> None:
        if not self.pieces:
            return
        top, pieces = self.open[-1], self.pieces
        self.pieces = []
        text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
        if not text or top.unseen:
            return
        count = lambda t: len(t.split()) + len(CJK.findall(t)) // 2
        within = sum(count(html.unescape(t)) for t, linked in pieces if linked)
        if self.heading:
            if top.after and self.heading <= top.after:
                top.after = 0
            if len(text) < 60 and AFTERWORD.fullmatch(text.rstrip(" :.…")):
                # the heading's own element, or that about a group of headings
                holder = self.open[-2] if top.name in HEADINGS and len(self.open) > 1 else top
                holder.after = holder.after or self.heading
        beside = top.aside or any(f.after for f in self.open[-3:])
        self.blocks.append((text, count(text), min(within, count(text)), self.heading > 0, top.article, beside))

    def push(self, name: str, frame: Frame) -> None:
        self.open.append(frame)
        self.counts[-1][name] = self.counts[-1].get(name, 0) + 1
        self.lists[-1][name] = self.lists[-1].get(name, 0) + 1
        if name in TABLE:
            self.counts.append({})
        if name in TABLE or name in LIST:
            self.lists.append({})

    def pop(self) -> str:
        name = self.open.pop().name
        if name in TABLE:
            self.counts.pop()
        if name in TABLE or name in LIST:
            self.lists.pop()
        self.counts[-1][name] -= 1
        self.lists[-1][name] -= 1
        if self.link > len(self.open):
            self.link = 0
        if name in HEADINGS:
            self.heading = 0
        return name

    def close(self, name: str) -> None:
        """Ends the innermost open element of that name, and what is open in it;
        an item only within its own list, others within their table cell. So each
        element is left once, however many end tags match nothing."""
        held = self.lists[-1:] if name in ("li", "dd", "dt") else self.counts[-3:] if name in OF_TABLE else self.counts[-1:]
        if any(x.get(name) for x in held):
            while self.pop() != name:
                pass

    def start(self, name: str, attributes: str) -> None:
        if name not in ("option", "optgroup") and self.counts[-1].get("p"):
            self.close("p")  # no block can stand in a paragraph
        for ended in ENDS.get(name, ()):
            self.close(ended)
        if name in HEADINGS:
            if self.open[-1].name in HEADINGS:
                self.pop()
            self.heading = int(name[1])
        if name in VOID or attributes.endswith("/") and name in UNSEEN:
            return
        above = self.open[-1]
        values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        names = [{p.lower() for p in NAME_PART.findall(x)} for k in ("class", "id") for x in values.get(k, "").split()]
        said = [x for x in names if x & ASIDE_NAMES and x <= ASIDE_NAMES | NEUTRAL_NAMES]
        remarks = above.remarks or any(x & REMARKS for x in said)
        role = values.get("role", "").lower()
        main = name in ("article", "main") or role in ("main", "article")
        frame = Frame(name, above.article, above.aside, remarks, above.unseen or name in UNSEEN or bool(HIDDEN.search(attributes)))
        if name in ASIDE or role in ASIDE_ROLES or (name == "header" and not above.article):
            frame.aside = True
        elif main:
            # a wrapper's name says nothing about the article in it, unless it holds comments
            frame.aside = above.aside if above.article or remarks else False
            frame.article = True
        elif said and name not in ("html", "body"):
            frame.aside = True
        elif any(x & MAIN_NAMES and x <= MAIN_NAMES | NEUTRAL_NAMES for x in names) and name in ("div", "section", "td"):
            frame.article = True
        self.push(name, frame)

    def read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            if m is None:
                self.pieces.append((source[at:], self.link > 0))
                return
            if m.start() > at:
                self.pieces.append((source[at : m.start()], self.link > 0))
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
            if not name:
                continue
            if name in RAW:
                if not closing:
                    ending = RAW[name].search(source, at)
                    at = ending.end() if ending else end
            elif name == "a":
                self.link = len(self.open) if not closing and "href" in attributes.lower() else 0
            elif name == "br":
                self.pieces.append((" ", self.link > 0))
            elif name not in INLINE:
                self.flush()
                if closing:
                    self.close(name)
                else:
                    self.start(name, attributes)


def rows(blocks: list[tuple]) -> list[tuple]:
    """FEATURES of a page's blocks. place: 1 in an article or main part, -1 beside
    the one that the page has, 0 on a page without."""
    marked = any(b[4] and not b[5] for b in blocks)
    out, none = [], ("", 0, 0)
    for i, (text, words, links, heading, article, aside) in enumerate(blocks):
        around: list[float] = []
        for other in (blocks[i - 1] if i else none, blocks[i + 1] if i + 1 < len(blocks) else none):
            around += [other[1], other[2] / other[1] if other[1] else 0.0]
        place = 1 if article else -1 if marked else 0
        out.append((words, links / words, *around, text[-1] in ".!?…。！？:;\"”»)", heading, place, aside))
    return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of all blocks of LABELLED, over all draws."""
    rng = np.random.default_rng(0)
    x, y = [], []
    for page in LABELLED:
        for draw in range(DRAWS if "*" in page else 1):
            labels: list[bool] = []

            def fill(m: re.Match) -> str:
                labels.append(m[1] == "+")
                n = int(m[2]) if not m[3] or not draw else max(1, round(int(m[2]) * rng.choice(STRETCH)))
                return " ".join(["word"] * n) + m[4]

            found = Page(re.sub(r"\{(\+?)(\d+)(\*?)(\.?)\}", fill, page)).blocks
            if len(found) != len(labels):
                raise ValueError(f"blocks and labels differ in number: {page}")
            x += rows(found)
            y += labels
    return np.array(x, float), np.array(y, float)


def _grow(x: np.ndarray, y: np.ndarray, depth: int) -> tuple:
    """A tree: (chance,) or (feature, threshold, at most, above)."""
    chance = float(y.mean())
    if depth == 0 or chance in (0.0, 1.0):
        return (chance,)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(np.diff(v))
        if not len(cuts):
            continue
        left, right = cuts + 1.0, len(y) - cuts - 1.0
        a, b = ones[cuts], ones[-1] - ones[cuts]
        impurity = a * (left - a) / left + b * (right - b) / right
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0] - 1e-12:
            best = (float(impurity[k]), f, float(v[cuts[k]] + v[cuts[k] + 1]) / 2)
    if best is None:
        return (chance,)
    _, f, cut = best
    left = x[:, f] <= cut
    return (f, cut, _grow(x[left], y[left], depth - 1), _grow(x[~left], y[~left], depth - 1))


@lru_cache(1)
def trained_tree(depth: int = 8) -> tuple:
    return _grow(*labelled_table(), depth)


def classify(tree: tuple, row: tuple) -> bool:
    while len(tree) > 1:
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree[0] >= 0.5


def main_text(source: str | None, tree: tuple | None = None) -> str:
    """The main text of a page: kept blocks, one line each."""
    tree = tree or trained_tree()
    found = Page(source or "").blocks
    return "\n".join(b[0] for b, row in zip(found, rows(found), strict=True) if classify(tree, row))


def extract(pages: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """pages plus the main text of html_col in out.

    Defined results: null or empty html, or a page without main text, gives an
    empty text; markup cut off anywhere counts up to its end; repeated rows are
    read each; other columns pass through, one named like out is replaced; an
    empty table gives an empty table. Time is linear in a page's length, and
    one pass over whole pages does it, without a shuffle.
    """
    tree = trained_tree()

    @F.pandas_udf("string")
    def text(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: main_text(s, tree))

    name = unused("html_source", pages)
    return pages.withColumn(name, quoted(html_col)).select(*[quoted(c) for c in without(pages, out).columns], text(quoted(name)).alias(out))
