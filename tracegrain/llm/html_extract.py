"""Main-text extraction from web pages by classifying flat text blocks.

A page is read once, tolerantly, into flat text blocks. Each block has its word
count and link density, those of its neighbours, and what encloses it; a small
decision tree decides whether it belongs to the article. Names of classes and ids
are one kind of evidence only: a word that most of the text stands under (or, of
the clear words, all of it) says nothing, since an article cannot be a notice of
its own page. Articles inside a comment section, sidebar, menu or footer are none. The tree is grown here,
from a small labelled table: example pages whose blocks are marked as article or
not (:data:`EXAMPLES`), read by the same reader.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by two newlines. Nothing is cut to a
length. Scripts, styles, comments, form controls and the head never make blocks.

Defined results: a null or empty page has the empty text; broken markup (tags
left open, pages cut off, stray quotes) is read as far as it goes; repeated rows
give repeated results; an empty table gives an empty table; extra columns are
carried along; a column named ``text`` is refused.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the article: what is in the first holds no tags and ends at their end tag only.
RAW = "script style textarea title"
DROPPED = frozenset("noscript template svg math iframe object select button canvas audio video head".split())
#: A head left open ends at the first other element.
METADATA = frozenset("base basefont bgsound link meta noscript template".split())
#: HTML elements that end a drawing or formula left open.
BREAKOUT = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr img li main nav ol p pre section table ul".split())
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
ROOTS = frozenset("article main".split())
_EDGE, _END = r"(?:^|[\s_-])", r"(?=$|[\s_-]|\d)"
#: Words in class or id names of reader comments, of what else surrounds an article, and of what may do so.
COMMENTS = re.compile(rf"{_EDGE}(?:comments?|commentlist|comment-?(?:body|text|content)|disqus|replies|responses){_END}", re.IGNORECASE)
CLEAR = re.compile(
    rf"{_EDGE}(?:ads?|advert(?:s|isements?|ising)?|adv|sponsor(?:s|ed)?|promos?|promotions?|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|popup|modal|overlay|"
    rf"nav(?:bar|igation)?|menus?|breadcrumbs?|sidebar|aside|widgets?|related|recommend(?:ed|ations?)|share|sharing|social|footer|masthead|copyright|legal){_END}",
    re.IGNORECASE,
)
VAGUE = re.compile(
    rf"{_EDGE}(?:alert|side|follow|reply|foot|header|topbar|toolbar|login|signup|search|form|tags?|pagination|pager|skip|author-box|teasers?){_END}",
    re.IGNORECASE,
)
#: What a line of rights begins with or says.
RIGHTS = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.IGNORECASE)
#: An article's own heading is no page header.
TITLE = re.compile(r"(?:article|post|entry|story|content)[_-]?(?:header|head|title)", re.IGNORECASE)
#: An article of this name is a reader's remark.
REMARK = re.compile(r"(?:^|\s)(?:comments?|reply|replies|response)(?:[_-](?:body|text|content|item|entry|\d+))?(?=\s|$)", re.IGNORECASE)
GOOD = re.compile(
    r"(?:^|[\s_-])(?:article\w*|post|posts?-?(?:body|content|text)|entry\w*|story\w*|content|main\w*|body|text)(?=$|[\s_-]|\d)", re.IGNORECASE
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    rf"|<(?P<gone>{'|'.join(RAW.split())})(?=[\s/>])[^>]*>(?:.*?</(?P=gone)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*|[^>]*)/?>",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "in_root", "in_aside", "clear_name", "vague_name", "heading", "list_item", "paragraph", "good", "page_has_root", "links", "rights",
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    root: int  # number of the article that it stands in; 0 if in none
    aside: int
    named: list[tuple[int, int]]  # enclosing elements with a telling name: its number, and 2 if clear, 1 if vague
    heading: bool
    item: bool
    paragraph: bool
    good: bool


@dataclass
class _Open:
    name: str
    number: int
    aside: int = 0
    named: int = 0
    comments: bool = False
    good: bool = False


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    opened: int = 0
    drop: list[str] = field(default_factory=list)  # the dropped element that is open, and what is open in it
    inline: list[str] = field(default_factory=list)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        linked, self.linked = self.linked, 0
        if not text:
            return
        root = aside = 0
        named: list[tuple[int, int]] = []
        good = heading = item = paragraph = False
        for x in reversed(self.stack):
            heading = heading or len(x.name) == 2 and x.name[0] == "h" and x.name[1].isdigit()
            item = item or x.name in ("li", "dt", "dd", "td", "th", "option")
            paragraph = paragraph or x.name in ("p", "pre", "blockquote")
            aside += x.aside
            if x.named:
                named.append((x.number, x.named))
            good = good or x.good
            if x.name in ROOTS:  # what an article stands in does not speak against it
                root = x.number
                break
        words = len(text.split())
        self.blocks.append(Block(text, words, min(linked, words), root, aside, named, heading, item, paragraph, good))

    def text(self, raw: str) -> None:
        if self.drop:
            return
        if "&" in raw:
            raw = html.unescape(raw)
        self.parts.append(raw)
        if self.links:
            self.linked += len(raw.split())

    def skips(self, name: str, alone: bool) -> bool:
        """Whether a start tag belongs to a dropped element; one left open may end here."""
        if self.drop == ["head"] and name not in METADATA or self.drop and self.drop[-1] in ("svg", "math", "g", "path") and name in BREAKOUT:
            self.drop.clear()
        if not self.drop and name not in DROPPED:
            return False
        if name == "head":
            self.flush()
        if not alone and name not in VOID:
            self.drop.append(name)
        return True

    def open(self, name: str, attrs: str, alone: bool = False) -> None:
        if self.skips(name, alone):
            return
        if name in INLINE:
            if name not in VOID:
                self.inline.append(name)
            if name == "br":
                self.parts.append(" ")
            elif name == "a":
                self.links = 1
            return
        self.flush()
        self.links = 0
        self.inline.clear()
        if name in VOID:
            return
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # opening one closes one of the kind left open
            for i in range(len(self.stack) - 1, -1, -1):
                x = self.stack[i].name
                if x == name or name == "p" and x == "p":
                    del self.stack[i:]
                    break
                if x not in ("p", "li", "td", "th", "dt", "dd"):
                    break
        self.opened += 1
        made = _Open(name, self.opened, int(name in ASIDE))
        for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                if name not in ("html", "body"):
                    bare = TITLE.sub("", value)
                    made.comments = made.comments or bool(COMMENTS.search(bare)) and (name not in ROOTS or bool(REMARK.search(bare)))
                    if name not in ROOTS:
                        made.named = max(made.named, 2 if made.comments or CLEAR.search(bare) else 1 if VAGUE.search(bare) else 0)
                made.good = made.good or bool(GOOD.search(value))
            elif key == "role":
                made.aside = made.aside or int(value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "form"))
            elif key == "hidden" or value.lower() == "true":
                made.aside += 1
        if name in ROOTS:
            if made.comments or any(x.comments or x.name in ("aside", "nav", "footer") for x in self.stack):
                made.name, made.named = "section", 2 * made.comments  # a remark, or a teaser beside the article
            else:
                self.stack = [x for x in self.stack if x.name in ("html", "body")]
        if name == "header" and not any(x.name in ROOTS for x in self.stack):
            made.aside = 1
        self.stack.append(made)

    def close(self, name: str) -> None:
        if self.drop:
            for i in range(len(self.drop) - 1, -1, -1):
                if self.drop[i] == name:
                    del self.drop[i:]
                    return
            if name not in self.inline and all(x.name != name for x in self.stack):
                return
            self.drop.clear()  # it ends with its parent
        if name in INLINE:
            if name in self.inline:
                while self.inline.pop() != name:
                    pass
            if name == "a":
                self.links = 0
            return
        self.flush()
        self.links = 0
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name or name in ROOTS and self.stack[i].name == "section" and all(x.name != name for x in self.stack):
                del self.stack[i:]
                return


def read_blocks(page: str | None) -> list[Block]:
    """Flat text blocks of a page, in order."""
    reader, at, page = _Reader(), 0, page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is not None:
            (reader.close(name.lower()) if m["close"] else reader.open(name.lower(), m["attrs"], m[0].endswith("/>")))
        elif m["gone"]:
            if m["gone"].lower() == "title" and not reader.drop:
                reader.flush()
        elif page.startswith("<![CDATA[", m.start()):
            reader.text(page[m.start() + 9 : m.end() - 3])
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)  # a tag that the page's end cuts off
        reader.text(rest[: cut.start()] if cut else rest)
    reader.flush()
    return reader.blocks


def block_features(blocks: list[Block]) -> np.ndarray:
    """A row of :data:`FEATURES` for each block of a page."""
    n = len(blocks)
    words = np.array([b.words for b in blocks], dtype=float)
    density = np.array([b.linked / b.words for b in blocks])
    pad = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    has_root = float(any(b.root for b in blocks))
    # Words under each telling name, and in the article (or, outside of all articles, the page) that it stands in.
    under: dict[int, int] = {}
    scope: dict[int, int] = {}
    for b in blocks:
        for number in {0, b.root}:  # 0: the whole page
            scope[number] = scope.get(number, 0) + b.words
        for number, _ in b.named:
            under[number] = under.get(number, 0) + b.words
    tells = lambda b, kind: any(k == kind and under[i] < (1.0 if kind == 2 else 0.5) * scope[b.root] for i, k in b.named)
    own = np.array([[b.root > 0, b.aside, tells(b, 2), tells(b, 1), b.heading, b.item, b.paragraph, b.good] for b in blocks], dtype=float)
    # In an article such a line is part of its text.
    rights = [float(b.words < 30 and not b.root and bool(RIGHTS.search(b.text))) for b in blocks]
    return np.column_stack(
        [words, density, pad(words, -1), pad(density, -1), pad(words, 1), pad(density, 1), own, np.full(n, has_root), [b.linked for b in blocks], rights]
    )


# --- the labelled table -------------------------------------------------------------------
# Example pages. {c:N} stands for a block of N words that belongs to the article, {b:N} for one
# that does not; {c:N:K} and {b:N:K} link K of their words.
_MENU = "<nav><ul><li>{b:1:1}</li><li>{b:2:2}</li><li>{b:1:1}</li></ul></nav>"
_FOOT = "<footer>{b:12}</footer>"
EXAMPLES = (
    "<body>" + _MENU + "<div class='ad'>{b:9}</div><article><h1>{c:7}</h1><p>{c:60}</p><p>{c:14}</p><p>{c:3}</p><p>{c:120}</p></article>" + _FOOT,
    "<body><header><h1>{b:3:3}</h1><p>{b:6}</p></header>" + _MENU + "<main><h1>{c:9}</h1><p>{c:45:2}</p><h2>{c:3}</h2><p>{c:80}</p><ul><li>{c:4}</li><li>{c:9}</li><li>{c:2}</li></ul><p>{c:5}</p></main><aside><h3>{b:2}</h3><p>{b:40}</p><ul><li>{b:5:5}</li></ul></aside>" + _FOOT,
    "<body><div class='cookie-notice'><p>{b:30:2}</p></div>" + _MENU + "<article><header><h1>{c:8}</h1></header><p>{c:55}</p><blockquote>{c:20}</blockquote><p>{c:70:4}</p><form><p>{b:8}</p><label>{b:2}</label></form><section class='comments'><h2>{b:2}</h2><p>{b:35}</p><p>{b:12}</p></section></article><aside>{b:25}</aside>" + _FOOT,
    "<body><div id='header'>{b:4:2}</div><div class='menu'><ul><li>{b:1:1}</li><li>{b:1:1}</li></ul></div><div class='sidebar'><p>{b:30}</p><p>{b:50}</p></div><div class='content'><h1>{c:6}</h1><p>{c:40}</p><p>{c:9}</p><p>{c:65:3}</p><p>{c:2}</p></div><div class='comments'><p>{b:44}</p><p>{b:6}</p></div><div id='footer'>{b:15:4}</div>",
    "<body><div>{b:3:3}</div><div>{b:2:2}</div><h1>{c:8}</h1><p>{c:70}</p><p>{c:30}</p><p>{c:12}</p><p>{c:90}</p><div>{b:4:4}</div><div>{b:3:3}</div><div>{b:6:6}</div><p>{b:8:3}</p>",
    "<body><ul><li>{b:2:2}</li><li>{b:1:1}</li></ul><div><p>{c:50}</p><p>{c:6}</p><p>{c:42:1}</p></div><div class='share'>{b:3:3}</div><div class='related'><h3>{b:2}</h3><ul><li>{b:7:7}</li><li>{b:9:9}</li></ul></div><p class='copyright'>{b:9}</p>",
    "<body><div role='banner'>{b:5}</div><div role='navigation'>{b:6:6}</div><main><article><p>{c:25}</p><div class='ad'>{b:11}</div><p>{c:33}</p><div class='newsletter'>{b:18}</div><p>{c:15}</p><table><tr><td>{c:2}</td><td>{c:3}</td></tr></table><p>{c:1}</p></article><div class='comments'><div>{b:25}</div></div></main><div role='contentinfo'>{b:8}</div>",
    "<body><table><tr><td>{b:1:1}</td><td>{b:2:2}</td></tr></table><h1>{c:5}</h1><div>{c:110}</div><div>{c:48}</div><div>{b:5:5}</div><div>{b:7:6}</div>",
    "<body><article><h1>{c:4}</h1><p>{c:1}</p><p>{c:2}</p><p>{c:8:8}</p><p>{c:5}</p><pre>{c:30}</pre><ul><li>{c:3:1}</li><li>{c:6}</li></ul></article>" + _FOOT,
    "<body><div class='popup'>{b:22}</div><div class='post'><h2>{c:6}</h2><p>{c:28}</p><p>{c:11}</p><ol><li>{c:12}</li><li>{c:4}</li></ol><div class='tags'>{b:4:4}</div><div class='social'>{b:3:3}</div></div><div class='widget'><p>{b:33}</p></div><div class='legal'><p>{b:27}</p></div>",
    "<body><div>{b:4}</div><p>{c:35}</p><p>{c:55}</p><p>{c:20}</p><div>{b:3}</div><div>{b:2:1}</div>",
    "<body><article><p>{c:16}</p><p>{c:40}</p></article><article><h2>{c:5}</h2><p>{c:22}</p></article><aside class='sponsored'>{b:19}</aside><form>{b:10}<p>{b:3}</p></form>",
    "<body><article><p>{c:12}</p><p>{c:30}</p><p>{c:4}</p></article>" + _MENU + _FOOT,
    "<body><article><h1>{c:3}</h1><p>{c:2:2}</p><p>{c:18:9}</p><ul><li>{c:1:1}</li><li>{c:2}</li></ul><p>{c:6:4}</p></article><nav>{b:2:2}</nav>",
    "<body><main><p>{c:21}</p><nav>{b:1:1}</nav><p>{c:2}</p><aside>{b:60}</aside><p>{c:10}</p><footer>{b:20}</footer></main>" + _MENU,
    "<body><main><div class='promo'>{b:40}</div><p>{c:5}</p><div class='comments'><p>{b:80}</p></div></main>",
    "<body><div class='content'><p>{c:12}</p><p>{c:1}</p></div><ul class='menu'><li>{b:1:1}</li><li>{b:2:2}</li></ul>",
    "<body>" + _MENU + "<div class='entry-content'><p>{c:3}</p><p>{c:4:4}</p><p>{c:60}</p><h3>{c:2}</h3></div>" + _MENU + _FOOT,
    "<body><p>{c:30}</p><p>{c:44}</p><p>{c:8}</p>" + _MENU,
    "<body><p>{c:64}</p>" + _FOOT,
    "<body>" + _MENU + "<p>{c:26}</p><div>{b:2:2}</div><div>{b:3:3}</div>",
    "<body><article><p>{c:1}</p></article>",
    "<body>" + _MENU + "<h1>{c:3}</h1><p>{c:50}</p><h2>{c:2}</h2><p>{c:40}</p><p>{c:3}</p><p>{c:38}</p>" + _FOOT,
    "<body><article><h1>{c:6}</h1><p>{c:33}</p><p>{c:12}</p></article>",
    "<body>" + _MENU + "<main><p>{c:47}</p><p>{c:3}</p><p>{c:8}</p>",
    "<body><div class='story'><p>{c:21}</p><p>{c:2}</p></div>",
    "<body><nav>{b:3}</nav><article><p>{c:9}</p></article><footer>{b:2}</footer><aside>{b:9}</aside>",
    "<body><article><p>{c:2}</p><div class='notice'>{b:14}</div></article><div class='comments'>{b:3}</div>",
    "<body><div>{b:1}</div><div>{b:1}</div><div>{b:2}</div><div>{c:40}</div><div>{c:65}</div><div>{c:33}</div><div>{b:r}</div>",
    "<body><div>{b:1}</div><div>{b:3}</div><h1>{c:5}</h1><p>{c:52}</p><p>{c:4}</p><p>{c:71}</p><div>{b:2}</div><div>{b:r}</div>",
    "<body><div>{b:1}</div><p>{c:18}</p><p>{c:6}</p><p>{c:39}</p><div>{b:4}</div><div>{b:1}</div>",
    "<body><main><h1>{c:4}</h1><p>{c:28}</p><div>{c:3}</div><p>{c:50}</p></main><p>{b:r}</p>",
    *(f"<body><article><p>{{c:{n}}}</p></article>" for n in (4, 5, 6, 7, 8, 11)),
    *(f"<body><main><p>{{c:25}}</p><p>{{c:{n}}}</p></main>" for n in (1, 4, 5, 6, 7, 8)),
    "<body><article><div class='form-of-life'><p>{c:30}</p><p>{c:5}</p><p>{c:44}</p></div></article>" + _FOOT,
    "<body><article><p>{c:30}</p><div class='signup form'>{b:9}</div><p>{c:44}</p><div class='tags'>{b:3}</div></article>" + _FOOT,
    "<body><article><p>{c:30}</p><p>{c:44}</p></article><div id='comments'><article class='comment-body'><p>{b:33}</p></article><article><p>{b:4}</p></article></div>",
    "<body><main><p>{c:12}</p><p>{c:31}</p></main><aside><article><h3>{b:4}</h3><p>{b:18}</p></article></aside>",
    "<body><div class='content'><p>{c:40}</p><div class='search-tips'><p>{c:80}</p><p>{c:7}</p></div></div><div class='login'>{b:6}</div>",
)
# {b:r} is a line of rights.
_MARK = re.compile(r"\{([cb]):(\d+|r)(?::(\d+))?\}")


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: article) of the example pages' blocks."""

    def words(m: re.Match) -> str:
        if m[2] == "r":
            return "© no 2024 all rights reserved"
        n, k = int(m[2]), int(m[3] or 0)
        own = [f"{'yes' if m[1] == 'c' else 'no'}{i}" for i in range(n)]
        return (f"<a href='#'>{' '.join(own[:k])}</a> " if k else "") + " ".join(own[k:])

    rows, labels = [], []
    for page in EXAMPLES:
        blocks = read_blocks(_MARK.sub(words, page))
        rows.append(block_features(blocks))
        labels += [int(b.text.startswith("yes")) for b in blocks]
    return np.concatenate(rows), np.array(labels)


# --- the decision tree --------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> dict:
    """A binary tree by Gini impurity: leaves hold a label, nodes ``feature <= at``."""
    if depth == 0 or len(y) <= least or y.min() == y.max():
        return {"label": int(2 * y.sum() > len(y))}
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones, n = np.cumsum(t)[:-1], np.arange(1, len(t))
        edge = np.flatnonzero(v[:-1] < v[1:])
        if not len(edge):
            continue
        a, b = ones[edge] / n[edge], (t.sum() - ones[edge]) / (len(t) - n[edge])
        impurity = n[edge] * a * (1 - a) + (len(t) - n[edge]) * b * (1 - b)
        k = int(np.argmin(impurity))
        if best is None or impurity[k] < best[0] - 1e-12:
            best = (impurity[k], f, (v[edge[k]] + v[edge[k] + 1]) / 2)
    if best is None:
        return {"label": int(2 * y.sum() > len(y))}
    _, f, at = best
    low = x[:, f] <= at
    return {"feature": f, "at": at, "low": grow(x[low], y[low], depth - 1, least), "high": grow(x[~low], y[~low], depth - 1, least)}


def decide(tree: dict, row: np.ndarray) -> int:
    while "label" not in tree:
        tree = tree["low"] if row[tree["feature"]] <= tree["at"] else tree["high"]
    return tree["label"]


@lru_cache(maxsize=1)
def trained_tree() -> dict:
    """The tree of the labelled table; the same in every process."""
    return grow(*labelled_table())


def main_text(page: str | None) -> str:
    """Text of a page's article."""
    blocks = read_blocks(page)
    if not blocks:
        return ""
    tree = trained_tree()
    return "\n\n".join(b.text for b, row in zip(blocks, block_features(blocks)) if decide(tree, row))


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without ``column``, with ``text``: each page's main text."""
    if "text" in pages.columns:
        raise ValueError("a column named text clashes with the result's")

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.withColumn("text", extract(column)).drop(column)
