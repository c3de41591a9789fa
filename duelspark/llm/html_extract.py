"""Main-text extraction with a tree-structured graphical model.

The variables are the block elements of a page, each content or not. A child's label depends on its parent's by a
potential of the child's kind of tag; what is seen of an element (its tag, the words of its class, id and role, how much
text it has, how much of that is link text) depends on its own label. Sum-product messages go upward from the leaves and
downward from the root once each and give every element's exact marginal; text whose element is content with half a
probability or more is kept. Inline elements belong to the block they stand in.

All potentials are counts, with additive smoothing, over labelled pages in which `data-main` says what an element and
everything below it, until said otherwise, is.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.
Comments, scripts, styles, templates and the like are never text.

Defined cases: a null html counts as empty; a page without content has an empty text; unclosed, misnested and cut-off tags
are closed where their parents close; rows that repeat are each read; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr noscript math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover mspace semantics".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"), "tbody": ("tr td th thead tbody tfoot", "table"), "body": ("head", "html")}
CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in CLOSES.items()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"(?i)(?<![\w-])(?:class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_MAIN = re.compile(r"data-main\s*=\s*[\"']?([01])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_PART = re.compile(r"[a-z]+")


class Page:
    """The block elements of a page in document order, with what the model sees of them, and the texts between breaks."""

    def __init__(self, source: str):
        self.parent, self.tag, self.seen, self.given = [-1], ["html"], [()], [None]
        self.size, self.linked = [0], [0]
        self.texts: list[tuple[int, list[str]]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        words: tuple[str, ...] = ()
        given = None
        if attributes:
            found = _NAMES.findall(attributes)
            if found:
                words = tuple(sorted({w for m in found for w in _PART.findall("".join(m).lower())}))
            if "data-main" in attributes and (m := _MAIN.search(attributes)):
                given = m[1] == "1"
        self.parent.append(parent)
        self.tag.append(tag)
        self.seen.append(words)
        self.given.append(given)
        self.size.append(0)
        self.linked.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # (tag, block element it is or stands in)
        held: Counter = Counter()  # open elements by tag: what isn't open needn't be looked for
        links, fresh, at, n = 0, True, 0, len(source)
        match = _TOKEN.match
        while at < n:
            m = match(source, at)
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                text = m[0]
                if text[0] == "<" and len(text) > 1:
                    continue
                block = stack[-1][1]
                if fresh or not self.texts:
                    self.texts.append((block, []))
                    fresh = False
                self.texts[-1][1].append(text)
                count = text.count(" ") + 1 if not text.isspace() else 0
                self.size[block] += count
                if links:
                    self.linked[block] += count
                continue
            tag, attributes = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                if held[tag]:
                    while True:
                        closed, _ = stack.pop()
                        held[closed] -= 1
                        links -= closed == "a"
                        fresh |= closed not in INLINE
                        if closed == tag:
                            break
                continue
            if tag == "html":
                continue
            if tag == "br":
                if not fresh:
                    self.texts[-1][1].append(" ")
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else n
                fresh |= tag not in INLINE and tag not in ("script", "style", "template")
                continue
            if tag in INLINE or tag in VOID:
                if tag == "hr":
                    fresh = True
                if tag not in VOID and not attributes.endswith("/"):
                    stack.append((tag, stack[-1][1]))
                    held[tag] += 1
                    links += tag == "a"
                continue
            if tag in CLOSES_P:
                links -= self._close(stack, held, frozenset(("p",)), frozenset())
            elif tag in CLOSES:
                links -= self._close(stack, held, *CLOSES[tag])
            fresh = True
            held[tag] += 1
            stack.append((tag, self._open(tag, attributes, stack[-1][1])))

    @staticmethod
    def _close(stack: list[tuple[str, int]], held: Counter, tags: frozenset, within: frozenset) -> int:
        """Close the innermost open element of `tags`, not looking beyond `within`; how many links that closes."""
        if not any(held[t] for t in tags):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                links = sum(t == "a" for t, _ in stack[k:])
                held.subtract(t for t, _ in stack[k:])
                del stack[k:]
                return links
            if stack[k][0] in within or not within and stack[k][0] in ("table", "button", "object", "td", "th"):
                break
        return 0

    def features(self, i: int) -> list[str]:
        n = self.size[i]
        amount = "none" if not n else "few" if n < 6 else "some" if n < 25 else "many"
        share = "" if not n else "all" if self.linked[i] * 4 > n * 3 else "half" if self.linked[i] * 4 > n else "little"
        return [f"tag:{self.tag[i]}", f"text:{amount}", f"link:{share}", *[f"word:{w}" for w in self.seen[i]]]

    def labels(self) -> list[bool]:
        """What data-main says of each element."""
        out: list[bool] = []
        for i, given in enumerate(self.given):
            out.append(given if given is not None else i > 0 and out[self.parent[i]])
        return out


#: How a tag may pass on or change its parent's label.
def kind(tag: str) -> str:
    return tag if tag in ("nav", "header", "footer", "aside", "form", "article", "main", "div", "section", "ul", "ol", "table", "p", "li", "head", "body", "button", "dialog") else "text" if tag in ("h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", "tr", "td", "th", "tbody", "thead") else "other"


def page_counts(source: str) -> Counter:
    """Of a labelled page: ("pair", kind, parent's label, label) and ("seen", feature, label)."""
    page, out = Page(source), Counter()
    labels = page.labels()
    for i, label in enumerate(labels):
        out["label", "", 0, int(label)] += 1
        for feature in page.features(i):
            out["seen", feature, 0, int(label)] += 1
        if i:
            out["pair", kind(page.tag[i]), int(labels[page.parent[i]]), int(label)] += 1
    return out


def train(pages: DataFrame, html_col: str = "html", smoothing: float = 0.3) -> dict:
    """Potentials from labelled pages; their number is that of tags, words and kinds in them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                total.update(page_counts(source or ""))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([k[2] for k in total], pa.int32()), pa.array([k[3] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["what", "name", "parent", "label", "n"])

    rows = pages.select(html_col).mapInArrow(count, "what string, name string, parent int, label int, n long").groupBy("what", "name", "parent", "label").agg(F.sum("n").alias("n")).collect()
    n = {(r["what"], r["name"], r["parent"], r["label"]): r["n"] for r in rows}
    totals = [n.get(("label", "", 0, label), 0) for label in (0, 1)]
    model: dict = {"pair": {}, "seen": {}, "unseen_pair": [[0.9, 0.1], [0.1, 0.9]]}
    for what, name in {k[:2] for k in n}:
        if what == "pair":
            model["pair"][name] = []
            for parent in (0, 1):
                a, b = (n.get((what, name, parent, label), 0) + smoothing for label in (0, 1))
                model["pair"][name].append([a / (a + b), b / (a + b)])
        elif what == "seen":
            p = [(n.get((what, name, 0, label), 0) + smoothing) / (totals[label] + 2 * smoothing) for label in (0, 1)]
            model["seen"][name] = math.log(p[1] / p[0])
    return model


def marginals(page: Page, model: dict) -> list[float]:
    """The probability that each block element is content: one sum-product pass up the tree, one down."""
    n, parent = len(page.tag), page.parent
    seen, pairs, unseen = model["seen"], model["pair"], model["unseen_pair"]
    up0, up1 = [1.0] * n, [1.0] * n  # own evidence times the messages from below
    edge = [pairs.get(kind(t), unseen) for t in page.tag]
    message: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for i in range(n):
        score = sum(seen.get(f, 0.0) for f in page.features(i))
        up1[i] = math.exp(max(-30.0, min(30.0, score)))
    for i in range(n - 1, 0, -1):
        (a, b), (c, d) = edge[i]
        low, high = up0[i], up1[i]
        m0, m1 = a * low + b * high, c * low + d * high
        total = m0 + m1
        message[i] = m0, m1 = m0 / total, m1 / total
        p = parent[i]
        low, high = up0[p] * m0, up1[p] * m1
        total = low + high
        up0[p], up1[p] = low / total, high / total
    down: list[tuple[float, float]] = [(0.99, 0.01)] * n  # what the rest of the tree says of a label; the root isn't content
    out = [0.0] * n
    for i in range(n):
        if i:
            p = parent[i]
            m0, m1 = message[i]
            low, high = down[p][0] * up0[p] / max(m0, 1e-300), down[p][1] * up1[p] / max(m1, 1e-300)
            (a, b), (c, d) = edge[i]
            x, y = low * a + high * c, low * b + high * d
            down[i] = (x / (x + y), y / (x + y))
        low, high = down[i][0] * up0[i], down[i][1] * up1[i]
        out[i] = high / (low + high)
    return out


def main_text(source: str, model: dict) -> str:
    page = Page(source)
    content = marginals(page, model)
    blocks = []
    for block, parts in page.texts:
        if content[block] >= 0.5:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                blocks.append(text)
    return "\n\n".join(blocks)


def extract(pages: DataFrame, model: dict, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page; one pass, no shuffle."""
    spark = pages.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source or "", sent.value) for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(read, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")


def labelled_pages(spark: SparkSession) -> DataFrame:
    """Hand-labelled pages the query's model is trained on."""
    return spark.createDataFrame([(i, page) for i, page in enumerate(LABELLED)], "page_id long, html string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train(labelled_pages(spark)))


_LONG = "The river had risen in the night and by morning the lower road was under water, so the carrier came round by the mill and left the letters there for anyone who cared to walk up and ask for them before noon."
_LIST = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>World news</a></li><li><a href='/c'>Sport</a></li><li><a href='/d'>Weather</a></li></ul>"
#: Labelled by hand: data-main is 1 where the article begins, 0 where something else does.
LABELLED = [
    f"<html><head><title>A page</title></head><body><nav class='menu'>{_LIST}</nav><div class='ad'>Buy two pans now and get a third one at no cost at all.</div><article data-main=1><h1>A wet morning</h1><p>{_LONG}</p><p>{_LONG}</p><p>Short.</p></article><footer>&copy; example &middot; A note on rights. {_LONG}</footer></body></html>",
    f"<body><header><h1>The Daily</h1><nav>{_LIST}</nav></header><main data-main=1><h1>Floods</h1><p>{_LONG}</p><blockquote><p>{_LONG}</p></blockquote><ul><li>first of all the road</li><li>then the bridge by the mill</li></ul><p>{_LONG}</p><aside data-main=0 class='related'><h2>Related</h2>{_LIST}</aside></main><footer><p>All about us, and how to write to us.</p></footer></body>",
    f"<body><div id='header' class='site-header'><div class='logo'>The Daily</div><div class='navigation'>{_LIST}</div></div><div id='content' class='post entry' data-main=1><h2>Floods again</h2><p>{_LONG}</p><p>See <a href='/x'>the map</a> too.</p><p>{_LONG}</p><div data-main=0 class='share social'><a href='/s'>Share</a> <a href='/t'>Post</a></div></div><div id='comments' class='comments reader'><h3>Comments</h3><div class='comment'><p>I saw this too, and so did all of my neighbours on the hill that day.</p></div></div><div id='sidebar' class='sidebar widget'><h3>Most read</h3>{_LIST}</div><div id='footer' class='footer'><p>Imprint and contact</p></div></body>",
    f"<body><div class='cookie notice banner consent'><p>We use cookies to make this page work for you; by reading on you accept them.</p><button>Accept</button></div><nav>{_LIST}</nav><article class='article' data-main=1><h1>Title</h1><section><h2>Part one</h2><p>{_LONG}</p><p>{_LONG}</p></section><section><h2>Part two</h2><p>{_LONG}</p><table><tr><td>one</td><td>two</td></tr></table></section><form data-main=0 class='newsletter subscribe'><p>Write your address here to get our letter each week.</p><input name=a><button>Send</button></form></article><section class='comments'><article class='comment'><p>{_LONG}</p></article><article class='comment'><p>Quite so.</p></article></section><footer>{_LIST}</footer></body>",
    f"<body><header class='top'><p>Welcome to the pages of our town, open every day.</p>{_LIST}</header><div class='wrapper'><div class='ad advert sponsored promo'><p>{_LONG}</p></div><article data-main=1><header><h1>Notes</h1><p>By a writer</p></header><p>{_LONG}</p><pre>some code</pre><ol><li>one</li><li>two</li></ol><p>{_LONG}</p><footer data-main=0><p>Filed under notes</p></footer></article><aside>{_LIST}<p>{_LONG}</p></aside></div><footer><p>{_LONG}</p></footer></body>",
    f"<body><nav>{_LIST}</nav><div class='ad'>{_LONG}</div><article data-main=1><h1>Only a title and a little</h1><p>Yes.</p><p><b>{_LONG}<br><p>{_LONG}</p></article><footer>&copy; example &middot; Contact.</footer>",
    f"<body><nav>{_LIST}</nav><div class='ad'>Few words.</div><article data-main=1><h1>List of words</h1><p>One | two | three</p><p>{_LONG}<p>{_LONG}<h2>More</h2><div><p>{_LONG}</p></div></article><footer>{_LONG}</footer></body>",
    "<html><head><title>t</title></head><body class='home page'><div id='top-bar' class='topbar navigation'><a href='/1'>Start</a> | <a href='/2'>Archive</a> | <a href='/3'>About</a></div><div id='main' class='content main' data-main=1><h1>How to graft an apple tree</h1><p class='byline'>By the gardener, in March</p><p>Cut the twig in winter while it sleeps and keep it damp and cool until the sap begins to rise in the tree that is to bear it.</p><h2>What you need</h2><ul><li>a sharp knife</li><li>tape or bast</li><li>wax to seal the cut</li></ul><p>Make a long slanting cut on both, fit them so that bark meets bark, bind them, and seal all that is bare.</p><figure><img src=x><figcaption>The finished graft</figcaption></figure></div><div id='right' class='column ads'><p>Garden shears at half the price this week only!</p></div><div class='bottom footer'>Copyright, terms, privacy</div></body></html>",
    "<body><section class='hero banner promo' id='announcement'><p>Subscribe now and get two months for the price of one.</p></section><main role='main'><div class='story-body' data-main=1><h1>Council votes on new ferry</h1><p>The council voted late on Tuesday to buy a second ferry, after three hours of talk about what it would cost and who would pay.</p><p>Opponents said that a bridge would last longer.</p><div class='pullquote'><p>We have waited twelve years for this.</p></div><p>The boat is to sail from next spring, six times a day in summer and twice in winter.</p><div data-main=0 class='related-links more'><h3>More stories</h3><p><a href='/q'>Harbour closed by storm</a></p><p><a href='/r'>Fish prices fall</a></p></div></div></main><div id='disqus_thread' class='comments-area'><ol><li class='comment'><p>About time too, said everybody I know on this side.</p></li><li class='comment'><p>Who pays?</p></li></ol></div><footer class='site-footer'><ul><li>Contact</li><li>Jobs</li></ul></footer></body>",
    "<body><table class='layout'><tr><td class='menu nav'><a href='/a'>one</a><br><a href='/b'>two</a><br><a href='/c'>three</a></td><td class='text' data-main=1><h2>Notes on an old clock</h2><p>The clock was made about two hundred years ago in a small shop by the gate, as a label in its case says.</p><p>Its pendulum is of wood, which swells when the air is damp, so that the clock is slow in autumn.</p><dl><dt>Height</dt><dd>two metres</dd><dt>Wheels</dt><dd>of brass</dd></dl></td></tr></table><div class='notice warning'>This page is no longer kept up to date.</div></body>",
    "<body><div class='skip'><a href='#c'>Skip to content</a></div><header role='banner' class='masthead'><a class='brand' href='/'>Kitchen Notes</a><form class='search'><input name=q><button>Search</button></form></header><article class='recipe entry-content' data-main=1><h1>Barley soup</h1><p>Serves four. Soak the barley over night, then boil it with the bone for an hour on a low flame.</p><h3>Ingredients</h3><ul><li>one cup of barley</li><li>two carrots</li><li>a bone, or some mushrooms</li></ul><h3>Method</h3><ol><li>Chop what is to be chopped.</li><li>Put all into the pot and wait.</li></ol><blockquote>Better on the second day.</blockquote><div data-main=0 class='rating widget'>Rate this: 1 2 3 4 5</div></article><nav class='pagination'><a href='/p'>Older</a> <a href='/n'>Newer</a></nav><section id='respond' class='comment-respond'><h3>Leave a reply</h3><form><p>Your name</p><textarea></textarea></form></section></body>",
    "<body><div class='wrapper'><div class='breadcrumbs'><a href='/'>Home</a> &gt; <a href='/docs'>Docs</a></div><div class='sidebar toc'><ul><li><a href='#1'>Install</a></li><li><a href='#2'>Use</a></li></ul></div><div class='document body' data-main=1><h1>The tool's handbook</h1><section id='1'><h2>Install</h2><p>Unpack the archive and put the program where your shell looks for programs.</p><pre>tar xf tool.tar</pre></section><section id='2'><h2>Use</h2><p>Give it the name of a file; what it finds is written to the standard output, a line for each.</p><table><tr><th>option</th><th>meaning</th></tr><tr><td>-q</td><td>say less</td></tr></table></section></div></div><div class='footer legal'><p>Built from sources. All trade marks belong to their owners.</p></div><div class='popup modal consent'><p>We and our partners store things on your device.</p></div></body>",
]
