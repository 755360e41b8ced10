"""Main text of web pages by consensus host paths.

1. Each page is parsed once (Arrow batches); every container is scored: the share of the
   page's content it covers, times the share of its own text that is content, with a
   preference for article-like and against page-wide containers.
2. Pages vote in Spark: scores are summed per host and generalised tag-class path (digits
   folded, ids dropped; one partial sum per task, so a host with a third of all pages is
   a few rows), and the best path of each host wins.
3. Every page is extracted again with its host's path; where no container of the page has that
   path, the page's own best container is taken.

Content is text outside boilerplate: scripts, styles, menus, headers and footers of the
page, sidebars, notices, adverts, forms and reader comments, by tag, role, class or id, also
inside the winning container. A class or id word does not count on an element that holds most of
the page's content, the page's only article or a main element, nor does a form that is wrapped
around these (its controls and labels are still left out). The winners, one row per host, are written before the join, so the
optimiser knows their size; if there are too many hosts to broadcast, the join splits hot hosts.

Defined cases: null or empty html gives an empty text; text without any container belongs to the
body; tags never closed end with their parent, a paragraph also at the next block; a null or
odd url belongs to the host ''; repeated rows stay rows; an empty table gives an empty result;
other columns are ignored. Nothing is dropped or capped besides boilerplate."""
from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, own_columns, stage

# Fixed values of HTML: elements without content, block elements, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary "
                   "table tbody td tfoot th thead title tr ul").split())
CONTAINER = frozenset("article body center div main section table tbody td tr dl ol ul li blockquote".split())
#: Elements that are never content.
NEVER = frozenset(("head title script style noscript template iframe object svg canvas nav footer aside form button select textarea "
                   "input label dialog menu").split())
#: Elements an opening tag of the same kind closes first.
SAME = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd", ("dl",)), "dt": ("dt", ("dl",)), "tr": ("tr", ("table",)),
        "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}
#: Words of class, id or role that mark boilerplate, and words that mark articles.
BOILER = re.compile(r"(^|[\s_-])(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|side-?bar\w*|foot(er)?\w*|masthead|"
                    r"site-?header|page-?header|top-?bar|header|breadcrumbs?|cookies?\w*|consent|gdpr|notices?|alert|comments?\w*|commentlist|disqus\w*|"
                    r"respond|repl(y|ies)|share|sharing|social\w*|related\w*|recommend\w*|newsletter\w*|subscri\w*|sign-?up|login|"
                    r"popup|modal|overlay|widget\w*|pagination|pager|search\w*|skip-?link|toolbar|complementary|contentinfo|navigation)($|[\s_-])", re.I)
#: State words about other elements ("no-sidebar", "has-sidebar", "with-comments") say nothing of their own.
STATE = re.compile(r"(?<![^\s_-])(?:no|has|with|without)[_-][\w-]+", re.I)
#: Boilerplate words of reader comments, which may be longer than the article.
READERS = re.compile(r"comment|disqus|respond|repl(y|ies)", re.I)
ARTICLE = re.compile(r"(^|[\s_-])(article\w*|main|content|post|entry|story|body-?text|article-?body)($|[\s_-])", re.I)
PREFER, PAGE_WIDE = 1.5, 0.7
#: A path names at most this many of the innermost containers.
PATH_STEPS = 12

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
                    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
                    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "parent", "path", "boiler", "link", "content", "total", "like", "hard", "soft", "readers")

    def __init__(self, tag, parent, path, link, like, hard=False, soft=False, readers=False):
        self.tag, self.parent, self.path, self.link, self.like = tag, parent, path, link, like
        # marks of the element itself: by tag or hidden, by class, id or role, of reader comments
        self.hard, self.soft, self.readers = hard, soft, readers
        self.boiler = hard or soft or (parent is not None and parent.boiler)
        self.content = self.total = 0


def parse(html: str):
    """(elements in page order, blocks): a block is a list of pieces (element, text) of the
    flowing text between two block borders."""
    root = Node("body", None, "body", False, False)
    stack, nodes, blocks, piece = [root], [root], [], []
    for m in _TOKEN.finditer(html):
        text = m["text"]
        if text is not None:
            top = stack[-1]
            piece.append((top, unescape(text) if "&" in text else text))
            continue
        tag = m["tag"]
        if tag is None:
            continue  # comments, raw elements, declarations
        tag = tag.lower()
        block = tag in BLOCK
        if block and piece:
            blocks.append(piece)
            piece = []
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # an inline end tag does not close blocks
                if not block and stack[i].tag in CONTAINER:
                    break
            continue
        if tag == "body" or tag == "html":
            continue
        if block:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in CONTAINER or stack[i].tag in NEVER:
                    break
            if tag in SAME:
                same, stop = SAME[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == same:
                        del stack[i:]
                        break
                    if stack[i].tag in stop:
                        break
        if tag in VOID:
            continue
        top, attr = stack[-1], m["attr"]
        names, hidden, like = "", False, tag in ("article", "main")
        step = tag
        if attr and len(attr) > 4:
            for a in _ATTR.finditer(attr):
                k, v = a[1].lower(), a[2] or a[3] or a[4] or ""
                if k in ("hidden", "aria-hidden"):
                    hidden |= k == "hidden" or v.lower() == "true"
                else:
                    names += " " + v
                    if k == "class" and v:
                        step = tag + "." + ".".join(sorted(_DIGITS.sub("#", v).split()))
        inside = top.like or any(n.like for n in stack) if tag == "header" else False
        # a form may be wrapped around the page: it is marked like a class word, and may be spared
        hard = (tag in NEVER and tag != "form") or (tag == "header" and not inside) or hidden
        soft = bool(names) and not (like and tag == "article" and "comment" not in names.lower()) and bool(BOILER.search(STATE.sub("", names)))
        like = like or bool(names and ARTICLE.search(names))
        soft = soft or tag == "form"
        container = tag in CONTAINER
        path = top.path
        if container:
            path += ">" + step
            if path.count(">") >= PATH_STEPS:
                path = path.split(">", 1)[1]
        node = Node(tag, top, path, top.link or tag == "a", like, hard, soft, soft and bool(names) and bool(READERS.search(names)))
        nodes.append(node)
        stack.append(node)
        if attr and attr.endswith("/") and not block:
            stack.pop()
    if piece:
        blocks.append(piece)
    if any(n.soft for n in nodes):
        _spare(nodes, blocks)
    for n in nodes:
        n.like = n.like and not n.boiler
    return nodes, blocks


def _spare(nodes, blocks) -> None:
    """Takes the mark of a class or id word, or of a form, off the element that holds more than all that is
    unmarked, off those around it, and off those around a main element or the only article. A form
    holds the page only if there are headings or at least two paragraphs with content in it."""
    held: dict = {id(n): 0 for n in nodes}
    for piece in blocks:
        for node, text in piece:
            if not node.link:
                held[id(node)] += len(text) - text.count(" ")
    hard, readers = {}, {}
    for n in nodes:
        hard[id(n)] = n.hard or (n.parent is not None and hard[id(n.parent)])
        readers[id(n)] = n.readers or (n.parent is not None and readers[id(n.parent)])
    for n in reversed(nodes):
        if n.parent is not None and not (n.hard or n.soft):
            held[id(n.parent)] += held[id(n)]
    inner = [n for n in nodes if not hard[id(n)] and held[id(n)]]
    articles = [n for n in inner if n.tag == "article" and not n.soft and not readers[id(n)]]
    keep = [n for n in inner if n.tag == "main"] + (articles if len(articles) == 1 else [])
    form, prose = {}, {}
    for n in nodes:
        form[id(n)] = n if n.tag == "form" else form.get(id(n.parent))
    for n in inner:
        around = form[id(n)]
        if around is not None and not n.soft and n.tag in ("p", "h1", "h2", "h3", "article", "main"):
            prose[id(around)] = prose.get(id(around), 0) + (1 if n.tag == "p" else 2)
    marked = [n for n in inner if n.soft and not readers[id(n)] and (n.tag != "form" or prose.get(id(n), 0) >= 2)]
    if marked:
        most = max(marked, key=lambda n: held[id(n)])
        if held[id(most)] > held[id(nodes[0])]:
            keep.append(most)
    spared = set()
    for n in keep:
        while n is not None and id(n) not in spared:
            spared.add(id(n))
            n = n.parent
    for n in nodes:
        n.boiler = n.hard or (n.soft and id(n) not in spared) or (n.parent is not None and n.parent.boiler)


def _measure(nodes, blocks) -> None:
    """Content and total characters of each element, its descendants included."""
    for piece in blocks:
        for node, text in piece:
            n = len(text) - text.count(" ")
            node.total += n
            if not (node.link or node.boiler):
                node.content += n
    for node in reversed(nodes):  # parents come before their children
        if node.parent is not None:
            node.parent.content += node.content
            node.parent.total += node.total


def scores(nodes, blocks) -> list[tuple[str, float]]:
    """(path, score) of the page's containers that hold content."""
    _measure(nodes, blocks)
    whole = nodes[0].content
    if not whole:
        return []
    best: dict = {}
    for n in nodes:
        if n.boiler or n.content * 10 < whole or (n.tag not in CONTAINER):
            continue
        s = n.content / whole * (n.content / n.total) * (PREFER if n.like else 1.0) * (PAGE_WIDE if n.tag == "body" else 1.0)
        best[n.path] = best.get(n.path, 0.0) + s
    return list(best.items())


def _rank(path_score):
    """Higher score wins, then the deeper path, then the text of the path."""
    return round(path_score[1], 9), path_score[0].count(">"), path_score[0]


def extract(html: str, path: str | None) -> str:
    """Text of all containers with ``path``, or of the page's best path if it has none."""
    nodes, blocks = parse(html)
    def having(path):
        return {id(n) for n in nodes if n.path == path and not n.boiler and n.tag in CONTAINER}
    at = having(path) if path else set()
    if not at:
        ranked = scores(nodes, blocks)
        if not ranked:
            return ""
        at = having(max(ranked, key=_rank)[0])
    inside = set(at)
    for n in nodes:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
    out = []
    for piece in blocks:
        t = " ".join("".join(text for node, text in piece if not node.boiler and id(node) in inside).split())
        if t:
            out.append(t)
    return " ".join(out)


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def vote(pages: DataFrame) -> DataFrame:
    """(host, path, score): summed scores of the pages' containers."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            total: dict = {}
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                for path, s in scores(*parse(html)):
                    total[host, path] = total.get((host, path), 0.0) + s
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()),
                                              pa.array(list(total.values()), pa.float64())], names=["host", "path", "score"])
    return pages.select("host", "html").mapInArrow(run, "host string, path string, score double") \
        .groupBy("host", "path").agg(F.sum("score").alias("score"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    p = own_columns(pages, page_id=("page_id", "long"), url=("url", "string"), html=("html", "string"))
    p = p.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    votes = vote(p)
    best = F.max(F.struct(F.round("score", 6).alias("score"), F.size(F.split("path", ">")).alias("depth"), F.col("path").alias("path")))
    winners = stage(votes.groupBy("host").agg(best.alias("w")).select("host", F.col("w.path").alias("path")), "host-paths")

    def run(batches):
        import pyarrow as pa
        for b in batches:
            texts = [extract(h, w) for h, w in zip(b.column("html").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return p.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op5_html_main_text(spark, sf_dir):
    return main_text(load(spark, sf_dir, "pages"))


QUERIES = {"op5_html_main_text": op5_html_main_text}
ORACLES = {}
