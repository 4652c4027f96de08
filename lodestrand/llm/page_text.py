"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: pieces of text between the borders of block elements. Features of
a block are the tags, classes and ids of the elements around it and what its text is like. The
field is trained on labelled pages, made here by a rule with very different layouts, and decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import crf
from lodestrand.llm.common import map_batches

# Elements that border a block, those without an end tag, and those whose content is never text.
BLOCKS = frozenset("html head body article section main aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend blockquote pre figure figcaption address details summary dialog hr hgroup menu search noscript iframe object button select option label textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template head noscript".split())
#: Elements of drawings whose content isn't shown; what a drawing or a formula shows is text like any other.
HIDDEN_IN_SVG = frozenset("title desc metadata defs".split())
#: Start tags that end an open element of the same kind, as HTML has it.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDED_BY_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_NAMES = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")


class Block:
    __slots__ = ("marks", "text", "linked", "tag")

    def __init__(self, marks: list[str], text: str, linked: int, tag: str):
        self.marks, self.text, self.linked, self.tag = marks, text, linked, tag


class Reader(HTMLParser):
    """Leaf blocks of a page in page order, with the marks of all their ancestors, each once, whatever the depth.
    Marks that a field doesn't know count nothing, so only those in ``known`` are kept, if that is given: a block then
    has no more marks than the field has features, and a page of any depth is read in time and memory of its length."""

    def __init__(self, known: Container[str] | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.blocks: list[Block] = []
        self.open: list[tuple[str, list[str]]] = []
        self.marks: dict[str, int] = {}  # marks of the open elements, how often each
        self.places: dict[str, int] = {}  # how many of a tag are open
        self.silent = 0
        self.drawings = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(list(self.marks), text, self.linked, self.open[-1][0] if self.open else ""))
            self.parts, self.linked = [], 0

    def push(self, tag: str, marks: list[str]) -> None:
        self.open.append((tag, marks))
        self.silent += tag in SILENT
        self.places[tag] = self.places.get(tag, 0) + 1
        for m in marks:
            self.marks[m] = self.marks.get(m, 0) + 1

    def pop(self, at: int) -> None:
        self.flush()
        for tag, marks in self.open[at:]:
            self.silent -= tag in SILENT
            self.places[tag] -= 1
            for m in marks:
                self.marks[m] -= 1
                if not self.marks[m]:
                    del self.marks[m]
        del self.open[at:]

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "svg":
            self.drawings += 1
        if tag == "a":
            self.links += 1
        if tag == "br":
            self.parts.append(" ")
        if self.drawings and tag in HIDDEN_IN_SVG:
            self.silent += 1
            return
        if tag not in BLOCKS and tag not in SILENT:
            return
        self.flush()
        if tag == "body" and self.places.get("head"):
            for k, (name, _) in enumerate(self.open):
                if name == "head":
                    self.pop(k)
                    break
        ends = _ENDS.get(tag, set()) | ({"p"} if tag in _ENDED_BY_BLOCK else set())
        for k in range(len(self.open) - 1, max(-1, len(self.open) - 4), -1):
            if self.open[k][0] in ends:
                self.pop(k)
                break
            if self.open[k][0] in ("table", "ul", "ol", "div", "article", "section", "body"):
                break
        if tag in VOID:
            return
        marks = [f"in:{tag}"]
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                marks += [f"is:{w}" for w in _NAMES.findall(value.lower())]
        if self.known is not None:
            marks = [m for m in marks if m in self.known]
        self.push(tag, marks)

    def handle_startendtag(self, tag, attrs) -> None:
        # "/>" closes elements of drawings and formulas; of others it means nothing
        if not (self.drawings and (tag in HIDDEN_IN_SVG or tag == "svg")) and tag != "svg":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        if tag == "svg":
            self.drawings = max(0, self.drawings - 1)
            if not self.drawings:  # whatever was left open in it is over
                self.silent = sum(self.places.get(t, 0) for t in SILENT)
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.drawings and tag in HIDDEN_IN_SVG:
            self.silent = max(0, self.silent - 1)
        elif (tag in BLOCKS or tag in SILENT) and not self.places.get(tag):
            self.flush()
        elif tag in BLOCKS or tag in SILENT:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self.links = 0
                    self.pop(k)
                    return

    def handle_data(self, data) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def read(html: str | None, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page; none of a null or empty one. A page cut off anywhere gives what was there."""
    if not html:
        return []
    r = Reader(known)
    r.feed(html)
    r.close()
    r.flush()
    return r.blocks


def features(blocks: list[Block]) -> list[crf.Position]:
    out = []
    for b in blocks:
        n = len(b.text)
        words = sum(1 for _ in _WORD.finditer(b.text))
        f = [*b.marks, f"tag:{b.tag}", f"length:{n.bit_length()}", f"links:{min(4, 5 * b.linked // max(1, n))}"]
        f += [f"words:{min(6, words.bit_length())}", f"stop:{b.text[-1] in '.!?…'}", f"mark:{b.text[0] in '©®'}", f"bar:{'|' in b.text or '·' in b.text or '»' in b.text}"]
        out.append(["bias", *f])
    return out


def labelled_pages(n: int = 260, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages with a mark for each leaf block, 1 for main text. Layouts, names of classes and texts
    vary by a seeded rule; pages with and without the elements of HTML5 are among them."""
    rng = random.Random(seed)
    syllables = "the re an in ti on le er ma so ka di vo lu pe sta ble ing tion é ü ñ sch ou".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        return (words(3, 16).capitalize() + rng.choice(".....!?")) if rng.random() < 0.93 else words(1, 10) + rng.choice(["###", "%%%", " |", "!!"])

    pages = []
    for _ in range(n):
        html, marks = [], []

        def put(tag: str, text: str, mark: int, attrs: str = "") -> None:
            html.append(f"<{tag}{attrs}>{escape(text, quote=False)}</{tag}>")
            marks.append(mark)

        def box(tag: str, name: str) -> str:
            return f"<{tag}>" if not name else f"<{tag} {rng.choice(['class', 'class', 'id'])}=\"{name}\">"

        def links() -> None:
            html.append("<ul>")
            for _ in range(rng.randint(2, 7)):
                html.append("<li>")
                put("a", words(1, 2), 0, ' href="/x"')
                html.append("</li>")
            html.append("</ul>")

        def extra(inside: bool) -> None:
            kind = rng.choice(["nav", "header", "footer", "aside", "ad", "notice", "form", "comments", "related", "share", "script"])
            modern = rng.random() < 0.5
            if kind == "nav":
                html.append("<nav>" if modern else box("div", rng.choice(["nav", "menu", "navbar", "navigation", "breadcrumb", "main-menu", "topnav"])))
                links()
                html.append("</nav>" if modern else "</div>")
            elif kind in ("header", "footer") and not inside:
                html.append(f"<{kind}>" if modern else box("div", rng.choice([kind, f"site-{kind}", f"page-{kind}", "masthead" if kind == "header" else "copyright", "top-bar" if kind == "header" else "bottom"])))
                put(rng.choice(["p", "div", "span"]), (rng.choice(["© ", "© 2024 ", ""]) if kind == "footer" else "") + words(1, 9), 0)
                html.append(f"</{kind}>" if modern else "</div>")
            elif kind in ("aside", "related"):
                html.append("<aside>" if modern else box("div", rng.choice(["sidebar", "side-bar", "widget", "related", "related-posts", "recommended", "more", "toc", "tags"])))
                if rng.random() < 0.5:
                    put(rng.choice(["h3", "h4"]), words(1, 4), 0)
                if rng.random() < 0.5:
                    links()
                else:
                    put("p", " ".join(sentence() for _ in range(rng.randint(1, 3))), 0)
                html.append("</aside>" if modern else "</div>")
            elif kind == "ad":
                put(rng.choice(["div", "div", "section"]), words(2, 14) + rng.choice([".", ""]), 0, f' class="{rng.choice(["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "ad-box", "ad-slot"])}"')
            elif kind == "notice":
                put("div", " ".join(sentence() for _ in range(rng.randint(1, 2))), 0, f' class="{rng.choice(["cookie", "cookie-notice", "notice", "consent", "gdpr", "popup", "modal", "alert", "disclaimer", "newsletter", "subscribe", "paywall"])}"')
            elif kind == "form":
                html.append("<form>")
                put("label", words(1, 4), 0)
                put("button", words(1, 2), 0)
                html.append("</form>")
            elif kind == "comments" and not inside:
                html.append(box(rng.choice(["section", "div", "ol"]), rng.choice(["comments", "comment-list", "comment", "replies", "discussion", "reader-comments", "responses", "disqus"])))
                for _ in range(rng.randint(1, 4)):
                    put(rng.choice(["p", "div"]), " ".join(sentence() for _ in range(rng.randint(1, 3))), 0)
                html.append("</" + re.match(r"<(\w+)", next(x for x in reversed(html) if re.match(r"<(section|div|ol) ", x) and x.endswith(">") and "</" not in x))[1] + ">")
            elif kind == "share":
                put("div", words(1, 4), 0, f' class="{rng.choice(["share", "social", "share-buttons", "follow"])}"')
            else:
                html.append("<script>var t='</p>';</script>")

        def article() -> None:
            style = rng.random()
            name = rng.choice(["content", "post", "entry", "entry-content", "article", "article-body", "main", "story", "post-body", "text", "body-text", "page-content"])
            start, end = ("<article>", "</article>") if style < 0.45 else ("<main><article>", "</article></main>") if style < 0.55 else ("<main>", "</main>") if style < 0.65 else (box("div", name), "</div>") if style < 0.93 else (f'<section class="{name}">', "</section>")
            html.append(start)
            if rng.random() < 0.85:
                put(rng.choice(["h1", "h1", "h2"]), words(2, 9) + rng.choice(["", "."]), 1)
            for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 12])):
                kind = rng.random()
                text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 7])))
                if kind < 0.72:
                    put("p", text if rng.random() < 0.95 else words(1, 2), 1)
                elif kind < 0.78:
                    put(rng.choice(["h2", "h3"]), words(1, 6), 1)
                elif kind < 0.84:
                    put("blockquote", text, 1)
                elif kind < 0.88:
                    put("pre", text, 1)
                elif kind < 0.92:
                    html.append("<ul>")
                    for _ in range(rng.randint(1, 4)):
                        put("li", words(1, 9), 1)
                    html.append("</ul>")
                elif kind < 0.94:
                    html.append("<table><tr>")
                    put("td", words(1, 4), 1)
                    put("td", words(1, 4), 1)
                    html.append("</tr></table>")
                else:
                    extra(True)
            html.append(end)

        for _ in range(rng.randint(1, 4)):
            extra(False)
        article()
        for _ in range(rng.randint(1, 4)):
            extra(False)
        page = "<!DOCTYPE html><html><head><title>" + words(1, 6) + "</title></head><body>" + "".join(html) + "</body></html>"
        if len(read(page)) == len(marks):
            pages.append((page, marks))
    return pages


@lru_cache(maxsize=1)
def model() -> crf.Field:
    """The field trained on :func:`labelled_pages`; made once in a process."""
    data = [(features(read(p)), ["main" if m else "rest" for m in marks]) for p, marks in labelled_pages()]
    return crf.train(("rest", "main"), data)


def page_texts(pages: DataFrame, field: crf.Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the main blocks in page order, a line each.

    Character references are decoded, white space in a block is one blank and none at its ends. Null and
    empty pages, and pages without main text, have an empty text. Null ids and repeated rows stay; other
    columns are not read; an empty table gives an empty one. One pass, no shuffle.
    """
    field = field or model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x.as_py(), field.features) for x in batch.column(2)]
            paths = field.decode([field.emit(features(b)) for b in found])
            texts = ["\n".join(b.text for b, s in zip(blocks, path) if s == 1) for blocks, path in zip(found, paths)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {c: t for c, t in rows.dtypes}
    return map_batches(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
