"""Layout-aware text of HTML pages.

A page becomes a tree (implied tags are supplied, stray ones ignored) and the tree is rendered: text
that a reader would see, blocks on lines of their own, list marks, and table cells in columns. The
tree of one page lives in one call; pages are spread over tasks as rows, without a shuffle.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.llm.common import ship_package

#: Elements nested deeper are not opened: their text goes to the deepest one, if none of them hides it.
DEEPEST = 200
#: A cell is padded to its column's width only up to here; longer cells keep their whole text.
WIDEST = 40

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title template".split())
UNSEEN = frozenset(
    "script style title template noscript iframe noembed noframes object audio video canvas datalist head".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure fieldset article section hr".split())
BLOCK = MARGIN | frozenset(
    "html body div header footer main nav aside address form li dt dd tr thead tbody tfoot caption figcaption legend "
    "details summary dialog center option optgroup hgroup search".split()
)
CLOSE_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li dt dd main menu nav ol p pre search section summary table ul".split()
)
#: Elements that end an svg drawing they stand in.
BREAKOUT = frozenset(
    "b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
CLOSED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "optgroup": ("option", "optgroup"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tr": ("tr", "td", "th", "caption"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    "thead": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
}
HOLDER = {
    "li": ("ul", "ol", "menu"),
    "dt": ("dl",),
    "dd": ("dl",),
    "option": ("select", "datalist"),
    "optgroup": ("select", "datalist"),
}
CELL_WALL = frozenset("table td th caption".split())
TABLE_PART = frozenset("table caption tr td th tbody thead tfoot".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))(?![\w-])", re.I)
_STYLE_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_NUMBER = re.compile(r"\s*([+-]?\d+)")
_SPACE = re.compile(r"[ \t\n\r\f]+")


#: Of an svg drawing the text of SVG_SHOWN is shown, also inside groups.
SVG_GROUPS = frozenset("a switch g svg".split())
SVG_SHOWN = frozenset("text foreignobject".split())
#: Formulas: markup for other programs.
MATH_UNSEEN = frozenset("annotation annotation-xml".split())


def attributes_of(text: str) -> dict[str, str]:
    """Names, in small letters, and values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for found in _ATTRIBUTE.finditer(text):
        value = found[2] if found[2] is not None else found[3] if found[3] is not None else found[4] or ""
        out.setdefault(found[1].lower(), html.unescape(value))
    return out


class Node:
    """An element: its tag, attributes and children (nodes and strings)."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.attributes = attributes_of(attributes) if attributes.strip(" /\t\n\r\f") else {}

    def seen(self) -> bool:
        if self.tag in UNSEEN or self.tag in MATH_UNSEEN or self.tag == "input":
            return False
        a = self.attributes
        if self.tag == "dialog" and "open" not in a:
            return False
        if "hidden" in a and a["hidden"].strip().lower() != "until-found":
            return False
        return not ("style" in a and _UNSEEN_STYLE.search(_STYLE_COMMENT.sub(" ", a["style"])))


class Tree:
    """Builds the tree tag by tag."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        # Elements past the depth limit: tag and whether text inside is hidden; and the places of each tag.
        self.deep: list[tuple[str, bool]] = []
        self.deep_at: dict[str, list[int]] = {}
        self.drawing = False  # there has been an svg or math element

    def text(self, value: str) -> None:
        if not (self.deep and self.deep[-1][1]):
            self.open[-1].children.append(value)

    def _close(self, tags: tuple[str, ...], walls: tuple[str, ...] | frozenset[str]) -> None:
        """Close the outermost open element of ``tags`` above the nearest wall, with all inside it."""
        found = None
        if self.deep:
            wall = self._last_deep(walls)
            inside = [at for t in tags for at in self.deep_at.get(t, ())[-1:] if at > wall]
            if inside:
                held = (self.deep_at[t] for t in tags if self.deep_at.get(t))
                self._undeep(min(at[k] for at in held if (k := bisect_right(at, wall)) < len(at)))
            if inside or wall >= 0:
                return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in tags:
                found = at
            elif tag in walls:
                break
        if found is not None:
            del self.open[found:]
            self._undeep(0)

    def _last_deep(self, tags) -> int:
        return max((at[-1] for t, at in self.deep_at.items() if at and t in tags), default=-1)

    def _undeep(self, at: int) -> None:
        for tag, _ in self.deep[at:]:
            self.deep_at[tag].pop()
        del self.deep[at:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body", "head"):
            return
        if tag in ("svg", "math"):
            self.drawing = True
        elif self.drawing and tag in BREAKOUT:
            self._leave_drawing()
        if tag in CLOSE_PARAGRAPH:
            self._close(("p",), CELL_WALL | {"button"})
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], HOLDER.get(tag, ("table",)))
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr"))
        node = Node(tag, attributes)
        if tag in VOID or self.ends_itself(attributes):
            if not (self.deep and self.deep[-1][1]):
                self.open[-1].children.append(node)
        else:
            self._push(node)

    def ends_itself(self, attributes: str) -> bool:
        """``<path/>``: only inside drawings and formulas the stroke ends an element."""
        return self.drawing and attributes.endswith("/") and any(n.tag in ("svg", "math") for n in self.open)

    def _leave_drawing(self) -> None:
        """Elements of the page's text end a drawing that is still open."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == "foreignobject":
                return
            if self.open[at].tag == "svg":
                del self.open[at:]
                self._undeep(0)
                return

    def _push(self, node: Node) -> None:
        if len(self.open) < DEEPEST:
            self.open[-1].children.append(node)
            self.open.append(node)
            return
        hidden = (bool(self.deep) and self.deep[-1][1]) or not node.seen()
        self.deep.append((node.tag, hidden))
        self.deep_at.setdefault(node.tag, []).append(len(self.deep) - 1)
        if not hidden:
            self.open[-1].children.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            if not (self.deep and self.deep[-1][1]):
                self.open[-1].children.append(Node("br"))
            return
        walls = frozenset(("table",)) if tag in TABLE_PART else CELL_WALL
        if self.deep:
            wall, own = self._last_deep(walls), self._last_deep((tag,))
            if own >= max(wall, 0):
                self._undeep(own)
            if max(own, wall) >= 0:
                return
        for at in range(len(self.open) - 1, 0, -1):
            here = self.open[at].tag
            if here == tag:
                del self.open[at:]
                self._undeep(0)
                return
            if here in walls:
                return


def parse(page: str) -> Node:
    """The page's tree. An unfinished comment runs to the end; a ``<`` that opens no tag is text."""
    tree = Tree()
    lower = None
    pattern = _TAG
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            tree.text(html.unescape(page[at:]))
            break
        if mark > at:
            tree.text(html.unescape(page[at:mark]))
        follow = page[mark + 1 : mark + 2]
        if follow in ("!", "?"):
            comment = page.startswith("<!--", mark)
            stop = page.find("-->", mark + 2) if comment else page.find(">", mark)
            at = size if stop < 0 else stop + (3 if comment else 1)
            continue
        found = pattern.match(page, mark)
        if found is None and pattern is _TAG and (found := _PLAIN_TAG.match(page, mark)):
            pattern = _PLAIN_TAG  # a quote never ends: from here on quotes mean nothing
        if found is None:
            if follow.isalpha() or follow == "/":  # no tag ends any more
                tree.text(html.unescape(page[mark:]))
                break
            tree.text("<")
            at = mark + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            tree.end(tag)
            continue
        tree.start(tag, found[3])
        if tag in RAW and not tree.ends_itself(found[3]):
            if lower is None:
                lower = page.lower() if len(page.lower()) == size else page
            stop = lower.find(f"</{tag}", at)
            stop = size if stop < 0 else stop
            if tag in ("textarea", "title"):
                tree.text(html.unescape(page[at:stop]))
            elif tag == "xmp":
                tree.text(page[at:stop])
            at = stop
    return tree.root


class Layout:
    """Collects text: white space is collapsed, lines and blank lines are asked for and never doubled."""

    def __init__(self):
        self.parts: list[str] = []
        self.lines = 0  # line ends due before the next text
        self.space = False
        self.indent = ""
        self.mark = ""

    def need(self, lines: int) -> None:
        self.space = False
        if self.parts:
            self.lines = max(self.lines, lines)

    def _begin(self) -> None:
        if self.lines or not self.parts:
            self.parts.append("\n" * self.lines)
            self.lines, self.space = 0, False
            if self.mark:
                self.parts.append(self.mark)
                self.mark = ""
            elif self.indent:
                self.parts.append(self.indent)
        elif self.space:
            self.parts.append(" ")
            self.space = False

    def inline(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words in ("", " "):
            self.space = self.space or bool(words)
            return
        self.space = self.space or words[0] == " "
        self._begin()
        self.parts.append(words.strip(" "))
        self.space = words[-1] == " "

    def literal(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.lines = self.lines + 1 if self.parts else 0
            if line.strip():
                self._begin()
                self.parts.append(line)

    def result(self) -> str:
        return "".join(self.parts)


def _cells(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions (and other loose content) and the rows of cells of a table, not of tables inside it."""
    loose, rows = [], []
    waiting = [c for c in reversed(table.children)]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            if node.strip():
                holder = Node("div")
                holder.children.append(node)
                loose.append(holder)
        elif not node.seen():
            continue
        elif node.tag == "tr":
            cells = [c for c in node.children if not isinstance(c, str) and c.tag in ("td", "th") and c.seen()]
            others = Node("div")
            others.children = [c for c in node.children if isinstance(c, str) or c.tag not in ("td", "th")]
            if any(c.strip() if isinstance(c, str) else True for c in others.children):
                loose.append(others)
            rows.append(cells)
        elif node.tag in ("tbody", "thead", "tfoot"):
            waiting.extend(reversed(node.children))
        else:
            loose.append(node)
    return loose, rows


def _table(table: Node, out: Layout) -> None:
    loose, rows = _cells(table)
    for node in loose:
        out.need(1)
        _render(node, out, False)
    texts = []
    for row in rows:
        line = []
        for cell in row:
            inner = Layout()
            for child in cell.children:
                _any(child, inner, False)
            line.append(_SPACE.sub(" ", inner.result()).strip())
        texts.append(line)
    widths: list[int] = []
    for line in texts:
        for k, text in enumerate(line):
            if k == len(widths):
                widths.append(0)
            if len(text) <= WIDEST:
                widths[k] = max(widths[k], len(text))
    for line in texts:
        if any(line):
            out.need(1)
            out._begin()
            out.parts.append("  ".join(t.ljust(widths[k]) for k, t in enumerate(line)).rstrip())
    out.need(2)


def _list(node: Node, out: Layout, literal: bool) -> None:
    number = int(found[1]) if node.tag == "ol" and (found := _NUMBER.match(node.attributes.get("start", ""))) else 1
    outer = out.indent
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            _any(child, out, literal)
            continue
        if not child.seen():
            continue
        label = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        out.need(1)
        out.mark, out.indent = outer + label, outer + " " * len(label)
        _render(child, out, literal)
        out.mark, out.indent = "", outer
        out.need(1)


def _drawing(node: Node, out: Layout, literal: bool) -> None:
    """The texts of an svg drawing, apart from each other; what is only defined is not shown."""
    for child in node.children:
        if isinstance(child, str) or not child.seen():
            continue
        if child.tag in SVG_SHOWN:
            out.space = True
            _render(child, out, literal)
            out.space = True
        elif child.tag in SVG_GROUPS:
            _drawing(child, out, literal)


def _any(child: Node | str, out: Layout, literal: bool) -> None:
    if not isinstance(child, str):
        _render(child, out, literal)
    elif literal:
        out.literal(child)
    else:
        out.inline(child)


def _render(node: Node, out: Layout, literal: bool) -> None:
    if not node.seen():
        return
    tag = node.tag
    if tag == "br":
        out.space = False
        out.lines = out.lines + 1 if out.parts else 0
        return
    lines = 2 if tag in MARGIN else 1 if tag in BLOCK else 0
    if lines and not (tag in ("ul", "ol", "menu") and out.indent):
        out.need(lines)
    if tag == "table":
        _table(node, out)
    elif tag == "svg":
        _drawing(node, out, literal)
    elif tag in ("ul", "ol", "menu"):
        _list(node, out, literal)
    else:
        inside = literal or tag in ("pre", "xmp", "textarea")
        for child in node.children:
            _any(child, out, inside)
        if tag in ("td", "th"):
            out.space = True
    if lines and not (tag in ("ul", "ol", "menu") and out.indent):
        out.need(lines)


def visible_text(page: str | None) -> str:
    """All text of a page that a reader would see; empty for null."""
    if not page:
        return ""
    out = Layout()
    _render(parse(page), out, False)
    return out.result()


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_lines`` for every row of ``pages``.

    ``text`` is the visible text of ``html``: hidden elements, scripts, styles, titles and comments
    are left out, blocks stand on lines of their own with a blank line around paragraphs, headings,
    lists and tables, list items carry their mark, cells stand in columns. Null or empty markup
    gives an empty text with 0 lines. Rows map one to one; no pages give no rows; other columns are
    ignored.
    """
    ship_package(pages.sparkSession)

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"].astype("Int64"),
                    "url": batch["url"],
                    "text": [visible_text(page) for page in batch["html"]],
                }
            )

    rows = pages.select("page_id", "url", "html").mapInPandas(render, "page_id long, url string, text string")
    filled = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return rows.select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), filled.cast("long").alias("n_lines")
    )
