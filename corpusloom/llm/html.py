"""Visible text of web pages, laid out as blocks, lists and aligned tables.

A tokenizer and a tree builder with the usual implied tags make a tree of a page, whatever is left open
or misnested. Visibility rules take out what a browser wouldn't show. The renderer walks what is left:
text runs have their white space collapsed, blocks stand on lines of their own with a blank line where
they have margins, list items are marked and indented, and table cells are padded to their column.
"""

from __future__ import annotations

import html as _entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Comments, tags, and declarations. Nothing backtracks: a quote counts after `=` only and if it is closed; a tag that isn't ends with the page.
_TAG = re.compile(r"""<!--(?:-?>|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
#: White space that is collapsed; no-break and ideographic spaces are text.
_WHITE = " \t\n\r\f"
_WORD = re.compile(r"[^ \t\n\r\f]+")
#: As in browsers, elements that would stand deeper are put beside the deepest.
DEEPEST = 512
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist title link meta area map param source track".split())
HEAD = frozenset("title style script meta link base template noscript".split())
#: Blocks, and the blank lines that they keep before and after them.
BLOCKS = dict.fromkeys("address article aside body center details dialog dir div dd dt fieldset footer form header hgroup html legend li main menu nav section summary search option optgroup caption tr thead tbody tfoot td th table figcaption".split(), 0) | dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl figure hr xmp listing".split(), 1) | {"table": 1}
#: What a start tag closes: (tags, borders that the search stops at).
_P = frozenset(["p"])
_P_BORDER = frozenset("button table td th caption html applet marquee object template".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt listing xmp".split())
_LIST = frozenset("ul ol menu dir table td th html body".split())
_TABLE = frozenset("table html template".split())
_CELLS = frozenset(["td", "th"])
IMPLIED = {
    "li": (frozenset(["li"]), _LIST), "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th html body".split())), "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th html body".split())),
    "td": (_CELLS, frozenset(["tr", *_TABLE])), "th": (_CELLS, frozenset(["tr", *_TABLE])), "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), _TABLE), "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), _TABLE),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), _TABLE), "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), _TABLE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup", "html"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "html"])),
}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), _entities.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return found


def parse(page: str) -> Node:
    """The tree of a page: html with head and body, made up where tags are missing."""
    root = Node("html", {})
    head, body = Node("head", {}), Node("body", {})
    root.children = [head, body]
    stack = [root, head]
    counts: dict[str, int] = {"html": 1, "head": 1}

    def push(node: Node) -> None:
        if len(stack) >= DEEPEST:
            pop()
        stack[-1].children.append(node)
        stack.append(node)
        counts[node.tag] = counts.get(node.tag, 0) + 1

    def pop() -> None:
        counts[stack.pop().tag] -= 1

    def enter_body() -> None:
        while len(stack) > 1:
            pop()
        stack.append(body)
        counts["body"] = counts.get("body", 0) + 1

    def close(tags: frozenset, border: frozenset) -> None:
        if not any(counts.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in tags:
                while len(stack) > k:
                    pop()
                if "tr" not in tags and "optgroup" not in tags:
                    return
            elif tag in border:
                return

    in_head = True
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if in_head and text.strip(_WHITE) and stack[-1].tag in ("head", "html"):
                in_head = False
                enter_body()
            stack[-1].children.append(_entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, rest = m[2].lower(), m[3]
        if m[1]:
            if tag == "head" and in_head:
                in_head = False
                enter_body()
            elif tag in ("html", "body", "head"):
                continue
            elif tag in ("br", "p") and not counts.get(tag):
                push(Node(tag, {}))
                pop()
            elif counts.get(tag):
                border = _TABLE if tag not in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption") else frozenset(["html"] if tag == "table" else ["table", "html"])
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k].tag in border or (tag not in _CELLS and tag not in _TABLE and stack[k].tag in _CELLS and tag not in ("tr", "thead", "tbody", "tfoot")):
                        break
            continue
        attrs = _attributes(rest) if rest.strip(_WHITE) else {}
        if tag == "html":
            root.attrs = attrs | root.attrs
            continue
        if tag == "head":
            continue
        if tag == "body":
            if in_head:
                in_head = False
                enter_body()
            body.attrs = attrs | body.attrs
            continue
        if in_head and tag not in HEAD:
            in_head = False
            enter_body()
        if tag in _CLOSES_P and counts.get("p"):
            close(_P, _P_BORDER)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, attrs)
        if tag in VOID:
            stack[-1].children.append(node)
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            inner = page[at : stop.start()] if stop else page[at:]
            node.children.append(_entities.unescape(inner) if tag in ("textarea", "title") else inner)
            stack[-1].children.append(node)
            at = (page.find(">", stop.end()) + 1 or end) if stop else end
        else:
            push(node)
            if rest.endswith("/") and tag in ("path", "circle", "rect", "g", "use"):
                pop()
    return root


def hidden(node: Node) -> bool:
    """Whether a browser leaves an element out."""
    if node.tag in HIDDEN:
        return True
    a = node.attrs
    if not a:
        return node.tag == "dialog"
    if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
        return True
    return "style" in a and bool(_HIDING.search(a["style"]))


class Lines:
    """Text laid out so far."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False  # white space is due before the next word
        self.blank = 0  # blank lines that are due before the next text
        self.indent: list[str] = [""]
        self.mark = ""  # a list item's mark, due at its first text

    def _begin(self) -> None:
        if self.blank and self.done:
            self.done.append("")
        self.blank = 0
        if self.mark:
            outer = self.indent[-2] if len(self.indent) > 1 else ""
            self.line.append(outer + self.mark)
            self.mark = ""
        else:
            self.line.append(self.indent[-1])

    def words(self, text: str) -> None:
        parts = _WORD.findall(text)
        if not parts:
            self.space = self.space or bool(text)
            return
        if not self.line:
            self._begin()
        elif self.space or text[0] in _WHITE:
            self.line.append(" ")
        self.line.append(" ".join(parts))
        self.space = text[-1] in _WHITE

    def verbatim(self, text: str) -> None:
        for k, line in enumerate(text.split("\n")):
            if k:
                self.end(True)
            if line:
                if not self.line:
                    self._begin()
                self.line.append(line.rstrip("\r"))

    def end(self, always: bool = False) -> None:
        """End the line, if there is one; always: an empty line counts too."""
        if self.line:
            self.done.append("".join(self.line).rstrip(_WHITE))
            self.line = []
        elif always and self.done:
            self.done.append("")
        self.space = False

    def block(self, margin: int) -> None:
        self.end()
        self.blank = max(self.blank, margin)

    def whole(self, lines: list[str]) -> None:
        self.end()
        for line in lines:
            self._begin()
            self.line.append(line)
            self.end()

    def text(self) -> str:
        self.end()
        return "\n".join(self.done)


def _int(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,6})", value or "")
    return int(m[1]) if m else default


def _rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and the visible cells by row of a table, without those of tables inside."""
    captions, rows = [], []
    todo = list(reversed(table.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if node.strip(_WHITE):
                loose = Node("caption", {})
                loose.children = [node]
                captions.append(loose)
        elif hidden(node):
            continue
        elif node.tag == "tr":
            rows.append([])
            for cell in node.children:
                if isinstance(cell, Node) and cell.tag in _CELLS:
                    if not hidden(cell):
                        rows[-1].append(cell)
                elif isinstance(cell, Node) or cell.strip(_WHITE):
                    loose = Node("td", {})
                    loose.children = [cell]
                    rows[-1].append(loose)
        elif node.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(node.children))
        elif node.tag in _CELLS:
            rows.append([node])
        elif node.tag not in ("colgroup", "col"):
            loose = Node("caption", {})
            loose.children = [node]
            captions.append(loose)
    return captions, rows


def _table(table: Node, depth: int, widest: int) -> tuple[list[str], list[str]]:
    captions, rows = _rows(table)
    above = [line for c in captions for line in render(c, depth + 1, widest).split("\n") if line]
    grid: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines) of each row's cells
    taken: dict[int, int] = {}  # column: rows for which a cell above reaches down
    for cells in rows:
        placed, column = [], 0
        for cell in cells:
            while taken.get(column, 0) > 0:
                column += 1
            span, down = max(1, min(1000, _int(cell.attrs.get("colspan"), 1))), max(1, _int(cell.attrs.get("rowspan"), 1))
            placed.append((column, span, render(cell, depth + 1, widest).split("\n")))
            if down > 1:
                for c in range(column, column + span):
                    taken[c] = down
            column += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(placed)
    widths: dict[int, int] = {}
    for placed in grid:
        for column, span, lines in placed:
            if span == 1:
                widths[column] = max(widths.get(column, 0), max((len(x) for x in lines if len(x) <= widest), default=0))
    out = []
    for placed in grid:
        for k in range(max((len(lines) for _, _, lines in placed), default=0)):
            line = ""
            for column, _, lines in placed:
                start = sum(w + 2 for c, w in widths.items() if c < column and w)
                if lines and k < len(lines) and lines[k]:
                    line = line.ljust(start) if len(line) <= start else line + "  "
                    line += lines[k]
            out.append(line.rstrip(_WHITE))
    return above, [line for line in out if line]


def render(top: Node, depth: int = 0, widest: int = 60) -> str:
    """Text of a tree. Table cells of up to `widest` characters set their column's width; tables more than 8 deep are laid out as blocks."""
    out = Lines()
    lists: list[list] = []  # [kind, next number, step]
    pre = 0
    todo: list[tuple[Node | str, bool]] = [(top, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            out.verbatim(node) if pre else out.words(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag in ("li", "blockquote", "dd"):
                if out.mark:  # an empty item keeps its mark
                    out._begin()
                    out.end()
                else:
                    out.end()
                out.indent.pop()
            elif tag in ("pre", "listing", "xmp"):
                pre -= 1
            elif tag == "q":
                out.words("”") if out.space else out.line.append("”") if out.line else out.words("”")
            if tag in BLOCKS:
                out.block(0 if (tag in ("ul", "ol") and lists) else BLOCKS[tag])
            continue
        if node is not top and hidden(node):
            continue
        if tag == "br":
            if out.line:
                out.end()
            else:
                out.end(True)
            continue
        if tag == "hr":
            out.block(1)
            continue
        if tag == "table" and depth < 8:
            out.block(1)
            above, lines = _table(node, depth, widest)
            out.whole(above + lines)
            out.block(1)
            continue
        if tag in BLOCKS:
            out.block(0 if (tag in ("ul", "ol") and lists) or node is top else BLOCKS[tag])
        todo.append((node, True))
        if tag in ("ul", "menu", "dir"):
            lists.append(["-", 0, 0])
        elif tag == "ol":
            n = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
            back = "reversed" in node.attrs
            lists.append(["1", _int(node.attrs.get("start"), n if back else 1), -1 if back else 1])
        elif tag == "li":
            kind = lists[-1] if lists else ["-", 0, 0]
            if kind[0] == "1":
                number = _int(node.attrs.get("value"), kind[1])
                kind[1] = number + kind[2]
                mark = f"{number}. "
            else:
                mark = "- "
            if out.mark:
                out._begin()
                out.end()
            out.indent.append(out.indent[-1] + " " * len(mark))
            out.mark = mark
        elif tag in ("blockquote", "dd"):
            out.indent.append(out.indent[-1] + "  ")
        elif tag in ("pre", "listing", "xmp"):
            pre += 1
        elif tag == "q":
            out.words(" “" if out.space else "“")
            out.space = False
        elif tag == "input" and node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
            out.words(node.attrs["value"])
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag == "pre" and children and isinstance(children[0], str):
            children = [children[0].removeprefix("\n"), *children[1:]]
        todo.extend((c, False) for c in reversed(children))
    return out.text()


def visible_text(page: str | None) -> str:
    """Text of a page; a null or empty one has none."""
    return render(parse(page)) if page else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of each page, in time that is linear in its length.

    Tags with unpaired quotes end at their first `>`; one that the page's end cuts off is no text.
    Every row stays, repeated ones too; a null or empty html gives an empty text with 0 lines; a null page_id
    stays null; other columns are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select("page_id", F.col("html").cast("string")).mapInArrow(work, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_chars long, n_lines long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))
