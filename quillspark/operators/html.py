"""Help pages: HTML to a tree, to typed blocks, to Markdown.

A page is parsed once in a Python worker (trees cannot be columns); everything after the blocks is Catalyst. Trees of
any depth are taken: building is iterative, and converting recurses in plain Python frames only, for which ``room``
lifts the interpreter's limit to what the tree needs.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from ..functions.text import CELL_RULES, CHUNK_RULES, PAGE_RULES, python_rules

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = ("script", "style")
BLANK = "\t\n\f\r "


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # Node or str

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def tags(self, *names: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and (not names or c.tag in names)]

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order, without recursion."""
        stack = self.tags()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(n.tags()[::-1])

    def find(self, tag: str | None = None, id: str | None = None, cls: str | None = None) -> Node | None:
        fits = (n for n in self.walk() if (tag is None or n.tag == tag) and (id is None or n.attrs.get("id") == id))
        return next((n for n in fits if cls is None or cls in n.classes), None)

    def strings(self) -> Iterator[str]:
        stack = self.children[::-1]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in SILENT:
                stack.extend(c.children[::-1])

    def text(self) -> str:
        return "".join(self.strings())

    def depth(self) -> int:
        most, level = 0, [self]
        while level:
            most, level = most + 1, [c for n in level for c in n.tags()]
        return most


class _Builder(HTMLParser):
    """Lenient tree: an end tag closes the nearest open element of its name, others are ignored. White space alone
    shrinks to one character, a line feed if it holds one, outside of preformatted text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.held: list[str] = []

    def flush(self) -> None:
        data = "".join(self.held)
        self.held.clear()
        if not data:
            return
        if not data.strip(BLANK) and not any(n.tag in ("pre", "textarea") for n in self.open):
            data = "\n" if "\n" in data else " "
        self.open[-1].children.append(data)

    def handle_starttag(self, tag, attrs):
        self.handle_startendtag(tag, attrs)
        if tag not in VOID:
            self.open.append(self.open[-1].children[-1])

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.held.append(data)

    def handle_comment(self, data):
        self.flush()


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder.flush()
    return builder.root


class room:
    """The recursion limit that a tree needs, for as long as it is converted."""

    def __init__(self, tree: Node):
        self.need = 12 * tree.depth() + 1000

    def __enter__(self):
        self.before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(self.before, self.need))

    def __exit__(self, *_):
        sys.setrecursionlimit(self.before)


@dataclass(frozen=True)
class Options:
    """What is converted and how; ``root`` is (tag, id, class), None for any."""

    root: tuple[str | None, str | None, str | None] = ("div", "hmpagebody_scroller", None)
    metadata: bool = True
    dropdowns: bool = True
    images: bool = True
    tables: bool = True
    footer: bool = False


# Classes of the help pages' paragraphs, with their block types and the Markdown around them.
PARAGRAPHS: dict[str, tuple[str, str, str]] = {
    "p_bodytext": ("PARAGRAPH", "", ""),
    "p_noNum": ("PARAGRAPH", "", ""),
    "p_noNum2": ("PARAGRAPH", "", ""),
    "p_Normal": ("PARAGRAPH", "", ""),
    "p_Head4": ("SECTION_HEADING", "#### ", ""),
    "p_Section_Title": ("SECTION_HEADING", "#### ", ""),
    "p_Procedure": ("PROCEDURE_HEADING", "", ""),
    "p_Table_Title": ("TABLE_TITLE", "", ""),
    "p_bulleted": ("BULLET_ITEM", "- ", ""),
    "p_bulleted2": ("BULLET_ITEM_L2", "  - ", ""),
    "p_bulleted3": ("BULLET_ITEM_L3", "    - ", ""),
    "p_Numbered": ("NUMBERED_STEP", "1. ", ""),
    "p_Numbered2": ("NUMBERED_SUBSTEP", "   1. ", ""),
    "p_Table_Cell": ("PARAGRAPH", "", ""),
    "p_Table_Cell_Center": ("PARAGRAPH", "", ""),
    "p_Table_Col_Name": ("PARAGRAPH", "", ""),
    "p_Table_Col_Name_Center": ("PARAGRAPH", "", ""),
    "p_Table_List": ("BULLET_ITEM", "- ", ""),
    "p_Table_Para_NWA": ("PARAGRAPH", "", ""),
    "p_Table_Para_0": ("PARAGRAPH", "", ""),
    "p_Table_Section": ("PARAGRAPH", "", ""),
    "p_Image_Center": ("IMAGE", "", ""),
    "p_Image_Left": ("IMAGE", "", ""),
    "p_Picture_Title": ("IMAGE_CAPTION", "*", "*"),
    "p_ImageCaption": ("IMAGE_CAPTION", "*", "*"),
    "p_SeeAlso": ("SEE_ALSO", "---\n\n", ""),
    "p_Z_LOC_TOC": ("LOCAL_TOC", "", ""),
    "p_underway": ("PARAGRAPH", "> ⚠️ ", ""),
    "p_Z_New": ("PARAGRAPH", "", ""),
    "p_StartPage_Link": ("PARAGRAPH", "- ", ""),
    "p_StartPage_Sect": ("SECTION_HEADING", "### ", ""),
    "p_Term_Name": ("TERM_DEFINITION", "**", "**"),
    "p_Term_Litera": ("SECTION_HEADING", "## ", ""),
}
# Span classes that are plain text, before all others.
UNWRAPPED = {"f_bodytext", "f_Table_Cell", "f_Table_List", "f_Normal", "f_Table_Para_NWA", "f_Table_Para_0", "f_Table_Section", "f_Image_Left", "f_Image_Center"}
# The Markdown around spans, by class; the first that a span has counts.
SPANS = {
    "f_Head4": "",
    "f_Procedure": "**",
    "f_Section_Title": "",
    "f_Table_Title": "**",
    "f_Z_SUPER": "^",
    "f_Z_SUB": "~",
    "f_Table_Col_Name": "**",
    "f_Table_Col_Name_Center": "**",
    "f_SeeAlso": "**",
    "f_Picture_Title": "*",
    "f_ImageCaption": "*",
    "f_StartPage_Link": "",
    "f_StartPage_Sect": "**",
    "f_Z_LOC_TOC": "",
    "f_underway": "",
    "f_Z_New": "",
    "f_Term_Name": "**",
    "f_Term_Litera": "",
}
# Parts of an icon's file name, in order, and the sign that its note gets.
NOTES = {"note": "📝", "warning": "⚠️", "caution": "⛔", "tip": "💡", "info": "ℹ️", "important": "❗"}
NOTE, PLACE, ARROW = "**Примечание**", "> **Путь:** ", " → "
STARTERS = {"PAGE_TITLE", "SECTION_HEADING", "PROCEDURE_HEADING"}
FOOTER, TOGGLE, BODY, CAPTION, ANCHOR = "topicfooter", "dropdown-toggle", "dropdown-toggle-body", "p_Picture_Title", "hmanchor"

_list_marker = re.compile(r"[•–—]|\d+\.").fullmatch
_chunk_rules, _page_rules, _cell_rules = map(python_rules, (CHUNK_RULES, PAGE_RULES, CELL_RULES))


def _ruled(text: str, rules: list) -> str:
    for pattern, to in rules:
        text = pattern.sub(to, text)
    return text


def normalised(markdown: str) -> str:
    """A chunk's Markdown, cleaned."""
    return _ruled(markdown, _chunk_rules).strip()


def normalised_page(markdown: str) -> str:
    """A whole page's Markdown, cleaned: by rules of its own."""
    return _ruled(markdown, _page_rules).strip()


def escaped(cell: str) -> str:
    """Content of a Markdown table's cell."""
    return " ".join(_ruled(cell, _cell_rules).replace("|", "\\|").split()) or " "


def clean(text: str) -> str:
    return " ".join(text.replace("\xa0", " ").split())


def paragraph_kind(node: Node) -> tuple[str, str, str] | None:
    """By the first known class in document order."""
    return next((PARAGRAPHS[c] for c in node.classes if c in PARAGRAPHS), None)


def listed(node: Node) -> bool:
    """Whether a node is the drawn marker of a list item."""
    style = node.attrs.get("style", "")
    return "display" in style and "margin-left" in style and bool(_list_marker(clean(node.text())))


class Converter:
    """Markdown of one page's elements. Results of cells are kept by node, since a note's cell may be asked for twice
    on each level of nested tables."""

    def __init__(self, options: Options = Options()):
        self.o = options
        self._cells: dict[int, str] = {}

    # pages

    def root(self, page: Node) -> Node | None:
        tag, id_, cls = self.o.root
        return page.find(tag, id_, cls)

    def metadata(self, page: Node) -> tuple[str, str]:
        title = page.find("p", cls="topictitle")
        crumbs = page.find("p", id="ptopic_breadcrumbs")
        links = [clean(a.text()) for a in crumbs.walk() if a.tag == "a" and "href" in a.attrs] if crumbs else []
        return clean(title.text()) if title else "", ARROW.join(x for x in links if x)

    def page(self, html: str) -> str | None:
        """The whole page, None without a content root or any content."""
        tree = parse(html)
        root = self.root(tree)
        if root is None:
            return None
        title, crumbs = self.metadata(tree) if self.o.metadata else ("", "")
        with room(tree):
            parts = [f"# {title}" if title else "", PLACE + crumbs if crumbs else "", self.blocks(root)]
        self._cells.clear()
        parts = [p for p in parts if p]
        return normalised_page("\n\n".join(parts)) if parts else None

    # block elements

    def blocks(self, node: Node) -> str:
        parts = []
        for c in node.children:
            part = c.strip() if isinstance(c, str) else self.block(c)
            if part and part.strip():
                parts.append(part)
        return "\n\n".join(parts)

    def block(self, n: Node) -> str | None:
        if n.tag in SILENT:
            return None
        if FOOTER in n.classes:
            return f"---\n\n{clean(n.text())}" if self.o.footer else None
        if n.tag == "table":
            return self.table(n)
        if n.tag == "div":
            return self.div(n)
        if n.tag == "p":
            return self.paragraph(n)
        if n.tag == "img":
            return self.image(n)
        if n.tag == "hr":
            return "---"
        if n.tag == "a" and ANCHOR in n.classes:
            return None
        text = self.inline(n)
        return f"{'#' * int(n.tag[1])} {text}" if text and n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else text

    def div(self, n: Node) -> str | None:
        classes = n.classes
        if FOOTER in classes:
            return f"---\n\n{clean(n.text())}" if self.o.footer else None
        if BODY in classes:
            return self.blocks(n) if self.o.dropdowns else None
        if CAPTION in classes:
            inner = n.find("p")
            if inner is not None:
                return self.paragraph(inner)
            text = self.inline(n)
            return f"*{text}*" if text else None
        return self.blocks(n) or None

    def paragraph(self, n: Node) -> str | None:
        kind = paragraph_kind(n)
        text = self.inline(n, markers=kind is None).strip()
        return f"{kind[1]}{text}{kind[2]}" if text and kind else text or None

    # inline elements

    def inline(self, n: Node, markers: bool = True) -> str:
        """markers: whether list markers among the direct children, which the page draws itself, are kept."""
        out = []
        for c in n.children:
            if isinstance(c, str):
                out.append(re.sub(r"[ \t]+", " ", c.replace("\xa0", " ")).replace("\n", " "))
            elif c.tag not in SILENT and ANCHOR not in c.classes and (markers or not listed(c)):
                out.append(self.span(c))
        return "".join(out)

    def span(self, c: Node) -> str:
        if c.tag == "br":
            return "  \n"
        if c.tag == "img":
            return self.image(c) or ""
        if c.tag == "a":
            return self.link(c)
        style, text = c.attrs.get("style", ""), self.inline(c)
        if style and text:
            mark = "**" * ("font-weight: bold" in style or "font-weight:bold" in style) + "*" * ("font-style: italic" in style or "font-style:italic" in style)
            inner = text.strip()
            if not mark or not inner:
                return text
            at = len(text) - len(text.lstrip())  # the marks stand tight around the words
            return f"{text[:at]}{mark}{inner}{mark}{text[at + len(inner) :]}"
        classes = set(c.classes)
        mark = "" if classes & UNWRAPPED else next((m for name, m in SPANS.items() if name in classes), "")
        return f"{mark}{text}{mark}" if text else ""

    def link(self, a: Node) -> str:
        if TOGGLE in a.classes:
            text = self.inline(a)
            return f"**{text}**" if text else ""
        if "imagetogglelink" in a.classes:
            shown = a.find("img", cls="image-toggle")
            return (self.image(shown) or "") if shown else ""
        text, href = self.inline(a), a.attrs.get("href", "")
        if not text or (not href and "weblink" not in a.classes):
            return text
        if "weblink" not in a.classes and not href.startswith(("http://", "https://", "#", "mailto:")):
            href = re.sub(r"\.html?$", ".md", href)
        return f"[{text}]({href})"

    def image(self, n: Node) -> str | None:
        """Icons of at most two by two rem keep their own text, others take the title first."""
        src = n.attrs.get("src") or n.attrs.get("data-src0", "")
        if not self.o.images or not src or "dropdown-toggle-icon" in n.classes:
            return None
        style, alt = n.attrs.get("style", ""), n.attrs.get("alt", "")
        sizes = [m[1] for d in ("width", "height") if (m := re.search(rf"{d}:\s*([\d.]+)rem", style))]
        try:
            small = len(sizes) == 2 and all(float(x) <= 2.0 for x in sizes)
        except ValueError:
            small = False
        return f"![{alt if small else n.attrs.get('title') or alt}]({src})"

    # tables

    @staticmethod
    def rows(t: Node, head: bool = False) -> list[Node]:
        """Rows of a table's own, else of its first body, with those of its first head before them."""
        direct = t.tags("tr")
        if direct:
            return direct
        parts = [t.find("thead")] * head + [t.find("tbody")]
        return [r for p in parts if p is not None for r in p.tags("tr")]

    def note(self, t: Node) -> str | None:
        """The quotation that a table of one row, an icon and a text, stands for."""
        rows = self.rows(t)
        cells = rows[0].tags("td") if len(rows) == 1 else []
        icon = cells[0].find("img") if len(cells) == 2 else None
        src = icon.attrs.get("src", "").lower() if icon else ""
        sign = next((s for name, s in NOTES.items() if name in src), None)
        text = self.cell(cells[1]) if sign else ""
        return "\n".join([f"> {sign} {NOTE}", *(f"> {x}" for x in text.split("\n"))]) if text else None

    @staticmethod
    def toggled(t: Node) -> Node | None:
        return t.find("a", cls=TOGGLE)

    def dropdown(self, t: Node) -> str | None:
        if not self.o.dropdowns:
            title = t.find("span", cls="f_Section_Title")
            return f"**{clean(title.text())}**" if title else None
        title, body = self.inline(self.toggled(t)), t.find("div", cls=BODY)
        parts = [f"**{title}**" if title else "", self.blocks(body) if body else ""]
        return "\n\n".join(p for p in parts if p) or None

    def frame(self, t: Node) -> list[Node] | None:
        """The cells of a table that only holds images and short captions, one in each row."""
        rows = [r for r in t.walk() if r.tag == "tr"]
        cells = [r.tags("td", "th") for r in rows]
        if len(rows) > 3 or any(len(c) != 1 for c in cells) or t.find("img") is None:
            return None
        return [c[0] for c in cells] if sum(len(s.strip()) for s in t.strings()) < 200 else None

    def table(self, t: Node) -> str | None:
        if (note := self.note(t)) is not None:
            return note
        if self.toggled(t) is not None:
            return self.dropdown(t)
        if (cells := self.frame(t)) is not None:
            parts = []
            for c in cells:
                images = [n for n in c.walk() if n.tag == "img"]
                parts += [self.image(n) for n in images] or ([f"*{clean(c.text())}*"] if clean(c.text()) else [])
            return "\n\n".join(p for p in parts if p) or None
        if not self.o.tables:
            lines = []
            for r in t.walk():
                if r.tag == "tr":
                    cells = [self.cell(c) for c in r.walk() if c.tag in ("td", "th")]
                    lines.append(" | ".join(c for c in cells if c))
            return "\n".join(x for x in lines if x) or None
        grid = []
        for r in self.rows(t, head=True):
            line: list[str] = []
            for c in r.tags("td", "th"):
                line += [self.cell(c), *[""] * (self.columns(c) - 1)]
            grid.append(line)
        width = max(map(len, grid), default=0)
        if not width:
            return None
        lines = ["| " + " | ".join([escaped(x) for x in r + [""] * (width - len(r))]) + " |" for r in grid]
        return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])

    @staticmethod
    def columns(c: Node) -> int:
        """What cannot be read as a number is one column."""
        n = c.attrs.get("colspan", "1").strip()
        if not n.isdecimal():
            return 1
        if len(n) > 6:  # no page has such a table: it fails as a page, and is counted as one
            raise ValueError(f"a cell of {n[:20]} columns")
        return max(1, int(n))

    def cell(self, c: Node) -> str:
        if id(c) not in self._cells:
            parts = []
            for x in c.children:
                if isinstance(x, str):
                    part = x.strip()
                elif x.tag == "br":
                    parts.append("")
                    continue
                elif x.tag in SILENT:
                    continue
                elif x.tag == "p":
                    part = self.paragraph(x)
                elif x.tag == "div":
                    part = self.div(x)
                elif x.tag == "table":
                    part = self.table(x)
                elif x.tag == "img":
                    part = self.image(x)
                else:
                    part = self.inline(x)
                if part:
                    parts.append(part)
            self._cells[id(c)] = "\n".join(parts)
        return self._cells[id(c)]


Block = tuple[str, str, str, list[str]]


class _Blocks:
    """Blocks of a page's content in order: (type, Markdown, heading text, classes)."""

    def __init__(self, make: Converter):
        self.make, self.out = make, []

    def put(self, kind: str, text: str | None, heading: str = "", node: Node | None = None) -> None:
        if kind in ("FOOTER", "ANCHOR") or (text and text.strip()):
            self.out.append((kind, text or "", heading, list(dict.fromkeys(node.classes)) if node else []))

    def visit(self, n: Node) -> None:
        make, classes = self.make, n.classes
        if FOOTER in classes:
            self.put("FOOTER", "", node=n)
        elif n.tag == "table":
            if (note := make.note(n)) is not None:
                self.put("NOTE", note)
            elif make.toggled(n) is not None:
                self.put("COMMAND_INVOCATION", make.dropdown(n))
            else:
                self.put("TABLE", make.table(n))
        elif n.tag == "div":
            if BODY in classes:
                self.put("COMMAND_INVOCATION", make.blocks(n))
            elif CAPTION in classes:
                self.put("IMAGE_CAPTION", make.div(n))
            else:
                for c in n.tags():
                    self.visit(c)
        elif n.tag == "p":
            kind = (paragraph_kind(n) or ("UNKNOWN",))[0]
            if all(ANCHOR in c.classes if isinstance(c, Node) else not c.strip() for c in n.children):
                self.put("ANCHOR", "")
            else:
                self.put(kind, make.paragraph(n), clean(n.text()) if kind in STARTERS else "", n)
        elif n.tag == "img":
            self.put("IMAGE", make.image(n))
        elif n.tag not in ("hr", *SILENT):
            self.put("UNKNOWN", make.inline(n))


def page_blocks(html: str, options: Options = Options()) -> tuple[str, str, list[Block]]:
    """Title, breadcrumbs and blocks; no content root: no blocks. Anchors and footers are blocks without text."""
    make = Converter(options)
    tree = parse(html)
    root = make.root(tree)
    found = _Blocks(make)
    if root is not None:
        with room(tree):
            for c in root.tags():
                found.visit(c)
    return *make.metadata(tree), found.out
