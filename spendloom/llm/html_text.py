"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a renderer.

The builder closes what HTML leaves implied (paragraphs before blocks, list items, definition terms, options, table
cells, rows and sections), opens implied rows, moves stray content of a table before it, and ignores end tags that
match nothing. Hidden are the head, scripts, styles, templates, closed details and dialogs, unselected options,
fallback content of media, what carries ``hidden`` or hides itself by ``style``, and what the style sheets of the page
hide by a selector of tag, classes and ids, unless a rule that wins over it shows it again; rules inside print and
conditional at-rules are left out, and a rule that shows is taken to match if in doubt. The renderer collapses white space outside ``pre``, separates
blocks by a line end and paragraphs by an empty line, marks and indents list items, and pads table cells to columns.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element groups, as its standard lists them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = set(
    "head title script style template noscript iframe noembed noframes datalist object video audio canvas map "
    "area col colgroup param source track rp".split()
)
# What of a drawing or a formula isn't drawn.
FOREIGN = {"svg", "math"}
FOREIGN_UNSEEN = set("desc metadata defs symbol annotation annotation-xml".split())
PRE = {"pre", "listing", "xmp", "plaintext", "textarea"}
LOOSE = set(
    "p h1 h2 h3 h4 h5 h6 blockquote pre listing xmp plaintext ul ol dl dir menu table figure article section aside nav header "
    "footer main address form fieldset hr details dialog".split()
)
TIGHT = set("html body div li dt dd tr caption summary legend figcaption option optgroup center hgroup search".split())
BLOCKS = LOOSE | TIGHT
SECTIONS = {"thead", "tbody", "tfoot"}
CELLS = {"td", "th"}
# A start tag of the key closes open elements of the first set, up to one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "td": (CELLS, {"table"}),
    "th": (CELLS, {"table"}),
    "tr": (CELLS | {"tr", "caption"}, {"table"}),
    **{s: (CELLS | {"tr", "caption"} | SECTIONS, {"table"}) for s in SECTIONS},
}
CLOSES_P = BLOCKS - {"html", "body", "tr", "caption", "option", "optgroup", "legend"}
WALLS = {"html", "body", "table", "td", "th", "caption", "object", "template", "button"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|$))|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'=<>`]+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_PART = re.compile(r"""((?:[^{};"']|"[^"]*"|'[^']*')*)([{};]|$)""")
_SCREEN = re.compile(r"@layer\b.*|@media\s+(?:.*,)?\s*(?:only\s+)?(?:all|screen)\s*(?:,.*)?", re.I | re.S)
_COMPOUND = re.compile(r"(?:[a-z][\w-]*|\*)?(?:[.#][\w-]+)*", re.I)
_DYNAMIC = re.compile(r":(?!not\()(?:hover|focus|active|target|checked|visited|before|after|:)", re.I)
_UNSURE = re.compile(r"\[[^\]]*\]|::?[\w-]+(?:\((?:[^()]|\([^()]*\))*\))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        """Value of an attribute; empty if it has none; null if it isn't there."""
        if not self.attributes or name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


class _Builder:
    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.sheets: list[str] = []

    def _parent(self, tag: str | None) -> list:
        """Where a new node goes; stray content of a table goes before the table."""
        top = self.open[-1]
        if top.tag not in ("table", "tr") and top.tag not in SECTIONS:
            return top.children
        if tag in ("caption", "colgroup", "col", "tr", "td", "th", "script", "style", "template") or tag in SECTIONS:
            return top.children
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == "table"), None)
        if at is None:
            return top.children
        outside = self.open[at - 1].children
        moved = Node("span")
        outside.insert(next((k for k in range(len(outside) - 1, -1, -1) if outside[k] is self.open[at]), len(outside)), moved)
        return moved.children

    def _close(self, tags: set[str], walls: set[str]) -> bool:
        """Close everything down to the outermost open element of ``tags`` above the last wall."""
        found = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                found = k
            elif self.open[k].tag in walls:
                break
        if found is not None:
            del self.open[found:]
        return found is not None

    def text(self, data: str) -> None:
        top = self.open[-1]
        where = top.children if not data.strip() else self._parent(None)
        where.append(unescape(data) if "&" in data else data)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "image":
            tag = "img"
        if tag in ("html", "body", "head"):
            if tag != "head":
                self._close({"head"}, set())
            if tag != "html":
                node = Node(tag, attributes)
                self.open[-1].children.append(node)
                self.open.append(node)
            return
        if self.open[-1].tag == "head" and tag not in ("base", "link", "meta", "title", "style", "script", "noscript", "template"):
            self.open.pop()
        if tag in CLOSES_P:
            self._close({"p"}, WALLS)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in CELLS and self.open[-1].tag != "tr" and any(n.tag == "table" for n in self.open):
            self.start("tr", "")
        node = Node(tag, attributes)
        self._parent(tag).append(node)
        closed = attributes.endswith("/") and (tag in FOREIGN or any(n.tag in FOREIGN for n in self.open))
        if tag not in VOID and not closed:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self._close({"p"}, WALLS):
            self.open[-1].children.append(Node("p"))
        elif tag in ("td", "th", "tr") or tag in SECTIONS:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    break
                if self.open[k].tag == "table":
                    break
        elif tag not in ("html", "body", "p"):
            walls = WALLS - {tag} if tag in WALLS else WALLS
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    break
                if self.open[k].tag in walls and not (tag == "table" and self.open[k].tag in ("td", "th", "caption")):
                    break


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the texts of its style sheets."""
    builder, at, n = _Builder(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            builder.text(page[at:])
            break
        if m.start() > at:
            builder.text(page[at : m.start()])
        at = m.end()
        if m[1]:
            builder.end(m[1].lower())
        elif m[2]:
            tag = m[2].lower()
            builder.start(tag, m[3])
            if tag in RAW and builder.open[-1].tag == tag:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(page, at) if tag != "plaintext" else None
                inner = page[at : close.start()] if close else page[at:]
                at = close.start() if close else n
                if tag == "style":
                    builder.sheets.append(inner)
                elif tag == "textarea":
                    builder.open[-1].children.append(unescape(inner))
                elif tag in ("xmp", "plaintext"):
                    builder.open[-1].children.append(inner)
    return builder.root, builder.sheets


class Rules:
    """Rules of style sheets on ``display`` and ``visibility``, by one name that an element must have to match."""

    def __init__(self, sheets: list[str]) -> None:
        self.by_name: dict[str, list[tuple]] = {}
        order = 0
        for sheet in sheets:
            for selectors, body in _style_rules(_COMMENT.sub(" ", sheet)):
                found = _declared(body)
                for selector in selectors.split(",") if found else ():
                    order += 1
                    self._add(selector.strip(), found, order)

    def _add(self, selector: str, found: dict[str, tuple[bool, bool]], order: int) -> None:
        plain, sure = selector, bool(selector) and _COMPOUND.fullmatch(selector) is not None
        if not sure:
            if _DYNAMIC.search(selector):
                return
            plain = re.split(r"[\s>+~]+", _UNSURE.sub("", selector).strip())[-1] or "*"
            if not _COMPOUND.fullmatch(plain):
                return
        names = frozenset(x if x[0] in ".#" else x.lower() for x in re.findall(r"[.#]?[\w-]+|\*", plain))
        rank = (selector.count("#"), len(re.findall(r"[.\[]|(?<!:):(?!:)", selector)), len(re.findall(r"(?:^|[\s>+~])[a-z]", selector, re.I)))
        for what, (hides, important) in found.items():
            # In doubt, what hides doesn't match and what shows does.
            if sure or not hides:
                self.by_name.setdefault(max(names, key=lambda x: (x[0] in ".#", x)), []).append((names, what, (important, *rank, order), hides))

    def of(self, names: set[str]) -> dict[str, tuple]:
        """For each property that is set, the winning (rank, hides)."""
        out: dict[str, tuple] = {}
        for name in names:
            for needed, what, rank, hides in self.by_name.get(name, ()):
                if needed <= names and (what not in out or out[what][0] < rank):
                    out[what] = (rank, hides)
        return out


def _style_rules(sheet: str):
    """(selectors, declarations) of the rules that always hold on a screen."""
    at, skipped, inside = 0, 0, None
    while at < len(sheet):
        m = _PART.match(sheet, at)
        if m is None or m.end() == at:
            at += 1
            continue
        text, at = m[1].strip(), m.end()
        if m[2] == "{":
            if skipped or inside is not None or (text.startswith("@") and not _SCREEN.fullmatch(text)):
                skipped += 1
            elif not text.startswith("@"):
                inside, body = text, []
            continue
        if inside is not None and not skipped:
            body.append(text)
        if m[2] == "}":
            if skipped:
                skipped -= 1
            elif inside is not None:
                yield inside, body
                inside = None
    if inside is not None:
        yield inside, body


def _declared(body: list[str]) -> dict[str, tuple[bool, bool]]:
    """(hides, important) of ``display`` and ``visibility``, if they are set."""
    out: dict[str, tuple[bool, bool]] = {}
    for line in body:
        name, _, value = line.partition(":")
        name, words = name.strip().lower(), value.lower().replace("!", " !").split()
        if name in ("display", "visibility") and words:
            important = "!important" in words or words[-2:] == ["!", "important"]
            if name not in out or important >= out[name][1]:
                out[name] = (words[0] in (("none",) if name == "display" else ("hidden", "collapse")), important)
    return out


def visible(node: Node, rules: Rules) -> bool:
    tag = node.tag
    if tag in UNSEEN:
        return False
    if tag == "dialog" and node.get("open") is None:
        return False
    found: dict[str, tuple] = {}
    if rules.by_name:
        names = {f".{c}" for c in (node.get("class") or "").split()} | {f"#{i}" for i in [node.get("id")] if i}
        found = rules.of(names | {tag, "*"})
    if node.attributes and (style := node.get("style")):
        for what, (hides, important) in _declared(_COMMENT.sub(" ", style).split(";")).items():
            if what not in found or important or not found[what][0][0]:
                found[what] = ((important,), hides)
    if any(hides for _, hides in found.values()):
        return False
    if node.attributes:
        if node.get("hidden") is not None and "display" not in found:
            return False
        if tag == "input":
            return (node.get("type") or "").lower() != "hidden"
    return True


class _Lines:
    """Text under construction: collapsed white space, owed line ends, and the indent of lists."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.owed, self.space, self.fresh = 0, False, True
        self.indent: list[str] = []
        self.marker = ""

    def owe(self, n: int) -> None:
        if n and not self.fresh:
            self.owed, self.space = max(self.owed, n), False

    def _begin(self) -> None:
        if self.owed:
            self.out.append("\n" * self.owed)
        if self.owed or self.fresh:
            self.out.append("".join(self.indent[:-1] if self.marker else self.indent) + self.marker)
            self.marker = ""
        elif self.space:
            self.out.append(" ")
        self.owed, self.space, self.fresh = 0, False, False

    def flow(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words[:1] == " ":
            self.space = not (self.fresh or self.owed)
            words = words[1:]
        if not words:
            return
        self._begin()
        if words[-1] == " ":
            self.space = True
            words = words[:-1]
        self.out.append(words)

    def exactly(self, text: str) -> None:
        for k, line in enumerate(text.split("\n")):
            if k:
                self.owed = self.owed + 1 if self.owed or not self.fresh else 0
            if line:
                self.space = False
                self._begin()
                self.out.append(line)

    def text(self) -> str:
        return "".join(self.out)


def _aligned(rows: list[list[tuple[str, int, int]]]) -> str:
    """Rows of (text, colspan, rowspan) as lines of padded cells."""
    grid, busy = [], {}
    for r, row in enumerate(rows):
        line: dict[int, str] = {}
        column = 0
        for text, across, down in row:
            while busy.get(column, 0) > r:
                column += 1
            line[column] = text
            for c in range(column, column + across):
                busy[c] = r + down
            column += across
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for c, text in line.items():
            widths[c] = max(widths.get(c, 0), max(map(len, text.split("\n"))))
    order = sorted(widths)
    out = []
    for line in grid:
        cells = [line.get(c, "").split("\n") for c in order]
        for k in range(max(map(len, cells), default=0)):
            out.append(" | ".join((x[k] if k < len(x) else "").ljust(widths[c]) for c, x in zip(order, cells)).rstrip(" "))
    return "\n".join(x for x in out if x.strip(" |"))


def _span(node: Node, name: str) -> int:
    value = (node.get(name) or "").strip()
    return min(max(int(value), 1), 1000) if value.isdecimal() and len(value) < 6 else 1


def render(root: Node, rules: Rules) -> str:
    """The laid-out text of a tree; walks by a stack of its own, so depth is no limit."""
    lines = [_Lines()]
    lists: list[list] = []
    tables: list[list[list[tuple[str, int, int]]]] = []
    pre = foreign = 0
    todo: list = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        now = lines[-1]
        if isinstance(node, str):
            now.exactly(node) if pre else now.flow(node)
            continue
        tag = node.tag
        gap = 2 if tag in LOOSE else 1 if tag in TIGHT or (foreign and tag == "text") else 0
        if tag in ("ul", "ol", "menu", "dir") and lists and (leaving is False or len(lists) > 1):
            gap = 1
        if not leaving:
            if not visible(node, rules) or (foreign and tag in FOREIGN_UNSEEN):
                continue
            if tag == "br":
                now.owed, now.space = 0 if now.fresh else now.owed + 1, False
                continue
            if tag == "table":
                now.owe(gap)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in CELLS and tables:
                lines.append(_Lines())
            else:
                now.owe(gap)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.get("start") or "1"
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                now.indent.append(" " * len(mark))
                now.marker = mark
            elif tag in ("dd", "blockquote"):
                now.indent.append("  ")
            elif tag in PRE:
                pre += 1
            foreign += tag in FOREIGN
            todo.append((node, True))
            children = node.children
            if tag == "details" and node.get("open") is None:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            elif tag == "select":
                options = [o for c in children if isinstance(c, Node) for o in ([c] if c.tag == "option" else c.children) if isinstance(o, Node)]
                chosen = [o for o in options if o.get("selected") is not None] or options[:1]
                children = chosen[-1:] if node.get("multiple") is None else options
            todo.extend((c, False) for c in reversed(children))
            continue
        foreign -= tag in FOREIGN
        if tag in CELLS and tables:
            cell = lines.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((cell.text(), _span(node, "colspan"), _span(node, "rowspan")))
        elif tag == "table":
            if text := _aligned(tables.pop()):
                now.owe(1)
                now.exactly(text)
            now.owe(gap)
        elif not (tag == "tr" and tables):
            now.owe(gap)
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            now.indent.pop()
            now.marker = ""
        elif tag in PRE:
            pre -= 1
    return lines[0].text()


def page_text(page: str | None) -> str:
    """Visible text of a page; empty for null."""
    if not page:
        return ""
    root, sheets = parse(page)
    return render(root, Rules(sheets))


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_col``.

    Null and empty pages, and pages without visible text, give an empty text; broken markup is read as far as it
    goes. Repeated rows get equal texts; an empty table stays empty; a column named like the text is replaced.
    """

    @F.arrow_udf("string")
    def text(html: pa.Array) -> pa.Array:
        return pa.array([page_text(x) for x in html.to_pylist()], pa.string())

    return pages.withColumn(text_col, text(F.col(html_col)))
