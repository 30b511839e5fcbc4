"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder that knows void elements, raw text, implied start and end tags and misnested end tags.  The
tree is walked once: hidden subtrees are left out (hidden, display:none, visibility, closed details and dialogs, elements
that never show, simple selectors of the page's own style sheets), blocks are set apart as a browser sets them, list items
get their marks and depth, preformatted text keeps its spaces, and the cells of a table are aligned in columns (spans of
columns and rows included).

One narrow pass; a worker holds a slice of pages.  The walk keeps its own stack, so depth is bounded by memory alone.

Cases: null or empty HTML gives an empty text and title; anything that is no tag is text; broken markup never fails; ids may
be null or repeat; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that show nothing, whatever their style.
NEVER = frozenset("script style template head title meta link base iframe noembed noframes object audio video canvas datalist".split())
#: Elements of embedded drawings and formulas whose text is not shown.
NEVER_EMBEDDED = {
    "svg": frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table ul xmp caption".split()
)
#: Blocks with a blank line around.
APART = frozenset("blockquote dl dir fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split()
)
#: Start tag: (open elements that it ends, elements that it does not look beyond).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"]
#: An end tag does not look beyond these, unless it names one.
WALLS = frozenset("table td th caption body html template".split())
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_CSS, _BRACE = re.compile(r"[{};]"), re.compile(r"[{}]")
_WHOLE = re.compile(r"\s*([+-]?[0-9]{1,9})")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)")


def _number(value: str, otherwise: int) -> int:
    """The whole number that an attribute begins with."""
    m = _WHOLE.match(value)
    return int(m[1]) if m else otherwise


class Node:
    #: embedded: svg or math, for what lies in one
    __slots__ = ("tag", "attributes", "children", "embedded")

    def __init__(self, tag: str, attributes: dict, embedded: str = ""):
        self.tag, self.attributes, self.children, self.embedded = tag, attributes, [], embedded


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("#root", {})
    open_ = [root]
    count: Counter = Counter()  # of open elements, so that what is not open is not looked for
    at, end = 0, len(html)

    def cut(k: int) -> None:
        for node in open_[k:]:
            count[node.tag] -= 1
        del open_[k:]

    def pop_to(tags, walls) -> None:
        if not any(count[t] for t in tags):
            return
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                cut(k)
                if len(tags) > 1:
                    pop_to(tags, walls)
                return
            if open_[k].tag in walls:
                return

    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            text = html[at:stop]
            if open_[-1].tag == "head" and not text.isspace():
                cut(len(open_) - 1)
            open_[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for k in range(len(open_) - 1, 0, -1) if count[tag] else ():
                if open_[k].tag == tag:
                    if tag not in ("html", "body"):
                        cut(k)
                    break
                if open_[k].tag in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            else:
                if tag == "br":
                    open_[-1].children.append(Node("br", {}))
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        rest = m[3] if m[2] else m[5]
        attributes = {a.lower(): unescape(v.strip("\"'")) if v else "" for a, v in _ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
        if tag in ("html", "body") and count[tag]:
            continue
        if tag in ENDS_P:
            pop_to({"p"}, WALLS)
        if tag in ENDS:
            pop_to(*ENDS[tag])
        if open_[-1].tag == "head" and tag not in ("title", "meta", "link", "style", "script", "base", "template", "noscript"):
            cut(len(open_) - 1)
        if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            open_[-1].children.append(row)
            open_.append(row)
            count["tr"] += 1
        embedded = "svg" if tag == "svg" or count["svg"] else "math" if tag == "math" or count["math"] else ""
        node = Node(tag, attributes, embedded)
        open_[-1].children.append(node)
        if tag in VOID or embedded and rest.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            text = html[at : close.start() if close else end]
            node.children.append(unescape(text) if tag in ("title", "textarea") else text)
            at = close.end() if close else end
        else:
            open_.append(node)
            count[tag] += 1
    return root


class _Lines:
    """Text with block spacing: `gap` line breaks are due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space, self.mark, self.indent = 0, False, "", 0

    def block(self, gap: int) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def _begin(self) -> None:
        if not self.now:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 1
            self.now.append(" " * (self.indent - len(self.mark)) + self.mark if self.mark else " " * self.indent)
            self.mark = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s[:1] == " ":
            s, self.space = s[1:], self.space or bool(self.now)
        if not s:
            return
        if self.space and self.now:
            self.now.append(" ")
        self._begin()
        self.space = s[-1] == " "
        self.now.append(s[:-1] if self.space else s)

    def line_break(self) -> None:
        if self.now:
            self.block(1)
        else:
            self.gap += 1

    def as_is(self, s: str) -> None:
        for k, line in enumerate(s.split("\n")):
            if k:
                self._begin()
                self.lines.append("".join(self.now).rstrip(" "))
                self.now = []
            if line:
                self._begin()
                self.now.append(line)

    def done(self) -> list[str]:
        self.block(1)
        return self.lines


class _Table:
    """Rows of cells: columns and rows that each spans, and its lines."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.before = _Lines()

    def _placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """The cells of each row with their first column; cells from rows above keep theirs."""
        out, busy = [], {}  # column: rows below that it is taken for
        for row in self.rows:
            at, cells, below = 0, [], {}
            for span, deep, lines in row:
                while busy.get(at):
                    at += 1
                cells.append((at, span, lines))
                below |= {at + k: deep - 1 for k in range(span) if deep > 1}
                at += span
            busy = {c: n - 1 for c, n in busy.items() if n > 1} | below
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        width: list[int] = []
        rows = self._placed()
        for row in rows:
            for at, span, lines in row:
                width += [0] * (at + span - len(width))
                if span == 1:
                    width[at] = max([width[at], *map(len, lines)])
        starts = [0]
        for w in width:
            starts.append(starts[-1] + w + 2)
        out = []
        for row in rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for at, _, lines in row:
                    line = (line + "  " * bool(line)).ljust(starts[at]) + (lines[k] if k < len(lines) else "")
                out.append(line.rstrip())
        return out


def _declared(style: str) -> dict[str, str]:
    """display and visibility of a list of declarations; the last one counts."""
    return dict(_DECLARED.findall(_COMMENT.sub(" ", style).lower()))


def _on_screens(media: str) -> bool | None:
    """Whether a list of media holds for every screen; None where that depends on the screen."""
    kinds = [re.sub(r"^only\s+", "", x.strip()) for x in media.lower().split(",")]
    if any(x in ("", "all", "screen", "not print", "not speech") for x in kinds):
        return True
    return False if all(re.match(r"(?:print|speech|tty|tv|projection|handheld|braille|embossed|aural|not (?:all|screen))\b", x) for x in kinds) else None


def _rules(css: str, holds: bool | None = True):
    """Selectors, declarations, and whether the rule holds on screens (None: on some) of a style sheet.  Rules in blocks that no
    screen applies are left out."""
    css, at, begin, blocks = _COMMENT.sub(" ", css), 0, 0, [holds]
    for m in _CSS.finditer(css):
        if m.start() < at:
            continue
        before = css[begin : m.start()].strip()
        if m[0] == "{" and before.startswith("@"):
            name, _, rest = before[1:].lower().partition(" ")
            name, rest = ("media", name[5:] + rest) if name.startswith("media(") else (name, rest)
            own = _on_screens(rest) if name == "media" else True if name == "layer" else None if name in ("supports", "container", "scope", "starting-style") or name.startswith(("supports(", "container(")) else False
            blocks.append(False if own is False or blocks[-1] is False else None if own is None or blocks[-1] is None else True)
        elif m[0] == "{":
            close, depth = len(css), 1  # rules may hold rules
            for brace in _BRACE.finditer(css, m.end()):
                depth += 1 if brace[0] == "{" else -1
                if not depth:
                    close = brace.start()
                    break
            if blocks[-1] is not False:
                yield before, css[m.end() : close], blocks[-1]
            at = close + 1
        elif m[0] == "}" and len(blocks) > 1:
            blocks.pop()
        begin = max(m.end(), at)


def _by_sheets(root: Node) -> tuple[set[str], dict[str, str]]:
    """Simple selectors (tag, .class, #id) that the page's style sheets do not display on any screen, and the visibility that
    they give others."""
    out, seen, todo = set(), {}, [root]
    while todo:
        node = todo.pop()
        if node.tag == "style" and (holds := _on_screens(node.attributes.get("media", ""))) is not False:
            for names, body, always in _rules("".join(c for c in node.children if isinstance(c, str)), holds):
                declared = _declared(body)
                display, visibility = declared.get("display"), declared.get("visibility")
                simple = {s.strip() for s in names.split(",") if re.fullmatch(r"\s*[.#]?[\w-]+\s*", s)} if declared else set()
                if display == "none" and always:
                    out |= simple
                elif display and display != "none":
                    out -= simple
                if visibility in ("visible", "initial") or visibility in ("hidden", "collapse") and always:
                    seen |= dict.fromkeys(simple, visibility)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out, seen


def render(root: Node) -> str:
    """The visible text of a tree."""
    sheets, visibilities = _by_sheets(root)
    writers, tables, lists = [_Lines()], [], []

    def names(node: Node):
        """The simple selectors that fit a node, weakest first."""
        return [node.tag, *("." + c for c in node.attributes.get("class", "").split()), "#" + node.attributes.get("id", "")]

    def shows(node: Node) -> bool:
        a, tag = node.attributes, node.tag
        if tag in NEVER or tag == "input" or "hidden" in a or (tag == "dialog" and "open" not in a):
            return False
        if node.embedded and tag in NEVER_EMBEDDED[node.embedded]:
            return False
        if a and "style" in a and (display := _declared(a["style"]).get("display")):
            return display != "none"
        return not (sheets and any(n in sheets for n in names(node)))

    def visible(node: Node, seen: bool) -> bool:
        style = _declared(node.attributes["style"]).get("visibility") if "style" in node.attributes else None
        if not style and visibilities:
            style = next((visibilities[n] for n in reversed(names(node)) if n in visibilities), None)
        return False if style in ("hidden", "collapse") else True if style in ("visible", "initial") else seen

    # stack of (node, step): step 0 enters, 1 leaves; seen: visibility; pre: spaces kept
    todo: list = [(root, True, False, 0)]
    while todo:
        node, seen, pre, step = todo.pop()
        if isinstance(node, str):
            if seen:
                out = tables[-1].before if tables and tables[-1] is writers[-1] else writers[-1]
                out.as_is(node) if pre else out.text(node)
            continue
        tag = node.tag
        out = tables[-1].before if tables and tables[-1] is writers[-1] else writers[-1]
        if step:
            if tag in ("td", "th"):
                span, deep = _number(node.attributes.get("colspan", ""), 1), _number(node.attributes.get("rowspan", ""), 1)
                cell = writers.pop().done()
                if isinstance(writers[-1], _Table):
                    writers[-1].rows = writers[-1].rows or [[]]
                    writers[-1].rows[-1].append((min(span, 1000) if span > 0 else 1, min(deep, 65534) if deep > 0 else 65534 if deep == 0 else 1, cell))
                else:
                    for line in cell:
                        writers[-1].text(line)
            elif tag == "table":
                writers.pop()
                table = tables.pop()
                out = tables[-1].before if tables and tables[-1] is writers[-1] else writers[-1]
                out.block(2)
                for lines in (table.before.done(), table.lines()):
                    for line in lines:
                        out.as_is(line)
                        out.block(1)
                out.block(2)
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                out.indent -= 2 if len(lists) == 0 else 2
                out.block(2 if not lists else 1)
            elif tag in ("blockquote", "dd"):
                out.indent -= 2
                out.block(2 if tag in APART else 1)
            elif tag == "q":
                out.text("”")
            elif tag in BLOCK or tag == "text" and node.embedded == "svg":
                out.block(2 if tag in APART else 1)
            continue
        if not shows(node):
            continue
        seen = visible(node, seen)
        if tag == "br":
            out.line_break()
            continue
        if tag == "wbr" or tag in VOID:
            if tag == "hr":
                out.block(2)
            continue
        todo.append((node, seen, pre, 1))
        if tag == "table":
            out.block(2)
            tables.append(_Table())
            writers.append(tables[-1])
        elif tag == "tr" and isinstance(writers[-1], _Table):
            writers[-1].rows.append([])
        elif tag in ("td", "th"):
            writers.append(_Lines())
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(2 if not lists else 1)
            lists.append([tag == "ol", _number(node.attributes.get("start", ""), 1)])
            out.indent += 2
        elif tag == "li":
            out.block(1)
            if lists:
                mark = f"{lists[-1][1]}. " if lists[-1][0] else "- "
                lists[-1][1] += 1
            else:
                mark = "- "
            out.mark = mark
        elif tag in ("blockquote", "dd"):
            out.block(2 if tag in APART else 1)
            out.indent += 2
        elif tag == "q":
            out.text("“")
        elif tag in BLOCK or tag == "text" and node.embedded == "svg":
            out.block(2 if tag in APART else 1)
        pre = pre or tag in ("pre", "textarea", "xmp", "listing")
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        todo += [(c, seen, pre, 0) for c in reversed(children)]
    return "\n".join(writers[0].done())


def _title(root: Node) -> str:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return ""


def extract(html: str) -> tuple[str, str]:
    """Title and visible text of a page."""
    root = parse(html)
    return _title(root), render(root)


def extract_html(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """page_id, title, text of each row."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "html"):
                found = [extract(h) for h in T.column(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *(pa.array(c, pa.string()) for c in zip(*found, strict=True))], ["page_id", "title", "text"])

    return pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(html_column).alias("html")).mapInArrow(run, "page_id long, title string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))
