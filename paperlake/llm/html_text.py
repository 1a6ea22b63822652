"""Layout-aware HTML to text (operator 4).

A tokenizer and tree builder with implied tags make a tree; elements that a browser would not show
go; the rest is laid out as text: blocks on lines of their own, blank lines where blocks have
margins, list markers with indentation, and tables with aligned cells.
"""

from __future__ import annotations

import re
import sys
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.session import prepare

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset(("title", "textarea"))
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist area base link meta param source track map title".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements of SVG and MathML that show nothing where they stand.
UNSHOWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split())
#: HTML goes on inside these, and these HTML elements end what they don't stand in.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Ended by their end tag only, over the blocks that began inside them.
FORMATTING = frozenset("a b big code em font i nobr s small span strike strong tt u label sub sup mark q cite abbr".split())
#: Blocks with a blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre figure hr form fieldset article section header footer main aside nav address details xmp listing".split())
BLOCK = SPACED | frozenset("html body div li dt dd tr td th caption thead tbody tfoot center dialog figcaption hgroup legend optgroup option search summary".split())
#: A start tag of the key closes an open element of the value, not beyond the borders.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul xmp".split(), ("p",)),
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("p", "td", "th", "tr", "caption", "colgroup"), "td": ("p", "td", "th", "caption", "colgroup"), "th": ("p", "td", "th", "caption", "colgroup"),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ("p", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup")),
    "caption": ("p", "caption"), "body": ("head",),
}
BORDERS = {"li": ("ul", "ol", "menu", "table", "td", "th"), "dt": ("dl", "table", "td", "th"), "dd": ("dl", "table", "td", "th"), **dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot", "caption"), ("table",))}
_BORDER = ("table", "td", "th", "caption", "button", "object", "template", "body", "html")
#: Deeper elements become siblings, as browsers do it.
DEPTH = 400
_NEXT = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden)\b", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def build(html: str) -> Node:
    """The tree; text is a str child, entities are resolved."""
    root = Node("html")
    stack = [root]
    foreign = False  # whether SVG or MathML was met
    at, n = 0, len(html)

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and not raw.isspace():
                stack.pop()
            stack[-1].children.append(unescape(raw) if "&" in raw else raw)

    def close(tags: tuple[str, ...], borders: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in borders and stack[i].tag not in tags:
                return
            if stack[i].tag in tags:
                del stack[i:]
                return

    while at < n:
        m = _NEXT.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag in ("html", "body"):
                pass
            elif tag in FORMATTING:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        inner = any(e.tag in BLOCK for e in stack[i + 1 :])
                        del stack[i : i + 1 if inner else None]  # blocks begun inside it go on
                        break
                    if stack[i].tag in ("td", "th", "caption", "table"):
                        break
            else:
                close((tag,), ("table",) if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ("table", "td", "th", "caption") if tag != "table" else ())
            continue
        attributes = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in reversed(_ATTRIBUTE.findall(m[3]))} if m[3] else {}
        inside = None
        if foreign:
            inside = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in FOREIGN or stack[k].tag in INTEGRATION), None)
            if inside is not None and stack[inside].tag in INTEGRATION and not any(e.tag in FOREIGN for e in stack[:inside]):
                inside = None
            if inside is not None and stack[inside].tag in FOREIGN and tag in BREAKOUT:
                while stack[inside - 1].tag not in INTEGRATION and any(e.tag in FOREIGN for e in stack[:inside]):
                    inside -= 1
                del stack[inside:]
                inside = None
            if inside is not None and (tag in UNSHOWN or attributes.get("display") == "none" or attributes.get("visibility") in ("hidden", "collapse")):
                attributes["hidden"] = ""
        foreign = foreign or tag in FOREIGN
        if tag in ("html", "body"):
            close(CLOSES.get(tag, ()), ())
            owner = next((e for e in stack if e.tag == tag), None)
            if owner is None:
                owner = Node(tag, attributes)
                stack[-1].children.append(owner)
                stack.append(owner)
            else:
                owner.attributes = attributes | owner.attributes
            continue
        if stack[-1].tag == "head" and tag not in HIDDEN:
            stack.pop()
        shut = CLOSES.get(tag)
        if shut:
            own = BORDERS.get(tag, _BORDER)
            for one in shut:
                close((one,), _BORDER if one == "p" else own)
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW or tag in ESCAPABLE:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(html, at)
            body = html[at : end.start()]
            if body:
                node.children.append(unescape(body) if tag in ESCAPABLE else body)
            at = end.end()
        elif tag not in VOID and len(stack) < DEPTH and not (m[3].endswith("/") and (inside is not None or tag in FOREIGN or tag == "path")):
            stack.append(node)
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _GONE.search(a["style"]))


class _Flow:
    """Lines of one block container."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False

    def words(self, raw: str, pre: bool) -> None:
        if pre:
            first, *rest = raw.replace("\r\n", "\n").split("\n")
            self.now.append(first.replace("\t", "    "))
            for line in rest:
                self.end(pre=True)
                self.now.append(line.replace("\t", "    "))
            return
        t = _BLANKS.sub(" ", raw)
        if t.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            t = t[1:]
        if t:
            self.now.append(t)

    def end(self, pre: bool = False, force: bool = False) -> None:
        line = "".join(self.now)
        self.now = []
        line = line.rstrip() if not pre else line.rstrip("\n")
        if line.strip() or (pre or force) and self.lines and not self.gap:
            self.add([line])

    def add(self, lines: list[str], spaced: bool = False) -> None:
        if not lines:
            return
        if (self.gap or spaced) and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = spaced
        self.lines.extend(lines)


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else default


def _render(node: Node, pre: bool, flow: _Flow) -> None:
    for child in node.children:
        if isinstance(child, str):
            flow.words(child, pre)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            flow.end(force=True)
        elif tag == "hr":
            flow.end()
            flow.gap = True
        elif tag == "wbr" or tag == "img":
            continue
        elif tag == "input":
            if child.attributes.get("type", "text").lower() in ("submit", "button", "reset") and child.attributes.get("value"):
                flow.words(child.attributes["value"], False)
        elif tag == "svg":
            _labels(child, flow)
        elif tag in BLOCK:
            flow.end()
            flow.add(_block(child, pre), tag in SPACED)
        elif tag in ("mtd", "mfrac"):
            for part in [child.children] if tag == "mtd" else [[c] for c in child.children]:
                apart = Node(tag)
                apart.children = part
                flow.words(" ", False)
                _render(apart, pre, flow)
            flow.words(" ", False)
        else:
            _render(child, pre or tag == "textarea", flow)


def _labels(node: Node, flow: _Flow) -> None:
    """The texts of a drawing, apart from each other; strings outside of them aren't shown."""
    for child in node.children:
        if isinstance(child, str) or not visible(child):
            continue
        if child.tag in ("text", "foreignobject"):
            flow.words(" ", False)
            _render(child, False, flow)
            flow.words(" ", False)
        else:
            _labels(child, flow)


def _strip(lines: list[str]) -> list[str]:
    a, b = 0, len(lines)
    while a < b and not lines[a].strip():
        a += 1
    while b > a and not lines[b - 1].strip():
        b -= 1
    return lines[a:b]


def _lines(node: Node, pre: bool = False) -> list[str]:
    flow = _Flow()
    _render(node, pre, flow)
    flow.end(pre=pre)
    return _strip(flow.lines)


def _block(node: Node, pre: bool) -> list[str]:
    tag = node.tag
    if tag in ("ul", "ol", "menu"):
        return _list(node)
    if tag == "table":
        return _table(node)
    if tag in ("pre", "xmp", "listing"):
        return _lines(node, True)
    if tag == "details" and "open" not in node.attributes:
        shown = Node("details")
        shown.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        return _lines(shown)
    lines = _lines(node, pre)
    if tag in ("dd", "blockquote"):
        return [f"  {x}" if x else x for x in lines]
    return [f"- {lines[0]}", *(f"  {x}" if x else x for x in lines[1:])] if tag == "li" and lines else lines


def _list(node: Node) -> list[str]:
    out: list[str] = []
    ordered = node.tag == "ol"
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
    step = -1 if ordered and "reversed" in node.attributes else 1
    count = _number(node.attributes.get("start"), len(items) if step < 0 else 1)
    loose = Node("div")

    def flush() -> None:
        out.extend(_lines(loose))
        loose.children = []

    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            loose.children.append(child)
            continue
        flush()
        if not visible(child):
            continue
        count = _number(child.attributes.get("value"), count)
        mark = f"{count}. " if ordered else "- "
        count += step
        lines = _lines(child)
        out.append((mark + lines[0]) if lines else mark.rstrip())
        out.extend(" " * len(mark) + x if x else x for x in lines[1:])
    flush()
    return out


def _rows(node: Node) -> tuple[list[list[str]], list[list[Node]]]:
    """(captions, rows of cells), heads first and feet last; what stands outside cells counts as caption."""
    captions, groups = [], {"thead": [], "tbody": [], "tfoot": []}
    loose: list = []

    def walk(parent: Node, group: str) -> None:
        for c in parent.children:
            if isinstance(c, str):
                if c.strip():
                    loose.append(c)
            elif not visible(c) or c.tag in ("col", "colgroup"):
                continue
            elif c.tag == "tr":
                groups[group].append([x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th") and visible(x)])
                loose.extend(x for x in c.children if (isinstance(x, str) and x.strip()) or isinstance(x, Node) and x.tag not in ("td", "th"))
            elif c.tag in groups:
                walk(c, c.tag)
            else:
                loose.append(c)

    walk(node, "tbody")
    if loose:
        outside = Node("div")
        outside.children = loose
        captions.append(_lines(outside))
    return captions, groups["thead"] + groups["tbody"] + groups["tfoot"]


def _table(node: Node) -> list[str]:
    captions, rows = _rows(node)
    out = [x for c in captions for x in c]
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # rows that a cell above still covers, by column
    for row in rows:
        at, line = 0, []
        for cell in row:
            while taken.get(at, 0) > 0:
                at += 1
            span = max(1, min(_number(cell.attributes.get("colspan"), 1), 1000))
            down = max(1, min(_number(cell.attributes.get("rowspan"), 1), 65534))
            line.append((at, span, _lines(cell)))
            for k in range(at, at + span):
                taken[k] = max(taken.get(k, 0), down)
            at += span
        taken = {k: v - 1 for k, v in taken.items() if v > 1}
        grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for at, span, lines in line:
            if span == 1:
                width[at] = max(width.get(at, 0), max(map(len, lines), default=0))
    columns = sorted({at for line in grid for at, _, _ in line})
    for line in grid:
        cells = {at: lines for at, _, lines in line}
        if not any(cells.values()):
            continue
        for k in range(max(map(len, cells.values()))):
            parts = [(cells[c][k] if c in cells and k < len(cells[c]) else "").ljust(width.get(c, 0)) for c in columns]
            out.append(" | ".join(parts).rstrip(" |") if len(parts) > 1 else parts[0].rstrip())
    return out


def render(html: str) -> str:
    """All visible text of a page, laid out."""
    if sys.getrecursionlimit() < 20 * DEPTH:
        sys.setrecursionlimit(20 * DEPTH)
    return "\n".join(_lines(build(html.replace("\0", ""))))


def _render_rows(batches):
    for rows in batches:
        texts = [None if h is None else render(h) for h in rows.column(2).to_pylist()]
        sizes = [None if t is None else len(t) for t in texts]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; nothing is shuffled.

    A null html gives a null text and n_chars; an empty one, or one with nothing to see, "" and 0.
    Unclosed, misnested and unknown tags are repaired; elements nested deeper than DEPTH become
    siblings. A null page_id or url stays null, rows that stand twice come out twice, an empty table
    gives no rows. Other columns are not read.
    """
    prepare(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(_render_rows, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
