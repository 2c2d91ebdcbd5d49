"""One TEI document: parsed, cited, and rendered as text or HTML.

Pure Python, called per document from within Arrow batches.  A document is
parsed once; its citable units are intervals of that tree, and each is rendered
from it without parsing anything again.
"""

from __future__ import annotations

import re
import xml.parsers.expat as expat
from collections.abc import Iterator
from dataclasses import dataclass, field

TEI = "http://www.tei-c.org/ns/1.0"
XML = "http://www.w3.org/XML/1998/namespace"
SPACE = " \t\r\n"


class Node:
    """An element; children are elements and texts in document order.

    `pre` counts elements and texts in document order from 1, `post` is the last
    number inside the element; descendants of a are those with pre in a.pre + 1
    to a.post.
    """

    __slots__ = ("attrs", "children", "ns", "parent", "post", "pre", "tag")

    def __init__(self, ns: str, tag: str, attrs: dict[str, str], parent: Node | None = None) -> None:
        self.ns, self.tag, self.attrs, self.parent = ns, tag, attrs, parent
        self.children: list[Node | Text] = []
        self.pre = self.post = 0

    @property
    def tei(self) -> bool:
        return self.ns == TEI

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))

    def text(self) -> str:
        """The string value."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, Node):
                todo.extend(reversed(n.children))
            else:
                out.append(n)
        return "".join(out)


class Text(str):
    """A text node with its place."""

    pre = 0


def parse(content: str | bytes) -> Node:
    """The root element.  Raises expat.ExpatError; comments and processing instructions part texts and are dropped."""
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    top = Node("", "", {})
    at, count, joined = top, 0, False

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal at, count, joined
        ns, _, tag = name.rpartition("}")
        count += 1
        node = Node(ns, tag, {k.replace(XML + "}", "xml:"): v for k, v in attrs.items()} if attrs else attrs, at)
        node.pre = count
        at.children.append(node)
        at, joined = node, False

    def end(_: str) -> None:
        nonlocal at, joined
        at.post = count
        at, joined = at.parent, False

    def text(s: str) -> None:
        nonlocal count, joined
        if joined:
            whole = Text(at.children[-1] + s)
            whole.pre = count
            at.children[-1] = whole
        else:
            count += 1
            node = Text(s)
            node.pre = count
            at.children.append(node)
            joined = True

    def part(*_: str) -> None:
        nonlocal joined
        joined = False

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    p.CommentHandler = p.ProcessingInstructionHandler = part
    p.Parse(content, True)
    root = next(top.elements())
    root.parent = None
    return root


class _HeaderDone(Exception):
    pass


def header(content: str | bytes | None) -> tuple[str, str]:
    """(title, author): of each the first that is not blank, in the order in which elements end, up to the header's end.

    Only the text before an element's first child counts.  A document without
    header is read to its end; of a malformed one, what was found before the
    error is kept.
    """
    found = {"title": "", "author": ""}
    if not content:
        return "", ""
    p = expat.ParserCreate(namespace_separator="}")
    p.buffer_text = True
    stack: list[list] = []  # tag, text before the first child, still before it

    def start(name: str, _: dict[str, str]) -> None:
        if stack:
            stack[-1][2] = False
        stack.append([name.rpartition("}")[2], "", True])

    def text(s: str) -> None:
        if stack and stack[-1][2]:
            stack[-1][1] += s

    def part(*_: str) -> None:
        if stack:
            stack[-1][2] = False

    def end(_: str) -> None:
        tag, lead, _ = stack.pop()
        if tag in found and not found[tag]:
            found[tag] = lead.strip()
        elif tag == "teiHeader":
            raise _HeaderDone

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, text
    p.CommentHandler = p.ProcessingInstructionHandler = part
    try:
        p.Parse(content, True)
    except (expat.ExpatError, _HeaderDone):
        pass
    return found["title"], found["author"]


# Citation


class CiteError(ValueError):
    """A tree of citation rules that can't be followed."""


@dataclass
class Rule:
    match: str
    use: str
    unit: str
    delim: str | None
    children: list[Rule] = field(default_factory=list)


@dataclass
class Unit:
    ord: int
    level: int
    unit: str
    ref: str
    parent_ref: str | None
    node: Node


def _path(node: Node, *tags: str) -> list[Node]:
    at = [node]
    for t in tags:
        at = [c for n in at for c in n.elements() if c.tei and c.tag == t]
    return at


def rules_of(root: Node) -> tuple[dict[str, list[Rule]], str | None]:
    """The trees of rules by name, in order, and the name of the default tree."""

    def rule(n: Node) -> Rule:
        a = n.attrs
        return Rule(a.get("match", ""), a.get("use", ""), a.get("unit", ""), a.get("delim"), [rule(c) for c in _path(n, "citeStructure")])

    trees: dict[str, list[Rule]] = {}
    default = None
    for decl in _path(root, "teiHeader", "encodingDesc", "refsDecl"):
        rules = [rule(c) for c in _path(decl, "citeStructure")]
        if rules:
            name = decl.attrs.get("n") or ("default" if "default" not in trees else f"tree{len(trees) + 1}")
            trees[name] = rules
            if decl.attrs.get("default") == "true":
                default = name
    return trees, default or next(iter(trees), None)


_STEP = re.compile(r"(//?)?(?:\.(?=/)|(?:child::)?(?:[\w.-]+:)?([\w.-]+|\*)((?:\[[^\]]*\])*))")
_CONDITION = re.compile(r"""\s*(?:(not)\(\s*@([\w:.-]+)\s*\)|@([\w:.-]+)(?:\s*(!?=)\s*(?:'([^']*)'|"([^"]*)"))?|(\d+))\s*""")


def _steps(match: str) -> list[tuple[bool, str, list[tuple]]]:
    """(anywhere below, name, conditions) of each step."""
    out, at = [], 0
    text = match.strip()
    while at < len(text):
        m = _STEP.match(text, at)
        if not m or m.end() == at:
            raise CiteError(f"unsupported match {match!r}")
        at = m.end()
        if m[2] is None:
            continue
        conditions = []
        for group in re.findall(r"\[([^\]]*)\]", m[3]):
            for one in re.split(r"\s+and\s+", group):
                c = _CONDITION.fullmatch(one)
                if not c:
                    raise CiteError(f"unsupported condition [{one}]")
                conditions.append(c.groups())
        out.append((m[1] == "//", m[2], conditions))
    if not out:
        raise CiteError("empty match")
    return out


def _holds(n: Node, c: tuple, place: int) -> bool:
    no, absent, name, op, v1, v2, position = c
    if position:
        return place == int(position)
    if no:
        return absent not in n.attrs
    value = n.attrs.get(name)
    if op is None:
        return value is not None
    return value is not None and (value == (v1 if v1 is not None else v2)) == (op == "=")


def _select(context: list[Node], match: str, through: frozenset[str]) -> list[Node]:
    """The elements a path leads to, in document order; child steps also pass through elements `through`."""

    def below(n: Node, deep: bool) -> Iterator[Node]:
        todo = [*n.elements()][::-1]
        while todo:
            c = todo.pop()
            yield c
            if deep or (c.tei and c.tag in through):
                todo.extend([*c.elements()][::-1])

    steps = _steps(match)
    absolute = match.strip().startswith("/")
    at = context
    for k, (deep, name, conditions) in enumerate(steps):
        found: dict[int, Node] = {}
        for n in at:
            if k == 0 and absolute:
                reached = [n, *(below(n, True) if deep else ())]
            else:
                reached = below(n, deep)
            place = 0
            for c in reached:
                if name == "*" or (c.tei and c.tag == name):
                    place += 1
                    if all(_holds(c, x, place) for x in conditions):
                        found[c.pre] = c
        at = [found[p] for p in sorted(found)]
    return at


def _used(n: Node, use: str, place: int) -> str | None:
    if m := re.fullmatch(r"(?:\./)?@([\w:.-]+)", use):
        return n.attrs.get(m[1])
    if use == "position()":
        return str(place)
    raise CiteError(f"unsupported use {use!r}")


def units_of(root: Node, rules: list[Rule], through: tuple[str, ...] = ("lg",)) -> list[Unit]:
    """The citable units of a tree, parents before children.

    A child's ref is its parent's, the rule's @delim and its own.  An element
    for which @use gives nothing is no unit.  Raises CiteError.
    """
    out: list[Unit] = []
    passing = frozenset(through)

    def walk(context: Node, rules: list[Rule], level: int, parent: str | None) -> None:
        here = [(n.pre, place, n, r) for r in rules for place, n in enumerate(_select([context], r.match, passing), 1)]
        for _, place, n, r in sorted(here, key=lambda x: x[:2]):
            value = _used(n, r.use, place)
            if not value:
                continue
            if parent is not None and r.delim is None:
                raise CiteError("no delimiter")
            ref = value if parent is None else parent + r.delim + value
            out.append(Unit(len(out) + 1, level, r.unit, ref, parent, n))
            walk(n, r.children, level + 1, ref)

    walk(root, rules, 1, None)
    return out


def excerpt(node: Node) -> Node:
    """The element within copies of the elements around it, without their other content."""
    at, around = node, node.parent
    while around is not None:
        copy = Node(around.ns, around.tag, around.attrs)
        copy.children = [at]
        at, around = copy, around.parent
    return at


# Text

# What happens to an element in the text.
TEXT_DROPPED = frozenset("teiHeader facsimile note figure graphic fsdDecl sic abbr orig".split())
TEXT_BLOCKS = frozenset("head p ab l label".split())
TEXT_SPACES = frozenset("pb lb cb milestone space gap".split())
KEEPS_SPACE = frozenset("p ab l head label item".split())
READINGS = ("corr", "expan", "reg", "supplied")
VARIANTS = ("sic", "abbr", "orig")
ENDS_LINE = frozenset("item lg sp speaker".split())


def normalize_space(s: str) -> str:
    return re.sub("[ \t\r\n]+", " ", s).strip(SPACE)


def _first(n: Node, tags: tuple[str, ...]) -> Node | None:
    """The first child with the first of the tags that any child has."""
    for t in tags:
        for c in n.elements():
            if c.tei and c.tag == t:
                return c
    return None


def _shown(choice: Node) -> Node | None:
    """The child of a choice whose content is read."""
    return _first(choice, READINGS) or next(choice.elements(), None)


def render_text(top: Node, strict_blocks: bool = False) -> str:
    """Clean reading text of a tree.

    `strict_blocks` also ends items, groups of lines and speeches with a line
    feed; by default only the blocks of running text do.
    """
    runs: list[list[str]] = [[]]  # of the blocks that are open, the innermost last
    todo: list[tuple[Node, bool] | str | None] = [(top, False)]

    def content(n: Node, kept: bool) -> None:
        todo.extend((c, kept) if isinstance(c, Node) else c for c in reversed(n.children) if isinstance(c, Node) or kept or c.strip(SPACE))

    while todo:
        item = todo.pop()
        if item is None:  # the end of a block
            run = "".join(runs.pop())
            runs[-1].append(normalize_space(run) + "\n")
            continue
        if isinstance(item, str):
            runs[-1].append(item)
            continue
        n, kept = item
        tag = n.tag if n.tei else ""
        kept = kept or tag in KEEPS_SPACE
        if tag in TEXT_DROPPED:
            continue
        if tag in TEXT_SPACES:
            runs[-1].append(" ")
        elif tag in TEXT_BLOCKS:
            runs.append([])
            todo.append(None)
            content(n, kept)
        elif tag == "choice":
            if shown := _shown(n):
                content(shown, kept or (shown.tei and shown.tag in KEEPS_SPACE))
        else:
            if tag == "div" or (strict_blocks and tag in ENDS_LINE):
                todo.append("\n")
            content(n, kept)
    return "".join(runs[0])


# HTML

# Elements whose white-space-only texts are dropped.
HTML_STRIPPED = frozenset("div lg sp list TEI text body".split())
HTML_DROPPED = frozenset("teiHeader facsimile fsdDecl".split())
HTML_CLEAR = frozenset("TEI text body group".split())
# Element -> HTML element, its class, and attributes taken over as (HTML name, TEI name).
HTML_PLAIN: dict[str, tuple[str, str, tuple[tuple[str, str], ...]]] = {
    "p": ("p", "tei-p", ()),
    "ab": ("p", "tei-ab", ()),
    "lg": ("div", "tei-lg", (("data-type", "type"),)),
    "sp": ("div", "tei-sp", ()),
    "speaker": ("span", "tei-speaker", ()),
    "list": ("ul", "tei-list", ()),
    "item": ("li", "tei-item", ()),
    "figure": ("figure", "tei-figure", ()),
    "figDesc": ("figcaption", "tei-figdesc", ()),
    "foreign": ("span", "tei-foreign", (("lang", "xml:lang"),)),
    "unclear": ("span", "tei-unclear", ()),
    "del": ("del", "tei-del", ()),
    "add": ("ins", "tei-add", ()),
    "seg": ("span", "tei-seg", (("data-type", "type"),)),
    "w": ("span", "tei-w", ()),
    "g": ("span", "tei-g", ()),
    "quote": ("q", "tei-quote", ()),
    "q": ("span", "tei-q", ()),
    "cit": ("span", "tei-cit", ()),
    "bibl": ("span", "tei-bibl", ()),
    **{t: ("span", f"tei-{t}", ()) for t in "corr expan reg sic abbr orig persName placeName name author editor title date num".split()},
}
# Fixed values: @rend words -> HTML element; where several match, the last one holds.
HTML_REND = {
    "em": {"italic", "i", "ital"},
    "strong": {"bold", "b"},
    "sup": {"sup", "superscript"},
    "sub": {"sub", "subscript"},
}


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;")


def _open(tag: str, *attributes: tuple[str, str | None]) -> str:
    parts = [f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;").replace(chr(160), "&nbsp;")}"' for k, v in attributes if v is not None]
    return f"<{tag}{''.join(parts)}>"


def render_html(top: Node) -> str:
    """An HTML fragment of a tree.  Raises ValueError for a @quantity of a space that is no integer."""
    todo: list[tuple[Node, int] | str] = [(top, 0)]

    def content(n: Node, out: list[str], depth: int) -> None:
        stripped = n.tei and n.tag in HTML_STRIPPED
        todo.extend((c, depth) if isinstance(c, Node) else _escape(c) for c in reversed(n.children) if isinstance(c, Node) or not stripped or c.strip(SPACE))

    def wrap(n: Node, out: list[str], depth: int, tag: str, *attributes: tuple[str, str | None], before: str = "", after: str = "") -> None:
        out.append(_open(tag, *attributes) + before)
        todo.append(f"{after}</{tag}>")
        content(n, out, depth)

    def element(n: Node, out: list[str], depth: int) -> None:
        get = n.attrs.get
        tag = n.tag
        if not n.tei:
            wrap(n, out, depth, "span", ("class", f"tei tei-{tag}"))
        elif tag in HTML_DROPPED:
            return
        elif tag in HTML_CLEAR:
            content(n, out, depth)
        elif tag in HTML_PLAIN:
            name, cls, taken = HTML_PLAIN[tag]
            wrap(n, out, depth, name, ("class", cls), *((k, get(a)) for k, a in taken))
        elif tag == "div":
            shown = get("n") is not None and not any(c.tei and c.tag == "head" for c in n.elements())
            before = f'<span class="tei-ref-n">{_escape(get("n"))}</span>' if shown else ""
            wrap(n, out, depth + 1, "section", ("class", "tei-div"), ("data-type", get("type")), ("data-subtype", get("subtype")), ("data-n", get("n")), before=before)
        elif tag == "head":
            wrap(n, out, depth, f"h{min(max(depth + 1, 2), 6)}", ("class", "tei-head"))
        elif tag == "label":
            if get("type") == "head":
                wrap(n, out, depth, "span", ("class", "tei-head-label"))
            else:
                wrap(n, out, depth, "span", ("class", "tei-label"), ("data-type", get("type")))
        elif tag == "l":
            number = f'<span class="tei-lineno">{_escape(get("n"))}</span>' if get("n") is not None else ""
            wrap(n, out, depth, "div", ("class", "tei-l"), ("data-n", get("n")), before=number + '<span class="tei-l-text">', after="</span>")
        elif tag == "graphic":
            out.append(_open("img", ("class", "tei-graphic"), ("src", get("url"))))
        elif tag == "hi":
            rend = get("rend")
            words = set(re.split(r"\s+", rend)) if rend is not None else set()
            named = [h for h, w in HTML_REND.items() if words & w]
            if named:
                wrap(n, out, depth, named[-1], ("class", "tei-hi"))
            else:
                cls = "tei-hi" if rend is None else "tei-hi tei-rend-" + re.sub(r"\s+", "-", normalize_space(rend))
                wrap(n, out, depth, "span", ("class", cls))
        elif tag == "choice":
            variant = _first(n, VARIANTS)
            out.append(_open("span", ("class", "tei-choice"), ("title", normalize_space(variant.text()) if variant else None)))
            todo.append("</span>")
            if shown := _shown(n):
                content(shown, out, depth)
        elif tag == "gap":
            title = normalize_space(" ".join(n.attrs[a] for a in ("reason", "extent", "unit") if a in n.attrs))
            out.append(_open("span", ("class", "tei-gap"), ("title", title)) + "[…]</span>")
        elif tag == "supplied":
            wrap(n, out, depth, "span", ("class", "tei-supplied"), before="\u2329", after="\u232a")
        elif tag == "ref":
            target = get("target")
            if target is None:
                wrap(n, out, depth, "span", ("class", "tei-ref"))
            else:
                wrap(n, out, depth, "a", ("class", "tei-ref"), ("href", target))
        elif tag == "note":
            wrap(n, out, depth, "span", ("class", "tei-note"), ("data-type", get("type")), ("data-n", get("n")), before='<span class="tei-note-body">', after="</span>")
        elif tag == "pb":
            out.append(_open("span", ("class", "tei-pb"), ("title", f"page {get('n', '')}"), ("data-n", get("n"))) + "</span>")
        elif tag == "cb":
            out.append(_open("span", ("class", "tei-cb"), ("data-n", get("n"))) + "</span>")
        elif tag == "lb":
            out.append(_open("br", ("class", "tei-lb")))
        elif tag == "milestone":
            out.append(_open("span", ("class", "tei-milestone"), ("data-unit", get("unit")), ("data-n", get("n"))) + "</span>")
        elif tag == "space":
            quantity = get("quantity", "1").strip(SPACE)
            if not re.fullmatch(r"[+-]?\d+", quantity):
                raise ValueError(f"@quantity {quantity!r} is no integer")
            out.append(_open("span", ("class", "tei-space")) + "&nbsp;" * int(quantity) + "</span>")
        else:
            wrap(n, out, depth, "span", ("class", f"tei tei-{tag}"))

    out: list[str] = []
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            element(item[0], out, item[1])
    return "".join(out)


def render(top: Node, mode: str = "html", strict_blocks: bool = False) -> str:
    """HTML for the mode "html", text for any other."""
    return render_html(top) if mode == "html" else render_text(top, strict_blocks)
