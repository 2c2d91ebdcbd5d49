"""Markup residue in texts: found, and turned into clean text with its structure (problem 1).

One scanner knows the forms of HTML and TEI, Markdown, wiki and LaTeX, whole or
broken, and tells them from the signs of editors: a word or a gap in brackets
of any shape, a dagger, a bar, a tilde, an ampersand, asterisks on one side of
a word.  Finding and cleaning use the same forms.

The suffix array over the token streams of a host, which finds what its pages
repeat, is not used: in this data what repeats within a file is the text (each
line stands again in its fragment), and what is markup often stands once.  The
README gives figures.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names of HTML and TEI that count as tags also without attributes.
# Names that are Latin words too (ab, ex, num, a, in, si ...) are left to the rule on closed pairs.
NAMES = """
abbr address app article aside author b back bibl big blockquote body br byline caption cb cell center choice cit closer code col corr date dd del
desc div dl dt em emph epigraph expan fig figcaption figdesc figure font footer foreign formula front gap graphic group h1 h2 h3 h4 h5 h6 head header
hi hr html i iframe img ins item kbd l label lb lem lg li link list mark math mentioned milestone name nav noscript note ol opener option
orig p pb pc persname placename poem pre q quote rdg ref reg rend row rs s samp script section seg sic small sp span speaker stage strike strong style sub sup
supplied surplus svg table tbody td tei text tfoot th thead title tr trailer tt u ul unclear var w
""".split()
# What an element means for the text.
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6, "head": 2, "title": 1}
ITEMS = {"li", "item", "dt", "dd"}
CODE = {"pre", "code", "tt", "samp", "kbd"}
LISTS = {"ul", "ol", "dl", "list"}
ROWS = {"tr", "row"}
CELLS = {"td", "th", "cell"}
BLOCKS = {"p", "div", "ab", "lg", "l", "blockquote", "section", "article", "table", "body", "text", "center", "figure", "figcaption", "caption", "label"}
DROPPED = {"note", "script", "style", "noscript", "teiheader", "facsimile", "figure", "graphic", "sic", "abbr", "orig"}
# Attributes by which an element is the footnote of a wiki, and what an element holds that is then kept.
FOOTNOTES = ("name", "group")
CAPTIONS = "figcaption"
BREAKS = {"br", "lb", "hr"}
SPACES = {"pb", "cb", "milestone", "space", "gap"}

_ATTRIBUTE = r"""\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+)"""
TAG = re.compile(rf"<(?P<close>/?)\s*(?P<name>[A-Za-z][\w.-]*(?::[\w.-]+)?)(?P<attributes>(?:{_ATTRIBUTE})*)\s*(?P<empty>/?)>")
COMMENT = re.compile(r"<!--.*?(?:-->|$)|-->|<!\[CDATA\[|\]\]>|<\?\w[^>]*\??>|<!DOCTYPE[^>]*>", re.S | re.I)
BROKEN_TAG = re.compile(
    rf"<[A-Za-z][\w:.-]*\s+[\w:.-]+\s*=|\b[\w:.-]+=\"[^\"\n<>]*\"\s*/?>|</[A-Za-z][\w:.-]*|<(?:{'|'.join(NAMES)})\s*$|(?<![<\w/-])/(?:{'|'.join(NAMES)})>", re.I | re.M
)
ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,30});|&#[xX]?[0-9a-fA-F]+|&(?:lt|gt|amp|nbsp|quot|apos)\b")
_DOLLARS = r"\$(?=\S)(?:[^$\n]*[^$\s])?\$(?!\d)"
LATEX = re.compile(rf"\\[A-Za-z]+\*?|\\[^\w\s]|\\\s|\\$|(?<!\$){_DOLLARS}|\$\$[^$]+\$\$")
FENCE = re.compile(r"^[ \t]*(?:```|~~~).*$", re.M)
EMPHASIS = re.compile(
    r"(?<![*\w])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![*\w])|(?<!\*)\*\*(?=[^\s*])(?:[^*\n]*[^\s*])?\*\*(?!\*)|(?<!\*)\*\*\*(?=[^\s*])(?:[^*\n]*[^\s*])?\*\*\*(?!\*)"
    r"|(?<!\*)(?:\*\*\*[^\s*]+\*\*|\*\*[^\s*]+\*\*\*)(?!\*)"
    r"|(?<!\w)(?:__(?=\S)[^_\n]+__|_(?=\S)[^_\n]*[^_\s]_)(?!\w)|~~(?=\S)[^~\n]+~~|`[^`\n]+`|'{2,}"
)
HEADING = re.compile(r"^[ \t]*(?:(#{1,6})[ \t]+(\S.*?)[ \t]*#*|(={1,6})[ \t]*([^=\n]+?)[ \t]*=+)[ \t]*$", re.M)
LIST = re.compile(r"^[ \t]*(?:[-+][ \t]+|\*\*?[ \t]+|#{1,4}[ \t]+|[#:;]{2,}[ \t]+)(?=\S)", re.M)
QUOTE = re.compile(r"^[ \t]*>[ \t]+(?=\S)", re.M)
TABLE = re.compile(r"^[ \t]*\|.*\|[ \t]*$|\|[ \t]*:?-{3,}:?[ \t]*\||^[ \t]*\{\||^[ \t]*\|[-}]", re.M)
LINK = re.compile(r"!?\[([^\]\n]*)\]\(([^)\s]*)\)|\[\[([^\[\]|\n]*)\|([^\[\]\n]*)\]\]|^\[[^\]\n^]+\]:[ \t]+\S+|\[(?:https?|mailto):[^\]\s]+(?: ([^\]]*))?\]", re.M)
FOOTNOTE = re.compile(r"\[\^[^\]\s]+\]:?")
TEMPLATE = re.compile(r"\{\{[^{}\n]*[|=:][^{}]*\}\}|\{\{[A-Za-z]+(?: [a-z]+)+\}\}")
RULE = re.compile(r"^[ \t]*(?:-{3,}|_{3,}|={3,})[ \t]*$", re.M)

#: Texts without any of these hold no markup; they need no scanner.
SUSPECT = r"[<>&\\$`#{|'=_\[*~\-+]|\]\]|[:;][#:;]"


_KNOWN = frozenset(NAMES)
_CLOSER = re.compile(r"</([A-Za-z][\w.:-]*)>")


def tags_of(text: str) -> Iterator[re.Match]:
    """Tags, not words in angle brackets: they close, have attributes, are empty, have a known name, or are closed somewhere."""
    closed = None
    for m in TAG.finditer(text):
        name = m["name"]
        if not (m["close"] or m["attributes"] or m["empty"] or name.lower().rpartition(":")[2] in _KNOWN):
            if closed is None:
                closed = set(_CLOSER.findall(text))
            if name not in closed:
                continue
        yield m


def kinds_of(text: str) -> list[str]:
    """Which markup a text holds: html, entity, latex, markdown, wiki; sorted."""
    found = set()
    if COMMENT.search(text) or next(tags_of(text), None) or BROKEN_TAG.search(text):
        found.add("html")
    if ENTITY.search(text):
        found.add("entity")
    if LATEX.search(text):
        found.add("latex")
    emphasis = EMPHASIS.search(text)
    if emphasis and emphasis.group()[0] == "'":
        found.add("wiki")
    elif emphasis:
        found.add("markdown")
    heading = HEADING.search(text)
    if heading:
        found.add("markdown" if heading[1] else "wiki")
    link = LINK.search(text)
    if link:
        found.add("wiki" if link[4] is not None else "markdown")
    if FENCE.search(text) or LIST.search(text) or QUOTE.search(text) or TABLE.search(text) or FOOTNOTE.search(text) or RULE.search(text):
        found.add("markdown")
    if TEMPLATE.search(text):
        found.add("wiki")
    return sorted(found)


# A block begins with MARK, its kind, its level and MARK; the characters are taken out of texts first.
MARK, END = "\x01", "\x02"


def _block(kind: str, level: int = 0) -> str:
    return f"\n{MARK}{kind} {level}{MARK}"


def _argument(text: str, at: int) -> tuple[str, int]:
    """The balanced {...} at a place: its inside, and the place behind it; without one, nothing."""
    if at >= len(text) or text[at] != "{":
        return "", at
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


# LaTeX commands by what becomes of them.
LATEX_HEADINGS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
LATEX_DROPPED = {
    "footnote", "footnotemark", "footnotetext", "label", "ref", "pageref", "cite", "citep", "citet", "index", "vspace", "hspace", "pagestyle", "thispagestyle", "usepackage", "documentclass", "marginpar", "includegraphics", "input", "bibliography",
    "setlength", "setcounter", "begin", "end",
}
LATEX_SWITCHES = set(
    "bfseries itshape scshape ttfamily sffamily rmfamily mdseries upshape slshape normalfont em bf it sc tt sl tiny scriptsize footnotesize small normalsize large Large LARGE huge Huge centering raggedright "
    "raggedleft noindent indent par newline linebreak newpage clearpage pagebreak bigskip medskip smallskip quad qquad hfill vfill maketitle tableofcontents hline left right displaystyle sic".split()
)
LATEX_SIGNS = {"S": "§", "P": "¶", "dag": "†", "ddag": "‡", "ldots": "…", "dots": "…", "textbackslash": "", "ss": "ß", "ae": "æ", "oe": "œ", "AE": "Æ", "OE": "Œ", "o": "ø", "copyright": "©", "pounds": "£", "times": "×", "leq": "≤", "geq": "≥"}
#: Arguments between which a sign stands, and those that only say how the last one is set.
LATEX_JOINED = {"frac": "/", "tfrac": "/", "dfrac": "/"}
LATEX_LAST = {"href", "textcolor", "colorbox", "raisebox", "parbox", "multicolumn", "foreignlanguage"}
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?|\\(.?)", re.S)
_OPTION = re.compile(r"\[[^\]\n]*\](?=\{)")


def _sign(name: str) -> str | None:
    """The sign that a command without arguments stands for: a fixed one, or a Greek letter by its name."""
    if name in LATEX_SIGNS:
        return LATEX_SIGNS[name]
    name = name.removeprefix("var")
    try:
        return unicodedata.lookup(f"GREEK {'SMALL' if name.islower() else 'CAPITAL'} LETTER {name.upper().replace('LAMBDA', 'LAMDA')}") if name.lower() == name or name.istitle() else None
    except KeyError:
        return None


def _latex(text: str) -> str:
    """LaTeX to text; formulas become blocks of their own."""

    def formula(m: re.Match) -> str:
        return _block("formula") + next(g for g in (*m.groups(), "") if g is not None).strip().replace("\\", END) + _block("text")

    text = re.sub(r"\\\[(.*?)\\\]|\$\$(.+?)\$\$", formula, text, flags=re.S)
    text = re.sub(r"\\\((.*?)\\\)|\$(?=\S)([^$\n]*[^$\s])\$(?!\d)", formula, text, flags=re.S)
    if "\\" in text:
        text = re.sub(r"(?<=\S)~(?=\S)", " ", text)
    out, at = [], 0
    while True:
        to = text.find("\\", at)
        if to < 0:
            out.append(text[at:])
            return "".join(out)
        out.append(text[at:to])
        m = _COMMAND.match(text, to)
        at, name = m.end(), m[1]
        if name is None:
            out.append("\n" if m[2] == "\\" else m[2] if m[2] in "&%$#_{}" else " ")
            continue
        if name == "item":
            out.append(_block("list", 1))
            continue
        arguments = []
        while len(arguments) < 9:
            if option := _OPTION.match(text, at):
                at = option.end()
            if not text.startswith("{", at):
                break
            inside, at = _argument(text, at)
            arguments.append(inside)
        if name in ("begin", "end"):
            out.append("\n")
        elif name in LATEX_HEADINGS and arguments:
            out.append(_block("heading", LATEX_HEADINGS[name]) + _latex(arguments[0]) + _block("text"))
        elif name in LATEX_DROPPED:
            continue
        elif arguments:
            if name in LATEX_LAST:
                arguments = arguments[-1:]
            sign = _sign(name)
            out.append((sign or "") + LATEX_JOINED.get(name, " ").join(map(_latex, arguments)))
        elif name not in LATEX_SWITCHES:
            sign = _sign(name)
            out.append(name if sign is None else sign)  # a command that is not known is text, as far as one can tell


_REFERENCE_MARK = re.compile(r"\s*\d+\s*</sup>", re.I)
_CHOICE_END = re.compile(r"</(?:\w+:)?choice\s*>", re.I)


@functools.cache
def _ender(name: str) -> re.Pattern:
    return re.compile(rf"</(?:\w+:)?{re.escape(name)}\s*>", re.I)


def _tags(text: str) -> str:
    """HTML and TEI to text."""
    out: list[str] = []
    dropped: list[str] = []  # open elements whose content is left out
    choices = lists = 0
    cells = 0  # of the row
    at = 0
    gone: set[str] = set()  # names that no tag closes any more

    def closed_later(name: str, pattern: re.Pattern) -> re.Match | None:
        """Whether a tag closes the name from here on; asked once more only where it did."""
        if name in gone:
            return None
        m = pattern.search(text, at)
        if not m:
            gone.add(name)
        return m

    for m in tags_of(text):
        if not dropped:
            out.append(text[at : m.start()])
        at = m.end()
        name = m["name"].lower().rpartition(":")[2]
        close, empty = bool(m["close"]), bool(m["empty"])
        if dropped:
            if close and name == dropped[-1]:
                dropped.pop()
            elif not close and not empty and name == dropped[-1]:
                dropped.append(name)
            continue
        choices += (name == "choice") * (-1 if close else 1)
        drops = name in DROPPED and (name not in ("sic", "abbr", "orig") or (choices > 0 and closed_later("choice", _CHOICE_END)))
        if name == "ref":
            drops = any(re.search(rf"\b{a}\s*=", m["attributes"]) for a in FOOTNOTES)
        if name == "sup" and not close and _REFERENCE_MARK.match(text, at):
            drops = True
        if name == "figure" and not close:
            end = closed_later(name, _ender(name))
            drops = bool(end) and text.find(f"<{CAPTIONS}", at, end.start()) < 0
        if drops and not (close and name == "figure"):
            if not close and not empty and closed_later(name, _ender(name)):
                dropped.append(name)
        elif name in HEADINGS:
            out.append(_block("text") if close else _block("heading", HEADINGS[name]))
        elif name in ITEMS:
            out.append(_block("text") if close else _block("list", max(1, lists)))
        elif name in LISTS:
            lists = max(0, lists + (-1 if close else not empty))
            out.append(_block("text"))
        elif name in CODE:
            out.append(_block("text") if close else _block("code"))
        elif name in ROWS:
            cells = 0
            out.append(_block("text") if close else _block("table"))
        elif name in CELLS:
            if not close:
                out.append("\t" if cells else "")
                cells += 1
        elif name in BREAKS or name in BLOCKS:
            out.append("\n")
        elif name in SPACES:
            out.append(" ")
    if not dropped:
        out.append(text[at:])
    left = "".join(out)
    left = re.sub(r"<[A-Za-z][\w:.-]*\s+[\w:.-]+\s*=[^<>\n]*>?|(?:\b[\w:.-]+=\"[^\"\n<>]*\"\s*)+/?>|</[A-Za-z][\w:.-]*\s*>?", "", left)
    return re.sub(rf"<(?:{'|'.join(NAMES)})\s*$|(?<![<\w/-])/(?:{'|'.join(NAMES)})>", "", left, flags=re.I | re.M)


_NUMBERED = re.compile(r"^([ \t]*)(\d{1,3})([.)])[ \t]+(?=\S)(.*)$", re.M)


def _ordered(text: str) -> str:
    """Lines that count up from 1 or so, two at least one after another, are a list; their numbers stay."""
    found = list(_NUMBERED.finditer(text))
    runs: list[list[re.Match]] = []
    for m in found:
        last = runs[-1][-1] if runs else None
        if last and text[last.end() : m.start()] == "\n" and int(m[2]) == int(last[2]) + 1 and m[3] == last[3]:
            runs[-1].append(m)
        else:
            runs.append([m])
    out, at = [], 0
    for run in runs:
        if len(run) < 2:
            continue
        for m in run:
            out += [text[at : m.start()], _block("list", len(m[1].expandtabs(4)) // 2 + 1), f"{m[2]}{m[3]} {m[4]}", _block("text")]
            at = m.end()
    out.append(text[at:])
    return "".join(out)


def _lines(text: str) -> str:
    """Markdown and wiki to text, line by line where the line is of a kind."""
    text = re.sub(r"^\[\^[^\]\s]+\]:.*$", "", text, flags=re.M)
    text = TEMPLATE.sub("", text)
    text = LINK.sub(lambda m: m[1] if m[1] is not None else m[4] if m[4] is not None else m[5] or "", text)
    text = FOOTNOTE.sub("", text)
    text = HEADING.sub(lambda m: _block("heading", len(m[1] or m[3])) + (m[2] or m[4]) + _block("text"), text)
    text = RULE.sub("", text)

    def row(m: re.Match) -> str:
        cells = [c.strip() for c in m.group().strip().strip("|").split("|")]
        return "" if all(re.fullmatch(r":?-*:?", c) for c in cells) else _block("table") + "\t".join(cells) + _block("text")

    text = re.sub(r"^[ \t]*\|.*\|[ \t]*$", row, text, flags=re.M)
    text = re.sub(r"^[ \t]*(?:\{\|.*|\|[-}].*)$", "", text, flags=re.M)
    text = _ordered(text)
    text = re.sub(rf"({LIST.pattern})(.*)$", lambda m: _block("list", _depth(m[1])) + m[2] + _block("text"), text, flags=re.M)
    text = QUOTE.sub("", text)
    for _ in range(2):  # emphasis within emphasis
        text = EMPHASIS.sub(lambda m: m.group().strip("*_~`'"), text)
    return text


def _depth(mark: str) -> int:
    """The depth of an item: by the signs of a wiki, or by its indentation."""
    signs = mark.strip()
    return len(signs) if len(signs) > 1 else len(mark[: len(mark) - len(mark.lstrip())].expandtabs(4)) // 2 + 1


def blocks_of(text: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of the blocks of a text, in order: heading, list, code, formula, table, text; items have their depth as level."""
    text = text.replace(MARK, "").replace(END, "").replace("\r\n", "\n")
    kept: list[str] = []

    def fenced(m: re.Match) -> str:
        kept.append(m[2].strip("\n"))
        return _block("code") + f"{END}{len(kept) - 1}{END}" + _block("text")

    text = re.sub(r"^[ \t]*(```|~~~)[^\n]*\n(.*?)\n?^[ \t]*\1[ \t]*$", fenced, text, flags=re.S | re.M)
    text = FENCE.sub(lambda m: re.sub(r"[`~]{3,}", "", m.group()), text)
    for _ in range(2):  # entities that were escaped once more
        text = ENTITY.sub(lambda m: html.unescape(m.group() if m.group().endswith(";") else m.group() + ";").replace("\xa0", " "), text)
    text = COMMENT.sub("", text)
    text = _lines(_latex(_tags(text)))
    text = re.sub(f"{END}(\\d+){END}", lambda m: kept[int(m[1])], text).replace(END, "\\")
    out: list[tuple[str, int, str]] = []
    for k, part in enumerate(re.split(f"{MARK}(\\w+ \\d+){MARK}", f"{MARK}text 0{MARK}{text}")[1:]):
        if not k % 2:
            kind, level = part.split()
            continue
        if kind == "table":
            part = re.sub(r"[ \n]*\t[ \n]*", "\t", re.sub(r"\n+", " ", part.strip("\n ")))
        body = part.strip("\n") if kind == "code" else "\n".join(" ".join(line.split(" ")).strip() for line in part.split("\n"))
        body = re.sub(r"\n{2,}", "\n", re.sub(r" {2,}", " ", body)).strip()
        if body:
            if kind == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", 0, f"{out[-1][2]}\n{body}")
            else:
                out.append((kind, int(level), body))
    return out


def clean(text: str) -> str:
    """The reading text: blocks joined by line feeds."""
    return "\n".join(body for _, _, body in blocks_of(text))


BLOCK = "array<struct<kind:string,level:int,text:string>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds = [kinds_of(t) for t in b.column("text").to_pylist()]
        keep = pa.array([bool(k) for k in kinds])
        out = pa.RecordBatch.from_arrays([b.column("id"), pa.array(kinds, pa.list_(pa.string()))], ["id", "kinds"])
        yield out.filter(keep)


def markup_rows(df: DataFrame, id_col: str = "passage_id", text_col: str = "text") -> DataFrame:
    """(id, kinds) of the rows whose text holds markup; null and empty texts hold none, repeated rows are found each."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & F.col("text").rlike(SUSPECT))
    return rows.mapInArrow(_found, "id long, kinds array<string>").withColumnRenamed("id", id_col)


def blocks(text: Column) -> Column:
    """The blocks of a text; a text without any suspect character is one block; null stays null."""
    whole = F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("level"), text.alias("text")))

    @F.arrow_udf(BLOCK)
    def parse(texts: pa.Array) -> pa.Array:
        names = ("kind", "level", "text")
        rows = [None if t is None else [dict(zip(names, b)) for b in blocks_of(t)] if kinds_of(t) else [dict(zip(names, ("text", 0, t)))] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())])))

    parsed = parse(F.when(text.rlike(SUSPECT), text))
    return F.when(text.isNotNull(), F.coalesce(parsed, F.when(text == "", F.array().cast(BLOCK)).otherwise(whole)))


def cleaned(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with `blocks` and `clean_text`, their texts joined by line feeds; columns of these names are replaced."""
    return df.withColumn("blocks", blocks(F.col(text_col))).withColumn("clean_text", F.array_join(F.col("blocks.text"), "\n"))
