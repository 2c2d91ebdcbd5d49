"""One consistent form for text that looks the same (problem 4).

A transducer over grapheme clusters is compiled once from the Unicode data of
the interpreter and a short list of look-alikes, checked for conflicts, and
applied from left to right: at each place the longest cluster (a letter with
all its marks, also where invisible characters stand between them) is replaced
by its one form.  Look-alike letters of Latin, Greek and Cyrillic take the
script of the word they stand in, which the letters that exist in one script
only decide; words without such letters take the script of their text.

Most texts need one search for odd characters and no more.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import written

# Letters that look the same, as Latin, Greek, Cyrillic ("-" where a script has none), and rarer ones of
# Cyrillic, Armenian and Cherokee that may stand for them.
LOOKALIKE_LETTERS = """
A Α А Ꭺ
B Β В Ᏼ
C Ϲ С Ꮯ
D - - Ꭰ
E Ε Е Ꭼ
G - - ԌᏀ
H Η Н Ꮋ
I Ι І Ӏ
J - Ј Ꭻ
K Κ К Ꮶ
L - - Ꮮ
M Μ М Ꮇ
N Ν -
O Ο О Օ
P Ρ Р Ꮲ
Q - - Ԛ
R - - Ꭱ
S - Ѕ ՏᏚ
T Τ Т Ꭲ
U - - Ս
V - - ѴᏙ
W - - ԜᎳ
X Χ Х
Y Υ - Ү
Z Ζ - Ꮓ
a - а
c ϲ с
d - - ԁ
e - е
h - һ հ
i - і
j ϳ ј
n - - ո
o ο о օ
p ρ р
q - - ԛ
s - ѕ
u - - ս
v ν - ѵ
w - - ԝ
x - х
y - у
- κ к
"""
# Signs that look the same; each line's first sign stands for the others.
LOOKALIKE_SIGNS = [
    "’ʼ᾽᾿",
    "-‐‑",
    "·∙⋅",
    "⟨〈〈",
    "⟩〉〉",
]
# Visible format characters (they are drawn), which stay.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"
# Greek accents and breathings that no Latin or Cyrillic letter of these corpora bears.
GREEK_MARKS = "̓̔͂ͅ"
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC")


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in sorted(points):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def _python_class(points: list[int]) -> str:
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(points))


def _own_form(ch: str) -> str:
    """What one code point is written as, without regard to marks around it."""
    p, cat = ord(ch), unicodedata.category(ch)
    if ch == "\n":
        return ch
    if ch in "\x85  ":
        return "\n"
    if cat == "Zs" or ch == "\t":
        return " "
    if cat == "Cc" or ch == "͏" or 0xFE00 <= p <= 0xFE0F or 0xE0100 <= p <= 0xE01EF:
        return ""
    if cat == "Cf":
        return ch if ch in VISIBLE_FORMAT else ""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>") or ch == "µ" or 0xFB00 <= p <= 0xFB06:
        ch = "".join(_own_form(chr(int(x, 16))) for x in rest.split())
    return unicodedata.normalize("NFC", ch)


class Memo(dict):
    """What a function of one string gave, up to a number of strings; then it starts anew."""

    def __init__(self, f: Callable[[str], str | None], limit: int = 200_000) -> None:
        self.f, self.limit = f, limit

    def __missing__(self, key: str) -> str | None:
        if len(self) >= self.limit:
            self.clear()
        self[key] = out = self.f(key)
        return out


class Transducer:
    """The compiled mapping; `apply` is its only entry."""

    def __init__(self, letters: str = LOOKALIKE_LETTERS, signs: list[str] = LOOKALIKE_SIGNS) -> None:
        self.own: dict[str, str] = {}
        marks, ignored = [], []
        for p in range(0x110000):
            ch = chr(p)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Co", "Cs"):
                continue
            form = _own_form(ch)
            if form != ch:
                self.own[ch] = form
            if cat == "Mn":
                marks.append(p)
            if not form:
                ignored.append(p)
        for line in signs:
            for ch in line[1:]:
                self.own[ch] = line[0]
        self.to: dict[str, dict[int, str]] = {s: {} for s in SCRIPTS}
        self.ambiguous: set[str] = set()
        others: set[str] = set()
        self.stands_for: dict[str, str] = {}  # scripts of rare letters that stand for a letter of one script only
        for line in filter(None, letters.split("\n")):
            *row, rare = (line.split() + [""])[:4] if len(line.split()) < 4 else line.split()
            alike = [c for c in row if c != "-"]
            if len(alike) > 1:
                self.ambiguous.update(alike, rare)
            else:
                self.stands_for.update(dict.fromkeys(rare, next(s for s, c in zip(SCRIPTS, row) if c != "-")))
            others.update(rare)
            for script, target in zip(SCRIPTS, row):
                target = alike[0] if target == "-" else target  # a letter that a script has not keeps one form in it
                for c in [*alike, *rare]:
                    if self.to[script].setdefault(ord(c), target) != target:
                        raise ValueError(f"{c!r} has two forms in {script}")
        self._check()
        self._memos()
        self.others = re.compile("[" + "".join(sorted(others)) + "]") if others else re.compile(r"(?!)")
        m, i = _python_class([p for p in marks if chr(p) not in self.own or self.own[chr(p)]]), _python_class(ignored)
        self.clusters = re.compile(f"(?:[^{m}{i}][{i}]*)?[{m}][{m}{i}]*|[{_python_class([ord(c) for c in self.own])}]")
        self.letters = re.compile(r"(?:[^\W\d_]|[" + m + "])+")
        self.odd = re.compile(f"[{m}{i}{_python_class([ord(c) for c in self.own])}]")
        self.latin, self.greek, self.cyrillic = re.compile("[A-Za-z\u00c0-\u024f]"), re.compile("[\u0370-\u03ff\u1f00-\u1fff]"), re.compile("[\u0400-\u052f]")
        self.decides = re.compile("[" + _python_class([p for p in (*range(0x41, 0x250), *range(0x370, 0x400), *range(0x1F00, 0x2000)) if self._decides(chr(p))]) + "]")

    def _check(self) -> None:
        """Each source has one form, each form is final, and the scripts' letters don't run in circles."""
        for ch, form in self.own.items():
            again = "".join(self.own.get(c, c) for c in form)
            if again != form:
                raise ValueError(f"the form {form!r} of {ch!r} is not final")
        for script, table in self.to.items():
            for c, target in table.items():
                if table.get(ord(target), target) != target:
                    raise ValueError(f"{chr(c)!r} and {target!r} disagree in {script}")
        if both := self.ambiguous & set(self.own):
            raise ValueError(f"{sorted(both)} are both rewritten and look-alikes")

    def _memos(self) -> None:
        self.cluster_of, self.word_of = Memo(self._cluster), Memo(self._word)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cluster_of", "word_of")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._memos()

    def _cluster(self, raw: str) -> str:
        return unicodedata.normalize("NFC", "".join(self.own.get(c, c) for c in raw))

    def _decides(self, ch: str) -> bool:
        return any(self.script_of(c) for c in unicodedata.normalize("NFD", ch))

    def script_of(self, ch: str) -> str | None:
        """The one script a letter or mark exists in, if there is one."""
        if ch in GREEK_MARKS:
            return "GREEK"
        if ch in self.ambiguous or not ch.isalpha():
            return None
        if ch in self.stands_for:
            return self.stands_for[ch]
        name = unicodedata.name(ch, "")
        return next((s for s in SCRIPTS if name.startswith(s)), None)

    def _majority(self, text: str) -> str | None:
        n = dict.fromkeys(SCRIPTS, 0)
        for ch in unicodedata.normalize("NFD", text):
            if s := self.script_of(ch):
                n[s] += 1
        best = max(SCRIPTS, key=lambda s: n[s])
        return best if n[best] else None

    def _word(self, word: str) -> str | None:
        """A run of letters in the script it decides on; null if it decides on none."""
        raw = unicodedata.normalize("NFD", word)
        if not self.ambiguous.intersection(raw) and not self.others.search(raw):
            return word
        if any(ch.isalpha() and ch not in self.ambiguous and not self.script_of(ch) for ch in raw):
            return word  # of a script that has no part in this, such as Armenian
        script = self._majority(raw)
        return script and unicodedata.normalize("NFC", raw.translate(self.to[script]))

    def _settled(self, text: str) -> bool:
        """The letters are of one script, and one of them exists in that script only."""
        latin, greek = self.latin.search(text), self.greek.search(text)
        if self.cyrillic.search(text) or (latin and greek) or self.others.search(text) or (latin and any(m in text for m in GREEK_MARKS)):
            return False
        return not (latin or greek) or self.decides.search(text) is not None

    def apply(self, text: str | None) -> str | None:
        if text is None:
            return None
        if self.odd.search(text):
            text = self.clusters.sub(lambda m: self.cluster_of[m.group()], text)
        if self._settled(text):
            return text
        whole: list[str] = []

        def word(m: re.Match) -> str:
            form = self.word_of[m.group()]
            if form is None:
                if not whole:
                    whole.append(self._majority(text) or SCRIPTS[0])
                raw = unicodedata.normalize("NFD", m.group())
                form = unicodedata.normalize("NFC", raw.translate(self.to[whole[0]]))
            return form

        return self.letters.sub(word, text)


def unified(text: Column) -> Column:
    """`text` in its one form; null stays null, an empty text stays empty."""
    compiled = Transducer()

    @F.arrow_udf(StringType())
    def form(texts: pa.Array) -> pa.Array:
        return pa.array(map(compiled.apply, texts.to_pylist()), pa.string())

    return form(text)


def unify(df: DataFrame, text: str = "text", out: str = "unified") -> DataFrame:
    """`df` with the column `out`: `text` in its one form.

    Repeated rows stay repeated, further columns pass through; a column named
    `out` is replaced.
    """
    return df.withColumn(out, unified(F.col(text)))


def _forms(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, form, form2, spelling) of the rows that have a text: hashes of its form, two, and of the text."""
    rows = (
        df.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
        .filter(F.col("id").isNotNull() & F.col("t").isNotNull() & (F.col("t") != ""))
        .withColumn("u", unified(F.col("t")))
        .select("id", F.xxhash64("u").alias("form"), F.xxhash64(F.lit(1), "u").alias("form2"), F.xxhash64("t").alias("spelling"))
    )
    return written(rows, "text-forms")


def classes(df: DataFrame, id_col: str = "passage_id", text: str = "text") -> DataFrame:
    """One row per text: (id, class_id, spelling_id, copies, spellings).

    `class_id` and `spelling_id` are the least ids of the rows of that form and
    of that very text, `copies` counts the latter and `spellings` the different
    texts of the form.  Its size is that of the table, whatever is repeated.
    """
    rows = _forms(df, id_col, text)
    texts = rows.groupBy("form", "form2", "spelling").agg(F.min("id").alias("spelling_id"), F.count("*").alias("copies"))
    whole = texts.groupBy("form", "form2").agg(F.min("spelling_id").alias("class_id"), F.count("*").alias("spellings"))
    return (
        rows.join(texts, ["form", "form2", "spelling"]).join(whole, ["form", "form2"])
        .select(F.col("id").alias(id_col), "class_id", "spelling_id", "copies", "spellings")
    )


def look_the_same(df: DataFrame, id_col: str = "passage_id", text: str = "text") -> DataFrame:
    """Pairs (id_lo, id_hi) of rows whose texts differ but have one form.

    Rows are first grouped into spellings (one form, one sequence of code
    points), so that a group of copies, however large, counts once; only forms
    with several spellings go on, and pairs are made between spellings, never
    within one.  Null and empty texts are no case.  Equal ids pair with no
    one.
    """
    rows = _forms(df, id_col, text)
    several = (
        rows.groupBy("form", "form2")
        .agg(F.min("spelling").alias("s0"), F.max("spelling").alias("s1"))
        .filter("s0 <> s1")
        .select("form", "form2")
    )
    rows = rows.join(several, ["form", "form2"], "left_semi")
    spellings = rows.select("form", "form2", "spelling").distinct()
    a, b = spellings.withColumnRenamed("spelling", "sa"), spellings.withColumnRenamed("spelling", "sb")
    pairs = a.join(b, ["form", "form2"]).filter("sa < sb")
    left = rows.withColumnsRenamed({"id": "ia", "spelling": "sa"})
    right = rows.withColumnsRenamed({"id": "ib", "spelling": "sb"})
    out = pairs.join(left, ["form", "form2", "sa"]).join(right, ["form", "form2", "sb"])
    return out.filter("ia <> ib").select(F.least("ia", "ib").alias("id_lo"), F.greatest("ia", "ib").alias("id_hi")).distinct()
