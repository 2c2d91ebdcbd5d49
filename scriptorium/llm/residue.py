"""Template residue, filler, error pages and script notices in documents (problem 8).

Lines that may be such text are picked out, numbers, addresses and dates in
them are masked, and lines of one masked form are one message, however many
documents and sources repeat it.  A message's documents and sources are counted
over the whole corpus, in steps, so that a message that a third of all
documents have is no large group in one task.  Each distinct message is then
classified once, by rules of two kinds; the documents follow by a join.

RULES need the form of the thing itself: a placeholder in its delimiters, a
message as a program utters it, a demand to switch scripts on.  Prose that
names errors, scripts or filler has words like these, but not those forms, so
these rules hold for a message however rare it is.  WIDESPREAD has mere words.
They count only in a short line that recurs as it is, masked, in several
documents and sources: so do messages of programs, and sentences do not.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from re import _constants, _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# What is masked, in this order.
MASKS = [
    (r"\b(?:https?|ftp)://\S+|\bwww\.\S+", "URL"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "MAIL"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "ADDRESS"),
    (r"\b\d{4}-\d\d?-\d\d?\b|\b\d\d?[./]\d\d?[./]\d{2,4}\b", "DATE"),
    (r"\b[0-9a-f]*\d[0-9a-f]*\b|\d+", "0"),
]

# Rules by class; a line of which a pattern matches a part is of that class.
RULES = {
    "placeholder": [
        r"\{\{[^{}]*\}\}",
        r"\$\{[^{}\s]+\}",
        r"<%=?[^%]*%>",
        r"%\(\w+\)[a-z]",
        r"%%[A-Za-z]\w*%%",
        r"\{%-?\s*\w[^{}%]*%\}",
        r"<\?(?:php|=)",
        r"(?<!\w)__[A-Z][A-Z_]*__(?!\w)",
        r"@@\w+@@",
        r"#{2,}[A-Z]\w*#{2,}",
        r"<<\s*[^\W\d]\w*\s*>>",
        r"\{0\}.*\{0\}",  # numbers are masked
        r"\[(?:[A-Z]{2,} )+[A-Z]{2,}\]",
        r"\[(?:INSERT|YOUR|ENTER|ADD)\b[^\]]*\]",
        r"\[_{2,}\]",
        r"<[a-z ]+ (?:goes here|name)>",
        r"\[[^\]]*\b(?:to be added|to be supplied|goes here)\]",
        r"\bDD/MM/YYYY\b|\bTT\.MM\.JJJJ\b|\bYYYY-MM-DD\b",
        r"\bX{4,}\b",
        r"[:,]\s*(?:TBD|TODO|FIXME)\s*(?:[.,;:!)\]]|$)",
        r"^\W*(?:TBD|TODO|FIXME)\b(?:\s*:.*|\W*)$",
        r"^\s*[\w ]{1,30}\s?:\s*(?:undefined(?:\.0)?|null|NaN|None|\[object Object\])\s*$",
        r"\[object Object\]",
        r"\bTitel einfügen\b",
        r"(?i)\[(?:insert|enter|add|your) (?:[^\[\]]* )?(?:here|name|title|text|author|date|work|translation|description|e-?mail)\]",
        r"(?i)\[(?:hier )?(?:titel|text|name|autor|datum|übersetzung) (?:hier )?(?:einfügen|eingeben|ergänzen)\]|\[(?:insérer|saisir) [^\[\]]+ ici\]",
        r"(?i)\{(?:title|author|work|name|date|year|editor|translator|page|source|titel|autor|verfasser|titre|auteur)\}",
        r"\{[a-z]+(?:_[a-z]+)+\}",
    ],
    "filler": [
        r"(?i)^\W*lorem ipsum\b(?!\W+(?:is|was|ist|war|est|è)\b)|\blorem ipsum dolor\b|\bdolor sit amet\b|\bconsectetur adipisc",
        r"(?i)^\s*your text here\b|\byour text here\. your text here\b",
        r"(?i)\bthis is (?:placeholder|dummy|sample|filler) (?:copy|text)\b",
        r"(?i)\bsample sentence for layout\b",
        r"(?i)\bdies ist ein (?:blindtext|platzhalter|fülltext)",
        r"(?i)\bhier steht später der richtige text\b",
        r"(?i)\btexte provisoire, à remplacer\b|\bfin du texte provisoire\b",
        r"(?i)\b(?:asdf|qwer|zxcv)\b.*\b(?:asdf|qwer|zxcv|jkl)\b",
        r"(?i)\btest test\b",
        r"^\s*(?:x{2,}\s+)+x{2,}\W*$",
    ],
    "error": [
        r"(?i)^\W*(?:http |error |status )?0\W* (?:not found|forbidden|bad (?:request|gateway)|unauthorized|internal server error|(?:service|gateway) \w+|service temporarily unavailable)\W*$",
        r"(?i)^\W*error 0: ",
        r"(?i)^\W*(?:https?[ /])?(?:error|status|fehler|erreur|errore)(?: code)? 0\W*$",
        r"(?i)^\W*(?:0\W+)?(?:bad gateway|bad request|gateway time-?out|request time-?out|service (?:temporarily )?unavailable|service overloaded)(?: nginx| apache)?\W*$",
        r"(?i)^\W*(?:php )?(?:fatal |parse |syntax |server )error: \S",
        r"^\W*ERROR: \S",
        r"(?i)\bthe requested (?:\w+ )?(?:[\w.]+ )?(?:was|could) not (?:be )?found on this server\b",
        r"(?i)\bseite nicht gefunden\b|\bdie angeforderte \w+ (?:\w+ )?existiert nicht\b",
        r"(?i)\bpage introuvable\b|\bdemandée? n'existe pas ou a été\b",
        # What prose may say too counts only as a whole line.
        r"(?i)^\W*(?:(?:http |error |status )?(?:code )?0\W+)?(?:(?:the |this )?(?:requested )?(?:page|file|document|resource|url) (?:(?:was|is|could|can) ?)?not (?:be )?found|internal server error|access denied|forbidden)\W*$",
        r"(?i)^\W*(?:(?:http |fehler )?0\W+)?(?:(?:die |diese )?(?:angeforderte )?(?:seite|datei) (?:konnte|wurde) (?:leider )?nicht gefunden(?: werden)?|zugriff verweigert|interner serverfehler)\W*$",
        r"(?i)^\W*(?:(?:http |erreur )?0\W+)?(?:page non trouvée|accès (?:refusé|interdit)|erreur interne du serveur)\W*$",
        r"(?i)^\W*(?:(?:http |errore? )?0\W+)?(?:pagina non trovata|página no encontrada|accesso negato|acceso denegado)\W*$",
        r"(?i)\baccess denied\. you do not have permission\b",
        r"(?i)\boops! something went wrong\b",
        r"(?i)\bunable to connect to the .{0,40}(?:database|server)\b|\bthe operation timed out after\b",
        r"(?i)^\W*too many requests\b",
        r"(?i)\byour session has expired\b",
        r"(?i)\b(?:please )?try again later\.?\s*$",
        r"\b[A-Za-z][\w.]*(?:Exception|Error): \S",
        r"^\s+at [\w$.]+\([\w.]+(?::0)?\)\s*$",
        r"\bTraceback \(most recent call last\)",
        r"^\s*File \"[^\"]+\", line 0\b",
    ],
    "scripts": [
        r"(?i)<noscript\b",
        r"(?i)\b(?:please|you (?:need|have) to|must|first) enable (?:javascript|scripts|scripting|cookies)\b",
        r"(?i)^\W*enable (?:javascript|scripts|scripting|cookies)\b|\benable cookies and javascript\b",
        r"(?i)\bthis \w+ requires (?:javascript|scripts|scripting)\b",
        r"(?i)^\W*you (?:will )?need (?:javascript|scripts|scripting|cookies) (?:to|for) [^.!?]{1,60}\W*$",
        r"(?i)^\W*(?:please )?(?:turn|switch) on (?:javascript|scripts|scripting|cookies)\b|\b(?:turn|switch) (?:javascript|scripting) on\W*$",
        r"(?i)\bchecking your browser before\b",
        r"(?i)^\W*(?:javascript|scripting) (?:is|must be|needs to be|has to be) (?:currently )?(?:disabled|enabled|required|(?:turned|switched) o(?:n|ff)|not (?:enabled|available|supported))(?: (?:in|by) your browser| (?:to|for) [^.!?]{1,40})?\W*$",
        r"(?i)\bjavascript is (?:currently )?(?:disabled|(?:turned|switched) off|not (?:enabled|supported)) (?:in|by) your browser\b",
        r"(?i)^\W*javascript (?:ist (?:in ihrem browser )?(?:deaktiviert|ausgeschaltet|erforderlich)|muss (?:in ihrem browser )?aktiviert (?:sein|werden))\W*$|^\W*diese (?:seite|anwendung) (?:benötigt|erfordert) javascript\W*$",
        r"(?i)^\W*javascript est (?:requis|nécessaire)\b[^.]{0,40}\W*$|\bveuillez activer (?:javascript|les scripts)\b",
        r"(?i)^\W*javascript (?:è (?:disabilitato|disattivato|richiesto|necessario)|está (?:desactivado|deshabilitado))\b[^.]{0,40}\W*$",
        r"(?i)\b(?:aktivieren sie|schalten sie) (?:bitte )?(?:javascript|skripte)\b",
        r"(?i)\bjavascript est désactivé\b|\bactivez(?:-le| javascript)\b",
        r"(?i)\boccorre attivare javascript\b|\battivare? javascript per\b",
        r"(?i)\b(?:active|habilite) javascript\b",
    ],
}

# Words by class that count only in messages that recur.
WIDESPREAD = {
    "scripts": [r"(?i)\b(?:javascript|scripting|cookies|browser|browsers|navigateur)\b"],
    "error": [
        r"(?i)\b(?:not (?:be )?found|unavailable|not available|timed out|time-?out|failed|forbidden|denied|expired|exception|unexpected error|error code|fehler|erreur|errore)\b",
        r"(?i)\b(?:nicht (?:gefunden|verfügbar|erreichbar)|introuvable|indisponible|non trovata|no encontrada)\b|\b(?:error|errno) 0\b",
    ],
    "filler": [r"(?i)\b(?:placeholder|dummy (?:copy|text)|sample text|filler text|blindtext|platzhalter|fülltext|texte provisoire|coming soon|under construction)\b"],
    "placeholder": [r"\b(?:TODO|TBD|FIXME|undefined|NaN)\b"],
}
#: Documents and sources in which such a message recurs, and its words at most.
RECURRING_DOCUMENTS, RECURRING_SOURCES, MESSAGE_WORDS = 3, 2, 25

# Letters that a pattern takes for another letter whatever their case, and that lower() leaves or splits.
ALIKE = [("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")]


def folded(text: str) -> str:
    """Lower case, so that every literal that a rule matches stands in it as a literal of TRIGGERS."""
    for letter, instead in ALIKE:
        text = text.replace(letter, instead)
    return text.lower()


def needs(tree: Iterable, case: bool) -> list[frozenset[str]]:
    """Sets of literals of a parsed pattern, in lower case unless `case` counts: what it matches holds one of each set.  A 0 is no literal: it may be a masked number."""
    out, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is _constants.AT:
            continue
        if op is _constants.LITERAL and chr(arg) != "0":
            run += chr(arg) if case else chr(arg).lower()
            continue
        if run.strip():
            out.append(frozenset([run]))
        run = ""
        if op is _constants.SUBPATTERN:
            out += needs(arg[3], case)
        elif op is _constants.MAX_REPEAT and arg[0]:
            item = list(arg[2])
            out += needs(item * arg[0] if len(item) == 1 and item[0][0] is _constants.LITERAL else item, case)
        elif op is _constants.BRANCH:
            arms = [needs(arm, case) for arm in arg[1]]
            if all(arms):
                out.append(frozenset().union(*(max(arm, key=lambda s: min(map(len, s))) for arm in arms)))
    return out


#: Each rule, whether case counts in it, and the literals that it needs; they are derived, so that no line that a rule matches is passed over.
NEEDS = [(p, case, needs(_parser.parse(p), case)) for rules in (RULES, WIDESPREAD) for patterns in rules.values() for p in patterns for case in [not p.startswith("(?i)")]]
#: All literals of NEEDS in lower case: a line without any of them, and not made of a few words over and over, is in no class.
TRIGGERS = sorted({t.lower() for _, _, sets in NEEDS for s in sets for t in s})

#: A line of at least so many words of which at most a third are distinct is filler.
MONOTONE_WORDS = 6


def monotone(line: str) -> bool:
    """A few lower-case words over and over."""
    words = line.split()
    return len(words) >= MONOTONE_WORDS and len(set(words)) * 3 <= len(words)


# How many of MASKS stand for addresses, and what counts in these as a placeholder besides the rules.
ADDRESSES = 2
NUMBERED = r"\{0\}"


def mask(line: str) -> str:
    """The line with its masks; an address that holds a placeholder is masked around it."""
    masked = _masked(line, MASKS)
    if ("://" in line or "www." in line or "@" in line) and not PLACEHOLDER.search(masked):
        bare = _masked(line, MASKS[ADDRESSES:])
        if PLACEHOLDER.search(bare):
            ends = [0, *(x for m in UNFILLED.finditer(bare) for x in m.span()), len(bare)]
            parts = [bare[i:j] if k % 2 else _address_before(bare[i:j]) for k, (i, j) in enumerate(zip(ends, ends[1:]))]
            around = "".join(parts)
            return around if PLACEHOLDER.search(around) else bare
    return masked


def _address_before(part: str) -> str:
    """Masked addresses; a sign at the end stays, since a placeholder behind it may need a border."""
    masked = _masked(part, MASKS[:ADDRESSES])
    return masked + part[-1] if masked != part and masked[-1] != part[-1] and not re.match(r"\w", part[-1]) else masked


def _masked(line: str, masks: list[tuple[str, str]]) -> str:
    for pattern, instead in masks:
        line = re.sub(pattern, instead, line)
    return line


class Classifier:
    """The class of a masked message, or none; what counts only where it recurs needs the numbers of its documents and sources."""

    def __init__(self) -> None:
        self.rules, self.widespread = (
            [(kind, re.compile("|".join(f"(?:{p})" for p in _inline(patterns)))) for kind, patterns in rules.items()] for rules in (RULES, WIDESPREAD)
        )

    def __call__(self, message: str, documents: int = 1, sources: int = 1) -> str | None:
        for kind, pattern in self.rules:
            if pattern.search(message):
                return kind
        if monotone(message):
            return "filler"
        if documents >= RECURRING_DOCUMENTS and sources >= RECURRING_SOURCES and short(message):
            return next((kind for kind, pattern in self.widespread if pattern.search(message)), None)
        return None


def short(message: str) -> bool:
    return len(message.split()) <= MESSAGE_WORDS


def _inline(patterns: list[str]) -> list[str]:
    """Patterns whose leading (?i) holds for themselves only."""
    return [f"(?i:{p[4:]})" if p.startswith("(?i)") else p for p in patterns]


PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in _inline(RULES["placeholder"])))
UNFILLED = re.compile("|".join(f"(?:{p})" for p in [NUMBERED, *_inline(RULES["placeholder"])]))


class Prefilter:
    """Which lines of a text may be residue: a rule matches them once masked, or they are monotone."""

    def __init__(self) -> None:
        whole = sum(map(len, RULES.values()))
        self.rules = [(re.compile(pattern), sorted(({(case, t) for t in s} for s in sets), key=lambda s: -min(len(t) for _, t in s)), k < whole) for k, (pattern, case, sets) in enumerate(NEEDS)]
        self.triggers = self._literals(self.rules)

    def __call__(self, text: str) -> Iterator[str]:
        """The masked forms of those lines."""
        rules = self._possible(text, self.rules, self.triggers)
        triggers = self._literals(rules)
        for line in text.split("\n"):
            possible = self._possible(line, rules, triggers) if rules else rules
            if monotone(line):
                yield mask(line)
            elif possible:
                masked = mask(line)
                brief = short(masked)
                if any((anyway or brief) and rule.search(masked) for rule, _, anyway in possible) or monotone(masked):
                    yield masked

    @staticmethod
    def _literals(rules: list) -> set[tuple[bool, str]]:
        """Of each rule the set that is searched for first: the one with the longest literals."""
        return {t for _, sets, _ in rules for t in (sets[0] if sets else ())}

    @staticmethod
    def _possible(text: str, rules: list, triggers: Iterable[tuple[bool, str]]) -> list:
        low = folded(text)
        held = {t for t in triggers if t[1] in (text if t[0] else low)}
        return [
            rule for rule in rules
            if not rule[1] or (not held.isdisjoint(rule[1][0]) and all(any(t in (text if case else low) for case, t in s) for s in rule[1][1:]))
        ]


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prefilter = Prefilter()
    for b in batches:
        docs, sources, messages = [], [], []
        for doc, source, text in zip(b.column("doc").to_pylist(), b.column("source").to_pylist(), b.column("text").to_pylist()):
            for message in prefilter(text):
                docs.append(doc)
                sources.append(source)
                messages.append(message)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sources, pa.string()), pa.array(messages, pa.string())], ["doc", "source", "message"])


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classify = Classifier()
    for b in batches:
        kinds = [classify(*row) for row in zip(*(b.column(c).to_pylist() for c in ("message", "documents", "sources")))]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string())], [*b.schema.names, "kind"])


def suspects(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc, source, message): the masked lines that may be residue."""
    return (
        df.select(F.col(doc_id).cast("long").alias("doc"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
        .filter("doc is not null and text is not null and text <> ''").mapInArrow(_suspects, "doc long, source string, message string")
    )


def _counted(found: DataFrame) -> DataFrame:
    """(form, message, documents, sources, lines, kind) of the messages of residue, from (form, message, doc, source)."""
    each = found.groupBy("form", "source", "doc").agg(F.first("message").alias("message"), F.count("*").alias("lines"))
    each = each.groupBy("form", "source").agg(F.first("message").alias("message"), F.count("*").alias("documents"), F.sum("lines").alias("lines"))
    whole = each.groupBy("form").agg(F.first("message").alias("message"), F.sum("documents").alias("documents"), F.count("*").alias("sources"), F.sum("lines").alias("lines"))
    return whole.mapInArrow(_classified, "form long, message string, documents long, sources long, lines long, kind string").filter("kind is not null")


def _forms(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return suspects(df, doc_id, text, source).withColumn("form", F.xxhash64("message"))


def messages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Messages of residue: (message, kind, documents, sources, lines), of whatever number of documents.

    A null source counts as one source.
    """
    return _counted(_forms(df, doc_id, text, source)).select("message", "kind", "documents", "sources", "lines")


def residue(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, kinds) of the documents that hold residue, with the sorted classes of it.

    Null and empty texts hold none; rows of one id are one document.
    """
    found = written(_forms(df, doc_id, text, source), "residue-suspects")
    hits = found.select("doc", "form").distinct().join(_counted(found).select("form", "kind"), "form")
    return hits.groupBy(F.col("doc").alias(doc_id)).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def without_residue(df: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The corpus without those documents; rows with a null id stay."""
    return df.join(residue(df, doc_id).select(doc_id), doc_id, "left_anti")
