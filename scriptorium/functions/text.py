"""Scalar functions as column expressions; all run in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Combining marks that do not part tokens of unicode61.
TOKEN_MARKS = "̀-̄̆-̛̣̌̏̑-̨̭̮̰̱"
# Letters that unicode61 folds to another letter, besides case and Latin accents.
VARIANTS = {"ς": "σ", "µ": "μ", "ſ": "s", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε"}
# Accented Latin letters that it leaves alone.
UNFOLDED = "ǡ"


def _latin_folds() -> dict[str, str]:
    out = {}
    for p in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(p))[0]
        if base.isascii() and base != chr(p) and chr(p) not in UNFOLDED:
            out[chr(p)] = base.lower()
    return out


_FOLDS = _latin_folds() | VARIANTS
_FROM, _TO = "".join(_FOLDS), "".join(_FOLDS.values())
#: Texts that hold a letter to be folded other than by case, or a final sigma.
_FOLDABLE = "[\u00b5\u00c0-\u024f\u1e00-\u1eff" + "".join(v for v in VARIANTS if v != "ς") + "]"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends, as Python's strip()."""
    s = r"[\s\p{Z}\x1c-\x1f\x85]+"
    return F.regexp_replace(c, f"^{s}|{s}$", "")


def normalize_space(c: Column) -> Column:
    """Space, tab, CR and LF collapsed to one space and trimmed; other white space stays."""
    return F.trim(F.regexp_replace(c, "[ \t\r\n]+", " "))


def fold(c: Column) -> Column:
    """Case and Latin accents folded, combining marks dropped; Greek accents of precomposed letters stay.

    translate() looks every character up; only texts with a letter for it get
    there, and others, Greek for the most part, only have their final sigmas
    replaced.
    """
    low = F.lower(c)
    folded = F.when(c.rlike(_FOLDABLE), F.translate(low, _FROM, _TO)).otherwise(F.replace(low, F.lit("ς"), F.lit("σ")))
    return F.regexp_replace(folded, f"[{TOKEN_MARKS}]", "")


def tokens(c: Column) -> Column:
    """Tokens of unicode61 with remove_diacritics 2: runs of letters, numbers and private-use characters, folded."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def token_count(c: Column) -> Column:
    """Number of tokens; they need not be folded for that."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}" + TOKEN_MARKS + "]*"))


def query_terms(c: Column) -> Column:
    r"""The \w+ terms of user input: letters, numbers and _, marks part them."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def match_string(c: Column) -> Column:
    """Quoted terms joined by AND; empty without terms."""
    return F.array_join(F.transform(query_terms(c), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " AND ")


def quote_plus(c: Column) -> Column:
    """Percent-encoding of form values: space to +, and ~ kept."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def quote_path(c: Column) -> Column:
    """Percent-encoding of paths: slashes stay, a space is %20."""
    return F.replace(F.replace(quote_plus(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def path_key(c: Column) -> Column:
    """Sort key of paths: component by component."""
    return F.split(c, "/")


# The same on the driver, for user input.


def input_terms(raw: str) -> list[str]:
    return re.findall(r"\w+", raw)


def fold_text(s: str) -> str:
    return re.sub(f"[{TOKEN_MARKS}]", "", s.lower().translate({ord(a): b for a, b in _FOLDS.items()}))


def token_spans(s: str) -> list[tuple[str, int, int]]:
    """Folded tokens of a text with their places in it."""
    out, start = [], -1
    for i, ch in enumerate(s):
        cat = unicodedata.category(ch)
        if cat[0] in "LN" or cat == "Co":
            if start < 0:
                start = i
        elif start >= 0 and not re.match(f"[{TOKEN_MARKS}]", ch):
            out.append((fold_text(s[start:i]), start, i))
            start = -1
    if start >= 0:
        out.append((fold_text(s[start:]), start, len(s)))
    return out
