"""Problem 4: one form for what looks the same."""

import random
import unicodedata
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import unify as U

SCHEMA = "passage_id long, text string"
DATA = Path("/root/testdata/sf0.01")
T = U.Transducer()

SAME = [
    ("ὰ", "ὰ"), ("ά", "ά"), ("ά", "ά"), ("ｆｕｌｌ！", "full!"), ("a\xa0b c d", "a b c d"), ("a​b⁠﻿\xad", "ab"),
    ("ѕі", "si"), ("εὐ\xb5", "εὐμ"), ("ﬁat", "fiat"), ("vόμος", "νόμος"), ("o̔ òς", "ὁ ὸς"),
    ("Οdd", "Odd"), ("γ;", "γ;"), ("·", "\xb7"), ("ἐ̣", "ἐ̣"), ("α‍́", "ά"), ("a\r\nb", "a\nb"), ("oο", "oo"),
    ("pο νόμος", "ρo νόμος"), ("Ａ", "A"), ("i‑j", "i-j"), ("ѕ̓", "s̓"), ("tā́", "tā́"),
]
DIFFER = ["a", "α", "á", "à", "ὰ", "ά", "ἀ", "ἁ", "A", "a.", "a,", "a ", "a\n", "a'", "a’", "ι", "i", "ı", "σ", "ς", "ᾳ", "ạ", "-", "–", "—", "†", "[a]", "(a)", "⟨a⟩", "<a>", "u", "υ", "ϑ", "θ", "ϲ", "ß", "ss", "²", "2", "…", "..."]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_one_form(a, b):
    assert T.apply(a) == T.apply(b)


def test_visible_differences_stay():
    assert len({T.apply(x) for x in DIFFER}) == len(DIFFER)


def test_null_and_empty():
    assert T.apply(None) is None and T.apply("") == ""


letters = st.text(alphabet=st.sampled_from("aeiopuvcsxαοινρυχἀέὸаорсеѕід \n.,;·’") | st.sampled_from("̣̀́̓͂​‍\xad\xa0 ｏａﬁµͅ"), max_size=25)


@settings(max_examples=500, deadline=None)
@given(letters)
def test_forms_are_final_and_independent_of_normal_form(s):
    once = T.apply(s)
    assert T.apply(once) == once
    for form in ("NFC", "NFD"):
        assert T.apply(unicodedata.normalize(form, s)) == once


@settings(max_examples=300, deadline=None)
@given(letters, st.randoms(use_true_random=False))
def test_disguises_have_the_same_form(s, r):
    """Any look-alike, width, space, decomposition or invisible character put in leaves the form as it was."""
    groups = [set(row.replace(" ", "")) - {"-"} for row in U.LOOKALIKE_LETTERS.strip().split("\n")]
    out = []
    for ch in s:
        for c in unicodedata.normalize("NFD", ch) if r.random() < 0.5 else ch:
            alike = next((g for g in groups if c in g), None)
            if alike and r.random() < 0.5:
                c = r.choice(sorted(alike))
            elif c == " " and r.random() < 0.5:
                c = r.choice("\xa0  ")
            out.append(c)
            if r.random() < 0.2:
                out.append(r.choice("​‌‍⁠﻿\xad"))
    assert T.apply("".join(out)) == T.apply(s)


def test_conflicts_are_found():
    with pytest.raises(ValueError):
        U.Transducer(letters="o ο о\no ω -\n")
    with pytest.raises(ValueError):
        U.Transducer(signs=["ａb"])


def test_pairs(spark):
    rows = [(1, "νόμος"), (2, "vόμος"), (3, "νόμος"), (4, "νό​μος"), (5, None), (6, ""), (7, "\u1f7d" * 300_000), (8, "\u03ce" * 300_000), (None, "νόμος"), (4, "νό​μος"), (9, "​")]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA + ", id int, form string")
    assert sorted(map(tuple, U.look_the_same(df).collect())) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]
    assert U.look_the_same(df.limit(0)).count() == 0
    got = {r.passage_id: r.unified for r in U.unify(df).collect()}
    assert got[2] == "νόμος" and got[5] is None and got[6] == "" and U.unify(df.limit(0)).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(k, "commune" if k % 3 else f"t{k}") for k in range(3000)] + [(9000, "cоmmune"), (9001, "commun⁠e")]
    got = U.look_the_same(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 2 * 2000 + 1


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_whole_table_against_a_plain_key(spark):
    """A key that folds all look-alikes to Latin, without regard to context, gives the same pairs."""
    fold = {}
    for row in U.LOOKALIKE_LETTERS.strip().split("\n"):
        first, *others = row.replace(" ", "").replace("-", "")
        fold |= {ord(c): first for c in others if c != "-"}
    gone = dict.fromkeys(map(ord, "\xad​‌‍⁠﻿"))
    df = spark.read.parquet(f"{DATA}/passages.parquet").select("passage_id", "text")
    groups = {}
    for i, t in df.filter("text <> ''").collect():
        key = unicodedata.normalize("NFC", unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t.translate(gone))).translate(fold))
        groups.setdefault(key, []).append((i, t))
    want = {(min(i, j), max(i, j)) for g in groups.values() for i, a in g for j, b in g if a != b}
    assert {tuple(r) for r in U.look_the_same(df).collect()} == want


def test_order_of_rows_does_not_matter(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["vetο", "veto", "vetο​", "νετο"])) for k in range(50)]
    one = {tuple(x) for x in U.look_the_same(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    r.shuffle(rows)
    assert {tuple(x) for x in U.look_the_same(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()} == one


def test_rarer_look_alikes():
    assert T.apply("ԝօrԁ") == "word" and T.apply("ᎪᏴᏟ Ӏus ѵіа") != "" and T.apply("Ӏus Ѵenus") == "Ius Venus" and T.apply("кόσмος")[0] == "κ"
    assert T.apply("Հայաստան օր") == "Հայաստան օր"  # Armenian words stay as they are
    assert T.apply("ток") == "ток" and T.apply("κόσμος") == "κόσμος"


def test_classes(spark):
    rows = [(1, "word"), (2, "wοrd"), (3, "wοrd"), (4, "other"), (5, "other"), (6, ""), (7, None), (None, "word"), (8, "ԝord")]
    got = {r.passage_id: tuple(r)[1:] for r in U.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1, 1, 3), 2: (1, 2, 2, 3), 3: (1, 2, 2, 3), 4: (4, 4, 2, 1), 5: (4, 4, 2, 1), 8: (1, 8, 1, 3)}
    assert U.classes(spark.createDataFrame([], SCHEMA)).count() == 0
