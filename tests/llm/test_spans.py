"""Problem 3: shared stretches against a dictionary of runs; the FM-index against counting."""

import random
from collections import defaultdict

import numpy as np
import pytest

from scriptorium.llm import spans as S

SCHEMA = "passage_id long, file string, text string"


def brute(rows, length):
    units = [(i, f, [w for w in t.replace("\n", " ").split(" ") if w]) for i, f, t in rows if None not in (i, f, t)]
    files = defaultdict(set)
    for _, f, w in units:
        for k in range(len(w) - length + 1):
            files[tuple(w[k : k + length])].add(f)
    out = set()
    for i, _, w in units:
        covered = [False] * len(w)
        for k in range(len(w) - length + 1):
            if len(files[tuple(w[k : k + length])]) > 1:
                covered[k : k + length] = [True] * length
        k = 0
        while k < len(w):
            j = k
            while j < len(w) and covered[j]:
                j += 1
            if j > k:
                out.add((i, k + 1, j))
            k = j + 1
    return out


def table(r, n, vocabulary):
    quotes = [[f"w{r.randrange(vocabulary)}" for _ in range(r.randint(5, 40))] for _ in range(12)]
    rows = []
    for k in range(n):
        w = []
        for _ in range(r.randint(0, 4)):
            q = r.choice(quotes)
            a = r.randrange(len(q))
            w += q[a:] if r.random() < 0.5 else q
            w += [f"w{r.randrange(vocabulary)}" for _ in range(r.randint(0, 9))]
        rows.append((k, f"f{r.randrange(4)}", " ".join(w)))
    return rows


@pytest.mark.parametrize(
    ("seed", "vocabulary", "length", "gram", "hot"), [(1, 500, 12, 6, S.HOT_WORDS), (2, 3, 12, 6, S.HOT_WORDS), (3, 500, 12, 6, 50), (4, 2, 12, 4, 30), (5, 40, 5, 2, S.HOT_WORDS), (6, 40, 20, 6, 0)]
)
def test_same_as_dictionary(spark, seed, vocabulary, length, gram, hot):
    """Also with hot anchors, and with texts of two or three words over and over."""
    rows = table(random.Random(seed), 150, vocabulary)
    got = [tuple(x) for x in S.shared_spans(spark.createDataFrame(rows, SCHEMA).repartition(4), length=length, gram=gram, hot_words=hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, length)


def test_a_third_of_all_rows_share_one_text(spark):
    quote = " ".join(f"q{k}" for k in range(15))
    rows = [(k, f"f{k % 40}", f"a{k} b{k} {quote} c{k}" if k % 3 == 0 else f"x{k} " * 14) for k in range(600)]
    for hot in (S.HOT_WORDS, 600):
        assert {tuple(x) for x in S.shared_spans(spark.createDataFrame(rows, SCHEMA), hot_words=hot).collect()} == {(k, 3, 17) for k in range(0, 600, 3)}


def test_edge_cases(spark):
    t = " ".join(f"w{k}" for k in range(12))
    rows = [(1, "f", t), (2, "f", t), (3, "g", t.replace(" ", "\n")), (4, None, t), (None, "h", t), (5, "h", None), (6, "h", ""), (7, "h", t.rpartition(" ")[0]), (8, "h", "x " * 300_000 + t)]
    df = spark.createDataFrame([(*r, 0, "y") for r in rows], SCHEMA + ", id int, w string")
    got = {tuple(x) for x in S.shared_spans(df).collect()}
    assert got == {(1, 1, 12), (2, 1, 12), (3, 1, 12), (8, 300_001, 300_012)}
    assert S.shared_spans(df.limit(0)).count() == S.shared_spans(df.filter("file = 'f'")).count() == 0
    shares = {r.passage_id: (r.words, r.shared_words, r.stretches) for r in S.shared_shares(df.filter("passage_id is not null")).collect()}
    assert shares[1] == (12, 12, 1) and shares[6] == (0, 0, 0) and shares[7] == (11, 0, 0) and 5 not in shares


def test_runs_that_touch_are_one_stretch(spark):
    a, b = [" ".join(f"{x}{k}" for k in range(12)) for x in "ab"]
    rows = [(1, "f", f"{a} {b}"), (2, "g", a), (3, "h", b)]
    assert {tuple(x) for x in S.shared_spans(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 1, 24), (2, 1, 12), (3, 1, 12)}


def test_many_small_shards(spark):
    rows = table(random.Random(7), 100, 300)
    rows += rows[:30]
    assert {tuple(x) for x in S.shared_spans(spark.createDataFrame(rows, SCHEMA), shard_words=40, hot_words=20).collect()} == brute(rows, 12)


def test_rank():
    r = np.random.default_rng(1)
    for symbols in (1, 2, 5, 64, 200):
        text = r.integers(0, symbols, 500)
        m = S.WaveletMatrix(text, symbols)
        c, at = r.integers(0, symbols, 300), r.integers(0, 501, 300)
        assert m.rank(c, at).tolist() == [int((text[:i] == s).sum()) for s, i in zip(c, at)]


def test_intervals_count_occurrences():
    r = np.random.default_rng(2)
    pieces = [r.integers(0, 4, n) for n in (5, 9, 30, 12, 7)]
    words, offsets = np.concatenate(pieces), np.r_[0, np.cumsum([len(p) for p in pieces])]
    index = S.FMIndex(words, offsets, 4)
    ends = np.concatenate([index.start[k] + np.arange(3, len(p)) for k, p in enumerate(pieces)])
    found, lo, hi = index.matches(ends, 4, np.zeros(len(ends), bool))
    grams = [tuple(p[k : k + 4]) for p in pieces for k in range(len(p) - 3)]
    assert (hi - lo).tolist() == [grams.count(g) for g in grams] and len(found) == len(ends)


def test_one_id_in_two_sources_and_with_two_texts(spark):
    t, o = [" ".join(f"{x}{k}" for k in range(20)) for x in "wo"]
    assert {tuple(x) for x in S.shared_spans(spark.createDataFrame([(1, "f", t), (1, "g", t)], SCHEMA)).collect()} == {(1, 1, 20)}
    rows = [(1, "f", t), (1, "f", " ".join(["x"] * 5) + " " + o), (2, "g", t), (3, "h", o)]
    assert {tuple(x) for x in S.shared_spans(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 1, 25), (2, 1, 20), (3, 1, 20)}
