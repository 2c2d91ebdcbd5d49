"""Problem 7: leaked items against a dictionary of runs."""

import random
import re

import pytest

from scriptorium.llm import leakage as L

DOCS, ITEMS = "doc_id long, text string, source string", "item_id long, text string, split string"


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def brute(docs, items, length=12):
    grams = {}
    for i, t, _ in items:
        if t is not None and i is not None:
            w = words(t)
            for k in range(len(w) - length + 1):
                grams.setdefault(tuple(w[k : k + length]), set()).add(i)
    out = set()
    for d, t, _ in docs:
        if t is not None and d is not None:
            w = words(t)
            for k in range(len(w) - length + 1):
                out |= {(d, i) for i in grams.get(tuple(w[k : k + length]), ())}
    return out


def tables(r, n, vocabulary):
    items = [(k, " ".join(f"W{r.randrange(vocabulary)}" for _ in range(r.randint(5, 60))), "x") for k in range(20)]
    items += [(100 + k, items[k][1] + ", Quid?", "x") for k in range(3)]  # items that share their passage
    docs = []
    for k in range(n):
        w = [f"w{r.randrange(vocabulary)}" for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            q = items[r.randrange(len(items))][1].split()
            a = r.randrange(len(q))
            w[r.randrange(len(w) + 1) : 0] = q[a : a + r.randint(5, 40)]
        docs.append((k, r.choice([" ", "; ", "\n"]).join(w), "s"))
    return docs, items


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 400), (2, 3), (3, 1)])
def test_same_as_dictionary(spark, seed, vocabulary):
    docs, items = tables(random.Random(seed), 200, vocabulary)
    c, t = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert {tuple(x) for x in L.leaked(c, t).collect()} == want
    texts, tests = {d: words(x) for d, x, _ in docs}, {i: words(x) for i, x, _ in items}
    for r in L.longest_leaks(c, t).collect():
        a, b = texts[r.doc_id], tests[r.item_id]
        run = a[r.doc_word - 1 : r.doc_word - 1 + r.words]
        assert run == b[r.item_word - 1 : r.item_word - 1 + r.words] and len(run) == r.words >= 12
        joined = lambda w: " " + " ".join(w) + " "
        longer = any(joined(b[k : k + r.words + 1]) in joined(a) for k in range(len(b) - r.words))
        assert not longer
    assert {r.doc_id for r in L.without_leaks(c, t).collect()} == {d for d, _, _ in docs} - {d for d, _ in want}


def test_blocks_and_shards(spark, monkeypatch):
    """Test sets beyond one block, shards of a few documents, extensions a few at a time."""
    docs, items = tables(random.Random(5), 150, 200)
    for name, value in (("BLOCK_WORDS", 100), ("SHARD_WORDS", 300), ("PLACES", 5)):
        monkeypatch.setattr(L, name, value)
    c, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert {tuple(x) for x in L.leaked(c, t).collect()} == brute(docs, items)


def test_a_third_of_all_documents_leak_one_item(spark):
    quote = " ".join(f"q{k}" for k in range(30))
    docs = [(k, f"a{k} {quote} b{k}" if k % 3 == 0 else f"other {k} words", "s") for k in range(3000)]
    got = L.leaked(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, quote.upper(), "x")], ITEMS))
    assert got.count() == 1000


def test_edge_cases(spark):
    t = " ".join(f"w{k}" for k in range(12))
    docs = [(1, t, "s"), (1, t, "s"), (2, None, "s"), (3, "", "s"), (4, t.rpartition(" ")[0], "s"), (None, t, "s"), (5, t.replace(" ", "—"), "s"), (6, "x " * 300_000 + t, "s"), (7, t.replace("w5", "w_5"), "s")]
    items = [(1, t, "x"), (2, None, "x"), (3, "", "x"), (4, "w1 w2", "x"), (None, t, "x"), (5, f"Quid: {t.upper()}?", "x")]
    c = spark.createDataFrame([(*d, 0, "h") for d in docs], DOCS + ", doc int, h string")
    b = spark.createDataFrame([(*i, 0) for i in items], ITEMS + ", item int")
    assert {tuple(x) for x in L.leaked(c, b).collect()} == {(d, i) for d in (1, 5, 6) for i in (1, 5)}
    assert L.leaked(c.limit(0), b).count() == L.leaked(c, b.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in L.without_leaks(c, b).collect()) == ["2", "3", "4", "7", "None"]
