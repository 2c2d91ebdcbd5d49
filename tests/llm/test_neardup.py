"""Problem 2: the grouped prefix join against all pairs."""

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import neardup as N

SCHEMA = "passage_id long, file string, text string"


def brute(rows, num, den, least):
    sets = [(i, f, frozenset(w for w in t.replace("\n", " ").split(" ") if w)) for i, f, t in rows if None not in (i, f, t)]
    sets = [s for s in sets if len(s[2]) >= max(1, least)]
    out = set()
    for k, (i, f, a) in enumerate(sets):
        for j, g, b in sets[:k]:
            if f != g and i != j and len(a & b) * den >= num * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def table(r, n, words, vocabulary, hot=0):
    base = [[f"w{min(r.randrange(vocabulary), r.randrange(vocabulary))}" for _ in range(r.randint(1, words))] for _ in range(max(1, n // 4))]
    rows = []
    for k in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = f"w{r.randrange(vocabulary)}"
        r.shuffle(w)
        rows.append((k, f"f{r.randrange(6)}", "\n".join([" ".join(w)]) if r.random() < 0.5 else "  ".join(w) + " \n "))
    rows += [(n + k, f"f{k % 3}", "one and the same text in all of these rows of three sources again") for k in range(hot)]
    return rows


@pytest.mark.parametrize(("seed", "num", "den", "least"), [(1, 3, 5, 10), (2, 4, 5, 1), (3, 3, 5, 3), (4, 1, 2, 1), (5, 1, 1, 2)])
def test_same_as_all_pairs(spark, seed, num, den, least):
    r = random.Random(seed)
    rows = table(r, 300, 30, 120, hot=100)  # a quarter of all rows are copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(x) for x in N.near_duplicates(df, num=num, den=den, min_words=least).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, num, den, least)


def test_large_sets(spark):
    r = random.Random(9)
    base = [f"w{k}" for k in range(900)]
    rows = [(k, f"f{k}", " ".join(r.sample(base, r.choice([500, 700, 800])))) for k in range(40)]
    assert {tuple(x) for x in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows, 3, 5, 10)


def test_ties_at_the_threshold(spark):
    """12 of 20 words in common is 0.6 exactly."""
    a, b = [f"w{k}" for k in range(16)], [f"w{k}" for k in range(4, 20)]
    rows = [(1, "f", " ".join(a)), (2, "g", " ".join(b)), (3, "h", " ".join(b[:-1] + ["x", "y"]))]
    assert {tuple(x) for x in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 2), (2, 3)}


def test_edge_cases(spark):
    ten = " ".join(f"w{k}" for k in range(10))
    rows = [(1, "f", ten), (2, "g", ten), (2, "g", ten), (3, "f", ten), (4, None, ten), (None, "h", ten), (5, "h", None), (6, "h", ""), (7, "h", " \n"), (8, "h", " ".join(ten.split()[:9])), (9, "h", (ten + " ") * 50_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", id int, h string")
    want = {(1, 2), (2, 3), (1, 9), (2, 9), (3, 9)}
    assert {tuple(x) for x in N.near_duplicates(df).collect()} == want
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert N.near_duplicates(df.filter("passage_id = 1")).count() == 0


def test_classes(spark):
    r = random.Random(3)
    rows = table(r, 200, 25, 90, hot=60)
    j = N.GroupedPrefixJoin(spark.createDataFrame(rows, SCHEMA), "passage_id", "file", "text", 3, 5, 10)
    got = {x.id: x for x in j.classes().collect()}
    sets = {i: frozenset(t.split()) for i, _, t in rows if len(set(t.split())) >= 10}
    files = {s: {f for i, f, _ in rows if sets.get(i) == s} for s in sets.values()}
    assert set(got) == set(sets)
    for i, s in sets.items():
        same = [k for k, x in sets.items() if x == s]
        assert (got[i].class_id, got[i].copies) == (min(same), len(same))
        assert got[i].links == sum(o != s and len(o & s) * 5 >= 3 * len(o | s) and len(files[o] | files[s]) > 1 for o in files)
    linked = {(x.class_lo, x.class_hi) for x in j.links().collect()}
    of = {s: min(k for k, x in sets.items() if x == s) for s in files}
    assert linked == {(of[a], of[b]) for a in files for b in files if of[a] < of[b] and len(a & b) * 5 >= 3 * len(a | b) and len(files[a] | files[b]) > 1}


@pytest.mark.parametrize(("seed", "num", "den", "least"), [(11, 3, 5, 10), (12, 3, 5, 1), (13, 1, 2, 1), (14, 4, 5, 2)])
def test_hot_words_are_paired(spark, monkeypatch, seed, num, den, least):
    """Every word is hot, and some sets are too large for pairs."""
    monkeypatch.setattr(N, "HOT", 0)
    monkeypatch.setattr(N, "PAIRED", 15)
    rows = table(random.Random(seed), 200, 40, 60, hot=20)
    assert {tuple(x) for x in N.near_duplicates(spark.createDataFrame(rows, SCHEMA), num=num, den=den, min_words=least).collect()} == brute(rows, num, den, least)


def test_one_group_of_many_sets(spark):
    """All texts begin their order with the same rare words; those that share no more than these never meet."""
    common = " ".join(f"a{k}" for k in range(10))
    rows = [(k, f"f{k}", common + " " + " ".join(f"b{k // 4}x{i}" if i < 6 else f"c{k}x{i}" for i in range(8))) for k in range(80)]
    assert {tuple(x) for x in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows, 3, 5, 10)


def test_a_full_bitmap_changes_no_result(spark, monkeypatch):
    rows = table(random.Random(8), 150, 25, 60)
    monkeypatch.setattr(N, "BITS", 64)
    assert {tuple(x) for x in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows, 3, 5, 10)


def test_few_counters_change_no_result(spark, monkeypatch):
    rows = table(random.Random(4), 150, 25, 60)
    monkeypatch.setattr(N, "COUNTERS", 8)
    assert {tuple(x) for x in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows, 3, 5, 10)


def test_null_words_hash(spark):
    assert spark.createDataFrame([("a  b\na",)], "t string").select(F.size(N.distinct_words(F.col("t")))).first()[0] == 2


def test_one_id_with_different_texts(spark):
    """Each text of an id is verified by its own words, whichever row comes first."""
    a, b = [[f"{x}{k}" for k in range(20)] for x in "ab"]
    rows = [(1, "f", " ".join(a)), (1, "f", " ".join(b)), (2, "g", " ".join([*a[:19], "x"])), (3, "h", " ".join([*b[:19], "y"]))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, SCHEMA).coalesce(1)
        assert {tuple(x) for x in N.near_duplicates(df).collect()} == {(1, 2), (1, 3)}
        assert sorted(r.links for r in N.GroupedPrefixJoin(df, "passage_id", "file", "text", 3, 5, 10).classes().collect()) == [1, 1, 1, 1]


def shuffled(spark):
    """Bytes that all queries so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.fixture
def by_shuffle(spark):
    """Joins as on large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def test_groups_of_one_set_shuffle_no_rests(by_shuffle):
    spark, r = by_shuffle, random.Random(5)
    n = 3000
    rows = [(k, f"f{k % 7}", " ".join(f"w{r.randrange(20_000)}" for _ in range(60))) for k in range(n)]
    j = N.GroupedPrefixJoin(spark.createDataFrame(rows, SCHEMA).repartition(4), "passage_id", "file", "text", 3, 5, 10)
    at = [shuffled(spark)]
    for query in (j.group_pairs, j.set_pairs):
        assert query().count() == 0
        at.append(shuffled(spark))
    assert (at[2] - at[1]) - (at[1] - at[0]) < 200 * n


def test_texts_of_pairs_are_not_shuffled(by_shuffle):
    """Long texts of few words: 64 bits a word are enough."""
    spark, r = by_shuffle, random.Random(6)
    words = [[f"w{k}x{i}" for i in range(12)] for k in range(100)]
    rows = [(k, f"f{k % 2}", " ".join([*words[k // 2], *r.choices(words[k // 2], k=2000), f"end{k}"])) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    before = shuffled(spark)
    assert {tuple(x) for x in N.near_duplicates(df).collect()} == {(k, k + 1) for k in range(0, 200, 2)}
    assert shuffled(spark) - before < 0.2 * sum(len(t) for _, _, t in rows)


def test_written_tables_leave_no_shuffle_files(spark, monkeypatch):
    """Whether or not the driver collects its garbage."""

    class WithoutCollection:
        System = SimpleNamespace(gc=lambda: None)

        def __getattr__(self, name):
            return getattr(spark.sparkContext._jvm, name)

    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    monkeypatch.setattr(spark, "_jvm", WithoutCollection())
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(name, None), files()
    df = N.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(name, None) == set_before
    assert sorted(tuple(x) for x in df.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
