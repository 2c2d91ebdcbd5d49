"""Near-duplicate units by a grouped prefix join (problem 2).

The similarity is the Jaccard measure on distinct words.  Words are ordered
from rare to frequent; two sets that are similar enough share a word among the
first few of each, their prefixes.  Sets of one size and one prefix form a
group; groups, not sets, are indexed and joined, and group pairs are filtered
by size, by the place of the shared word and by a bound from bit signatures,
before they are expanded to their sets and these verified word by word.

There is one plan for all sizes.  What bounds each step:

* The order of the words comes from a table of 2^18 counters whatever the size
  of the input.  Any order is right; the counters only make prefixes rare.
* A hot word, one that more than `HOT` sets have, is no key by itself: sets of
  which it is the first common word share a second one within one more word of
  their prefixes, so pairs of words are the keys instead.
* Sets of one group, which have the same prefix, meet only where the rests of
  their words share a word of the rests' prefixes, by the same principle.
* Copies are one set.  They are expanded at the very end, by a join.
* A set has 256 parity bits of its words; a group carries, for each of 128 that
  they fold to, whether all its sets have it or none has.  Bits that all sets
  of one side have and none of the other count as different words, so no true
  pair is lost.
* Words are read again for those sets only that stand in a candidate pair.
  Others are passed over by a bitmap of 2^23 bits before anything is shuffled,
  and what it lets through is dropped by the join with the pairs.  Groups of
  one set, which nearly all are, are passed over likewise where sets of one
  group meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_freed, written

#: Counters of the word order; a fixed 2 MB on the driver and in each task.
COUNTERS = 1 << 18
#: Sets from which a word is hot.
HOT = 4096
#: Distinct words up to which a set has pairs of words as keys; larger ones have single words throughout.
PAIRED = 150
#: Bits of the bitmap of ids; a fixed 1 MB on the driver and in each task.
BITS = 1 << 23

RECORD = "id long, file string, size int, gid long, sid long, keys array<int>, places array<int>, rest array<int>, s0 long, s1 long, s2 long, s3 long"


def distinct_words(text: Column) -> Column:
    """64-bit hashes of the distinct words: maximal runs without space or line feed, compared exactly."""
    words = F.array_remove(F.split(text, "[ \n]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed mixer of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty(0, col.type.value_type.to_pandas_dtype()), np.zeros(1, np.int64)
    offsets = np.asarray(col.offsets).astype(np.int64)
    values = np.asarray(col.values)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def set_ids(mixed: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash for each set of mixed words, in whatever order these are."""
    return mix(np.add.reduceat(mixed, start))


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        h, off = flat_lists(b.column("h"))
        sid = set_ids(mix(h.view(np.uint64)), off[:-1])
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sid.view(np.int64)), b.column("h")], ["id", "sid", "h"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(COUNTERS, np.int64)
    for b in batches:
        values, _ = flat_lists(b.column(0))
        n += np.bincount(values.view(np.uint64) & np.uint64(COUNTERS - 1), minlength=COUNTERS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])


def word_counters(sets: DataFrame) -> np.ndarray:
    """How many sets have a word of each slot, over all sets; COUNTERS numbers at most reach the driver."""
    with shuffles_freed(sets.sparkSession):
        rows = sets.select("h").mapInArrow(_count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def _spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + many[0] - 1, first[1] .., one after another."""
    ends = np.cumsum(many)
    return np.repeat(first - ends + many, many) + np.arange(many.sum())


def _short(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _keys(m: np.ndarray, hot: np.ndarray, start: np.ndarray, size: np.ndarray, alpha: np.ndarray, wide: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, place) by which sets meet: their words m, of which some are hot, begin at `start` and are sorted.

    A set has `alpha` words in common, at least, with any that is similar, so
    the first common word is among the first size - alpha + 1 of both, and a
    second one, if alpha is 2 or more, among one word more (`wide`).
    """
    keep = size - alpha + 1
    row = np.repeat(np.arange(len(size)), keep)
    at = _spans(start, keep)
    paired = size <= PAIRED
    single = ~paired | (size * den > PAIRED * num) | (alpha < 2)  # those also that may be similar to a set without pairs
    alone = ~hot[at] | single[row]
    double = hot[at] & paired[row]
    first, of = at[double], row[double]
    many = start[of] + wide[of] - 1 - first
    second = _spans(first + 1, many)
    first, of = np.repeat(first, many), np.repeat(of, many)
    pair = mix(m[first] * np.uint64(0x9E3779B97F4A7C15) + m[second])
    rows = np.r_[row[alone], of]
    order = np.argsort(rows, kind="stable")
    places = np.r_[at[alone], first] - start[rows]
    return rows[order], np.r_[_short(m[at[alone]]), _short(pair)][order], places[order]


def _recorder(spark: SparkSession, counters: np.ndarray, num: int, den: int):
    shared = spark.sparkContext.broadcast(counters)
    limit = HOT

    def lists(rows: np.ndarray, n: int) -> pa.Array:
        return pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            h, off = flat_lists(b.column("h"))
            h = h.view(np.uint64)
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            m = mix(h)
            often = order[h & np.uint64(COUNTERS - 1)]
            at = np.lexsort((m, often, row))
            m, hot = m[at], often[at] > limit
            start = off[:-1]
            sid = set_ids(m, start)
            bit, quarter = np.uint64(1) << (m & np.uint64(63)), m >> np.uint64(6) & np.uint64(3)
            signature = [np.bitwise_xor.reduceat(np.where(quarter == np.uint64(q), bit, np.uint64(0)), start) for q in range(4)]
            alpha = -(-num * size // den)
            wide = np.minimum(size, size - alpha + 2)
            inside = np.arange(len(h)) - np.repeat(start, size) < np.repeat(wide, size)
            gid = mix(np.add.reduceat(np.where(inside, mix(m + np.uint64(1)), np.uint64(0)), start) + size.astype(np.uint64))
            of, key, place = _keys(m, hot, start, size, alpha, wide, num, den)
            keys, places = (pa.ListArray.from_arrays(lists(of, len(size)), pa.array(x.astype(np.int32))) for x in (key, place))
            # sets of one group need so many more words in common, out of their rests
            more = -(-2 * num * size // (num + den)) - wide
            many = np.where(more > 0, np.maximum(size - wide - more + 1, 0), np.minimum(size - wide, 1))
            taken = _short(mix(m[_spans(start + wide, many)]))
            taken[np.repeat(more <= 0, many)] = 0  # no word decides: all are similar
            rest = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(taken))
            i64 = lambda x: pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("file"), pa.array(size.astype(np.int32)), i64(gid), i64(sid), keys, places, rest, *map(i64, signature)],
                ["id", "file", "size", "gid", "sid", "keys", "places", "rest", "s0", "s1", "s2", "s3"],
            )

    return records


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of `ids`; its size is fixed, so that of very many ids it only lets more through."""
    slot = F.pmod(F.xxhash64("id"), F.lit(BITS))
    with shuffles_freed(ids.sparkSession):
        words = ids.groupBy(F.floor(slot / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {BITS}) % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _in_bitmap(spark: SparkSession, bits: np.ndarray):
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def within(hashed: pa.Array) -> pa.Array:
        slot = hashed.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(len(shared.value) * 64 - 1)
        return pa.array((shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1)

    return within


class GroupedPrefixJoin:
    """The steps of the join over one table; the results are methods.

    `file_col` names what counts as one source: pairs within it are not
    wanted.  Rows with a null id, source or text, or with fewer than
    `min_words` distinct words, are in no pair.  The threshold is num/den.
    """

    def __init__(self, df: DataFrame, id_col: str, file_col: str, text_col: str, num: int, den: int, min_words: int) -> None:
        self.num, self.den = num, den
        self.texts = (
            df.select(F.col(id_col).cast("long").alias("id"), F.col(file_col).cast("string").alias("file"), F.col(text_col).alias("t"))
            .filter("id is not null and file is not null and t is not null")
        )
        self.least = max(1, min_words)
        spark = df.sparkSession
        sets = self._sets(self.texts)
        self.records = written(sets.mapInArrow(_recorder(spark, word_counters(sets), num, den), RECORD), "near-records")

    def _sets(self, texts: DataFrame) -> DataFrame:
        # a generator of one row, which no filter is moved below: the words are split and hashed once, not for the filter again
        return texts.select("id", "file", F.explode(F.array(distinct_words(F.col("t")))).alias("h")).filter(F.size("h") >= self.least)

    def _enough(self, overlap: Column, sizes: Column) -> Column:
        """overlap / (sizes - overlap) >= num / den"""
        return overlap * (self.num + self.den) >= sizes * self.num

    def _near(self, different: Column, sizes: Column) -> Column:
        """The bound on words that two similar sets do not share, from the same inequality."""
        return different * (self.num + self.den) <= sizes * (self.den - self.num)

    def group_pairs(self) -> DataFrame:
        """Pairs (ga, gb), ga < gb, of groups that may hold similar sets."""
        groups = self.records.groupBy("gid").agg(
            F.first("size").alias("size"), F.first("keys").alias("key"), F.first("places").alias("at"),
            *(f(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k + 2}"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("a", F.bit_and), ("o", F.bit_or))),  # 256 bits folded to 128
        )
        postings = groups.select(F.inline(F.arrays_zip("key", "at")), "gid", "size", "a0", "o0", "a1", "o1")
        a = postings.select("key", *(F.col(c).alias(f"{c}_a") for c in ("at", "gid", "size", "a0", "o0", "a1", "o1")))
        b = postings.select("key", *(F.col(c).alias(f"{c}_b") for c in ("at", "gid", "size", "a0", "o0", "a1", "o1")))
        c = F.col
        sizes = c("size_a") + c("size_b")
        apart = sum(
            (F.bit_count(c(f"a{k}_{x}").bitwiseAND(F.bitwise_not(c(f"o{k}_{y}")))) for k in "01" for x, y in ("ab", "ba")),
            start=F.lit(0),
        )
        ok = (
            (c("gid_a") < c("gid_b"))
            & (F.least("size_a", "size_b") * self.den >= F.greatest("size_a", "size_b") * self.num)
            & self._enough(F.least(c("size_a") - c("at_a"), c("size_b") - c("at_b")), sizes)
            & self._near(apart, sizes)
        )
        return a.join(b, "key").filter(ok).select(c("gid_a").alias("ga"), c("gid_b").alias("gb")).distinct()

    def _members(self, records: DataFrame, *more: Column) -> DataFrame:
        return records.groupBy("gid", "sid").agg(F.first("size").alias("size"), *(F.first(f"s{k}").alias(f"s{k}") for k in range(4)), F.min("id").alias("rep"), *more)

    def _several(self, records: DataFrame) -> DataFrame:
        """The groups of more than one set."""
        return records.groupBy("gid").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).filter("x <> y").select("gid")

    def set_pairs(self) -> DataFrame:
        """Verified pairs (ga, sa, gb, sb) of different sets that are similar enough."""
        spark = self.records.sparkSession
        name_a, name_b = ({"gid": f"g{x}", "sid": f"s{x}", "size": f"n{x}", "rep": f"r{x}"} | {f"s{k}": f"{x}{k}" for k in range(4)} for x in "ab")
        c = F.col
        near = self._near(reduce(Column.__add__, (F.bit_count(c(f"a{k}").bitwiseXOR(c(f"b{k}"))) for k in range(4))), c("na") + c("nb"))
        columns = ["ga", "sa", "na", "ra", "gb", "sb", "nb", "rb"]
        sets = self._members(self.records)
        across = self.group_pairs().join(sets.withColumnsRenamed(name_a), "ga").join(sets.withColumnsRenamed(name_b), "gb").filter(near).select(columns)
        crowded = self.records.filter(_in_bitmap(spark, bitmap_of(self._several(self.records).withColumnRenamed("gid", "id")))(F.xxhash64("gid")))
        inner = self._members(crowded.join(self._several(crowded), "gid", "left_semi"), F.first("rest").alias("rest")).withColumn("word", F.explode("rest")).drop("rest")
        a, b = inner.withColumnsRenamed(name_a), inner.withColumnsRenamed(name_b)
        within = a.join(b, (c("ga") == c("gb")) & (a["word"] == b["word"])).filter((c("sa") < c("sb")) & near).select(columns).distinct()
        candidates = written(across.unionByName(within), "near-candidates")

        ids = candidates.select(F.explode(F.array("ra", "rb")).alias("id")).distinct()
        wanted = _in_bitmap(spark, bitmap_of(ids))
        # An id may have several texts: the words of a set are those of its id and its hash.
        texts = self.texts.filter(wanted(F.xxhash64("id")))
        words = self._sets(texts).select("id", "h").mapInArrow(_with_sets, "id long, sid long, h array<long>").dropDuplicates(["id", "sid"])
        wa, wb = words.withColumnsRenamed({"id": "ra", "sid": "sa", "h": "ha"}), words.withColumnsRenamed({"id": "rb", "sid": "sb", "h": "hb"})
        both = candidates.join(wa, ["ra", "sa"]).join(wb, ["rb", "sb"])
        return both.filter(self._enough(F.size(F.array_intersect("ha", "hb")), c("na") + c("nb"))).select("ga", "sa", "gb", "sb")

    def pairs(self) -> DataFrame:
        """Rows (id_lo, id_hi) of different sources that are similar enough, each pair once."""
        rows = self.records.select("id", "file", "gid", "sid")
        copied = (
            rows.groupBy("gid", "sid").agg(F.min("file").alias("f0"), F.max("file").alias("f1")).filter("f0 <> f1")
            .select(F.col("gid").alias("ga"), F.col("sid").alias("sa"), F.col("gid").alias("gb"), F.col("sid").alias("sb"))
        )
        a = rows.withColumnsRenamed({"id": "ia", "file": "fa", "gid": "ga", "sid": "sa"})
        b = rows.withColumnsRenamed({"id": "ib", "file": "fb", "gid": "gb", "sid": "sb"})
        # similar sets, and each set that has rows of several sources, with itself: expanded together
        both = self.set_pairs().unionByName(copied).join(a, ["ga", "sa"]).join(b, ["gb", "sb"])
        once = (F.col("fa") != F.col("fb")) & (F.col("ia") != F.col("ib")) & ((F.col("sa") != F.col("sb")) | (F.col("ga") != F.col("gb")) | (F.col("ia") < F.col("ib")))
        return both.filter(once).select(F.least("ia", "ib").alias("id_lo"), F.greatest("ia", "ib").alias("id_hi")).distinct()

    def _classes(self) -> DataFrame:
        """(gid, sid, class_id, copies, f0, f1): the sets with what their rows say together."""
        return self.records.groupBy("gid", "sid").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.min("file").alias("f0"), F.max("file").alias("f1"))

    def links(self) -> DataFrame:
        """Pairs (class_lo, class_hi) of classes that are similar enough and not both of one and the same source, each once."""
        a = self._classes().select(F.col("gid").alias("ga"), F.col("sid").alias("sa"), F.col("class_id").alias("ca"), F.col("f0").alias("a0"), F.col("f1").alias("a1"))
        b = self._classes().select(F.col("gid").alias("gb"), F.col("sid").alias("sb"), F.col("class_id").alias("cb"), F.col("f0").alias("b0"), F.col("f1").alias("b1"))
        apart = (F.col("a0") != F.col("a1")) | (F.col("b0") != F.col("b1")) | (F.col("a0") != F.col("b0"))
        both = self.set_pairs().join(a, ["ga", "sa"]).join(b, ["gb", "sb"]).filter(apart)
        return both.select(F.least("ca", "cb").alias("class_lo"), F.greatest("ca", "cb").alias("class_hi"), "ga", "sa", "gb", "sb")

    def classes(self) -> DataFrame:
        """One row per text: (id, class_id, copies, links).

        `class_id` is the least id of the rows with the same set of words,
        `copies` the number of such rows and `links` the number of other
        classes that are similar enough and have a row of another source than
        some row of this class.
        """
        both = F.array(F.struct(F.col("ga").alias("gid"), F.col("sa").alias("sid")), F.struct(F.col("gb").alias("gid"), F.col("sb").alias("sid")))
        ends = self.links().select(F.explode(both).alias("e")).select("e.*")
        links = ends.groupBy("gid", "sid").agg(F.count("*").alias("links"))
        return (
            self.records.select("id", "gid", "sid").join(self._classes(), ["gid", "sid"]).join(links, ["gid", "sid"], "left")
            .select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
        )


def near_duplicates(
    df: DataFrame, id_col: str = "passage_id", file_col: str = "file", text_col: str = "text", num: int = 3, den: int = 5, min_words: int = 10
) -> DataFrame:
    """Pairs of rows of different sources whose common distinct words are num/den of all or more.

    Empty tables give no rows; a repeated id counts as its rows; ties at the
    threshold are pairs.
    """
    return GroupedPrefixJoin(df, id_col, file_col, text_col, num, den, min_words).pairs()
