"""Long exact spans shared between records, by FM-indexes per shard (problem 3).

A run of `length` words that two records share has the same words, hence the
same anchor: the least hash among its grams of `gram` words.  Records are cut
where the anchor changes; a piece goes to the shard of its anchor, so that all
occurrences of a run meet in one shard and every run is looked up once.  Each
shard is an FM-index: the suffixes of its pieces sorted to the depth of a run,
their Burrows-Wheeler text in a wavelet matrix of packed bits.  The pieces are
streamed against it; backward search extends all their matches by one word at a
time and drops those whose interval cannot hold two sources.  What is left at
full length is checked against the sources in the interval.

There is one plan for all sizes, without broadcasts.  What bounds each step:

* Places are joined with the anchors of two sources and more before any text
  meets them: 32 bytes each, so that an anchor that a third of all rows have is
  split by the skew join of adaptive execution.  A text then joins its own
  places once, by its id.
* Pieces are counted and merged when equal, before the shuffle to the shards.
* The number of shards follows the words of the pieces, counted before.  An
  anchor with many words of context, a phrase quoted everywhere, is cut into
  single runs, which go to shards by their own hash and are one piece when
  equal.  So no key brings more than a thirtieth of a shard's words to it, and
  a shard holds about `SHARD_WORDS`; twice as many are improbable by far.
* The index keeps packed bits and two 32-bit numbers for each word; the suffix
  array is dropped once the index is made from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, written
from .neardup import flat_lists, mix

#: Words of distinct pieces that a shard holds on average.
SHARD_WORDS = 1 << 20
#: Words of pieces from which an anchor is hot; what one anchor brings to a shard, or one run if it is hot, is below a thirtieth of its words.
HOT_WORDS = 1 << 15


def word_hashes(text: Column) -> Column:
    """Hashes of all words in order: maximal runs without space or line feed."""
    return F.transform(F.array_remove(F.split(text, "[ \n]+"), ""), lambda w: F.xxhash64(w))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i; the last width - 1 places hold less."""
    out, done = x.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = np.minimum(out[:-step], out[step:])
        done += step
    return out


def cutter(length: int, gram: int):
    """A function of word lists: their pieces (start, n, anchor), each with all runs of one anchor in a row."""
    width = length - gram + 1

    @F.arrow_udf("array<struct<start:int,n:int,anchor:long>>")
    def pieces(words: pa.Array) -> pa.Array:
        h, off = flat_lists(words)
        h = mix(h.view(np.uint64))
        n = np.diff(off)
        g = np.zeros(len(h), np.uint64)
        for k in range(gram):
            if k < len(h):
                g[: len(h) - k] = g[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
        anchor = sliding_min(mix(g), width)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(h)) - np.repeat(off[:-1], n)
        at = np.flatnonzero(place <= np.repeat(n, n) - length)  # starts of runs
        if not len(at):
            empty = pa.StructArray.from_arrays([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64())], ["start", "n", "anchor"])
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(n) + 1, np.int32)), empty)
        a, r = anchor[at], row[at]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
        runs = np.diff(np.r_[first, len(at)])
        values = pa.StructArray.from_arrays(
            [pa.array(place[at[first]].astype(np.int32)), pa.array((runs + length - 1).astype(np.int32)), pa.array(a[first].view(np.int64))],
            ["start", "n", "anchor"],
        )
        ends = np.searchsorted(r[first], np.arange(len(n) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values)

    return pieces


class WaveletMatrix:
    """Rank of any symbol at any place of a text, on packed bits."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.depth = max(1, int(symbols - 1).bit_length())
        start = np.arange(symbols)  # becomes the place where each symbol's own stretch begins
        first = np.zeros(symbols, np.int64)
        for level in range(self.depth):
            shift = self.depth - 1 - level
            bits = (text >> shift) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            words = np.zeros(len(text) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ranks = np.r_[0, np.cumsum(np.bitwise_count(words))].astype(np.int64)
            zeros = int(len(text) - ranks[-1])
            self.levels.append((words, ranks, zeros))
            text = np.concatenate([text[bits == 0], text[bits == 1]])
            first = self._step(first, (start >> shift) & 1, level)
        self.first = first

    def _step(self, at: np.ndarray, bit: np.ndarray, level: int) -> np.ndarray:
        words, ranks, zeros = self.levels[level]
        word = at >> 6
        below = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        ones = ranks[word] + np.bitwise_count(below)
        return np.where(bit == 1, zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each `symbol` stands before the place `at`."""
        for level in range(self.depth):
            at = self._step(at, (symbol >> (self.depth - 1 - level)) & 1, level)
        return at - self.first[symbol]


class FMIndex:
    """An index of word pieces for backward search of patterns up to `depth` words.

    Sorting the suffixes to `depth` words is enough: intervals of shorter
    patterns are then contiguous, and the step to a longer pattern counts
    rightly whatever the order of equal contexts.
    """

    def __init__(self, words: np.ndarray, offsets: np.ndarray, depth: int) -> None:
        n = np.diff(offsets)
        self.piece = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        distinct, ids = np.unique(words, return_inverse=True)
        self.text = np.zeros(len(words) + len(n), np.int32)
        self.start = offsets[:-1] + np.arange(len(n))  # a 0 ends each piece
        inside = np.ones(len(self.text), bool)
        inside[self.start + n] = False
        self.text[inside] = ids + 1
        self.symbols = len(distinct) + 1
        rank, done = self.text, 1
        while done < depth:
            after = np.zeros(len(rank), np.int64)
            after[:-done] = rank[done:] + 1
            key = rank.astype(np.int64) * (int(rank.max()) + 2) + after
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            done *= 2
        order = np.argsort(rank, kind="stable")
        self.before = np.r_[0, np.cumsum(np.bincount(self.text, minlength=self.symbols))]
        self.bwt = WaveletMatrix(self.text[order - 1], self.symbols)
        self.source = self.piece[order]  # the piece of each suffix

    def matches(self, ends: np.ndarray, length: int, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs of `length` words that end at `ends`: those that occur twice at least, or are not `alone`; with their intervals."""
        lo, hi = self.before[self.text[ends]], self.before[self.text[ends] + 1]
        for back in range(1, length):
            keep = (hi - lo > 1) | ~alone
            ends, lo, hi, alone = ends[keep], lo[keep], hi[keep], alone[keep]
            c = self.text[ends - back]
            both = self.bwt.rank(np.r_[c, c], np.r_[lo, hi])
            lo, hi = self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]
        keep = (hi - lo > 1) | ~alone
        return ends[keep], lo[keep], hi[keep]


def _search(length: int):
    def shard(table: pa.Table) -> pa.Table:
        words, offsets = flat_lists(table.column("words"))
        f0, f1 = (table.column(c).to_numpy() for c in ("f0", "f1"))
        index = FMIndex(words, offsets, length)
        n = np.diff(offsets)
        runs = n - length + 1
        which = np.repeat(np.arange(len(n)), runs)
        ends = index.start[which] + np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs) + length - 1
        ends, lo, hi = index.matches(ends, length, (f0 == f1)[which])
        at, back = np.unique(lo, return_inverse=True)
        stop = np.zeros(len(at), np.int64)
        stop[back] = hi
        source = index.source
        edges = np.stack([at, stop], 1).ravel()
        least = np.minimum.reduceat(np.r_[f0[source], 0], edges)[::2] if len(at) else at
        most = np.maximum.reduceat(np.r_[f1[source], 0], edges)[::2] if len(at) else at
        ends = np.sort(ends[(least != most)[back]])
        piece = index.piece[ends]
        last = ends - index.start[piece]
        new = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (last[1:] > last[:-1] + length)]) if len(ends) else ends
        close = np.r_[new[1:], len(ends)] - 1 if len(ends) else ends
        key = table.column("key").to_numpy()
        return pa.table({
            "key": pa.array(key[piece[new]], pa.int64()),
            "lo": pa.array((last[new] - length + 1).astype(np.int32)),
            "hi": pa.array(last[close].astype(np.int32)),
        })

    return shard


def _slicer(length: int):
    """A function of word lists and their shared places: the pieces to index (start, shard, words), hot ones as single runs."""

    @F.arrow_udf("array<struct<start:int,shard:long,words:array<long>>>")
    def pieces(words: pa.Array, places: pa.Array) -> pa.Array:
        h, off = flat_lists(words)
        at = np.asarray(places.offsets).astype(np.int64)
        each = places.values.slice(at[0], at[-1] - at[0])
        at -= at[0]
        start, n, anchor, hot = (each.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "anchor", "hot"))
        runs = np.where(hot, n - length + 1, 1)
        which = np.repeat(np.arange(len(n)), runs)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))[which]
        first = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
        many = np.where(hot, length, n)[which]
        ends = np.cumsum(many)
        taken = h[np.repeat(off[row] + first - ends + many, many) + np.arange(many.sum())]
        m = mix(taken.view(np.uint64))
        own = mix(np.add.reduceat(m * (2 * (np.arange(len(m)) - np.repeat(ends - many, many)).astype(np.uint64) + np.uint64(1)), ends - many)) if len(m) else m
        shard = np.where(hot[which], own.view(np.int64), anchor[which])
        values = pa.StructArray.from_arrays(
            [pa.array(first.astype(np.int32)), pa.array(shard), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(taken))], ["start", "shard", "words"]
        )
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(runs)][at].astype(np.int32)), values)

    return pieces


def shared_spans(
    df: DataFrame, id_col: str = "passage_id", file_col: str = "file", text_col: str = "text", length: int = 12, gram: int = 6,
    shard_words: int = SHARD_WORDS, hot_words: int = HOT_WORDS,
) -> DataFrame:
    """Maximal stretches (id, first_word, last_word) in which every word is in a run of `length` words that another source has too.

    Words count from 1.  Rows with a null id, source or text have none, nor has
    a text of fewer than `length` words; runs within one source don't count.
    Runs that overlap or touch are one stretch.  Rows of one id and one text
    give its stretches once; of one id and several texts, the places covered in
    any of them.
    """
    spark = df.sparkSession
    cut = cutter(length, gram)
    units = (
        df.select(F.col(id_col).alias("id"), F.xxhash64(file_col).alias("f"), F.col(file_col).alias("file"), F.col(text_col).alias("t"))
        .filter("id is not null and file is not null and t is not null").filter(F.size(F.split("t", "[ \n]+")) >= length)
        .select("id", "f", "t", F.xxhash64("t").alias("u"))
    )
    places = units.select("id", "u", "f", F.explode(cut(word_hashes(F.col("t")))).alias("p")).select("id", "u", "f", "p.*")
    anchors = places.groupBy("anchor").agg(F.min("f").alias("f0"), F.max("f").alias("f1"), F.sum("n").alias("words"), F.sum(F.col("n") - length + 1).alias("runs"))
    hot = (F.col("words") > hot_words).alias("hot")
    anchors = written(anchors.filter("f0 <> f1").select("anchor", hot, F.when(hot, F.col("runs") * length).otherwise(F.col("words")).alias("words")), "span-anchors")
    shards = max(partitions(spark), -(-(anchors.agg(F.sum("words")).first()[0] or 0) // shard_words))

    # an id may have several texts, and a text of it several sources
    shared = places.select("id", "u", "start", "n", "anchor").join(anchors.select("anchor", "hot"), "anchor")
    shared = shared.groupBy("id", "u").agg(F.collect_set(F.struct("start", "n", "anchor", "hot")).alias("places"))
    pieces = units.join(shared, ["id", "u"]).select("id", "f", F.explode(_slicer(length)(word_hashes(F.col("t")), F.col("places"))).alias("p"))
    found = written(pieces.select("id", "f", "p.start", "p.words", "p.shard", F.xxhash64("p.words").alias("key")), "span-pieces")
    distinct = (
        found.groupBy("key", "shard").agg(F.first("words").alias("words"), F.min("f").alias("f0"), F.max("f").alias("f1"))
        .withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(shards)))
    )
    hits = distinct.groupBy("shard").applyInArrow(_search(length), "key long, lo int, hi int")
    spans = found.select("id", "start", "key").join(hits, "key").select("id", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    before = Window.partitionBy("id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spans.withColumn("new", F.coalesce(F.col("lo") > F.max("hi").over(before) + 1, F.lit(True)).cast("int"))
        .withColumn("stretch", F.sum("new").over(upto))
        .groupBy("id", "stretch").agg((F.min("lo") + 1).alias("first_word"), (F.max("hi") + 1).alias("last_word"))
        .select(F.col("id").alias(id_col), "first_word", "last_word")
    )


def shared_shares(df: DataFrame, id_col: str = "passage_id", file_col: str = "file", text_col: str = "text", length: int = 12) -> DataFrame:
    """One row per record with a text: its words, how many of them are shared, and the share (0 for a text without words)."""
    spans = shared_spans(df, id_col, file_col, text_col, length)
    sums = spans.groupBy(id_col).agg(F.sum(F.col("last_word") - F.col("first_word") + 1).alias("shared"), F.count("*").alias("stretches"))
    words = df.filter(F.col(text_col).isNotNull()).select(id_col, F.size(F.array_remove(F.split(text_col, "[ \n]+"), "")).alias("words"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return words.join(sums, id_col, "left").select(
        id_col, "words", zero("shared").alias("shared_words"), zero("stretches").alias("stretches"),
        F.when(F.col("words") > 0, zero("shared") / F.col("words")).otherwise(0.0).alias("share"),
    )
