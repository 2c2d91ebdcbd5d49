"""Evaluation texts in training text, by suffix arrays of the training text (problem 7).

Training documents are taken in shards of bounded size.  A shard's suffix
array holds its suffixes, sorted as deep as the shortest match that counts;
suffixes that begin with a word no test item has, or meet one before that
depth, can't match and are left out.  Every suffix of every test item is looked
up by binary search, word after word, all at once; the places found are
extended to the longest verbatim match, and of each match only the place where
it begins is kept.

The test items go to all tasks, in blocks of bounded size: one block for a
usual benchmark, as many passes over the training text as needed beyond that.
A pass ends before the next begins, so that the driver and the tasks hold one
block at a time, and the training text is split and hashed once for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .neardup import flat_lists

#: Words of test items in a block: 32 MB in each task.
BLOCK_WORDS = 1 << 22
#: Words of training text in a shard.
SHARD_WORDS = 1 << 21
#: Places extended at a time.
PLACES = 1 << 20

MATCH = "doc long, item long, words int, doc_word int, item_word int"


def letters_and_digits(text: Column) -> Column:
    """Hashes of the runs of letters and digits of the lower-cased text, in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


class TestItems:
    """The test side: items one after another, each followed by a stop that equals nothing."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> None:
        self.ids, self.vocabulary = ids, np.unique(words)
        n = np.diff(offsets)
        self.start = offsets[:-1] + np.arange(len(n))
        self.item = np.repeat(np.arange(len(n)), n + 1)
        self.text = np.full(len(words) + len(n) + 1, -1, np.int64)
        inside = np.ones(len(words) + len(n), bool)
        inside[self.start + n] = False
        self.text[:-1][inside] = np.searchsorted(self.vocabulary, words) + 1
        self.left = (self.start + n)[self.item] - np.arange(len(self.item))  # words from each place to the item's end


class SuffixArray:
    """Suffixes of a shard that may match, sorted to `depth` words.

    `text` holds 0 for words outside the vocabulary and between documents.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text = np.r_[text, np.zeros(depth, np.int64)]
        stop = np.flatnonzero(self.text == 0)
        run = stop[np.searchsorted(stop, np.arange(len(text)))] - np.arange(len(text))
        at = np.flatnonzero(run >= depth)
        keys = [self.text[at + k] for k in range(depth)]
        width = max(1, int(self.text.max(initial=1)).bit_length())
        per = max(1, 63 // width)  # words packed in one sort key
        packed = []
        for k in range(0, depth, per):
            key = np.zeros(len(at), np.int64)
            for word in keys[k : k + per]:
                key = (key << width) | word
            packed.append(key)
        self.order = at[np.lexsort(packed[::-1])] if len(at) else at

    def search(self, test: TestItems, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Test suffixes with the interval of training suffixes that share their first `depth` words."""
        suffix = np.flatnonzero(test.left[: len(test.item)] >= depth)
        lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(self.order), np.int64)
        for k in range(depth):
            want = test.text[suffix + k]
            lo, hi = self._bound(lo, hi, k, want, False), self._bound(lo, hi, k, want, True)
            keep = hi > lo
            suffix, lo, hi = suffix[keep], lo[keep], hi[keep]
        return suffix, lo, hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, k: int, want: np.ndarray, after: bool) -> np.ndarray:
        """First place in lo..hi whose word k is not below `want` (not up to it, if `after`)."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            word = self.text[self.order[mid] + k]
            right = word <= want[open_] if after else word < want[open_]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]


def _matches(test: TestItems, length: int):
    def shard(ids: list[np.ndarray], words: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc_ids, h, n = np.concatenate(ids), np.concatenate(words), np.concatenate(sizes)
        start = np.r_[0, np.cumsum(n + 1)[:-1]] + 1  # a 0 stands before each document
        text = np.zeros(len(h) + len(n) + 1, np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(h)) + doc + 1
        slot = np.searchsorted(test.vocabulary, h)
        known = test.vocabulary[np.minimum(slot, len(test.vocabulary) - 1)] == h
        text[at[known]] = slot[known] + 1
        array = SuffixArray(text, length)
        suffix, lo, hi = array.search(test, length)
        upto = np.cumsum(hi - lo)
        done = 0
        while done < len(suffix):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PLACES, side="right")))
            many = (hi - lo)[done:stop]
            q = np.repeat(suffix[done:stop], many)
            p = array.order[np.repeat(lo[done:stop], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            first = (q == 0) | (test.text[q - 1] != array.text[p - 1])
            q, p = q[first], p[first]
            long = np.full(len(q), length)
            more = np.arange(len(q))
            while len(more):
                a, b = q[more] + long[more], p[more] + long[more]
                more = more[(test.text[a] == array.text[np.minimum(b, len(array.text) - 1)])]
                long[more] += 1
            d = np.searchsorted(start, p, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids[d]), pa.array(test.ids[test.item[q]]), pa.array(long.astype(np.int32)),
                    pa.array((p - start[d] + 1).astype(np.int32)), pa.array((q - test.start[test.item[q]] + 1).astype(np.int32)),
                ],
                ["doc", "item", "words", "doc_word", "item_word"],
            )
            done = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, sizes, total = [], [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            h, off = flat_lists(b.column("h"))
            ids.append(b.column("doc").to_numpy())
            words.append(h)
            sizes.append(np.diff(off))
            total += len(h)
            if total >= SHARD_WORDS:
                yield from shard(ids, words, sizes)
                ids, words, sizes, total = [], [], [], 0
        if ids:
            yield from shard(ids, words, sizes)

    return run


def leaks(
    corpus: DataFrame, tests: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", doc_text: str = "text", item_text: str = "text", length: int = 12
) -> DataFrame:
    """Maximal verbatim matches of at least `length` words: (doc, item, words, doc_word, item_word); places count from 1.

    Words are the runs of letters and digits of the lower-cased texts.  Rows
    with a null id or text match nothing, nor do texts of fewer words.  Ids
    may repeat; their matches then do.
    """
    spark = corpus.sparkSession
    docs = (
        corpus.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("t")).filter("doc is not null and t is not null")
        .select("doc", letters_and_digits(F.col("t")).alias("h")).filter(F.size("h") >= length)
    )
    items = (
        tests.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("t")).filter("item is not null and t is not null")
        .select("item", letters_and_digits(F.col("t")).alias("h")).filter(F.size("h") >= length)
    )
    total = items.agg(F.sum(F.size("h"))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    if blocks > 1:  # hashed once for all passes
        docs = written(docs, "leak-words")
    found = []
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow()
        if not block.num_rows:
            continue
        h, off = flat_lists(block.column("h"))
        shared = spark.sparkContext.broadcast(TestItems(block.column("item").to_numpy(), h, off))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return _matches(shared.value, length)(batches)

        matches = docs.mapInArrow(run, MATCH)
        if blocks > 1:  # one block at a time in memory, on the driver and in the tasks
            matches = written(matches, "leak-matches")
            shared.destroy()
        found.append(matches)
    if not found:
        return spark.createDataFrame([], MATCH)
    return reduce(DataFrame.unionAll, found)


def leaked(corpus: DataFrame, tests: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents and items with at least 12 consecutive words in common."""
    return leaks(corpus, tests).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def longest_leaks(corpus: DataFrame, tests: DataFrame) -> DataFrame:
    """For each such pair its longest match and where it begins (the first in the document, of equal ones)."""
    best = leaks(corpus, tests).groupBy("doc", "item").agg(
        F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m"), F.count("*").alias("matches")
    )
    return best.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("m.words").alias("words"),
        (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"), "matches",
    )


def without_leaks(corpus: DataFrame, tests: DataFrame) -> DataFrame:
    """The corpus without the documents that hold a test passage; rows with a null id stay."""
    return corpus.join(leaked(corpus, tests).select("doc_id").distinct(), "doc_id", "left_anti")
