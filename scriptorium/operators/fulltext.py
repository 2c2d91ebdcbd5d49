"""Full-text search: inverted index, conjunctive and phrase matching, BM25, snippets, top k.

A written index has four tables.  `postings` has a row for each token of the
searchable columns, with the length of its passage; it is partitioned by a hash
of the term and sorted by term, so that a query reads the row groups of its
terms and nothing else for the scores.  `terms` says how many passages have a
term.  `docstats` has the length of every passage, and `passages` are sorted by
their id, so that the k best are looked up by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text, input_terms, token_count, token_spans, tokens
from ..session import spread, written

COLUMNS = ("title", "author", "text")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Hash buckets of the written postings and terms, and files over which the postings of one term spread.
TERM_BUCKETS = 64
SPREAD = 8
#: Hits up to which passages are looked up by the ids found; more are joined.
LOOKED_UP = 1000


def postings(passages: DataFrame, id_col: str = "passage_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(term, passage_id, col, pos): every token of every searchable column; null columns have none."""
    return posted(passages, id_col, columns).drop("dl")


def posted(passages: DataFrame, id_col: str = "passage_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Postings with the length of their passage."""
    parts = F.array(*(F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("terms")) for c in columns))
    each = passages.select(F.col(id_col).alias("passage_id"), parts.alias("p"))
    length = F.aggregate("p", F.lit(0), lambda n, x: n + F.size(x["terms"])).alias("dl")
    each = each.select("passage_id", length, F.explode("p").alias("p")).select("passage_id", "dl", F.col("p.col").alias("col"), F.posexplode("p.terms").alias("pos", "term"))
    return each.select("term", "passage_id", "col", "pos", "dl")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def docstats(passages: DataFrame, id_col: str = "passage_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(passage_id, dl): tokens over all searchable columns, for every passage, also those without any."""
    return passages.select(F.col(id_col).alias("passage_id"), reduce(Column.__add__, (token_count(F.col(c)) for c in columns)).alias("dl"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(term, df, cf): passages that have the term, and its occurrences."""
    per = posted.groupBy("term", "passage_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def phrases_of(raw: str) -> list[list[str]]:
    """User input as phrases of folded tokens, one for each of its terms; empty if a term has no token, or there is none."""
    phrases = [[t for t, _, _ in token_spans(term)] for term in input_terms(raw)]
    return phrases if all(phrases) else []


@dataclass
class Index:
    """The tables a query reads; of a written index also its terms, how many passages there are, and how many tokens they have in all."""

    postings: DataFrame
    docstats: DataFrame
    passages: DataFrame
    terms: DataFrame | None = None
    known: tuple[int, int] | None = None

    @classmethod
    def over(cls, passages: DataFrame) -> Index:
        """No index but the passages themselves: a query scans them, and shuffles nothing but its hits."""
        return cls(postings(passages), docstats(passages), passages)

    @property
    def total(self) -> int:
        return self._totals()[0]

    @property
    def length(self) -> int:
        return self._totals()[1]

    def _totals(self) -> tuple[int, int]:
        return self.known or tuple(self.docstats.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def write(self, path: str) -> None:
        """The index as Parquet below `path`; a full rebuild replaces what was there.

        Texts are tokenised once for the postings; the terms come from these as
        they were written.
        """
        spark = self.passages.sparkSession
        rows = posted(self.passages).withColumn("bucket", bucket(F.col("term")))
        # the postings of a frequent term spread over several files
        spread = rows.repartition("bucket", F.pmod(F.xxhash64("passage_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "passage_id", "col", "pos")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        stats = term_stats(spark.read.parquet(f"{path}/postings")).withColumn("bucket", bucket(F.col("term")))
        stats.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        self.docstats.write.mode("overwrite").parquet(f"{path}/docstats")
        self.passages.repartitionByRange("passage_id").sortWithinPartitions("passage_id").write.mode("overwrite").parquet(f"{path}/passages")
        totals = spark.read.parquet(f"{path}/docstats").agg(F.count("*").alias("total"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
        totals.write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index | None:
        """A written index, or none if there is none."""
        try:
            read = {t: spark.read.parquet(f"{path}/{t}") for t in ("postings", "docstats", "passages")}
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        try:
            row, terms = spark.read.parquet(f"{path}/totals").first(), spark.read.parquet(f"{path}/terms")
        except Exception:  # an index that is still growing has neither
            row, terms = read["docstats"].agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first(), None
        return cls(read["postings"], read["docstats"], read["passages"], terms, (row[0], row[1]))

    def of_terms(self, terms: list[str]) -> DataFrame:
        """The postings of some terms, with the length of their passages."""
        return self._of(self.postings, terms)

    def document_frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many passages each term is."""
        rows = self._of(self.terms, terms) if self.terms is not None else term_stats(self.of_terms(terms))
        return dict.fromkeys(terms, 0) | {r.term: r.df for r in rows.select("term", "df").collect()}

    def _of(self, table: DataFrame, terms: list[str]) -> DataFrame:
        if "bucket" in table.columns:
            at = table.sparkSession.range(1).select(F.array(*(bucket(F.lit(t)) for t in terms))).first()[0]
            table = table.filter(F.col("bucket").isin(sorted(set(at))))
        return table.filter(F.col("term").isin(terms))

    def looked_up(self, ids: list[int]) -> DataFrame:
        """Some passages; a written index reads the row groups that may have them."""
        return self.passages.filter(F.col("passage_id").isin(ids))


def occurrences(index: Index, phrase: list[str]) -> DataFrame:
    """(passage_id, f, dl): how often a phrase stands in a passage, its tokens adjacent in one column, and the passage's length."""
    posted = index.of_terms(sorted(set(phrase)))
    if len(phrase) == 1:
        return posted.groupBy("passage_id").agg(F.count("*").alias("f"), F.first("dl").alias("dl"))
    # each token once for every place in the phrase where it stands
    places = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for k, t in enumerate(phrase)))
    at = posted.select("passage_id", "col", "pos", "dl", F.explode(F.filter(places, lambda x: x["t"] == F.col("term"))).alias("x"))
    whole = at.groupBy("passage_id", "col", (F.col("pos") - F.col("x.k")).alias("at")).agg(F.count("*").alias("n"), F.first("dl").alias("dl")).filter(F.col("n") == len(phrase))
    return whole.groupBy("passage_id").agg(F.count("*").alias("f"), F.first("dl").alias("dl"))


def scores(index: Index, raw: str) -> DataFrame:
    """(passage_id, score) of the passages that have all terms of `raw`; BM25 over all columns, higher is better.

    A term that is repeated counts as often; input without terms matches nothing.
    """
    phrases = phrases_of(raw)
    if not phrases:
        return index.docstats.select("passage_id", F.lit(0.0).alias("score")).limit(0)
    distinct = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
    times = [sum(p == q for q in phrases) for p in distinct]
    if index.known is None:
        return _scanned(index.passages, distinct, times)
    single = all(len(p) == 1 for p in distinct)
    if single:
        terms = [p[0] for p in distinct]
        found = index.of_terms(terms).select("passage_id", "dl", *(F.when(F.col("term") == t, 1).alias(f"f{k}") for k, t in enumerate(terms)))
    else:
        each = (occurrences(index, p).select("passage_id", "dl", *(F.when(F.lit(k) == j, F.col("f")).alias(f"f{j}") for j in range(len(distinct)))) for k, p in enumerate(distinct))
        found = reduce(DataFrame.union, each)
    have = found.groupBy("passage_id").agg(F.first("dl").alias("dl"), *(F.sum(f"f{k}").alias(f"f{k}") for k in range(len(distinct))))
    both = have.filter(reduce(Column.__and__, (F.col(f"f{k}").isNotNull() for k in range(len(distinct)))))
    total, length = index.known
    if single:
        df = index.document_frequencies(terms)
        hits = F.struct(*(F.lit(df[t]).alias(f"n{k}") for k, t in enumerate(terms)))
    else:  # phrases are counted: one row, a scalar subquery
        hits = have.agg(F.struct(*(F.count(f"f{k}").alias(f"n{k}") for k in range(len(distinct)))).alias("n")).scalar()
    # a subquery that is named several times is planned as often, so it becomes a column first
    score = _score(times, F.lit(float(total)), F.lit(length / total if total else 1.0), F.col("s"))
    return both.withColumn("s", hits).select("passage_id", score.alias("score"))


def _score(times: list[int], total: Column, average: Column, df: Column) -> Column:
    out = F.lit(0.0)
    for k, n in enumerate(times):
        hits, f = df[f"n{k}"], F.col(f"f{k}")
        idf = F.greatest(F.log((total - hits + 0.5) / (hits + 0.5)), F.lit(LEAST_IDF))
        out = out + n * idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / average))
    return out


def _scanned(passages: DataFrame, distinct: list[list[str]], times: list[int]) -> DataFrame:
    """The same scores from one scan of the passages: counted row by row, then a table of a few numbers per passage.

    A passage becomes one string, each token between two spaces and columns
    apart by a control character, in which phrases are counted, overlapping ones
    too.  (A U+0001 that stands alone in a text parts phrases there.)  The
    counts are written, since the statistics and the scores both need them.
    """
    whole = fold(F.concat_ws(" \x01 ", *(F.coalesce(F.col(c), F.lit("")) for c in COLUMNS)))
    padded = F.concat(F.lit(" "), F.regexp_replace(whole, r"[^\p{L}\p{N}\p{Co}\x01]+|(?<! )\x01|\x01(?! )", "  "), F.lit(" "))
    find = lambda p: F.regexp_count("s", F.lit("(?= " + "  ".join(p) + " )"))
    strings = spread(passages.select("passage_id", *COLUMNS)).select("passage_id", padded.alias("s"))
    counts = strings.select("passage_id", F.regexp_count("s", F.lit(r"[\p{L}\p{N}\p{Co}]+")).alias("dl"), *(find(p).alias(f"f{k}") for k, p in enumerate(distinct)))
    counted = written(counts, "scan-counts")
    fields = [F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"n{k}") for k in range(len(distinct))]
    stats = counted.agg(F.struct(F.count("*").cast("double").alias("total"), F.avg("dl").alias("average"), *fields).alias("s")).scalar()
    hits = counted.filter(reduce(Column.__and__, (F.col(f"f{k}") > 0 for k in range(len(distinct)))))
    return hits.withColumn("s", stats).select("passage_id", _score(times, F.col("s.total"), F.col("s.average"), F.col("s")).alias("score"))


def snippet(text: str | None, phrases: list[list[str]], size: int = 12, before: str = "<mark>", after: str = "</mark>", gap: str = " … ") -> str:
    """At most `size` tokens of a text around its best match, matches marked.

    Windows begin at a match, centred, or at the beginning of the sentence it
    is in; each phrase counts 1000 once and 1 again, a sentence start 100, the
    text's start 120; the first best wins.
    """
    text = text or ""
    spans = token_spans(text)
    words = [w for w, _, _ in spans]
    hits = sorted((i, k, len(p)) for k, p in enumerate(phrases) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)

    def weigh(start: int) -> tuple[int, int]:
        seen, score, first, last = set(), 0, -1, 0
        for i, k, n in hits:
            if start <= i < start + size:
                score += 1 if k in seen else 1000
                seen.add(k)
                first = i if first < 0 else first
                last = i + n
        middle = first - (size - (last - first)) // 2 if size >= last - first else first + ((last - first - size) // 2)
        return score, max(0, min(middle, len(words) - size))

    sentences = [0]
    for i in range(1, len(spans)):
        ahead = text[: spans[i][1]].rstrip(" \t\n\r")
        if ahead.endswith((".", ":")):
            sentences.append(i)
    best, start = 0, 0
    for i, _, _ in hits:
        score, centred = weigh(i)
        if score > best:
            best, start = score, centred
        if len(words) > size:
            begin = max((s for s in sentences if s <= i), default=0)
            if begin < i:
                score = weigh(begin)[0] + (120 if begin == 0 else 100)
                if score > best:
                    best, start = score, begin
    stop = start + size - 1
    marked: list[tuple[int, int]] = []
    for i, _, n in hits:
        if start <= i <= stop:
            if marked and i <= marked[-1][1]:
                marked[-1] = (marked[-1][0], max(marked[-1][1], i + n - 1))
            else:
                marked.append((i, i + n - 1))
    out, at = [gap if start > 0 else ""], spans[start][1] if start > 0 else 0
    for a, b in marked:
        b = min(b, stop)
        out += [text[at : spans[a][1]], before, text[spans[a][1] : spans[b][2]], after]
        at = spans[b][2]
    out.append(text[at:] if stop >= len(words) - 1 else text[at : spans[stop][2]] + gap)
    return "".join(out)


def snippets(text: Column, phrases: list[list[str]], size: int = 12) -> Column:
    @F.arrow_udf("string")
    def make(texts: pa.Array) -> pa.Array:
        return pa.array([snippet(t, phrases, size) for t in texts.to_pylist()], pa.string())

    return make(text)


def ranked(index: Index, raw: str, k: int = 50, among: DataFrame | None = None) -> DataFrame:
    """(rn, passage_id, score) of the k best passages, of those in `among` if given; ties, to ten decimals, by passage_id."""
    found = scores(index, raw).withColumn("score", F.round("score", 10))
    if among is not None:
        found = found.join(among.select("passage_id"), "passage_id", "left_semi")
    top = found.orderBy(F.desc("score"), "passage_id").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "passage_id")).alias("rn"), "passage_id", "score")  # of k rows


def search(index: Index, raw: str, k: int = 50) -> DataFrame:
    """The k best passages: (rn, passage_id, file, tree, ref, title, author, snippet, score)."""
    top = ranked(index, raw, k)
    if k <= LOOKED_UP:
        best = top.collect()
        found, top = index.looked_up([r.passage_id for r in best]), top.sparkSession.createDataFrame(best, "rn int, passage_id long, score double")
        rows = found.join(F.broadcast(top), "passage_id")  # k rows
    else:
        rows = index.passages.join(top, "passage_id")
    return rows.select("rn", "passage_id", "file", "tree", "ref", "title", "author", snippets(F.col("text"), phrases_of(raw)).alias("snippet"), "score").orderBy("rn")


def bm25(f: float, hits: int, total: int, dl: int, average: float) -> float:
    """The score of one phrase, for reference."""
    idf = max(math.log((total - hits + 0.5) / (hits + 0.5)), LEAST_IDF)
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / average))


__all__ = ["Index", "bm25", "docstats", "fold_text", "occurrences", "phrases_of", "postings", "ranked", "scores", "search", "snippet", "snippets", "term_stats"]
