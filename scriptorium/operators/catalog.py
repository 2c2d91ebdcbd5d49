"""The catalog of works: ids from paths, search by name, works grouped by author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, path_key, strip
from .ordered import OrderedGroups


def relative(path: Column, root: str) -> Column:
    """A path below `root`, relative to it."""
    return F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))


def author_id(file: Column) -> Column:
    """The first component of a relative path."""
    return F.split(file, "/")[0]


def work_id(file: Column) -> Column:
    """The second component, which is the file's own name where it lies right below its author; empty if there is none."""
    return F.coalesce(F.try_element_at(F.split(file, "/"), F.lit(2)), F.lit(""))


def resolved(path: Column) -> Column:
    """A slash-separated path without empty, `.` and `..` components; leading `..` that lead above the start stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(up, "/")


def inside(path: Column) -> Column:
    """Whether a relative path stays below its root; null and absolute paths do not."""
    r = resolved(path)
    return F.coalesce(~path.startswith("/") & ~r.startswith("../") & (r != "..") & (r != ""), F.lit(False))


def leads_inside(path: str) -> bool:
    """The same for one name, on the driver."""
    depth = 0
    for part in path.split("/"):
        depth += 0 if part in ("", ".") else -1 if part == ".." else 1
        if depth < 0:
            return False
    return depth > 0 and not path.startswith("/")


def works(df: DataFrame, file: str = "file") -> DataFrame:
    """(file, author_id, work_id, title, author), empty rather than null; one row for each row of `df` with a file."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.filter(F.col(file).isNotNull()).select(
        F.col(file).alias("file"), author_id(F.col(file)).alias("author_id"), work_id(F.col(file)).alias("work_id"), blank("title").alias("title"), blank("author").alias("author")
    )


def latest(df: DataFrame, order: str, key: str = "file") -> DataFrame:
    """Of the rows of one key the one with the greatest `order`; of equal ones any."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.col(order)).alias("r")).select(key, "r.*")


def name_search(catalog: DataFrame, raw: str, columns: tuple[str, ...] = ("title", "author", "file")) -> DataFrame:
    """Works of which a name contains the input, whatever the case; no input keeps all.  % and _ are ordinary characters."""
    q = strip(F.lit(raw))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(q))
    return catalog.filter((q == "") | hit)


def group_by_author(catalog: DataFrame) -> DataFrame:
    """(rank, author, id, n_works, works): authors by name, each with its works by title.

    A work without author goes under its author id; ids of one name merge, and
    the group's id is that of its first work in path order.  Ties in the order
    are settled by path.  A group is one row; where an author may have more
    works than fit in one, `author_works` has the same as flat rows.
    """
    key = first_filled(F.col("author"), F.col("author_id"))
    path = path_key(F.col("file"))
    shown = F.lower(first_filled(F.col("title"), F.col("file")))
    groups = (
        catalog.withColumn("key", key).groupBy("key").agg(
            F.min_by("author_id", path).alias("id"), F.min(path).alias("first"), F.count("*").alias("n_works"),
            F.array_sort(F.collect_list(F.struct(shown.alias("name"), path.alias("path"), "file", "work_id", "title"))).alias("works"),
        )
    )
    works_ = F.transform("works", lambda w: F.struct(w["file"].alias("file"), w["work_id"].alias("work_id"), w["title"].alias("title")))
    return groups.select(F.col("key").alias("author"), "id", "n_works", works_.alias("works"), "first")


def ordered_authors(groups: DataFrame) -> DataFrame:
    """Groups in the order of their names, ties by first path; a total sort, for the reader's page."""
    return groups.orderBy(F.lower("author"), "first")


def numbered_authors(groups: DataFrame) -> DataFrame:
    """The same with each group's `place` in that order."""
    keyed = groups.withColumns({"_all": F.lit(0), "_name": F.lower("author")})
    return OrderedGroups(keyed, ["_all"], ["_name", "first"]).numbered().drop("_all", "_name")


def in_order(works_of_authors: DataFrame) -> DataFrame:
    """The flat rows of `author_works` by author name and place: a range sort, which no author's rows need to fit in one task for."""
    return works_of_authors.orderBy(F.lower("author"), "author", "place")


def totals(catalog: DataFrame) -> DataFrame:
    """One row: authors, as they are grouped, and works."""
    key = first_filled(F.col("author"), F.col("author_id"))
    return catalog.groupBy(key.alias("key")).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_authors"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_works"))


def author_works(catalog: DataFrame) -> DataFrame:
    """(author, id, n_works, place, file, work_id, title): the groups as flat rows, `place` counting within the author."""
    key = first_filled(F.col("author"), F.col("author_id"))
    path = path_key(F.col("file"))
    shown = F.lower(first_filled(F.col("title"), F.col("file")))
    rows = catalog.withColumns({"key": key, "name": shown, "path": path})
    groups = rows.groupBy("key").agg(F.min_by("author_id", "path").alias("id"), F.count("*").alias("n_works"))
    placed = OrderedGroups(rows.select("key", "name", "path", "file", "work_id", "title"), ["key"], ["name", "path"]).numbered()
    return placed.join(groups, "key").select(F.col("key").alias("author"), "id", "n_works", "place", "file", "work_id", "title")
