"""Documents into containers of fixed capacity by hierarchical residual packing (problem 6).

Sizes are dealt out to leaves, so that each has a like mixture of them however
the documents lie in their files.  A leaf packs its documents, best fit from
large to small, and emits the containers that are nearly full.  The others go
on as items: those of several leaves meet in one node of a tree, are packed
again, and so on up to the root.  No step moves a document; a join at the end
tells in which container each came to lie.

What a node carries on is bounded without a loss.  After best fit at most one
of its containers is half full or less, and of two fuller ones neither goes
into the other.  So with M nodes on a level at most M - 1 containers can still
come that go into one of its fuller ones; the M emptiest of these are as good
for that as all, and the others stay as they are.  Of n documents in all a
node sees a small multiple of the root of n at most: M is large only where
nodes are small.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count
from ..session import partitions, written

#: Documents of a leaf.
LEAF = 20_000
#: Share of the capacity from which a container is nearly full.
FULL = 0.99
#: Partitions, or nodes, that meet in a node.
FANOUT = 8
#: Kinds of containers that reach the driver and the tasks at a time; further ones take another pass.
KINDS = 1000


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, from 0: items from large to small, each into the fullest bin it fits in."""
    out = [0] * len(sizes)
    room: dict[int, list[int]] = {}  # bins by the room they have
    rooms: list[int] = []  # those rooms, sorted
    bins = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(rooms, sizes[i])
        if k < len(rooms):
            left = rooms[k]
            b = room[left].pop()
            if not room[left]:
                del room[left], rooms[k]
        else:
            left, b = capacity, bins
            bins += 1
        left -= sizes[i]
        if left in room:
            room[left].append(b)
        else:
            room[left] = [b]
            insort(rooms, left)
        out[i] = b
    return out


def _settle(bins: list[int], sizes: list[int], capacity: int, nodes: int) -> tuple[list[int], set[int]]:
    """How full each bin is, and which are carried on from one of so many nodes: one of half the capacity at most, and the emptiest others."""
    fill = [0] * (max(bins, default=-1) + 1)
    for b, n in zip(bins, sizes):
        fill[b] += n
    loose = sorted((f, b) for b, f in enumerate(fill) if f < FULL * capacity)
    return fill, {b for _, b in loose[: nodes + 1]}


LEAF_ROW = "container_kind string, capacity int, doc_id long, piece int, tokens int, bin long, node int, open boolean"


def _leaf(kinds: list[tuple[str, int]], leaf: int, leaves: int):
    def pack(docs: list[int | None], sizes: list[int], at: int, node: int) -> tuple[pa.RecordBatch, int]:
        columns: list[list] = [[] for _ in range(8)]
        for kind, capacity in kinds:
            ids, pieces, tokens = [], [], []
            for doc, n in zip(docs, sizes):
                for k in range(max(1, -(-n // capacity))):
                    ids.append(doc)
                    pieces.append(k + 1)
                    tokens.append(min(capacity, n - k * capacity))
            bins = best_fit(tokens, capacity)
            _, loose = _settle(bins, tokens, capacity, leaves)
            new = [kind] * len(ids), [capacity] * len(ids), ids, pieces, tokens, [at + b for b in bins], [node] * len(ids), [b in loose for b in bins]
            for column, values in zip(columns, new):
                column.extend(values)
            at += max(bins, default=-1) + 1
        types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
        names = [c.split()[0] for c in LEAF_ROW.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        at = node << 36
        docs, sizes = [], []
        for b in batches:
            docs += b.column("doc_id").to_pylist()
            sizes += b.column("n").to_pylist()
            while len(docs) >= 2 * leaf:
                out, at = pack(docs[:leaf], sizes[:leaf], at, node)
                yield out
                docs, sizes = docs[leaf:], sizes[leaf:]
        if docs:
            yield pack(docs, sizes, at, node)[0]

    return run


NODE_ROW = "container_kind string, capacity int, bin long, into long, tokens long, open boolean, node int"


def _node(nodes: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, capacity, node = (k.as_py() for k in key)
        order = sorted(zip(table.column("bin").to_pylist(), table.column("tokens").to_pylist()))
        ids, sizes = [b for b, _ in order], [n for _, n in order]
        bins = best_fit(sizes, capacity)
        fill, loose = _settle(bins, sizes, capacity, nodes)
        name: dict[int, int] = {}  # a container keeps the least id of what it is made of
        for b, i in zip(bins, ids):
            name.setdefault(b, i)
        return pa.table({
            "container_kind": pa.array([kind] * len(ids)), "capacity": pa.array([capacity] * len(ids), pa.int32()), "bin": pa.array(ids, pa.int64()), "into": pa.array([name[b] for b in bins], pa.int64()),
            "tokens": pa.array([fill[b] for b in bins], pa.int64()), "open": pa.array([b in loose for b in bins]), "node": pa.array([node] * len(ids), pa.int32()),
        })

    return run


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = "n_tokens") -> DataFrame:
    """(doc_id, n): tokens as delivered, counted where they are not; a text that is null has none."""
    counted = token_count(F.col(text_col))
    n = F.coalesce(F.col(tokens_col), counted) if tokens_col else counted
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(n.cast("int"), F.lit(0)).alias("n"))


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity, container, doc_id, piece, first_token, tokens): where each document of `sizes` lies.

    Every row of `sizes` is a document, also with equal or null ids, and lies in
    containers of every kind.  Only a document larger than the capacity is cut:
    into pieces of full containers and the rest; tokens count from 1.  A
    document without tokens lies in some container and takes no room.
    `container` is unique within its kind.  Kinds without a positive capacity
    are left out.
    """
    kinds = containers.filter("capacity > 0 and container_kind is not null").select("container_kind", "capacity").distinct()
    n, names = kinds.agg(F.count("*"), F.countDistinct("container_kind")).first()
    if names < n:
        raise ValueError("a kind of containers has two capacities")
    sizes = written(sizes.select("doc_id", "n"), "pack-sizes")
    blocks = -(-n // KINDS)
    packed = []
    for k in range(blocks):
        block = kinds.filter(F.pmod(F.xxhash64("container_kind"), F.lit(blocks)) == k).orderBy("container_kind")
        packed.append(_pack(sizes, [tuple(r) for r in block.collect()]))
    packed = reduce(DataFrame.unionAll, packed) if packed else sizes.limit(0).select(F.lit("").alias("container_kind"), F.lit(0).alias("capacity"), F.lit(0).cast("long").alias("bin"), "doc_id", F.lit(0).alias("piece"), "n")
    first = (F.col("piece") - 1) * F.col("capacity") + 1
    return packed.toDF("container_kind", "capacity", "container", "doc_id", "piece", "tokens").select("container_kind", "capacity", "container", "doc_id", "piece", first.alias("first_token"), "tokens")


def _pack(sizes: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """(container_kind, capacity, bin, doc_id, piece, tokens) for some kinds."""
    leaves = max(1, sizes.count() // LEAF)
    parts = min(leaves, 4 * partitions(sizes.sparkSession))
    # dealt out in turn, after a sort that makes it repeatable: every leaf gets all sizes
    items = written(sizes.repartition(parts).mapInArrow(_leaf(kinds, LEAF, leaves + parts), LEAF_ROW), "pack-leaves")
    open_ = items.filter("open").groupBy("container_kind", "capacity", "bin").agg(F.sum("tokens").alias("tokens"), F.first("node").alias("node"))
    moves = None
    nodes = parts
    while nodes > 1:
        nodes = -(-nodes // FANOUT)
        step = written(
            open_.withColumn("node", F.floor(F.col("node") / FANOUT).cast("int")).groupBy("container_kind", "capacity", "node").applyInArrow(_node(nodes), NODE_ROW), "pack-moves"
        )
        moved = step.select("container_kind", "bin", "into")
        moves = moved if moves is None else (
            moves.join(moved.select("container_kind", F.col("bin").alias("into"), F.col("into").alias("further")), ["container_kind", "into"], "left")
            .select("container_kind", "bin", F.coalesce("further", "into").alias("into"))
        )
        open_ = step.filter("open").select("container_kind", "capacity", F.col("into").alias("bin"), "tokens", "node").distinct()
    if moves is not None:
        items = items.join(moves, ["container_kind", "bin"], "left").withColumn("bin", F.coalesce("into", "bin"))
    return items.select("container_kind", "capacity", "bin", "doc_id", "piece", "tokens")


def usage(packed: DataFrame) -> DataFrame:
    """Per kind: documents' pieces, tokens, containers used, the least number any packing needs, and the share of room left unused."""
    each = packed.groupBy("container_kind", "capacity", "container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    sums = each.groupBy("container_kind", "capacity").agg(F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"))
    return sums.select(
        "container_kind", "capacity", "pieces", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"),
        (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused"),
    )
