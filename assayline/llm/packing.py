"""Packing token pieces into sequences: best fit, then swap-based local search.

Documents become pieces of at most one sequence; pieces are dealt by a hash into groups
of bounded size, and each group is packed by itself. The search exchanges pieces between
underfull bins, one for one or two for one, or moves them, whenever the sum of squared
fills rises; fuller bins leave emptier ones, until bins have nothing left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut
from .tokens import MergeCounter, Remembered

#: Pieces that one group holds on average, and so the most that is packed at once.
GROUP = 20_000


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: by falling size, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(k)
        else:
            b, room = len(bins), capacity
            bins.append([k])
        left = room - size
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def _parts(values: list[int], capacity: int) -> np.ndarray:
    """For each limit up to ``capacity`` the most that one or two of ``values`` come to within it."""
    distinct, times = np.unique(np.array(values, np.int64), return_counts=True)
    most = np.zeros(capacity + 1, np.int64)
    most[distinct] = distinct
    for k, x in enumerate(distinct.tolist()):
        pairs = x + distinct[k + (times[k] == 1) :]
        pairs = pairs[pairs <= capacity]
        if not len(pairs):
            break
        most[pairs] = pairs
    return np.maximum.accumulate(most)


def _taken(own: list[int], size: list[int], total: int) -> tuple[int, ...]:
    """One or two of the pieces ``own`` that come to ``total``."""
    seen: dict[int, int] = {}
    for x in own:
        if size[x] == total:
            return (x,)
    for x in own:
        if total - size[x] in seen:
            return seen[total - size[x]], x
        seen[size[x]] = x
    raise ValueError(total)


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The bins after exchanges; never more of them, and none above capacity.

    It ends when the bins are as few as their content allows, or when no exchange between
    any two underfull bins is left: each in turn, emptiest first, gives to the bin that is
    at least as full and gains most, until none gains. What an underfull bin could give to
    all others is looked up at once; bins that haven't changed since are not compared again.
    """
    size = [int(x) for x in sizes]
    fill = np.array([sum(size[x] for x in b) for b in bins], np.int64)
    least = -(-int(fill.sum()) // capacity)
    alive = int((fill > 0).sum())
    changed, settled, clock = np.zeros(len(bins), np.int64), np.full(len(bins), -1, np.int64), 0
    place = np.zeros(len(size), np.int64)
    moved = True
    while moved and alive > least:
        moved = False
        live = np.flatnonzero((fill > 0) & (fill < capacity))
        pieces = [x for b in live.tolist() for x in bins[b]]
        # What a bin can give up for what it gets: one of its pieces, or nothing.
        lost = np.concatenate([np.array([size[x] for x in pieces], np.int64), np.zeros(len(live), np.int64)])
        owner = np.concatenate([np.repeat(live, [len(bins[b]) for b in live.tolist()]), live])
        place[pieces] = np.arange(len(pieces))
        for source in live[np.argsort(fill[live], kind="stable")].tolist():
            most = None
            while 0 < fill[source] < capacity and alive > least:
                partner = (fill >= fill[source]) & (fill < capacity)
                partner[source] = False
                if changed[source] <= settled[source]:
                    partner &= changed > settled[source]
                at = np.flatnonzero(partner[owner])
                if not len(at):
                    break
                if most is None:
                    most = _parts([size[x] for x in bins[source]], capacity)
                gains = most[capacity - fill[owner[at]] + lost[at]] - lost[at]
                best = int(gains.argmax())
                gain, k = int(gains[best]), int(at[best])
                if gain <= 0:
                    break
                target = int(owner[k])
                into = _taken(bins[source], size, gain + int(lost[k]))
                out = (pieces[k],) if k < len(pieces) else ()
                for a, b, those in ((source, target, into), (target, source, out)):
                    for x in those:
                        bins[a].remove(x)
                        bins[b].append(x)
                        owner[place[x]] = b
                fill[target] += gain
                fill[source] -= gain
                clock += 1
                changed[source] = changed[target] = clock
                moved, most = True, None
                alive -= not bins[source]
            settled[source] = clock
    return [b for b in bins if b]


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(i, piece, start, length, ids_crc32): each document's ids and an end id, cut only beyond ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Remembered(MergeCounter(path))
        end = np.array([end_id], "<u4")
        for batch in bounded(batches, 1):
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(table.ids(batch.column(1))):
                ids = np.concatenate([ids.astype("<u4"), end])
                for p, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["i", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(run, f"i {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(
    docs: DataFrame,
    path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids of a document are those that the tokenizers library gives for the file at
    ``path``, without added tokens, and ``end_id``. Only a document longer than
    ``capacity`` is cut. Pieces lie in their sequence without gaps from offset 0.

    A null or empty text is one piece, the end id alone. Null ids and repeated rows are
    documents of their own; equal sizes go by the order in which rows come to a group.
    An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    pieces = cut(token_pieces(docs, path, capacity, end_id, id_col, text_col))
    whole = pieces.filter(F.col("length") == capacity)
    parts = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-parts.count() // GROUP))
    kind = pieces.schema["i"].dataType.simpleString()

    def packed(table: pa.Table) -> list[pa.RecordBatch]:
        sizes = table.column("length").to_numpy()
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for k, members in enumerate(pack(sizes, capacity)):
            sequence[members], offset[members] = k, np.cumsum(sizes[members]) - sizes[members]
        sequence = sequence * groups + table.column("g")[0].as_py()
        out = table.drop_columns("g").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            group = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and group[a] != now:
                    if parts:
                        yield from packed(pa.Table.from_batches(parts))
                    now, parts = group[a], []
                if a < b:
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield from packed(pa.Table.from_batches(parts))

    # A row's group depends on its id, place and content; repeated rows spread by their rank.
    group = F.pmod(F.xxhash64("i", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    placed = parts.select(group.alias("g"), "*").repartition("g").sortWithinPartitions("g", "i", "piece", "ids_crc32")
    packed_rows = placed.mapInArrow(run, f"i {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed_rows.unionByName(alone).withColumnRenamed("i", id_col)
