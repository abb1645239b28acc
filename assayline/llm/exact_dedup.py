"""Exact deduplication by content sort, with DataFrame operations alone.

Sampled splitters range-partition the rows by the head of their normalised bytes, an
external sort places equal texts side by side, and the window that runs over the sorted
rows compares whole neighbouring texts. All copies of a text lie in one range, unless the
text has more than a range's share of the bytes: such a hot text is cut by salts, and its
parts, one row for each salt, are compared with each other as whole texts again. A head
that many unlike texts share is cut by the texts' hashes, which keep copies together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, few, shuffle_partitions

#: Bytes of a text that a splitter holds: bounds what sampling sends to the driver.
SPLITTER_BYTES = 64
#: Rows (some 100 bytes each) that a broadcast may have.
BROADCAST_ROWS = 100_000


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (i, t, c) with their range key: head p, and 0 or, for what is hot, hash q and salt s.

    Every head's and text's share of the bytes is counted, by 72 bytes a row; hot is what
    has more than one in so many parts as the shuffle has, so there are no more than that.
    """
    parts = shuffle_partitions(rows.sparkSession)
    headed = rows.select("i", "t", "c", F.substring(F.col("t").cast("binary"), 1, SPLITTER_BYTES).alias("p"), F.xxhash64("t").alias("x"))
    counts = cut(headed.groupBy("p", "x").agg(F.sum(F.octet_length("t") + F.lit(SPLITTER_BYTES)).cast("long").alias("w")))
    total = counts.agg(F.sum("w")).first()[0] or 0
    heads = counts.groupBy("p").agg(F.sum("w").alias("w")).filter(F.col("w") * parts > total).select(F.col("p").alias("hot_p"))
    texts = counts.filter(F.col("w") * parts > total).select(F.col("p").alias("hot_text"), F.col("x").alias("hot_x"), F.ceil(F.col("w") * parts / total).alias("salts"))
    by_head = headed.join(F.broadcast(cut(heads)), F.col("p") == F.col("hot_p"), "left")
    by_text = by_head.join(F.broadcast(cut(texts)), (F.col("p") == F.col("hot_text")) & (F.col("x") == F.col("hot_x")), "left")
    # Rows that repeat an id have their place in the input, too, to tell them apart.
    salt = F.pmod(F.xxhash64("i", F.monotonically_increasing_id()), F.col("salts"))
    return by_text.select("i", "t", "c", "p", F.when(F.col("hot_p").isNotNull(), F.col("x")).otherwise(0).alias("q"), F.coalesce(salt, F.lit(-1)).alias("s"))


def sorted_groups(rows: DataFrame, keep: str) -> DataFrame:
    """(i, h, r, top, n, s, g, t, c) for ``rows`` (i, t, c): what neighbours in the sorted order say.

    ``top`` and ``n`` are the best id and the size of the row's group of equal neighbours,
    ``r`` its place there and ``g`` the group's number. ``s`` is -1 for a group that is
    whole; else it is one of the parts of a hot text, whose first row has the text.
    """
    same = W.partitionBy("p", "q", "s", "t")
    first = F.col("i").asc_nulls_last() if keep == "smallest" else F.col("i").desc_nulls_last()
    ranged = _keyed(rows).repartitionByRange("p", "q", "s").withColumn("k", F.monotonically_increasing_id())
    r = F.row_number().over(same.orderBy(first))
    return cut(
        ranged.select(
            "i", "c", F.sha2("t", 256).alias("h"), r.alias("r"), F.first("i").over(same.orderBy(first)).alias("top"), F.count(F.lit(1)).over(same).alias("n"), "s",
            F.min("k").over(same).alias("g"), F.when((F.col("s") >= 0) & (r == 1), F.col("t")).alias("t"),
        )
    )


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are; without ``normalise`` nothing is
    changed. ``keep`` says whether the smallest or the largest id of a group stays. The
    digest is for the caller and decides nothing. ``carry`` names further columns of the
    result, small ones, worked out of the columns of ``docs``.

    A null text counts as empty, and empty texts form a group like any other. Long texts
    are compared whole. A null id stays only in a group without other ids (keep_id is then
    null). Of repeated rows (same id, same text) exactly one is kept. An empty table gives
    an empty result. Other columns of ``docs`` are not read, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = F.struct(*[c.alias(n) for n, c in carry.items()]) if carry else F.lit(None).cast("int")
    marks = sorted_groups(docs.select(F.col(id_col).alias("i"), (normalise(text) if normalise else text).alias("t"), carried.alias("c")), keep)
    # The parts of hot texts: no more than twice the parts of a shuffle, unless hashes meet.
    parts = marks.filter("s >= 0 AND r = 1").select("g", "top", "n", "t")
    whole = W.partitionBy("t")
    best = F.col("top").asc_nulls_last() if keep == "smallest" else F.col("top").desc_nulls_last()
    first = F.row_number().over(whole.orderBy(best, "g"))
    met = cut(parts.select("g", F.first("top").over(whole.orderBy(best, "g")).alias("best"), F.sum("n").over(whole).alias("size"), (first == 1).alias("leads")))
    out = marks.drop("t").join(few(met, BROADCAST_ROWS), "g", "left")
    return out.select(
        F.col("i").alias(id_col),
        F.when(F.col("size").isNull(), F.col("top")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("size", "n").alias("group_size"),
        ((F.col("r") == 1) & F.coalesce("leads", F.lit(True))).alias("kept"),
        F.col("h").alias("text_sha256"),
        *[F.col(f"c.{n}").alias(n) for n in carry or ()],
    )
