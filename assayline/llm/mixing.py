"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; within a source
the documents come in the order of their keys, and the prefix sums of their sizes are
held against the source's token budget. What a target asks beyond whole multiples of
the source is taken in that order; the multiples themselves are complete epochs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, cut
from .tokens import text_bytes

#: Sources (some 50 bytes each) that a broadcast may have.
BROADCAST_ROWS = 100_000
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(i, source, x, size, quality): hash and words of each text, and its share of letters, from 0.01 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            texts = text_bytes(batch.column(2))
            words = [len(t.split()) for t in texts]
            letters = [len(t) - len(t.translate(None, _LETTERS)) for t in texts]
            solid = [len(t.translate(None, b" \t\n\r\x0b\x0c")) for t in texts]
            quality = [max(0.01, a / b) if b else 0.01 for a, b in zip(letters, solid, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(words, pa.int64()), pa.array(quality, pa.float64())], names=["i", "source", "x", "size", "quality"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("x", F.xxhash64("t"))
    return rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, source string, x long, size long, quality double")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes`` (one row a source: source, n, source_size) with its target.

    Sources in code point order, null last, have the weights in turn and share all
    words; a target stops at ``most`` times its source, and the excess goes to the
    others by weight until none is above. Capped sources are those first in the order
    of cap over weight, so one pass over cumulative sums finds them. The pass is one
    task's, over one row of some 50 bytes for each source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    turn = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(turn, (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    up = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    onward = up.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    sums = (
        weighed.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(onward))
        .withColumn("capped", F.col("cap") * F.col("shares") <= F.col("weight") * F.col("left"))
    )
    # The first source that isn't capped has what remains for all behind it.
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "left", "shares"))).over(everything)
    return sums.withColumn("first", first).select(
        "source", "n", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("first.left")).cast("double") / F.col("first.shares").cast("double")).alias("target"),
    )


def unit(seed: int, key: Column) -> Column:
    """A number above 0 and below 1 that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 0,
) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken, copies, source, text_hash.

    ``copies`` is how often the mix has the whole document and ``taken`` its words times
    that, at most ``most`` times its size. ``text_hash`` is Spark's ``xxhash64`` of the text. The document in which a source's budget ends
    is taken if that comes nearer to the target.

    A null text has size 0; long texts are counted whole. A null source is a source, last
    in order. Rows with equal keys (repeated or null ids) come in the order of their sizes. A source without words has
    target 0. An empty table gives an empty result. Other columns are not read.
    """
    # The checkpoint fixes the rows' places, by which rows alike in all else are told apart.
    rows = cut(measured(docs, id_col, text_col, source_col).withColumn("u", unit(seed, F.col("i"))).withColumn("at", F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    aims = cut(targets(sizes, weights, most))
    aims = aims.select(F.col("source").alias("aim"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"))
    aims = F.broadcast(aims) if aims.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else aims
    keyed = rows.join(aims, F.col("source").eqNullSafe(F.col("aim"))).select("i", "source", "x", "size", "source_size", "target", "epochs", (-F.log("u") / F.col("quality")).alias("key"), "at")
    # Sampled splitters cut a large source into ranges of keys, and rows of one id as well; range k comes before k + 1.
    order = [F.col("key"), F.col("i").asc_nulls_last(), F.col("size"), F.col("at")]
    ranged = cut(keyed.repartitionByRange(F.col("source"), *order).withColumn("range", F.spark_partition_id()))
    starts = ranged.groupBy("source", "range").agg(F.sum("size").alias("words")).select(
        F.col("source").alias("s2"), F.col("range").alias("r2"),
        (F.sum("words").over(W.partitionBy("source").orderBy("range")) - F.col("words")).alias("ahead"),
    )
    within = W.partitionBy("source", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranged.withColumn("upto", F.sum("size").over(within)).join(starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (F.col("epochs") < most) & (F.col("ahead") + F.col("upto") - F.col("size") / 2 <= budget)
    copies = F.col("epochs") + chosen.cast("long")
    return placed.select(F.col("i").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", F.col("x").alias("text_hash"))
