"""From raw documents to packed training sequences.

Five stages, each one operator applied to all that the stage before it kept: toxic
documents go, then all but one of equal texts, then all but one of each group of near
duplicates; sources are mixed to their weights, a document standing in the result as
often as the mix takes it; and what is left is packed. A document is a doc_id and its
text; rows that are alike in both are the same one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import exact_dedup, mixing, near_dedup, packing, tokens, toxicity, warc
from assayline.llm.common import cut, few, shared_folder, table
from assayline.llm.queries import held_out

#: Rows of ids (some 80 bytes each) that a broadcast may have; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


class Own:
    """A stage's documents under names of its own, c0, c1, ..., so that no column of theirs
    can clash with another; ``back`` gives a frame with these columns the names they had."""

    def __init__(self, docs: DataFrame) -> None:
        self.columns = docs.columns
        self.names = [f"c{k}" for k in range(len(docs.columns))]
        self.docs = docs.toDF(*self.names)

    def of(self, column: str) -> str:
        return self.names[self.columns.index(column)]

    def pick(self, *columns: str) -> DataFrame:
        """These columns alone, under the names that they had."""
        return self.docs.select(*[F.col(self.of(c)).alias(c) for c in columns])

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*self.names).toDF(*self.columns)

    def key(self) -> tuple[Column, Column]:
        """What tells rows apart: id, and hash of the text; rows alike in both are one document."""
        return F.col(self.of("doc_id")), F.xxhash64(F.coalesce(F.col(self.of("text")).cast("string"), F.lit("")))

    def found(self) -> Column:
        """The join condition with a frame that has (i, x)."""
        i, x = self.key()
        return i.eqNullSafe(F.col("i")) & (x == F.col("x"))


def _without(own: Own, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """The documents but for those that ``gone`` (i, x) names, and one each of ``repeated`` (i, x)."""
    out = own.docs.join(few(cut(gone), BROADCAST_ROWS), own.found(), "left_anti")
    repeated = cut(repeated)
    if repeated.isEmpty():
        return own.back(out)
    marked = few(repeated, BROADCAST_ROWS)
    once = out.join(marked, own.found(), "left_semi").dropDuplicates([own.of("doc_id"), own.of("text")])
    return own.back(out.join(marked, own.found(), "left_anti").unionByName(once))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on labelled rows that aren't held out, rejects.

    A null or empty text has the score of a text without known words; repeated rows are
    judged alike, long texts whole; an empty table stays empty. Other columns are kept,
    whatever their names, and don't count.
    """
    own = Own(docs)
    model = toxicity.train(own.pick("doc_id", "text"), table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return own.back(toxicity.clean(own.docs, model, own.of("text")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, the one with the smallest doc_id.

    A null text is empty and empty texts are copies of each other; a null id stays only in
    a group without others. Of rows that repeat id and text one stays; unlike texts of one
    id are apart. Long texts are compared whole; an empty table stays empty; other columns
    are kept, whatever their names.
    """
    own = Own(docs)
    i, x = own.key()
    marks = exact_dedup.content_sort(own.docs, own.of("doc_id"), own.of("text"), keep="smallest", carry={"x": x})
    marks = cut(marks.select(i.alias("i"), "x", "kept", i.eqNullSafe(F.col("keep_id")).alias("first")))
    return _without(own, marks.filter("NOT kept AND NOT first").select("i", "x"), marks.filter("NOT kept AND first").select("i", "x").distinct())


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8).

    Texts without words and rows with a null id are in no group and stay. Of rows that
    repeat id and text one stays; unlike texts of one id have links of their own. Long
    texts are compared whole; an empty table stays empty; other columns are kept, whatever
    their names.
    """
    own = Own(docs)
    marks = cut(near_dedup.near_duplicates(own.pick("doc_id", "text")).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("x"), "kept", (F.col("n_shingles") > 0).alias("words")))
    alike = marks.filter("kept AND words AND i IS NOT NULL").groupBy("i", "x").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("i", "x")
    return _without(own, marks.filter("NOT kept").select("i", "x").distinct(), alike)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A document without words has size 0 and is taken as its place in its source says. Rows
    that are alike in id, text and source share what the mix takes of them evenly. A null
    source is a source; long texts are counted whole; an empty table stays empty; other
    columns are kept, whatever their names.
    """
    own = Own(docs)
    source = F.col(own.of("source"))
    taken = mixing.mix(own.pick("doc_id", "text", "source")).groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("x"), F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("all"))
    joined = own.docs.join(few(cut(taken.filter("all > 0")), BROADCAST_ROWS), own.found() & source.cast("string").eqNullSafe(F.col("s")))
    # The rows come from files, so their numbers stay the same when they are read again.
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("rows"))
    times = F.floor(F.col("all") / F.col("rows")) + F.when(draw < F.pmod(F.col("all"), F.col("rows")), 1).otherwise(0)
    often = joined.withColumn("times", times.cast("long")).filter("times > 0")
    return own.back(often.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a row for each piece.

    Cases as for ``packing.best_fit_pack``, which reads doc_id and text alone.
    """
    return packing.best_fit_pack(Own(docs).pick("doc_id", "text"), tokens.vocabulary_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("source mix", mixed),
    ("packing", packed),
]

#: Training a classifier, MinHash and tokenizing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; between stages the rows are Parquet in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        warc.remove(spark, folder)
