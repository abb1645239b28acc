"""The registered queries and the pipeline on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from assayline.llm import exact_dedup, queries
from assayline.llm.tokens import MergeCounter, Remembered, vocabulary_path

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    cursor = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    assert got == sorted(([plain(r[order.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline(spark):
    """Each stage against what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    rows = lambda df: [tuple(r) for r in df.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "source mix", "packing"]
    toxic, exact, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)

    more = spark.read.parquet(f"{LARGER}/documents.parquet")  # the smallest tables have 11 toxic rows
    clean = toxic(spark, more, LARGER)
    assert clean.columns == columns and set(rows(clean)) < set(rows(more))
    gone = {r.doc_id for r in more.collect()} - {r.doc_id for r in clean.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    known = [labels[i] for i in gone if i in labels]
    assert len(known) > 20 and sum(known) > 0.9 * len(known)
    doubled = docs.unionByName(docs.limit(3)).cache()
    once = rows(exact(spark, doubled, SF))
    smallest = {}
    for r in docs.collect():
        smallest[r.text] = min(r.doc_id, smallest.get(r.text, r.doc_id))
    assert sorted(r[0] for r in once) == sorted(smallest.values())
    kept = near(spark, docs, SF)
    assert kept.columns == columns and len({r.text for r in kept.collect()}) == kept.count() <= len(once)
    mixed = mix(spark, docs, SF).cache()
    assert mixed.columns == columns and set(rows(mixed)) <= set(rows(docs))
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(mixed) - words(docs)) < 0.1 * words(docs)
    packed = pack(spark, mixed, SF).collect()
    import pyarrow as pa

    texts = [r.text for r in mixed.collect()]
    total = sum(n + 1 for n in Remembered(MergeCounter(vocabulary_path("word_bpe_49k.json"))).counts(pa.array(texts)))
    assert sum(r.length for r in packed) == total


def test_exact_stage_keeps_texts_of_one_id(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "b", "en", "s", 1), (2, "a", "en", "s", 1), (None, None, None, None, None), (1, "b", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.without_copies(spark, docs, SF).collect()), key=str)
    assert got == [(1, "a"), (1, "b"), (None, None)]
    assert len(exact_dedup.content_sort(docs).collect()) == 5
