"""That texts are told apart by content: hashes that meet, repeated ids, hot texts."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayline.llm import exact_dedup, near_dedup, packing, tokens

PATH = tokens.vocabulary_path("word_bpe_49k.json")


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text[:n]


#: Strings that a polynomial modulo a power of two can't tell apart.
PAIR = [thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def equal_the_library(library, texts):
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    table = tokens.Remembered(tokens.MergeCounter(PATH))
    column = pa.array(texts, pa.string())
    for _ in range(2):
        assert table.counts(column) == [len(x) for x in want]
        assert [x.tolist() for x in table.ids(column)] == want
    return table


def test_strings_that_polynomials_confuse(spark, library):
    equal_the_library(library, [*PAIR, f"w {PAIR[0]} {PAIR[1]} z"])
    df = spark.createDataFrame(list(enumerate(PAIR)), "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in packing.best_fit_pack(df, PATH).collect()}
    import zlib

    for k, t in enumerate(PAIR):
        assert got[k] == zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert {r.component_id for r in near_dedup.near_duplicates(df).collect()} == {0, 1}


def test_chunks_whose_hashes_meet(library, monkeypatch):
    """With a hash of three values nearly all chunks meet another's; their bytes decide."""
    located = tokens.located

    def weak(*args, **options):
        found = located(*args, **options)
        found.hashes = found.hashes % np.uint64(3)
        return found

    monkeypatch.setattr(tokens, "located", weak)
    texts = [f"word{k} and others, {'x' * (k % 40)} {k * 7919}" for k in range(60)] + [None, "", "word1"]
    assert equal_the_library(library, texts).odd


def test_very_long_pre_tokens(library):
    rnd = random.Random(0)
    letters = lambda n, low, high: "".join(chr(rnd.randrange(low, high)) for _ in range(n))
    equal_the_library(library, [letters(20_000, 97, 107), letters(8_000, 0x4E00, 0x5E00), "ab" * 5000, "a" * 9001, "é" * 4000 + " short " + "z" * 2500])


def test_links_whose_hashes_meet(spark, monkeypatch):
    """A link that hashes propose is confirmed by the words."""
    texts = [" ".join(f"{c}{k}" for k in range(40)) for c in "ab"]
    shingled = [near_dedup.Shingled(t, 2) for t in texts]
    same = [near_dedup.Shingled(t, 2, np.arange(39, dtype=np.uint64)) for t in texts]
    assert not shingled[0].similar(shingled[1], 80) and not same[0].similar(same[1], 80)
    assert same[0].similar(near_dedup.Shingled(texts[0].upper() + " more", 2, np.arange(40, dtype=np.uint64)), 80)


def test_unlike_texts_of_one_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(3, a + " end"), (7, a), (7, b), (7, b), (9, b + " end"), (None, a)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == [(3, 3, True), (7, 3, False), (7, 7, True), (7, 7, True), (9, 7, False), (None, None, True)]


def test_very_long_near_copies(spark):
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    other = list(words)
    for k in range(0, 60_000, 100):
        other[k] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_copies_meet_as_neighbours(spark):
    """All copies of a text lie in one group of neighbours, but for texts that are hot."""
    rnd = random.Random(0)
    common = "a head that many unlike texts share, longer than a splitter is by itself: "
    rows = [(k, "hot text " * 20) for k in range(900)] + [(2000 + k, f"text {rnd.randrange(400)} " * 9) for k in range(1200)]
    rows += [(5000 + k, common + str(rnd.randrange(500))) for k in range(1000)] + [(9000 + k, None) for k in range(3)]
    df = spark.createDataFrame(rows, "i long, t string").fillna("").withColumn("c", F.lit(None)).repartition(6)
    marks = exact_dedup.sorted_groups(df, "smallest")
    whole = collections.defaultdict(set)
    hot = collections.defaultdict(set)
    for r in marks.collect():
        (whole if r.s < 0 else hot)[r.h].add(r.g)
    assert len(whole) > 800 and all(len(g) == 1 for g in whole.values())
    assert len(hot) == 1 and len(next(iter(hot.values()))) > 1
    got = {r.doc_id: r for r in exact_dedup.content_sort(df.select(F.col("i").alias("doc_id"), F.col("t").alias("text"))).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for ids in groups.values():
        assert all((got[i].keep_id, got[i].group_size, got[i].kept) == (min(ids), len(ids), i == min(ids)) for i in ids)


def test_hot_repeats_of_one_row(spark):
    """Rows that repeat both id and text, too many for one range."""
    df = spark.createDataFrame([(1, "same")] * 500 + [(None, "same")] * 500 + [(2, "other")], "doc_id long, text string").repartition(5)
    got = exact_dedup.content_sort(df).collect()
    assert [(r.doc_id, r.group_size) for r in got if r.kept] in ([(1, 1000), (2, 1)], [(2, 1), (1, 1000)])
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 1000), (2, 1)}
