"""Counts and ids against the tokenizers library; packing and mixing against their rules."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from assayline.llm import mixing, packing, tokens

PATH = tokens.vocabulary_path("word_bpe_49k.json")
ODD = [
    "", "  ", "a\x1cb c\x85d e\xa0f", "ΑΣ Σ ΟΔΟΣ'S", "İstanbul I'LL we've DON'T", "aaaaaaa aaaa!!!!!!! 1234567 ½²", "<|endoftext|> x<|startoftext|>y<|endoftext|>z", "日本語テキスト 👩‍👩‍👧",
    "é é ſ ﬁ Å Ω", " x y​z", "a" * 5000, "ab" * 3000 + " " + "!" * 999, "'s't're it's'", "\x00\x01 ﻿­", "ǅ ᾳ ẞ Ⓐ Ⅷ", "₏₝ x",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(3)
    ranges = [(32, 127), (0xA0, 0x250), (0x370, 0x530), (0x2000, 0x2100), (0x300, 0x370), (0x1E00, 0x2000), (9, 14)]
    return ODD + ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(60)) for _ in range(400)]


def test_counts_and_ids_equal_the_library(library):
    want = [e.ids for e in library.encode_batch(texts(), add_special_tokens=False)]
    table = tokens.Remembered(tokens.MergeCounter(PATH))
    column = pa.array(texts(), pa.string())
    for _ in range(2):  # the second time from the table
        assert table.counts(column) == [len(x) for x in want]
        assert [x.tolist() for x in table.ids(column)] == want


def test_count_tokens(spark, library):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts()[:100])] + [(None, None, "x", 1), (7, "again " * 3000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, i string, n int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, PATH).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)
    assert tokens.count_tokens(df.limit(0), PATH).collect() == []


def test_pair_table():
    rng = np.random.default_rng(0)
    keys = rng.choice(10**9, 5000, replace=False).astype(np.int64)
    table = tokens.PairTable(keys)
    assert (table.find(keys) == np.arange(5000)).all()
    assert (table.find(keys + 10**10) == np.iinfo(np.int32).max).all()


def test_packing(spark, library):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(int(rnd.paretovariate(0.6)) % 900)), 1) for k in range(400)] + [(999, None, 1), (998, "long " * 1000, 1), (3, "x", 1), (3, "x", 1), (2**60 + 1, "far", 1), (None, "nul", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.best_fit_pack(df, PATH, capacity=256).collect()
    ids = collections.defaultdict(list)
    for i, t, _ in rows:
        ids[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r.length for r in got) == total
    pieces = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = collections.Counter()
    for i, docs in ids.items():
        for x in docs:
            for p, a in enumerate(range(0, len(x), 256)):
                own = np.array(x[a : a + 256], "<u4")
                want[i, p, a, len(own), zlib.crc32(own.tobytes())] += 1
    assert pieces == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(sequences) <= -(-total // 256) + 2
    assert packing.best_fit_pack(df.limit(0), PATH).collect() == []


def test_local_search():
    rng = np.random.default_rng(0)
    sizes = rng.integers(200, 2000, 600)
    bins, fill = [], 4097
    for k, x in enumerate(sizes.tolist()):
        if fill + x > 4096:
            bins, fill = [*bins, []], 0
        bins[-1].append(k)
        fill += x
    squares = lambda bs: sum(int(sizes[b].sum()) ** 2 for b in bs)
    found = packing.local_search([list(b) for b in bins], sizes, 4096)
    assert sorted(sum(found, [])) == list(range(600)) and max(sizes[b].sum() for b in found) <= 4096
    assert len(found) < 0.9 * len(bins) and squares(found) > squares(bins)
    # 60 + 40, 50 + 50 need an exchange that best fit alone doesn't find.
    tight = np.array([60, 50, 50, 40])
    assert len(packing.local_search([[0], [1, 3], [2]], tight, 100)) == 2


def test_local_search_ends_when_nothing_moves():
    sizes, capacity = np.random.default_rng(0).integers(900, 1366, 1500), 4096
    found = packing.pack(sizes, capacity)
    assert len(found) <= 440  # 453 with 8 rounds and 64 partners
    rest = [(int(sizes[b].sum()), [0, *sizes[b].tolist()], b) for b in found if sizes[b].sum() < capacity]
    for k, (fill, _, b) in enumerate(rest):
        own = sizes[b].tolist()
        gifts = np.unique([*own, *(x + y for j, x in enumerate(own) for y in own[:j])])
        for other, (full, out, _) in enumerate(rest):
            if other != k and full >= fill:
                gains = gifts[:, None] - np.array(out)
                assert not ((gains > 0) & (gains <= capacity - full)).any()


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(k, "word " * rnd.randrange(1, 60), rnd.choice(["a", "a", "a", "a", "b", "c", None]), 1, 2.0) for k in range(3000)]
    rows += [(9001, None, "empty", 1, 2.0), (9002, "x y", "tiny", 1, 2.0), (None, "x y z", "a", 1, 2.0), (9003, "x", "a", 1, 2.0), (9003, "x", "a", 1, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target double").repartition(6)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    # Water filling by repeated resharing.
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else weight[s] * left / share for s in order}
        over = {s for s in order if s not in capped and target[s] >= 3 * sizes[s]}
        if not over:
            break
        capped |= over
    source = {i: s for i, _, s, *_ in rows}
    taken, biggest = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == sizes[s] and r.taken == r.copies * r.size <= 3 * r.size
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= biggest[s]
        copies = {r.copies for r in got if source[r.doc_id] == s}
        assert max(copies) - min(copies) <= 1  # whole epochs come before a part of one
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    assert mixing.mix(df.limit(0)).collect() == []


def test_quality_weighs(spark):
    rows = [(k, "letters here " * 5 if k % 2 else "#### 1234 " * 5, "s") for k in range(2000)] + [(5000 + k, "w " * 30, "t") for k in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 2)).collect()
    mean = [np.mean([r.copies for r in got if r.doc_id < 2000 and r.doc_id % 2 == k]) for k in (0, 1)]
    assert mean[1] > mean[0]
