"""Exact and near duplicates against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from assayline.llm import exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, i string, h int, s int, t string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA).repartition(5)


def test_content_sort(spark):
    rnd = random.Random(0)
    base = ["", "a", "a ", "b" * 70, "b" * 70 + "c", "ü" * 50_000, "ü" * 50_000 + "x", "same head " * 20]
    rows = [(k, rnd.choice(base)) for k in range(300)] + [(1000 + k, "hot") for k in range(200)]
    for keep, best in (("largest", max), ("smallest", min)):
        got = {r.doc_id: r for r in exact_dedup.content_sort(frame(spark, rows), keep=keep).collect()}
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        assert len(got) == len(rows)
        for t, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best(ids), len(ids), i == best(ids), hashlib.sha256(t.encode()).hexdigest())


def test_content_sort_edges(spark):
    rows = [(None, "a"), (None, "a"), (1, "b"), (1, "b"), (None, "b"), (2, None), (3, "")]
    got = exact_dedup.content_sort(frame(spark, rows)).collect()
    kept = sorted(((r.doc_id, r.keep_id, r.group_size) for r in got if r.kept), key=str)
    assert kept == [(1, 1, 3), (2, 2, 2), (None, None, 2)]
    assert exact_dedup.content_sort(frame(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        exact_dedup.content_sort(frame(spark, rows), keep="first")


def brute(rows, n, percent=80):
    """{id: (n_shingles, component, kept)} by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rnd = random.Random(n)
    word = lambda: "w%d" % rnd.randrange(3000)
    rows = [(k, " ".join(word() for _ in range(rnd.choice([1, 4, 30, 200])))) for k in range(60)]
    # One group of near copies that drift away from each other, one that shares a passage only.
    seed = [word() for _ in range(150)]
    for k in range(80):
        copy = list(seed)
        for _ in range(rnd.randrange(12)):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((100 + k, ("  \n" if k % 2 else " ").join(copy).upper() if k % 3 else " ".join(copy)))
    passage = [word() for _ in range(60)]
    rows += [(300 + k, " ".join(passage + [word() for _ in range(40)])) for k in range(40)]
    rows += [(500, ""), (501, None), (502, " \t\n"), (503, "one"), (504, "ONE"), (505, "one two"), (506, "one\x0btwo"), (507, "a b c d e f g h i j"), (508, "b c d e f g h i j")]
    rows += [(600 + k, rows[70][1]) for k in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows), words_per_shingle=n).collect()}
    assert got == brute(rows, n)


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (None, None, True)]
    assert near_dedup.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        n = 2000
        both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64)]) for _ in range(2))
        x, y = (near_dedup.circulant_signature(v, 2048) for v in (a, b))
        assert abs((x == y).mean() - (share + (1 - share) / 256)) < 0.04


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (150, 200), (300, 301)]
    got = {r.v: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a long, m long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}


def test_without_broadcasts_and_in_small_blocks(spark, monkeypatch):
    """Beyond the counted bounds joins are shuffled, and groups spread over many blocks."""
    rnd = random.Random(9)
    seed = ["w%d" % k for k in range(100)]
    rows = []
    for k in range(60):
        copy = list(seed)
        for _ in range(rnd.randrange(12)):
            copy[rnd.randrange(100)] = "x%d" % rnd.randrange(10**6)
        rows.append((k, " ".join(copy)))
    want = brute(rows, 2)
    assert len({c for _, c, _ in want.values()}) > 1
    for name, value in (("BROADCAST_ROWS", 0), ("BLOCK", 7)):
        monkeypatch.setattr(near_dedup, name, value)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows), words_per_shingle=2).collect()}
        assert got == want
