"""Stages of the pipeline on odd rows, and operators against plain Python."""

import collections
import math
import os
import random

import numpy as np
import pytest
import regex

import corpus_pipeline
from assayline.llm import fingerprints, packing, pii, queries, toxicity, url_filter, warc
from test_other_operators import labelled, python_spans, trained

SF = "/root/testdata/sf0.001"
TEXT = " ".join(f"w{k}" for k in range(60))
ROWS = [(1, "unrelated text of its own", "s"), (1, TEXT, "s"), (0, TEXT + " tail", "s"), (2, TEXT, "s"), (2, TEXT, "s"), (None, None, None), (3, "", None), (3, "", None)]
KEPT = {
    "toxicity": [0, 1, 1, 2, 2, 3, 3, None],
    "exact dedup": [0, 1, 1, 3],
    "near dedup": [0, 1, 3, 3, None],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated ids and rows, an empty table, and columns with the names that stages use."""
    odd = "doc_id long, text string, lang string, source string, n_chars int, __i string, c0 string, kept string, x string, i int"
    df = spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "b", "c", "d", 1) for i, t, s in ROWS], odd)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, SF)
        if name == "packing":
            assert got.count() == len(ROWS)
        else:
            assert got.columns == df.columns
        if name in KEPT:
            assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(KEPT[name], key=str), name
        assert stage(spark, df.limit(0), SF).collect() == []
    near = {(r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, df, SF).collect()}
    assert (1, ROWS[0][1]) in near and (1, TEXT) not in near


def test_mixed_stage_shares_alike_rows(spark):
    """Rows alike in id, text and source are taken as often as the mix takes all of them."""
    rows = [(k % 50, f"text of {k % 50} " * (1 + k % 5), "ab"[k % 2], k) for k in range(400)] + [(None, "null id", None, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").coalesce(3)
    from assayline.llm import mixing

    want, got = collections.Counter(), collections.Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source] += r.copies
    for r in corpus_pipeline.mixed(spark, df, SF).collect():
        got[r.doc_id, r.source] += 1
    assert all(abs(got[k] - want[k]) <= 8 for k in want) and abs(sum(got.values()) - sum(want.values())) < 0.1 * sum(want.values())


# --- toxicity -----------------------------------------------------------------------


def test_objective_against_plain_loops():
    rnd = random.Random(0)
    n = 12
    rows = [(rnd.randrange(2), rnd.sample(range(n), rnd.randrange(n)), [[(c + 1) * rnd.choice([1, -1]) for c in rnd.sample(range(n), rnd.randrange(1, 4))] for _ in range(rnd.randrange(3))]) for _ in range(40)]
    f = toxicity.Objective(rows, n, 3.0)

    def loss(w, b):
        total, squares = 0.0, []
        for y, x, pairs in rows:
            z = b + sum(w[c] for c in x)
            total += math.log1p(math.exp(z)) - y * z
            squares += [sum(w[abs(c) - 1] * (1 if c > 0 else -1) for c in p) ** 2 for p in pairs]
        return total / len(rows) + 3.0 * sum(squares) / len(squares)

    w, b = np.array([rnd.gauss(0, 1) for _ in range(n)]), 0.3
    assert f.loss(w, b) == pytest.approx(loss(w, b))
    g, gb = f.gradient(w, b)
    for k in range(n):
        step = np.zeros(n)
        step[k] = 1e-6
        assert g[k] == pytest.approx((loss(w + step, b) - loss(w - step, b)) / 2e-6, abs=1e-5)
    assert gb == pytest.approx((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6, abs=1e-5)
    # At the fitted weights no step makes the loss with the absolute weights less.
    w, b = toxicity.fit(rows, n, 3.0, 0.01)
    g, gb = toxicity.Objective(rows, n, 3.0).gradient(w, b)
    assert abs(gb) < 1e-3
    for k in range(n):
        assert abs(g[k] + 0.01 * np.sign(w[k])) < 1e-3 if w[k] else abs(g[k]) <= 0.01 + 1e-3


def test_every_text_makes_pairs():
    kinds = toxicity.IDENTITY_TERMS
    swaps = toxicity.counterfactuals("the muslims of the town", kinds)
    assert len(swaps) == 2 and all("muslims" in a and "muslims" not in b and a - b == {"muslims"} for a, b in swaps)
    made = [toxicity.counterfactuals(f"plain words {k}", kinds) for k in range(2000)]
    names = {w for kind in kinds for w in kind}
    assert all(len(pairs) == 2 for pairs in made)
    for (bare, one), (same, other) in made:
        assert same == one and len((one - bare) & names) == 1 and len((other - one) & names) == 1
    assert {w for pairs in made for w in pairs[1][1] & names} == names  # all names come up
    assert toxicity.counterfactuals("plain", ()) == []


def test_penalty_acts_on_mentions(spark, monkeypatch):
    """Insults beside one group's name: with the penalty neutral mentions aren't flagged."""
    rows = labelled(1500, identity=0.7, insults=0.6)
    _, fair = trained(spark, rows)
    monkeypatch.setattr(toxicity.fit, "__defaults__", (0.0, toxicity.SPARSE))
    _, plain = trained(spark, rows)
    assert fair.pairs > 2 * 1000
    (flagged, n, change), (flagged_plain, _, change_plain) = toxicity.neutral_mentions(fair), toxicity.neutral_mentions(plain)
    assert flagged == 0 < flagged_plain < n and change < 0.2 < change_plain


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_pairs_on_the_given_tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    model = toxicity.train(read("documents"), read("labels"), lambda i: ~queries.held_out(i))
    assert model.pairs >= 2 * 300 and toxicity.neutral_mentions(model)[0] == 0


def test_conflicting_labels_and_texts(spark):
    docs = spark.createDataFrame([(k, "awful" if k % 2 else "fine") for k in range(60)] + [(0, "fine too")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(0, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, lambda i: i.isNotNull())
    assert model.score("awful") > 0.5 > model.score("fine")


# --- URL rules, fingerprints, packing -----------------------------------------------


def test_more_rules_than_a_broadcast(spark, monkeypatch):
    rnd = random.Random(0)
    labels, paths = ["a", "b", "com", "net"], ["", "/", "/en", "/en/", "/en/x", "//", "/é/"]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 4)))
    rules = [(rnd.choice(["allow", "block"]), host(), rnd.choice(paths)) for _ in range(60)] + [("block", "", "/everywhere")]
    urls = [(k, f"http://{host()}{rnd.choice([*paths, '/en/x/y?q', '/everywhere/z'])}") for k in range(300)] + [(None, None), (7, "none"), (7, "none"), (8, "http://a.b/" + "x" * 100_000)]
    df = spark.createDataFrame([(i, u, "z") for i, u in urls], "page_id long, url string, rule string")
    rows = lambda: sorted(map(tuple, url_filter.judge(df, rules).collect()), key=str)
    want = rows()
    monkeypatch.setattr(url_filter, "MOST_RULES", 3)
    assert rows() == want and len({r[3] for r in want}) > 20


M = (1 << 64) - 1


def scramble(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_fingerprint(text, size=5, bins=256):
    """One-permutation MinHash with optimal densification, one number at a time."""
    golden = 0x9E3779B97F4A7C15

    def word(w):
        eights = [int.from_bytes(w[k : k + 8], "little") for k in range(0, len(w), 8)]
        total = sum(scramble(x ^ scramble((k + 1) * golden & M)) for k, x in enumerate(eights)) & M
        return scramble(total ^ (len(w) * golden & M))

    hashes = [word(w) for w in text.encode().lower().split()]
    factor = [scramble(k + 1) | 1 for k in range(size)]
    runs = [hashes[k : k + size] for k in range(len(hashes) - size + 1)] or ([hashes] if hashes else [])
    values = {}
    for run in runs:
        total = sum(h * f for h, f in zip(run, factor, strict=False)) + (len(run) if len(run) < size else 0)
        spread = scramble(scramble(total & M) ^ 0xA0761D6478BD642F)
        b = (spread >> 32) % bins
        values[b] = min(values.get(b, M), spread & 0xFFFFFFFF)
    if not values:
        return ""
    out = ""
    for b in range(bins):
        at, attempt = b, 0
        while at not in values:
            attempt += 1
            at = scramble(scramble(b + 1) + attempt & M) % bins
        out += "%x" % (scramble(values[at] + (b + 1) * golden & M) & 15)
    return out


def test_fingerprints_against_plain_python(spark):
    rnd = random.Random(1)
    texts = ["", " \n", "one", "One TWO", "a b c d e", "ünïcödé Wörter " * 30, "x" * 5000, *(" ".join("w%d" % rnd.randrange(80) for _ in range(rnd.choice([3, 9, 60, 700]))) for _ in range(30)), "a\x0bb\x1cc d\x85e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(df).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain_fingerprint(t), t
    order = sorted(got, reverse=True)
    for r in fingerprints.neighbours(df.repartition(9)).collect():
        after = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        assert r.fingerprint == got[r.doc_id] and r.edited_fingerprint == plain_fingerprint(fingerprints.edited(texts[r.doc_id], after))


def test_neighbours_of_hot_ids(spark):
    """Many rows of one id, or without one, are cut into ranges like any others."""
    rows = [(None, f"t{k % 7}") for k in range(300)] + [(5, f"u{k}") for k in range(300)] + [(k, "same") for k in range(100, 130)]
    got = fingerprints.neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id is None) >= 300 - 7 - 1


def test_search_on_many_like_sizes():
    sizes = np.random.default_rng(0).integers(900, 1900, 3000)
    found = packing.pack(sizes, 4096)
    assert sorted(sum(found, [])) == list(range(3000)) and max(sizes[b].sum() for b in found) <= 4096
    assert len(found) <= len(packing.best_fit(sizes, 4096)) - 36  # 25 with 8 rounds and 64 partners


# --- WARC ---------------------------------------------------------------------------


def test_captures_of_odd_pages(spark, tmp_path, monkeypatch):
    """Null and repeated ids, long payloads, archives that end by bytes, joins without broadcasts."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    monkeypatch.setattr(warc, "RANGE", 15)
    rows = [(None, "http://a.org/n", "same"), (4, "http://a.org/4", "same"), (4, "http://a.org/4", "same"), (2, None, "same"), (None, "http://b.org", None), (7, "http://b.org", ""), (8, "http://c.org", "é" * 300_000), (9, "http://c.org", "é" * 300_000)]
    rows += [(100 + k, f"http://d.org/{k % 10}", f"page {k % 30} " * 50) for k in range(120)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int").repartition(3)
    found = warc.captured(df, str(tmp_path / "a")).collect()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in found if r.page_id is None or r.page_id < 100)
    assert kinds == {(None, "revisit", 4): 1, (4, "response", None): 2, (2, "revisit", 4): 1, (None, "revisit", 7): 1, (7, "response", None): 1, (8, "revisit", 9): 1, (9, "response", None): 1}
    assert sorted(r.place for r in found) == list(range(len(rows)))
    keys = [(r.url_key, r.captured_at, r.archive, r.offset) for r in sorted(found, key=lambda r: r.place)]
    assert keys == sorted(keys) and len({r.range for r in found}) > 3 and len({r.archive for r in found}) > 3
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    again = warc.captured(df, str(tmp_path / "b")).collect()
    shown = lambda rows: collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_digest) for r in rows)
    assert shown(again) == shown(found)


# --- personal data ------------------------------------------------------------------


def plain_terms(texts):
    """{term: score} by loops over all documents."""
    spans = [python_spans(t) for t in texts]
    value = lambda k, s: f"{s[0]}:{texts[k][s[1] : s[2]].lower()}"
    holders = collections.defaultdict(set)
    for k, own in enumerate(spans):
        for s in own:
            holders[value(k, s)].add(k)
    alike = collections.defaultdict(list)
    for entity, docs in holders.items():
        alike[frozenset(docs)].append(entity)
    words = lambda t: set(map(str.lower, regex.findall(r"\p{L}+", t)))
    vocabulary = [words(t) for t in texts]
    n, out = len(texts), {}
    for docs, entities in alike.items():
        entity = min(entities)
        together = collections.Counter()
        for k in docs:
            outside = list(texts[k])
            for _, a, b in spans[k]:
                outside[a:b] = " " * (b - a)
            there = words("".join(outside))
            for s in spans[k]:
                if len(entities) > 1 or value(k, s) != entity:
                    there |= words(texts[k][s[1] : s[2]])
            together.update(there)
        for term, c in together.items():
            c_t = sum(term in v for v in vocabulary)
            share, known = c / c_t, math.log2(n / len(docs))
            if c - 0.75 >= 0.375 * max(c, c_t) and share >= 0.5 and known > 0 and math.log2(share) + known >= 0.5 * known:
                out[term] = max(share, out.get(term, 0))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_terms_against_plain_python(spark, seed):
    rnd = random.Random(seed)
    entities = ["a@b.co", "C.D@e.org", "1.2.3.4", "+49 30 1234567", "4111 1111 1111 1111"]
    texts = [" ".join(rnd.choice([rnd.choice("abcdefghij") * 2, f"Name{'xyzuvw'[rnd.randrange(6)]}", rnd.choice(entities) if rnd.random() < 0.15 else "plain", "b", "e"]) for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    texts += [f"Zed {entities[0]} always", f"zed {entities[0]}", "É é a@x.yz", "é a@x.yz"]
    want = plain_terms(texts)
    assert len(want) >= 2
    rows = list(enumerate(texts)) + [(3, texts[3])] * 4 + [(61, texts[61])] * 2  # rows that repeat count once
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {}
    for r in got:
        own = {(s["start"], s["end"]): s["score"] for s in r.spans if s["kind"] == "term"}
        free = [m for m in regex.finditer(r"\p{L}+", texts[r.doc_id]) if not any(a < m.end() and m.start() < b for _, a, b in python_spans(texts[r.doc_id]))]
        assert own == {(m.start(), m.end()): want[m[0].lower()] for m in free if m[0].lower() in want}
        found |= {texts[r.doc_id][a:b].lower(): s for (a, b), s in own.items()}
    assert found.items() <= want.items() and found
