"""Toxicity, URL rules, fingerprints, WARC and personal data on small cases."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayline.llm import fingerprints, pii, queries, toxicity, url_filter, warc

# --- toxicity -----------------------------------------------------------------------


def labelled(n, identity=0.0, insults=1.0, seed=0):
    """Texts of random words; toxic ones have an insult, and a group's name more often."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        toxic = int(rnd.random() < 0.3)
        words = ["w%s" % "abcdefgh"[rnd.randrange(8)] * 2 for _ in range(rnd.randrange(3, 40))]
        if toxic and rnd.random() < insults:
            words.insert(rnd.randrange(len(words)), rnd.choice(["awfulness", "awfulment", "dreckig,"]))
        if rnd.random() < (identity if toxic else 0.02):
            words.append("muslims")
        rows.append((k, " ".join(words), toxic))
    return rows


def trained(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, toxicity.train(docs, labels, lambda i: ~queries.held_out(i), **options)


def test_held_out_accuracy(spark):
    rows = labelled(1500)
    docs, model = trained(spark, rows)
    truth = {i: y for i, _, y in rows}
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert model.score("an awfulish word") > 0.5 > model.score("a plain word")  # by the word's beginning
    kept = {r.doc_id for r in toxicity.clean(docs, model).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_swaps_take_weight_from_names(spark, monkeypatch):
    rows = labelled(1500, identity=0.7, insults=0.6)
    _, fair = trained(spark, rows)
    monkeypatch.setattr(toxicity.fit, "__defaults__", (0.0, toxicity.SPARSE))
    _, plain = trained(spark, rows)
    neutral = "the muslims of the town"
    assert plain.score(neutral) > 0.6 > 0.4 > fair.score(neutral)
    assert fair.score("awfulness of the town") > 0.5


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x " * 50_000), (2, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none, lambda i: F.lit(True))
    assert [0 <= r.score <= 1 for r in toxicity.score(docs, model).collect()] == [True] * 4
    odd = spark.createDataFrame([(1, 1), (2, None), (2, 7), (None, 1), (99, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, odd, lambda i: F.lit(True)).score("") == toxicity.train(docs, odd, lambda i: F.lit(True)).score("x")
    assert toxicity.score(docs.limit(0), model).collect() == []


# --- URL rules ----------------------------------------------------------------------

LABEL = st.sampled_from(["a", "b", "com", "net", ""])
HOST = st.lists(LABEL, min_size=1, max_size=4).map(".".join)
PATH = st.sampled_from(["", "/", "/en", "/en/", "/en/x", "/english/", "//", "/en//x/"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), HOST, PATH), max_size=8), HOST, PATH)
def test_trie_equals_scan(rules, host, path):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1]) or r[1] == "") and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1].split(".")) if r[1] else 0, len(r[2]), r[0] == "block"), default=None)
    assert url_filter.Trie(rules).find(host, path) == (best and (best[0], best[1] + best[2]))


def test_judge(spark):
    urls = [(1, "http://WWW.Example.com/en/x?q#f"), (2, "http://example.com/en/"), (3, "http://com"), (4, "http://x.net/fr/"), (5, None), (6, "no scheme/en/"), (7, "ftp://a.com#/b"), (8, "http://com.evil.org/"), (8, "http://com.evil.org/"), (None, "x://a.com/?/")]
    df = spark.createDataFrame([(i, u, "z") for i, u in urls], "page_id long, url string, rule string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, queries.URL_RULES).collect()]
    assert got == [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "example.com", "/en/", "example.com/en/", "block"), (3, "com", "", None, "allow"),
        (4, "x.net", "/fr/", "net/fr/", "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "a.com", "", None, "allow"),
        (8, "com.evil.org", "/", None, "allow"), (8, "com.evil.org", "/", None, "allow"), (None, "a.com", "/", "com/", "allow"),
    ]
    assert url_filter.judge(df.limit(0), queries.URL_RULES).collect() == []


# --- fingerprints -------------------------------------------------------------------


def jaccard(a, b, n=5):
    sets = []
    for t in (a, b):
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_neighbours(spark):
    rnd = random.Random(0)
    rows = [(3 * k, " ".join("w%d" % rnd.randrange(50) for _ in range(rnd.choice([0, 1, 3, 8, 300])))) for k in range(80)] + [(1, "ünïcödé " * 40), (2, None), (4, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, b int, place string").repartition(7)
    got = {r.doc_id: r for r in fingerprints.neighbours(df).collect()}
    single = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(df).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        r, n = got[i], len(t)
        new = t[: n - n // 2] + after[: n // 2]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (n, hashlib.sha256(new.encode()).hexdigest(), single[i])
        assert abs(r.near_edited - jaccard(t, new)) < 0.2 and abs(r.near_next - jaccard(t, after)) < 0.2
    by_text = collections.defaultdict(set)
    for i, t in rows:
        by_text[t or ""].add(single[i])
    assert all(len(x) == 1 for x in by_text.values())


def test_densification_fills_all_bins():
    values = np.full((3, 256), 2**64 - 1, np.uint64)
    values[0, 7], values[1, ::2] = 5, np.arange(128)
    out = fingerprints.densify(values)
    assert (out[0] == 5).all() and (out[1] < 128).all() and (out[2] == 2**64 - 1).all()
    assert (out[1, ::2] == np.arange(128)).all()
    low = fingerprints.low_bits(out)
    assert len(fingerprints.packed(low)[0]) == 128


def test_neighbour_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None), (3, ""), (3, "x"), (2, None)], "doc_id long, text string")
    got = [(r.doc_id, r.n_chars, r.near_next) for r in fingerprints.neighbours(df).collect()]
    assert sorted(got, key=str) == sorted([(3, 0, 0.0), (3, 1, 0.0), (2, 0, 1.0), (None, 0, 0.0), (None, 5, 0.0)], key=str)
    assert [r.near_next for r in fingerprints.neighbours(df.filter("doc_id = 2")).collect()] == [1.0]
    assert fingerprints.neighbours(df.limit(0)).collect() == []


# --- WARC ---------------------------------------------------------------------------


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 20)
    monkeypatch.setattr(warc, "RECORDS", 7)
    rnd = random.Random(0)
    bodies = ["", "same\r\n\r\nWARC/1.1\r\n", "ünï" * 1000, *("page %d" % k for k in range(40))]
    rows = [(k, rnd.choice(["http://b.a.com/x", "https://a.com/%d?q" % rnd.randrange(9), "http://Z.org"]), rnd.choice(bodies)) for k in range(150)]
    rows += [(900, None, None), (901, "http://a.com/line\r\nbreak", "unique")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string").repartition(6)
    found = warc.captured(df, str(tmp_path / "a")).collect()
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(i, largest.get(h or "", -1))
    assert sorted(r.page_id for r in found) == sorted(r[0] for r in rows)
    text = {i: h or "" for i, _, h in rows}
    for r in found:
        body = text[r.page_id].encode()
        first = largest[text[r.page_id]] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", largest[text[r.page_id]]))
        with open(r.archive.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            ((_, length, head, block),) = warc.records_of(f.read(r.length))
        assert length == r.length and head["warc-record-id"] == f"<urn:capture:{r.page_id}>"
        assert not first or block.partition(b"\r\n\r\n")[2] == body
    found.sort(key=lambda r: (r.range, r.place))
    keys = [(r.url_key, r.captured_at, r.archive, r.offset) for r in found]
    assert keys == sorted(keys) and found[-1].range > 2
    none = warc.captured(df, str(tmp_path / "b"), least_bytes=10**6).collect()
    assert {r.record_type for r in none} == {"response"}
    assert warc.captured(df.limit(0), str(tmp_path / "c")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        list(warc.records_of(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))


def test_captures_in_order_of_time(spark, tmp_path):
    times = ["2024-03-05 00:00:00.5", "2024-03-05 00:00:00", None, "1969-12-31 23:59:59.000001", "2023-12-31 23:59:59"]
    df = spark.createDataFrame([(k, "http://a.org/x", f"p{k}", t) for k, t in enumerate(times)], "page_id long, url string, html string, t string")
    df = df.withColumn("t", df.t.cast("timestamp")).coalesce(1)
    got = warc.captured(df, str(tmp_path / "w"), time_col="t").orderBy("range", "place").collect()
    assert [r.page_id for r in got] == [3, 2, 4, 1, 0]
    assert [r.captured_at for r in got] == ["1969-12-31T23:59:59.000001Z", "1970-01-01T00:00:00Z", "2023-12-31T23:59:59.000000Z", "2024-03-05T00:00:00.000000Z", "2024-03-05T00:00:00.500000Z"]


# --- personal data ------------------------------------------------------------------

PYTHON = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in re.sub("[^0-9]", "", value)]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def python_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PYTHON.items()) for m in re.finditer(p, text) if valid(kind, m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_base_spans(spark):
    rnd = random.Random(0)
    parts = ["a@b.co", "x.y@z-1.org_q@r.st", "@", "a@b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "1 2", "+49 (30) 1234567", "+1", "+1 23456789 ", "é😀", " ", ".", "-", "\n", "word"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(400)]
    texts += [None, "", "a" * 100_000, "a." * 20_000 + "@", "1" * 50_000, "a.b@" + "c." * 20_000 + "d", "9 " * 10_000, "😀 a@b.co"]
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in enumerate(texts)], "doc_id long, text string, h int, spans string")
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.base] for r in pii.find(df).collect()}
    for k, t in enumerate(texts):
        assert got[k] == python_spans(t or ""), t


def test_terms_that_disclose(spark):
    """A nickname that stands only near one address reveals it; common words don't."""
    rnd = random.Random(1)
    common = ["some", "plain", "words", "that", "everyone", "writes"]
    filler = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    rows = [(k, f"{filler(30)} Zaphod <z@heart.org> {filler(30)}") for k in range(6)]
    rows += [(10, f"only Zaphod here, {filler(5)}"), (11, "zaphodical zaphod@x.org")]
    rows += [(20 + k, f"{filler(20)} u{k}@mail.org {filler(20)}") for k in range(40)] + [(100 + k, filler(40)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    words = {i: {t[s["start"] : s["end"]] for s in got[i].spans if s["kind"] == "term"} for i, t in rows}
    assert words[0] == {"Zaphod"} and words[10] == {"Zaphod"}
    assert words[11] == set()  # inside an address, or another word
    assert all(not words[i] for i, _ in rows if i >= 20)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zaphod" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[-60][1]
    assert clean[10].startswith("only [TERM] here,")
    # The score is the share of the word's documents that name the entity: 6 of 8.
    assert {s["score"] for s in got[10].spans} == {6 / 8}


def test_terms_of_entities_in_two_documents(spark):
    """Two documents of two, or of three, are evidence; two of four and one of one aren't."""
    rows = [(k, f"plain words Trillian <t@earth.org> Slartib Marvin plain {k}") for k in range(2)]
    rows += [(5, "plain words Slartib"), (6, "words Marvin"), (7, "plain Marvin words"), (8, "plain Hapax h@earth.org")]
    rows += [(20 + k, "plain words") for k in range(60)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {i: {t[s["start"] : s["end"]] for s in got[i] if s["kind"] == "term"} for i, t in rows}
    assert words[0] == words[1] == {"Trillian", "Slartib"}
    assert words[5] == {"Slartib"} and not any(words[i] for i in words if i > 5)


def test_terms_of_frequent_entities(spark):
    """What stands only beside a frequent address discloses it; what is as common without it doesn't."""
    rows = [(k, f"plain words Trillian <t@earth.org> always {k}") for k in range(30)]
    rows += [(100 + k, "plain words always") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = lambda df: {s["value"] for r in pii.find(df).collect() for s in r.spans if s["kind"] == "term"}
    assert terms(df) == {"Trillian"}
    assert terms(df.filter("doc_id < 4 OR doc_id BETWEEN 100 AND 104")) == {"Trillian"}  # nine documents
    assert terms(df.filter("doc_id < 30 OR doc_id < 110")) == {"Trillian"}  # the address in 30 of 40
    assert terms(df.filter("doc_id < 30")) == set()  # in all, so that nothing can disclose it


def test_terms_anywhere_in_the_document(spark):
    """A heading discloses the footer's address, and a name may be short; an address doesn't disclose itself."""
    far = " plain words of the town" * 40
    rows = [(k, f"Zarniwoop, Kim 李明:{far} <k@vogon.org> {k}") for k in range(3)]
    rows += [(5, f"Kim,{far} <x@else.org> <y@both.net>"), (6, f"{far} <x@else.org>, y@both.net"), (7, f"vogon, both{far}")]
    rows += [(20 + k, far) for k in range(40)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {i: {t[s["start"] : s["end"]] for s in got[i] if s["kind"] == "term"} for i, t in rows}
    assert words[0] == {"Zarniwoop", "Kim", "李明"}
    # Both addresses stand in the same documents: a word of one discloses the other.
    assert words[5] == {"Kim"} and words[7] == {"both"}
    assert not any(words[i] for i in words if i >= 20)


def test_pii_edges(spark):
    df = spark.createDataFrame([(None, "a@b.co"), (1, "a@b.co"), (1, "a@b.co"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.base)) for r in pii.find(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 0), ("None", 1)]
    assert len(pii.sanitise(df).collect()) == 4
    assert pii.find(df.limit(0)).collect() == []
