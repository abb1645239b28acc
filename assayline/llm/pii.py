"""Personal data by patterns, and terms that disclose it, with DataFrame operations alone.

Base spans come from four patterns. The information-theoretic part asks how strongly a
word reveals a protected entity, that is an address or number which the patterns found:
over the corpus it counts the documents that have both the word and the entity, and the
documents that have the word at all. Their ratio is the probability that a reader of the
word can name the entity, and its logarithm against the entity's own share of documents
is the information disclosed, taken as a part of the information that the entity itself
has. Words beyond both thresholds, in documents enough for the discounted ratio to hold,
become spans too wherever they occur; the sanitised text generalises them, or removes the strongest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that Java's engine takes time in proportion to the text:
#: a run is entered at its first character or where the last match ended, and what cannot
#: match otherwise is not tried again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has if it can hold a match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: A word that can disclose, however short.
TERM = r"\p{L}+"
#: What is taken off the documents that a word shares with an entity, and the part of the
#: word's documents that must be left. So few documents count for less, but none is too few
#: by itself: 2 of 2 or 3, and 3 of 6, are enough. One document alone isn't, as nothing in
#: it tells a name from any other word that is rare.
DISCOUNT, EVIDENCE = 0.75, 0.375
#: Probability of the entity, given the word, from which the word is a span, and from which it is removed.
DISCLOSES, REMOVED = 0.5, 0.9
#: Part of the entity's own information that a span's word carries at least. A frequent
#: entity has few bits, and so needs few; one that is in every document has none to disclose.
OF_ENTITY = 0.5
#: Terms that a broadcast may have; more are joined by a shuffle.
TERMS_AT_ONCE = 100_000
#: Rows of ids, and of documents with their terms, that a broadcast may have; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_DOCS = 200_000, 20_000

_SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits; every second digit from the right counts doubled."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = _digits(value)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _matches(kind: str, text: Column, pattern: Column) -> Column:
    """Spans of the leftmost matches, by the lengths of what lies between them."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["at"] + F.length(piece["gap"])
        end = begin + F.length(piece["hit"])
        span = F.struct(F.lit(kind).alias("kind"), begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), piece["hit"].alias("value"))
        return F.struct(
            F.coalesce(end, begin).cast("bigint").alias("at"),
            F.when(piece["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, the valid spans in ``text`` as an array of structs."""
    none = F.array().cast(f"array<{_SPAN}>")
    out = {}
    for kind in KINDS:
        hint = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
        out[kind] = F.when(hint, _only_valid(kind, _matches(kind, text, F.lit(PATTERNS[kind])))).otherwise(none)
    return out


def _only_valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def count_of(kind: str, spans: Column) -> Column:
    """How many of ``spans`` are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), kind)


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), s["score"].alias("score")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score")),
    )


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column, removed: float = REMOVED) -> Column:
    """``text`` with its spans replaced by their kind in brackets; a term whose score
    reaches ``removed`` goes. Of overlapping spans the one that starts first counts."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        filled = F.when((s["kind"] == "term") & (s["score"] >= removed), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, filled).alias("out")))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def _outside(text: Column, spans: Column) -> Column:
    """``text`` with a space for each of its spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.lit(" ")).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def _words(text: Column, spans: Column) -> Column:
    """(term, inside) for the lower-cased words of ``text``; inside which entity, null for a word outside all."""
    found = lambda t: F.transform(_vocabulary(t), F.lower)
    beside = F.transform(found(_outside(text, spans)), lambda w: F.struct(w.alias("term"), F.lit(None).cast("string").alias("inside")))
    within = F.flatten(F.transform(spans, lambda s: F.transform(found(s["value"]), lambda w: F.struct(w.alias("term"), _entity(s).alias("inside")))))
    return F.array_distinct(F.concat(beside, within))


def _vocabulary(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def _enough(together: Column, of: Column) -> Column:
    return together - DISCOUNT >= EVIDENCE * of


def disclosing_terms(based: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, score): words that reveal an entity, with the highest probability of one.

    ``based`` has (i, h, spans) for every document, ``texts`` has (i, h, text). A document
    counts once for each entity and word, wherever in it they stand, and once however often
    its row repeats; a word that a document has only inside the entity doesn't count with it.
    """
    again = cut(based.groupBy("i", "h").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("i").alias("i3"), F.col("h").alias("h3"), (F.col("rows") - 1).alias("more")))
    surplus = again.agg(F.sum("more")).first()[0] or 0
    if surplus:
        repeated = F.col("i").eqNullSafe(F.col("i3")) & (F.col("h") == F.col("h3"))
        marked = few(again, BROADCAST_ROWS)
        once = texts.join(marked, repeated, "left_semi").groupBy("i", "h").agg(F.min("text").alias("text"))
        texts = texts.join(marked, repeated, "left_anti").select("i", "h", "text").unionByName(once)
    mention = based.filter(F.size("spans") > 0).select("i", "h", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).distinct()
    # Entities of the same documents have the same counts, so one of them stands for all.
    # What only one of them has inside stands beside the others.
    entities = mention.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e"), F.bit_xor(F.xxhash64("i", "h")).alias("a"), F.bit_xor(F.xxhash64("h", "i", F.lit(1))).alias("b"))
    entities = entities.filter(_enough(F.col("c_e"), F.col("c_e"))).groupBy("c_e", "a", "b").agg(F.min("entity").alias("entity"), (F.count(F.lit(1)) > 1).alias("several"))
    held = cut(mention.join(few(cut(entities.drop("a", "b")), BROADCAST_ROWS), "entity"))
    ids = held.select(F.col("i").alias("i2"), F.col("h").alias("h2")).distinct()
    own = F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))
    bodies = texts.join(few(ids, BROADCAST_ROWS), own, "left_semi").dropDuplicates(["i", "h"])
    words = (
        bodies.select("i", "h", F.explode(_words(F.col("text"), F.concat(*base_spans(F.col("text")).values()))).alias("w"))
        .groupBy("i", "h", F.col("w.term").alias("term"))
        .agg(F.when((F.count("w.inside") == F.count(F.lit(1))) & (F.min("w.inside") == F.max("w.inside")), F.min("w.inside")).alias("only"))
    )
    right = held.select(F.col("i").alias("i2"), F.col("h").alias("h2"), "entity", "c_e", "several")
    together = cut(
        words.join(few(right, BROADCAST_ROWS), own)
        .filter(F.col("several") | ~F.col("only").eqNullSafe(F.col("entity")))
        .groupBy("term", "entity", "c_e")
        .agg(F.count(F.lit(1)).alias("c_te"))
        .filter(_enough(F.col("c_te"), F.col("c_te")))
    )
    wanted = cut(together.select("term").distinct())
    seen = texts.select(F.explode(F.array_distinct(F.transform(_vocabulary(F.col("text")), F.lower))).alias("term"))
    if wanted.limit(TERMS_AT_ONCE + 1).count() <= TERMS_AT_ONCE:  # else all words are counted, and only counts are shuffled
        seen = seen.join(F.broadcast(wanted), "term", "left_semi")
    counts = seen.groupBy("term").agg(F.count(F.lit(1)).alias("c_t"))
    n = based.count() - surplus
    share = F.col("c_te") / F.col("c_t")
    known = F.log2(F.lit(float(n)) / F.col("c_e"))
    return (
        together.join(counts, "term")
        .filter((share >= DISCLOSES) & _enough(F.col("c_te"), F.col("c_t")))
        .filter((known > 0) & (F.log2(share) + known >= OF_ENTITY * known))
        .groupBy("term")
        .agg(F.max(share).alias("score"))
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, text_hash, base, spans (base and terms).

    A span is (kind, start, end, value, score) in code points, end exclusive; base spans
    have no score. Term spans that overlap a base span are left out. ``text_hash`` is
    Spark's ``xxhash64`` of the text.

    A null text counts as empty and has no spans. A null id is an id like any other, and
    rows that repeat an id and text have the same spans each. An empty table gives an
    empty result. Other columns of ``docs`` are not read, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = base_spans(F.col("text"))
    texts = texts.select("i", "text", F.xxhash64("text").alias("h"))
    based = cut(texts.select("i", "h", *[c.alias(k) for k, c in kinds.items()]).select("i", "h", F.concat(*KINDS).alias("spans")))
    terms = cut(disclosing_terms(based, texts))

    # One pass over all words, whatever the number of terms; then one over the texts that have any.
    words = texts.select("i", "h", F.explode(_vocabulary(F.col("text"))).alias("word"))
    named = words.join(few(terms, TERMS_AT_ONCE), F.lower("word") == F.col("term")).groupBy("i", "h").agg(F.collect_set(F.struct("word", "score")).alias("named"))
    right = cut(named).select(F.col("i").alias("i2"), F.col("h").alias("h2"), "named")
    own = F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))
    listed = F.array_join(F.transform("named", lambda n: n["word"]), "|")
    spans = _matches("term", F.col("text"), F.concat(F.lit(r"(?<!\p{L})(?:"), listed, F.lit(r")(?!\p{L})")))
    scores = F.map_from_entries("named")
    scored = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.element_at(scores, s["value"]).alias("score")))
    by_doc = texts.join(few(right, BROADCAST_DOCS), own).select("i", "h", scored.alias("terms")).dropDuplicates(["i", "h"])
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(None).cast("double").alias("score")))
    based = based.select("i", "h", _ordered(base).alias("base"))
    out = [F.col("i").alias(id_col), F.col("h").alias("text_hash"), "base"]
    right = by_doc.select(F.col("i").alias("i2"), F.col("h").alias("h2"), "terms")
    free = F.filter("terms", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return based.join(right, own, "left").select(
        *out, F.when(F.col("terms").isNull(), F.col("base")).otherwise(_ordered(F.concat("base", free))).alias("spans")
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the sanitised text, and all spans, for each row; cases as for ``find``."""
    spans = find(docs, id_col, text_col).dropDuplicates([id_col, "text_hash"]).select(F.col(id_col).alias("i"), F.col("text_hash").alias("h"), "spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i0"), text.alias("t"))
    return rows.join(spans, F.col("i0").eqNullSafe(F.col("i")) & (F.xxhash64("t") == F.col("h"))).select(
        F.col("i0").alias(id_col), sanitised(F.col("t"), F.col("spans")).alias(text_col), "spans"
    )
