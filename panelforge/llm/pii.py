"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that patterns and checks find. Words near an
entity are terms that may give it away. Over all documents, with n(e) documents mentioning an entity, n(e, t) with the term near it and
df(t) with the term anywhere, a term tells PMI(e; t) = log(n(e, t) N / (n(e) df(t))) of the IC(e) = log(N / n(e)) that the entity holds.
Where PMI / IC reaches the disclosure threshold the term is generalised wherever it stands in a document that mentions the entity, and
removed from a higher one on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import lower_ascii, small_side, staged, text_or_empty

#: Kinds in their order. Repeats are possessive, which changes no match and keeps long runs linear: what follows a repeat can't be part of
#: it. A local part or digit run is entered at its start, or where the last match ended. Cards need 14 digits to match at all.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "phone": "+"}
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_KIND = "term"
#: Candidate terms are broadcast up to this many rows (one word each), else joined by shuffle.
BROADCAST_TERMS = 200_000
#: Items folded in one go, and code points of a block of text.
STRETCH, BLOCK = 256, 4096


@dataclass(frozen=True)
class Disclosure:
    """``near``: characters on either side of an entity in which pairs are counted. ``support``: documents that must show a pair."""

    near: int = 60
    support: int = 3
    generalise: float = 0.8
    remove: float = 0.95


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for each row, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, kind: str, start: Column, weight, combine) -> Column:
    """(at, x) for each item: ``at`` combines ``start`` and the weights of all items before.

    Items are folded in stretches, so that appending copies a bounded number of places for each item, however many there are.
    """
    cell = f"struct<at:int,x:{kind}>"

    def stretches(all_items: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), F.lit(STRETCH)), lambda i: F.slice(all_items, i, F.lit(STRETCH)))
        first = F.struct(start.cast("int").alias("at"), F.array().cast(f"array<struct<at:int,items:array<{kind}>>>").alias("out"))

        def place(acc: Column, c: Column) -> Column:
            after = F.aggregate(c, acc["at"], lambda s, x: combine(s, weight(x)).cast("int"))
            return F.struct(after.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), c.alias("items")))).alias("out"))

        def one(acc: Column, x: Column) -> Column:
            return F.struct(combine(acc["at"], weight(x)).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("x")))).alias("out"))

        placed = F.aggregate(cut, first, place, lambda acc: acc["out"])
        inner = lambda o: F.struct(o["at"].alias("at"), F.array().cast(f"array<{cell}>").alias("out"))
        return F.flatten(F.transform(placed, lambda o: F.aggregate(o["items"], inner(o), one, lambda acc: acc["out"])))

    return _let(items, stretches)


def _located(matches: Column, gaps: Column, shift: Column | None = None) -> Column:
    """Matches with their places (start, end), from the gaps before them."""
    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("value"), g.alias("gap")))
    placed = _running(pairs, "struct<value:string,gap:string>", F.lit(0) if shift is None else shift, lambda x: F.length(x["gap"]) + F.length(x["value"]), lambda a, n: a + n)
    begin = lambda p: p["at"] + F.length(p["x"]["gap"])
    return F.transform(placed, lambda p: F.struct(begin(p).alias("start"), (begin(p) + F.length(p["x"]["value"])).alias("end"), p["x"]["value"].alias("value")))


def _blocks(text: Column) -> Column:
    """A text in blocks, so that a stretch of it is cut out without a walk from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{BLOCK}}})"), 1)


def _stretch(blocks: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` (exclusive) of a text in blocks."""
    low, high = F.floor(begin / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, low + 1, high - low + 1), ""), begin - low * BLOCK + 1, end - begin)


def _matches(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({PATTERNS[kind]})"), 1)
    hint = HINTS.get(kind)
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(F.array().cast("array<string>")) if hint else found


def find_entities(docs: DataFrame, near: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, entities (start, kind_no, end, kind, value, before, after; in span order) of every document, and t, its text if it has any.

    Places are code points, ends exclusive. ``before`` and ``after`` hold ``near`` characters around the entity and one more to tell cut words.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    rows = rows.select("doc_id", "t", F.xxhash64("t").alias("text_hash"), *[_matches(F.col("t"), k).alias(k) for k in KINDS])
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    rows = rows.select("doc_id", "t", "text_hash", *[F.when(F.size(k) > 0, _located(F.col(k), F.split("t", PATTERNS[k], -1))).otherwise(none).alias(k) for k in KINDS])

    def entity(i: int, kind: str, blocks: Column, size: Column):
        def one(m: Column) -> Column:
            before = _stretch(blocks, F.greatest(m["start"] - near - 1, F.lit(0)), m["start"])
            after = _stretch(blocks, m["end"], F.least(m["end"] + near + 1, size))
            return F.struct(m["start"].alias("start"), F.lit(i).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(F.filter(F.col(kind), lambda m: _valid(kind, m["value"])), one)

    any_match = F.greatest(*[F.size(k) for k in KINDS]) > 0
    cut = F.struct(_blocks(F.col("t")).alias("b"), F.length("t").alias("n"))
    found = _let(cut, lambda c: F.concat(*[entity(i, k, c["b"], c["n"]) for i, k in enumerate(KINDS)]))
    nothing = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,value:string,before:string,after:string>>")
    entities = F.array_sort(F.when(any_match, found).otherwise(nothing))
    return rows.select("doc_id", "text_hash", entities.alias("entities"), "t").withColumn("t", F.when(F.size("entities") > 0, F.col("t")))


def _terms_near(mentions: DataFrame, near: int) -> DataFrame:
    """doc_id, text_hash, entity, term, start, end for every whole word near an entity."""

    def whole_words(context: Column, shift: Column) -> Column:
        words = F.regexp_extract_all(context, F.lit(f"({TERM})"), 1)
        return _located(words, F.split(context, TERM, -1), shift)

    # A word that touches the far edge of a full context may be cut, and is left to the rest of the text.
    cut_left = F.length("e.before") > near
    before = F.filter(whole_words(F.col("e.before"), F.col("e.start") - F.length("e.before")), lambda w: ~cut_left | (w["start"] > F.col("e.start") - F.length("e.before")))
    cut_right = F.length("e.after") > near
    after = F.filter(whole_words(F.col("e.after"), F.col("e.end")), lambda w: ~cut_right | (w["end"] < F.col("e.end") + F.length("e.after")))
    value = F.when(F.col("e.kind").isin("card", "phone"), F.regexp_replace("e.value", "[^0-9]", "")).otherwise(lower_ascii(F.col("e.value")))
    near_by = mentions.select("doc_id", "text_hash", F.concat_ws(":", "e.kind", value).alias("entity"), F.explode(F.concat(before, after)).alias("w"))
    return near_by.select("doc_id", "text_hash", "entity", lower_ascii(F.col("w.value")).alias("term"), "w.start", "w.end")


def disclosing_terms(docs: DataFrame, base: DataFrame, found: DataFrame, terms: DataFrame, rule: Disclosure, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """entity, term, disclosure of the pairs that reach ``rule.generalise``; counted over all documents.

    Documents are distinct pairs of id and text: rows that repeat one change no count. Only words that some pair with enough
    support needs are counted in the texts.
    """
    mentions = found.select("doc_id", "text_hash", "entity").distinct()
    n_entity = mentions.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = terms.select("doc_id", "text_hash", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= rule.support)
    pairs = staged(pairs, "pii-pairs")
    wanted = small_side(pairs.select("term").distinct(), BROADCAST_TERMS, "pii-terms")
    copies = base.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    counts = copies.agg(F.count("*").alias("docs"), F.max("n").alias("most")).first()
    n_docs = counts["docs"]
    t = text_or_empty(text)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("t"))

    def holding(rows: DataFrame) -> DataFrame:
        words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("t")), F.lit(f"({TERM})"), 1))).alias("term"))
        return words.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))

    if (counts["most"] or 0) < 2:
        df = holding(texts)
    else:  # the rows of documents that repeat are counted once, apart from the others
        again = staged(copies.where("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "pii-repeated")
        same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
        single = texts.join(again, same, "left_anti")
        repeated = texts.join(again, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
        df = holding(single).unionByName(holding(repeated)).groupBy("term").agg(F.sum("df").alias("df"))
    told = pairs.join(df, "term").join(n_entity, "entity")
    whole = F.log(F.lit(float(max(n_docs, 1))) / F.col("n_e"))
    told = told.withColumn("disclosure", F.log(F.col("n_et") * F.lit(float(max(n_docs, 1))) / (F.col("n_e") * F.col("df"))) / whole)
    return told.where((whole > 0) & (F.col("disclosure") >= rule.generalise)).select("entity", "term", "disclosure")


def _told_words(base: DataFrame, found: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, disclosure of every whole word that gives away an entity of its document, at any distance."""
    terms = found.distinct().join(told, "entity").groupBy("doc_id", "text_hash", "term").agg(F.max("disclosure").alias("disclosure"))
    terms = staged(terms.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}), "pii-told-terms")
    own = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    texts = base.where(F.col("t").isNotNull()).select("doc_id", "text_hash", "t").join(terms.select("__id", "__hash").distinct(), own, "left_semi")
    words = texts.select("doc_id", "text_hash", F.explode(_located(F.regexp_extract_all("t", F.lit(f"({TERM})"), 1), F.split("t", TERM, -1))).alias("w"))
    words = words.select("doc_id", "text_hash", "w.start", "w.end", lower_ascii(F.col("w.value")).alias("word"))
    return words.join(terms, own & (F.col("word") == F.col("term"))).select("doc_id", "text_hash", "start", "end", "disclosure")


def _clear_of_entities(hits: DataFrame, mentions: DataFrame) -> DataFrame:
    """The hits that overlap no entity of their document, by running bounds over its spans in order."""
    key = ["doc_id", "text_hash"]
    docs = hits.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    own = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    entities = mentions.join(docs, own, "left_semi").select(*key, "e.start", "e.end", F.lit(None).cast("double").alias("disclosure"))
    entity = F.col("disclosure").isNull()
    up = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    both = hits.unionByName(entities).withColumns({"before": F.max(F.when(entity, F.col("end"))).over(up), "after": F.min(F.when(entity, F.col("start"))).over(down)})
    free = ~entity & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("after"), F.col("end")) >= F.col("end"))
    return both.where(free).drop("before", "after")


def find_personal_data(docs: DataFrame, rule: Disclosure = Disclosure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, spans (start, kind_no, end, kind, disclosure), ordered by start, then kind.

    Kinds are email, ip, card, phone and, last, term; entities have disclosure 1. A term span never overlaps an entity of its document.
    A term that gives an entity away is marked wherever it stands in a document that mentions the entity. Null texts are empty, null
    ids stay; ids are whole numbers. Rows with equal id and text are one document for all counts and get equal spans.
    Texts of any length cost in proportion to their length.
    """
    base = staged(find_entities(docs, rule.near, doc_id, text), "pii-entities")
    once = base.where(F.size("entities") > 0).dropDuplicates(["doc_id", "text_hash"])
    mentions = once.select("doc_id", "text_hash", F.explode("entities").alias("e"))
    value = F.when(F.col("e.kind").isin("card", "phone"), F.regexp_replace("e.value", "[^0-9]", "")).otherwise(lower_ascii(F.col("e.value")))
    found = mentions.select("doc_id", "text_hash", F.concat_ws(":", "e.kind", value).alias("entity"))
    terms = staged(_terms_near(mentions, rule.near), "pii-near-terms")
    told = staged(disclosing_terms(docs, base, found, terms, rule, doc_id, text), "pii-told")
    span = F.struct("start", F.lit(len(KINDS)).alias("kind_no"), "end", F.lit(TERM_KIND).alias("kind"), "disclosure")
    # A word that stands against an entity without a gap is whole only beside it.
    close = terms.join(told, ["entity", "term"]).select("doc_id", "text_hash", "start", "end", "disclosure")
    hits = close.unionByName(_told_words(once, found, told)).groupBy("doc_id", "text_hash", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    hits = _clear_of_entities(staged(hits, "pii-hits"), mentions)
    hits = hits.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list(span).alias("terms"))
    out = base.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    entities = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["kind_no"].alias("kind_no"), e["end"].alias("end"), e["kind"].alias("kind"), F.lit(1.0).alias("disclosure")))
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,disclosure:double>>")
    return out.select("doc_id", "text_hash", F.array_sort(F.concat(entities, F.coalesce("terms", none))).alias("spans"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text``: entities by ``[KIND]``, terms by ``[TERM]`` or, from ``rule.remove`` on, by nothing.

    Of overlapping spans the first is replaced and the rest of the others is cut. Texts without spans, null ones too, stay
    as they are; other columns are untouched.
    """
    spans = find_personal_data(docs, rule, doc_id, text).where(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__hash"])
    keyed = docs.withColumn("__key", F.xxhash64(text_or_empty(text)))
    joined = keyed.join(spans, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left")
    t = F.col(f"`{text}`")

    def replaced(p: Column, blocks: Column) -> Column:
        """What stands for a span and the text since the spans before it (their largest end is ``at``)."""
        s = p["x"]
        tag = F.when(s["kind"] != TERM_KIND, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["disclosure"] >= rule.remove, F.lit("")).otherwise(F.lit("[TERM]"))
        return F.when(s["start"] >= p["at"], F.concat(_stretch(blocks, p["at"], s["start"]), tag)).otherwise(F.lit(""))

    spans_kind = "struct<start:int,kind_no:int,end:int,kind:string,disclosure:double>"
    placed = _running(F.col("__spans"), spans_kind, F.lit(0), lambda x: x["end"], F.greatest)
    last = F.aggregate("__spans", F.lit(0), lambda a, x: F.greatest(a, x["end"]))
    pieces = _let(_blocks(t), lambda b: F.concat(F.transform(placed, lambda p: replaced(p, b)), F.array(_stretch(b, last, F.length(t)))))
    clean = F.array_join(pieces, "")
    new = F.when(F.col("__spans").isNull(), t).otherwise(clean)
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
