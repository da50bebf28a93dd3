"""Personal data, and the terms that give it away, by DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers. From all
documents, co-occurrence then estimates how strongly a term near such an entity
reveals it: P(entity | term), against P(entity) in bits. A term over both
thresholds, with enough different texts behind it, is protected wherever it
stands. sanitise() puts a general name in the place of each span.

Positions come from the strings between matches: a start is the length of all
that stands before it. Patterns are possessive where that cannot change a match,
so that long runs of digits or labels need neither backtracking nor deep stacks.

Defined cases: a null text is empty and has no spans; rows that repeat count
each in the statistics and are returned each; spans that share a start follow in
the order of the kinds; an added span that touches a base span is left out; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import picked, shielded, written

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"(?<![\p{L}\p{N}])\p{N}*+\p{L}[\p{L}\p{N}]*+"
#: Characters on either side of an entity whose words count as near it.
NEAR = 80
#: Different texts behind a term and an entity; least P(entity | term); least bits over P(entity).
SUPPORT, SHARE, BITS = 3, 0.6, 6.0
#: Documents with protected terms that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_ROWS = 20_000
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row."""
    return F.transform(F.array(value), use)[0]


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda s, x: s + x)


def find(text: Column, pattern: str | Column, kind: int) -> Column:
    """All matches, leftmost first, as start, kind, end (code points) and value."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("m"), F.transform(F.split(text, regex, -1), F.length).alias("gaps"))

    def places(x: Column) -> Column:
        sizes = F.struct(x["m"].alias("m"), x["gaps"].alias("gaps"), F.transform(x["m"], F.length).alias("n"))
        return let(sizes, lambda y: F.transform(y["m"], lambda m, i: let(total(F.slice(y["gaps"], 1, i + 1)) + total(F.slice(y["n"], 1, i)), lambda at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("end"), m.alias("value")))))

    return let(both, places).cast(_SPAN)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    from_end = F.split(F.reverse(s), "")
    doubled = F.transform(F.filter(from_end, lambda c: c != ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return total(doubled) % 10 == 0


def _size_between(s: Column, least: int, most: int) -> Column:
    return F.length(s).between(least, most)


def base_spans(text: Column) -> Column:
    """E-mail, IP, card and phone spans of a text that is not null, by start and kind."""
    none = F.array().cast(_SPAN)
    has_digit = text.rlike("[0-9]")
    small = lambda part: let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    email = F.when(text.contains("@"), find(text, EMAIL, 0)).otherwise(none)
    ip = F.when(has_digit, F.filter(find(text, IP, 1), lambda s: F.forall(F.split(s["value"], r"\."), small))).otherwise(none)
    card = F.when(has_digit, F.filter(find(text, CARD, 2), lambda s: let(digits(s["value"]), lambda d: F.when(_size_between(d, 12, 19), luhn(d)).otherwise(False)))).otherwise(none)
    phone = F.when(text.contains("+"), F.filter(find(text, PHONE, 3), lambda s: _size_between(digits(s["value"]), 9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def _entity(span: Column) -> Column:
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(digits(span["value"])))


def revealing_terms(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """term: those whose occurrence tells of one entity more than the thresholds allow."""
    text = picked(docs, text_col).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = text.select("text", F.xxhash64("text").alias("t"), base_spans(F.col("text")).alias("s")).filter(F.size("s") > 0)
    around = lambda s: F.array_distinct(F.concat(F.regexp_extract_all(F.substring(F.col("text"), F.greatest(s["start"] - NEAR + 1, F.lit(1)), F.least(s["start"], F.lit(NEAR))), F.lit(WORD), F.lit(0)), F.regexp_extract_all(F.substring(F.col("text"), s["end"] + 1, F.lit(NEAR)), F.lit(WORD), F.lit(0))))
    mentions = found.select("t", F.explode(F.transform("s", lambda s: F.struct(_entity(s).alias("entity"), around(s).alias("terms")))).alias("m")).select("t", "m.*")
    entities = mentions.groupBy("entity", "t").agg(F.lit(1).alias("x")).groupBy("entity").agg(F.count(F.lit(1)).alias("texts_e"))
    near = mentions.select("t", "entity", F.explode("terms").alias("term")).groupBy("entity", "term", "t").agg(F.lit(1).alias("x")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    every = text.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs_t"))
    with_docs = mentions.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("docs"))
    counts = text.agg(F.count(F.lit(1)).cast("double").alias("n"))
    joined = near.join(with_docs, ["entity", "term"]).join(every, "term").join(entities, "entity").join(F.broadcast(counts))
    given = F.least(F.col("docs") / F.col("docs_t"), F.lit(1.0))
    return joined.filter((given >= share) & (F.log2(given * F.col("n") / F.col("texts_e")) >= bits)).select("term").distinct()


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds: float) -> DataFrame:
    """docs with columns base and added: arrays of spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    terms = revealing_terms(docs, text_col, **thresholds)
    spoken = docs.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).alias("term"))
    terms = written(terms, "revealing-terms")
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        terms = F.broadcast(terms)
    by_doc = written(spoken.join(terms, "term").groupBy("_id").agg(F.sort_array(F.collect_set("term")).alias("_terms")), "documents-with-terms")
    if by_doc.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join("_terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    with_base = docs.join(by_doc, docs[id_col].eqNullSafe(by_doc["_id"]), "left").withColumn("base", base_spans(text))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] <= s["end"]) & (s["start"] <= b["end"]))
    added = F.when(F.col("_terms").isNotNull(), F.filter(find(text, pattern, 4), apart)).otherwise(F.array().cast(_SPAN))
    return with_base.withColumn("added", added).drop("_id", "_terms")


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, their digest, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    spans = all_spans(picked(docs, id_col, text_col), id_col, text_col)
    return spans.select(id_col, *map(count, range(4)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of the text generalised to the name of its kind; a null text stays null."""
    return shielded(docs, _sanitised, id_col, text_col)


def _sanitised(docs: DataFrame) -> DataFrame:
    text_col = "text"
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    found = all_spans(docs)
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        put = F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), names[s["kind"]]).alias("out"), s["end"].alias("at"))
        over = F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= a["at"], put).otherwise(over)

    clean = let(F.aggregate(F.array_sort(F.concat("base", "added")), start, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(text.isNull() | (F.size("base") + F.size("added") == 0), text).otherwise(clean)).select(docs.columns)
