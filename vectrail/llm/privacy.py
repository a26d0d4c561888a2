"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
Each is a protected entity. A term t beside an entity e discloses it as far as it
makes e likely: with document frequencies, PMI(t, e) = log p(t, e) / (p(t) p(e))
is compared with the entity's own information -log p(e); at a ratio of
``DISCLOSURE`` or more the term's occurrences in documents that hold the entity
become spans of kind ``term``. p(e | t) is smoothed by ``PRIOR`` documents that
hold e as often as any do: the more common the entity, the more support a term
needs, and one document is enough for an entity that only it holds. ``redact``
replaces base spans by their kind and generalises terms.

Frequencies cover all documents, and t is beside e in every document that holds
both, however far apart. Terms are counted in each partition before they are
dealt out, and only terms rare enough to disclose some entity are paired with
entities; the tables of frequencies, pairs and flags are written first, so that
the planner sees their sizes and broadcasts them only when they are small.

Spans come without positions from regexp functions; so matches are fenced by
U+0001 (which no pattern matches; those of the text are exchanged first) and
positions are sums of lengths. Patterns are possessive and can't backtrack
over long runs.

Defined results: a null text is empty; an empty table gives an empty result;
repeated rows, rows of one doc_id with different texts and rows with a null
doc_id each get their spans as documents of their own; very long texts with
very many spans take time in proportion to the spans times the square root of
their number; extra columns pass through ``find_spans``, which takes other
``names`` for its results where they would clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, let, running, stage_table, table

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.9
PRIOR = 0.5
FENCE = "\x01"
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    # a match starts where a run of local characters starts, or where the last match ended
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign that a text may hold the kind at all.
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}+"


def row_key() -> Column:
    """What tells documents apart; rows of one doc_id may have different texts, and doc_id may be null."""
    return F.xxhash64("doc_id", "text").alias("row")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda x: let(F.regexp_replace(x, "^0+", ""), lambda z: (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255")))
        return F.forall(F.split(m, r"\."), small)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":

        def luhn(d: Column) -> Column:
            def value(i: Column) -> Column:
                x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
                twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
                return F.when(i % 2 == 1, twice).otherwise(x)

            total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + value(i))
            return F.when(F.length(d).between(16, 19), total % 10 == 0).otherwise(F.lit(False))

        return let(digits, luhn)
    return F.lit(True)


def fenced(text: Column, pattern: str) -> Column:
    """The text in parts, every second of which is a match."""
    return F.split(F.regexp_replace(F.translate(text, FENCE, "\x02"), pattern, f"{FENCE}$0{FENCE}"), FENCE, -1)


def matches(text: Column, pattern: str, kind: str, valid) -> Column:
    """Spans of the pattern's matches that are ``valid``, leftmost first."""
    parts = fenced(text, pattern)

    def spans(x: Column) -> Column:
        starts = running(F.transform(x, lambda part: F.length(part).cast("long")), F.lit(0), lambda at, n: at + n)
        return let(starts, lambda at: of(x, at))

    def of(x: Column, at: Column) -> Column:
        # every second part is a match
        def span(part: Column, i: Column) -> Column:
            there = F.get(at, i)
            return F.when((i % 2 == 1) & valid(part), F.struct(F.lit(kind).alias("kind"), there.alias("start"), (there + F.length(part)).cast("long").alias("end")))

        return F.filter(F.transform(x, span), lambda s: s.isNotNull())

    return let(parts, lambda x: F.when(F.size(x) == 1, F.array().cast(SPANS)).otherwise(spans(x)))


def base_spans(text: Column) -> Column:
    """All base spans, by kind, then start."""
    found = []
    for kind in KINDS:
        spans = matches(text, PATTERNS[kind], kind, lambda m, kind=kind: _valid(kind, m))
        found.append(F.when(text.rlike(SIGNS[kind]), spans).otherwise(F.array().cast(SPANS)))
    return F.concat(*found)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text in lower case, as ``TERM`` finds them, and its shorter words."""
    return F.array_distinct(F.transform(F.array_distinct(F.split(text, r"\P{L}+")), F.lower))


def entities_of(text: Column) -> Column:
    """A hash of each distinct base match of the text."""

    def of(kind: str) -> Column:
        some = F.filter(fenced(text, PATTERNS[kind]), lambda m, i: (i % 2 == 1) & _valid(kind, m))
        return F.when(text.rlike(SIGNS[kind]), F.transform(some, lambda m: F.xxhash64(F.lit(kind), m))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(*map(of, KINDS)))


def mentions(docs: DataFrame) -> DataFrame:
    """(row, entities, terms): one row for each document that holds an entity, with the distinct terms of its whole text."""
    return docs.filter(F.size("base") > 0).select(row_key(), entities_of(F.col("text")).alias("entities"), terms_of(F.col("text")).alias("terms"))


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(row, terms): the terms that disclose an entity of the document. ``docs`` has doc_id, text and base."""
    seen = stage_table(mentions(docs), "mentions")
    df_entity = stage_table(seen.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")), "entities")
    most = df_entity.agg(F.max("with_entity").alias("most")).first()["most"]
    if most is None:
        return docs.select(row_key(), F.array().cast("array<string>").alias("terms")).limit(0)
    total = float(docs.count())
    # no term of more documents than this reaches the ratio with any entity, even if every document of the entity holds it
    bound = (1 + PRIOR) * most * (total / most) ** (1 - disclosure) + 1
    in_corpus = docs.select(F.explode(terms_of(F.coalesce("text", F.lit("")))).alias("term")).filter(F.length("term") >= 3)
    df_term = stage_table(in_corpus.groupBy("term").agg(F.count(F.lit(1)).alias("with_term")), "frequencies")
    # the commonest, at most 1000 times the mean number of terms a document, go before terms are dealt out
    common = df_term.filter(F.col("with_term") > max(bound, total / 1000)).select("term")
    terms = seen.select("row", "entities", F.explode("terms").alias("term")).filter(F.length("term") >= 3).join(common, "term", "left_anti")
    rare = terms.join(df_term.filter(F.col("with_term") <= bound), "term")
    pairs = stage_table(rare.select("row", F.explode("entities").alias("entity"), "term", "with_term"), "pairs")
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"), F.first("with_term").alias("with_term"))
    scored = together.join(df_entity, "entity")
    own = F.log(total / F.col("with_entity"))
    # documents of no evidence that hold the entity as often as any do
    smooth = (F.col("together") + PRIOR * F.col("with_entity") / total) / (F.col("with_term") + PRIOR)
    pmi = F.log(smooth) + own
    flagged = stage_table(scored.filter((own > 0) & (pmi >= disclosure * own)).select("entity", "term"), "flagged")
    return stage_table(pairs.select("row", "entity", "term").join(flagged, ["entity", "term"]).groupBy("row").agg(F.collect_set("term").alias("terms")), "terms")


def find_spans(docs: DataFrame, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """Adds base spans, and base and term spans, under ``names`` to rows with doc_id and text."""
    base, spans = names
    row, own = free_names([*docs.columns, *names], "row", "terms")
    text = F.coalesce("text", F.lit(""))
    with_base = docs.withColumn(base, base_spans(text))
    terms = disclosing_terms(with_base.select("doc_id", "text", F.col(base).alias("base"))).select(F.col("row").alias(row), F.col("terms").alias(own))
    known = matches(text, TERM, "term", lambda m: F.array_contains(F.col(own), F.lower(m)))
    clear = F.filter(known, lambda x: ~F.exists(F.col(base), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    more = F.when(F.col(own).isNotNull(), clear).otherwise(F.array().cast(SPANS))
    # rows without base spans have no terms and no key to look up
    key = F.when(F.size(base) > 0, row_key())
    return with_base.withColumn(spans, key).join(terms, F.col(spans) == F.col(row), "left").withColumn(spans, F.concat(F.col(base), more)).drop(row, own)


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))))

    def build(m: Column, before: Column) -> Column:
        # finding a place in a text takes time by its distance from the start, so spans go in pieces, each with its own part of the text
        width = F.ceil(F.sqrt(F.size(m))).cast("int")
        cut = lambda x, a, b: F.substring(x, (a + 1).cast("int"), (b - a).cast("int"))

        def some(k: Column) -> Column:
            at = k * width
            spans, base = F.slice(m, at + 1, width), F.get(before, at)

            def with_part(part: Column) -> Column:
                # a span that starts after all ends before it begins a new gap in the text
                def piece(s: Column, i: Column) -> Column:
                    begin = F.get(before, at + i)
                    return F.when(s["start"] >= begin, F.concat(cut(part, begin - base, s["start"] - base), F.lit("["), s["kind"], F.lit("]")))

                return F.array_join(F.filter(F.transform(spans, piece), lambda x: x.isNotNull()), "")

            return let(cut(text, base, F.greatest(base, F.element_at(spans, -1)["start"])), with_part)

        pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(m) / width).cast("int") - 1), some)
        last = F.array_max(F.transform(m, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), cut(text, last, F.greatest(last, F.length(text))))

    def with_ends(m: Column) -> Column:
        return let(running(F.transform(m, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), lambda before: build(m, before))

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, with_ends))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
