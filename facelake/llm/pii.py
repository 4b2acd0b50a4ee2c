"""Personal data: pattern spans, and terms that give protected entities away.

Patterns find four kinds of values (`KINDS`), whose spans stay whatever follows. Protected entities are the
values and what narrows them down (`entities`): an email's domain, a network, a number without its last
digits. How much a term tells of an entity is estimated from the whole corpus, by the documents in which
both occur, all values blanked out. An entity in a share p of the documents has an information content of
-log p; a document in which the term is seen leaves -log q of it, where q, the share of the term's n
documents that have the entity, is drawn to p as by `PRIOR` further documents, so that terms seen once or
twice count for less. The term's disclosure is the part of the content that it gives away, 1 - log q / log p,
which is the pointwise mutual information of both over the content. Terms above the threshold, in at least
`min_support` documents with the entity (`part_support` with what narrows values down), become spans of kind `term`
there. `sanitise` removes the most revealing terms and generalises the others.

Everything is built-in column expressions. Only documents with an entity carry their text on; entities without
support, and terms that are in too many documents to reach the threshold, go before the two are paired, and entities
that are in the same documents are paired as one.

Defined results: a null text is empty and has no spans; texts of any length are read whole; equal texts get
equal spans, and each of their rows counts in the corpus; repeated rows stay repeated; an empty table gives an
empty result. Positions are code points, the end exclusive. Only id, digest, base, spans and the
text that they are of are returned, so that no further column can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facelake.llm.common import stored, text_column

KINDS = ("email", "ip", "card", "phone")
ORDER = (*KINDS, "term")
#: The patterns, leftmost and non-overlapping. Possessive repeats and the check that a run begins here
#: (or that the match before ended here) find the same matches in time that grows with the text alone.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for its pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{N}]{3,}"
SPAN = "array<struct<kind:int,start:int,end:int,value:string,score:double>>"
#: Documents without evidence that a term's share is drawn by.
PRIOR = 0.5
#: Numbers of a block, when numbers are folded one after the other.
BLOCK = 64
#: Characters of the parts that a text is cut into, to find places in it.
PART = 1000
#: A table of frequent terms with no more rows than this is broadcast, to drop their rows before they move.
SMALL_TERMS = 200_000


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, fold) -> Column:
    """For each of some numbers the fold of all before it, 0 for the first; fold is associative and keeps 0.

    An aggregate that gathers an array copies it at every step, so that blocks are folded to numbers: an element looks at its own
    block and at the folds of the blocks before.
    """

    def over(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), fold)

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda parts: _let(F.transform(parts, over), lambda folds: F.flatten(F.transform(parts, lambda part, b: _let(
            over(F.slice(folds, F.lit(1), b)), lambda before: F.transform(part, lambda _, i: fold(before, over(F.slice(part, F.lit(1), i)))))))))

    return F.when(F.size(values) > 0, _let(values, blocked)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, kind: int) -> Column:
    """The spans of a pattern's matches, placed by the lengths of the pieces between them."""
    pieces = F.struct(
        F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap)).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")
    )

    def placed(z):
        steps = F.transform(z["values"], lambda v, i: F.get(z["gaps"], i) + F.length(v))
        return _let(scanned(steps, lambda a, b: a + b), lambda starts: F.transform(z["values"], lambda v, i: spanned(v, F.get(starts, i) + F.get(z["gaps"], i))))

    def spanned(value, start):
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lit(1.0).alias("score"))

    return _let(pieces, placed).cast(SPAN)


def _valid(kind: str):
    """A kind's condition on a matched value."""
    if kind == "ip":
        return lambda s: F.forall(F.split(s["value"], r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":

        def card(s):
            digits = F.regexp_replace(s["value"], "[ -]", "")
            return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)

        return card
    if kind == "phone":
        return lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(9, 15)
    return lambda s: F.lit(True)


def base_spans(text: Column) -> Column:
    """The valid spans of all kinds, by kind and start."""
    none = F.array().cast(SPAN)
    parts = []
    for i, kind in enumerate(KINDS):
        tried = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        if kind != "email":
            tried = tried & text.rlike("[0-9]")
        parts.append(F.when(tried, F.filter(matches(text, PATTERNS[kind], i), _valid(kind))).otherwise(none))
    return F.concat(*parts)


def merged(spans: Column) -> Column:
    """Spans by their place, those that overlap as one: it has the kind and score of the first by start, kind and end."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "value", "score")])))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,score:double>>")

    def parted(z):
        """A span starts a new one where no span before it reaches it; that ends where the furthest of its spans does."""
        firsts = F.filter(F.sequence(F.lit(0), F.size(z["spans"]) - 1), lambda i: F.get(z["spans"], i)["start"] >= F.get(z["before"], i))

        def whole(f):
            def one(i, place):
                s = F.get(z["spans"], i)
                last = F.coalesce(F.get(f, place + 1), F.size(z["spans"])) - 1
                end = F.greatest(F.get(z["before"], last), F.get(z["spans"], last)["end"])
                return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), end.alias("end"), s["value"].alias("value"), s["score"].alias("score"))

            return F.transform(f, one)

        return _let(firsts, whole)

    def reached(k):
        return _let(F.struct(k.alias("spans"), scanned(F.transform(k, lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias("before")), parted)

    return F.when(F.size(spans) > 0, _let(keyed, reached)).otherwise(none)


def splice(text: Column, spans: Column, put) -> Column:
    """text with put(span) in place of each of some merged spans.

    A place in a text is found by counting characters from its start, so the text is cut into parts first and places
    are looked up there; a text without spans is not touched.
    """
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))

    def spliced(z):
        def between(a, b):
            first, last = F.floor(a / PART).cast("int"), F.floor(b / PART).cast("int")
            one = F.substring(F.get(z["parts"], first), a % PART + 1, b - a)
            head, tail = F.substring(F.get(z["parts"], first), a % PART + 1, F.lit(PART)), F.substring(F.get(z["parts"], last), F.lit(1), b % PART)
            several = F.concat(head, F.array_join(F.slice(z["parts"], first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.coalesce(tail, F.lit("")))
            return F.when(a >= b, F.lit("")).when(first == last, one).otherwise(several)

        pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(z["spans"], lambda s: s["end"])), z["spans"], lambda at, s: F.struct(at.alias("at"), s.alias("s")))

        def piece(p):
            gap = between(p["at"], F.coalesce(p["s"]["start"], z["n"]))
            return F.concat(gap, F.when(p["s"].isNull(), F.lit("")).otherwise(put(p["s"])))

        return F.array_join(F.transform(pairs, piece), "")

    both = F.array(F.struct(parts.alias("parts"), spans.alias("spans"), F.length(text).alias("n")))
    return F.when(F.size(spans) > 0, F.get(F.transform(both, spliced), F.lit(0))).otherwise(text)


def entities(spans: Column) -> Column:
    """The protected entities of base spans: values, and what narrows them down."""

    def wider(s):
        value = s["value"]
        digits = F.regexp_replace(value, "[^0-9]", "")
        return (
            F.when(s["kind"] == KINDS.index("email"), F.substring_index(value, "@", -1))
            .when(s["kind"] == KINDS.index("ip"), F.substring_index(value, ".", 3))
            .otherwise(F.substring(digits, F.lit(1), F.length(digits) - 4))
        )

    def named(tag, s, value):
        return F.concat_ws(":", F.lit(tag), s["kind"].cast("string"), F.lower(value))

    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.array(named("value", s, s["value"]), named("part", s, wider(s))))))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def entity_classes(own: DataFrame, min_support: int, part_support: int) -> DataFrame:
    """(doc, entity, n_e) of the entities with support in each document of own (doc, entities), a row for each document.

    Entities that are in the same documents have the same numbers with every term, so that one class stands for all of
    them, however many values two pages have in common. A class is the number and two sums of hashes of its documents.
    """
    listed = own.select("doc", F.explode("entities").alias("value"))
    part = F.startswith("value", F.lit("part")).alias("part")
    sums = [F.sum(F.xxhash64(F.lit(seed), "doc").cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    counted = listed.groupBy("value").agg(F.count("*").alias("n_e"), *sums)
    support = F.when(part, part_support).otherwise(min_support)
    known = counted.where(F.col("n_e") >= support).select("value", F.struct(part, "n_e", "s1", "s2").alias("entity"))
    return listed.join(known, "value").select("doc", "entity").distinct()


def revealing_terms(docs: DataFrame, own: DataFrame, threshold: float, min_support: int, part_support: int) -> DataFrame:
    """(doc, term, score): the terms of each document that give one of its entities away, with their disclosure.

    docs: (text), the whole corpus. own: (doc, entities, terms, unmasked) of each row that has an entity: its
    terms without the values, and with them.

    A term that reaches the threshold with an entity in n_e documents is in few documents itself: the bound on their number
    follows from the threshold. So terms are left to their document's bound before they meet its entities.
    """
    pairs_of = stored(entity_classes(own.select("doc", "entities"), min_support, part_support), "pii-entities")
    total = docs.count()

    def bound(n_e):
        """The most documents that a term with disclosure can be in, which grows with n_e."""
        share = n_e / total
        return (n_e + PRIOR * share) / F.pow(share, F.lit(1 - threshold)) * (1 + 1e-9) - PRIOR

    n_e = F.col("entity.n_e")
    bounds = pairs_of.groupBy("doc").agg(F.max(bound(n_e)).alias("most"))
    most = bounds.agg(F.max("most")).first()[0]
    if most is None:
        most = 0.0
    # documents by term: all texts, and the difference that the masks make
    seen = docs.select(F.explode(_terms(F.col("text"))).alias("term"), F.lit(1).alias("n"))
    less = own.select(F.explode(F.array_except("unmasked", "terms")).alias("term"), F.lit(-1).alias("n"))
    more = own.select(F.explode(F.array_except("terms", "unmasked")).alias("term"), F.lit(1).alias("n"))
    n_t = stored(seen.unionByName(less).unionByName(more).groupBy("term").agg(F.sum("n").alias("n_t")).where(F.col("n_t") >= min_support), "pii-terms")
    rows = own.select("doc", F.explode("terms").alias("term"))
    frequent = n_t.where((F.col("n_t") > most) & (F.col("n_t") > total / 1000)).select("term")
    if frequent.count() <= SMALL_TERMS:
        rows = rows.join(F.broadcast(frequent), "term", "left_anti")
    rare = rows.join(n_t.where(F.col("n_t") <= most), "term").groupBy("doc", "term", "n_t").agg(F.count("*").alias("m"))
    rare = rare.join(bounds, "doc").where(F.col("n_t") <= F.col("most"))
    # m: rows with the document's text
    met = rare.join(pairs_of, "doc").where(F.col("n_t") <= bound(n_e)).select("doc", "term", "n_t", "m", "entity")
    met = stored(met, "pii-pairs")
    support = F.when(F.col("entity.part"), part_support).otherwise(min_support)
    together = met.groupBy("entity", "term", "n_t").agg(F.sum("m").alias("n_te")).where(F.col("n_te") >= support)
    share = n_e / F.lit(total)
    drawn = (F.col("n_te") + PRIOR * share) / (F.col("n_t") + PRIOR)
    score = F.when(share < 1, 1 - F.ln(drawn) / F.ln(share))
    told = together.select("entity", "term", score.alias("disclosure")).where(F.col("disclosure") >= threshold)
    return met.select("doc", "entity", "term").join(told, ["entity", "term"]).groupBy("doc", "term").agg(F.max("disclosure").alias("score"))


def find_personal_data(
    docs: DataFrame, threshold: float = 0.95, min_support: int = 2, part_support: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, digest, base, spans, text) of each row; base and spans are arrays of (kind, start, end, value, score).

    kind is a place in ORDER; spans are base and then the terms, whose score is their disclosure; text is null
    without spans. threshold: the disclosure from which a term is a span. min_support: the fewest documents that
    a term shares with a value, part_support: with what narrows values down.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_column(docs, text_col))
    seen = rows.withColumn("base", base_spans(F.col("text")))
    has = F.size("base") > 0
    base = stored(
        seen.select(
            "id", F.when(has, F.sha2("text", 256)).alias("digest"), "base", F.when(has, F.col("text")).alias("text")
        ),
        "pii-base",
    )
    blank = splice(F.col("text"), merged(F.col("base")), lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]))
    doc = F.substring(F.unhex("digest"), 1, 16).alias("doc")
    some = base.where("digest is not null").select("digest", doc, entities(F.col("base")).alias("entities"), blank.alias("masked"), _terms(F.col("text")).alias("unmasked"))
    some = stored(some.withColumn("terms", _terms(F.col("masked"))), "pii-texts")
    revealed = stored(revealing_terms(rows.select("text"), some.select("doc", "entities", "terms", "unmasked"), threshold, min_support, part_support), "pii-revealed")
    kind = ORDER.index("term")
    texts = some.select("doc", "digest", "masked").join(revealed.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
    # few bytes, but much to do for each text
    texts = texts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")
    places = texts.select("doc", "digest", F.explode(matches(F.col("masked"), TERM, kind)).alias("s"))
    found = places.select("doc", "digest", F.lower("s.value").alias("term"), "s").join(revealed, ["doc", "term"])
    span = F.struct("s.kind", "s.start", "s.end", "s.value", "score")
    marked = found.groupBy("digest").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("found"))  # no more than the text has words
    # written, so that what meets here is a plain join, whose hot digests Spark splits
    out = base.join(stored(marked, "pii-marked"), "digest", "left")
    return out.select("id", "digest", "base", F.concat("base", F.coalesce("found", F.array().cast(SPAN))).alias("spans"), "text")


def label(spans: Column) -> Column:
    """Spans as comma-joined kind:start:end."""
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sanitise(text: Column, spans: Column, remove: float = 0.99) -> Column:
    """text with each value as its kind's name; a term with a disclosure of `remove` or more goes, others become
    a number, a name or a word mark. Spans that overlap are replaced as one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def put(s):
        general = F.when(s["value"].rlike("[0-9]"), F.lit("<NUMBER>")).when(s["value"].rlike(r"^\p{Lu}"), F.lit("<NAME>")).otherwise(F.lit("<WORD>"))
        return F.when(s["kind"] < len(KINDS), F.get(names, s["kind"])).when(s["score"] >= remove, F.lit("")).otherwise(general)

    return splice(text, merged(spans), put)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == ORDER.index(kind))).cast("long")
