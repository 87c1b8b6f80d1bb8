"""Personal data: patterns for the base kinds, then information-theoretic sanitisation of revealing terms.

Base: email, ip, card and phone, leftmost and non-overlapping per kind, each match checked once. The patterns are
written so that a long run is scanned once: a match can only begin where the run begins or where the last match
ended, and runs are possessive. Matches are laid out by position through the pieces between them, which needs no
Python: piece and match lengths are summed up per document.

Terms are whole runs of letters and digits of any length, but for a fixed list of particles of up to three letters. A
protected entity is a value found by the patterns. The corpus gives n(t), the documents holding a term, n(e) and n(t, e),
the documents that hold e and, outside of all entities, t. Knowing t tells log2 p(e|t)/p(e) bits of the log2 1/p(e) that
e holds. A term that tells the share ``disclosure`` of them or more is disclosing, if there is evidence enough: at least
``support`` different texts hold both; or, for an entity in fewer texts than that, all of them hold the term and it reads
like a name or a number that stands for someone: capitalised inside a sentence beside the entity and nowhere in the corpus
begun with a small letter, or of four digits or more. (Any rare word tells all about an entity that is mentioned once, so
that counts alone can't tell names from rare words there.) All mentions of such a term become spans of kind ``term``, and
``redact`` generalises entities to their kind and removes terms. Only terms that would tell
enough if no other documents held them are counted over the whole corpus.

Defined results: null texts have no spans; a repeated id counts once and rows without id take no part
(``one_per_id``); without entities no term is disclosing, and nothing tells about an entity that all documents hold. Other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import one_per_id, save, work
from .line_dedup import LOWER, UPPER

KINDS = ("email", "ip", "card", "phone")
RUN = r"[\p{L}\p{N}]++"
NAMED = r"(?<=[\p{Ll}\p{N},;:)] |[(]|^ )\p{Lu}[\p{L}\p{N}]*+"
NUMBERED = r"(?:\p{N}\P{N}*+){4}"
# Prepositions, articles and conjunctions, which name nobody, however rare they are in a small table.
PARTICLES = "a and as at but by for if in nor of off on or the to up".split()
BITS = 1 << 20  #: of the filters for terms and documents; fixed, so what reaches the driver is bounded

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A chain of under 14 digits fails anyway, so only the starts of chains are tried and only long ones match.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


def _cut(kind: str, pattern: str, hint: Column) -> Column:
    """kind, the pieces around its matches and the matches; null without match. ``hint`` must hold for any match."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(hint & text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.split(text, pattern, -1).alias("gaps"), found.alias("hits")))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end (code points, end exclusive), value, copy (hash of the text): one row a match that holds."""
    text = F.col("text")
    cuts = F.array(
        _cut("email", EMAIL, F.contains(text, F.lit("@"))),
        _cut("ip", IP, F.contains(text, F.lit("."))),
        _cut("card", CARD, F.lit(True)),
        _cut("phone", PHONE, F.contains(text, F.lit("+"))),
    )
    per_kind = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.explode(F.filter(cuts, lambda x: x.isNotNull())).alias("cut"))
    rows = per_kind.select(
        "doc_id",
        "copy",
        F.col("cut.kind").alias("kind"),
        F.posexplode(
            F.transform(
                F.col("cut.hits"),
                lambda hit, i: F.struct(
                    F.length(F.get(F.col("cut.gaps"), i)).cast("long").alias("gap"),
                    hit.alias("value"),
                ),
            )
        ).alias("i", "hit"),
    ).select("doc_id", "copy", "kind", "i", "hit.*")
    size = F.length("value").cast("long")
    end = F.sum(F.col("gap") + size).over(W.partitionBy("doc_id", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("value", "[^0-9]", "")
    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")),
    )
    luhn = F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0
    parts = F.split("value", r"\.")
    holds = (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(4)).cast("int") <= 255)))
        .when(F.col("kind") == "card", F.when(F.length(digits).between(14, 19), luhn).otherwise(False))
        .otherwise(F.length(digits).between(10, 15))
    )
    return rows.where(holds).select("doc_id", "kind", "start", "end", "value", "copy")


def _lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _terms(text: Column) -> Column:
    return _found(_lower(text), RUN)


def _beside(docs: DataFrame, base: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, term, like: once for each document of ``chosen`` (doc_id, often: whether an entity of it is in texts enough)
    and term that it holds outside of its base spans; whether it reads like a name or a number there. Where no entity is in
    texts enough, only those that do can be disclosing."""
    passes = _sieve(chosen, "doc_id")
    before = W.partitionBy("doc_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    glued = F.col("value").rlike(r"^[\p{L}\p{N}]")
    gaps = base.join(chosen, "doc_id", "left_semi").withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    gaps = gaps.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("start") > F.col("from"), F.struct("from", F.col("start").alias("to"), glued.alias("glued")))).alias("gaps"),
        F.max("end").alias("last"),
    )
    tail = F.struct(F.col("last").alias("from"), F.length("text").cast("long").alias("to"), F.lit(False).alias("glued"))

    def piece(x: Column) -> Column:  # without the runs that touch a span: they aren't whole
        cut = F.substring("text", (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int"))
        cut = F.when(x["from"] > 0, F.regexp_replace(cut, "^" + RUN, "")).otherwise(cut)
        return F.when(x["glued"], F.regexp_replace(cut, r"(?<![\p{L}\p{N}])" + RUN + "$", "")).otherwise(cut)

    pieces = F.transform(F.concat("gaps", F.array(tail)), piece)
    docs = docs.where(passes(F.col("doc_id")))  # so that few texts are shuffled
    cut = docs.join(gaps, "doc_id").join(chosen, "doc_id").select("doc_id", "often", pieces.alias("pieces"))
    named = F.flatten(F.transform("pieces", lambda x: F.transform(_found(x, NAMED), lambda w: F.struct(_lower(w).alias("term"), F.lit(True).alias("like")))))
    words = F.flatten(F.transform("pieces", lambda x: F.transform(_terms(x), lambda w: F.struct(w.alias("term"), w.rlike(NUMBERED).alias("like")))))
    words = F.filter(words, lambda x: F.col("often") | x["like"])
    rows = cut.select("doc_id", F.explode(F.concat(words, named)).alias("word")).select("doc_id", "word.*")
    return rows.where(~F.col("term").isin(PARTICLES)).groupBy("doc_id", "term").agg(F.max("like").alias("like"))


def disclosing_terms(docs: DataFrame, base: DataFrame, at: str, *, support: int, disclosure: float) -> DataFrame | None:
    """term: the disclosing ones; None where there is no entity or no term could tell enough of one."""
    entity = F.concat("kind", F.lit(":"), F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value")))
    mentions = save(base.select("doc_id", "copy", entity.alias("entity")).distinct(), at, "mentions")
    holders = mentions.groupBy("entity").agg(F.count("*").alias("n_e"), F.count_distinct("copy").alias("e_copies"))
    n = docs.count()
    mentions = save(mentions.join(holders.where(F.col("n_e") < n), "entity"), at, "holders")
    if mentions.isEmpty():
        return None
    chosen = mentions.groupBy("doc_id", "copy").agg(F.max(F.col("e_copies") >= support).alias("often"))
    beside = save(_beside(docs, base, chosen.select("doc_id", "often")).join(chosen.select("doc_id", "copy"), "doc_id"), at, "beside")

    def enough(n_t: Column) -> Column:  # whether that tells the share: n(t, e) / n(t) * n / n(e) >= (n / n(e)) ^ disclosure
        return n_t <= F.col("n_te") * F.pow(n / F.col("n_e"), F.lit(1 - disclosure)) * (1 + 1e-9)

    # What would tell enough if no other documents held the term; those are gone through for these only.
    pairs = (
        beside.join(mentions.select("doc_id", "entity", "n_e", "e_copies"), "doc_id")
        .groupBy("term", "entity")
        .agg(
            F.max("n_e").alias("n_e"), F.max("e_copies").alias("e_copies"), F.max("like").alias("like"), F.count("*").alias("n_te"), F.count_distinct("copy").alias("copies"),
        )
        .withColumn("often", F.col("copies") >= support)
        .where(F.col("often") | (F.col("e_copies") < support) & (F.col("copies") == F.col("e_copies")) & F.col("like"))
    )
    least = beside.groupBy("term").agg(F.count("*").alias("n_b"))
    pairs = save(pairs.join(least, "term").where(enough(F.col("n_b"))).select("term", "n_e", "n_te", "often").distinct(), at, "pairs")
    passes = _sieve(pairs, "term")
    if passes is None:
        return None
    # Documents that hold a candidate, and of these the ones where it begins with a small letter.
    row = lambda small: lambda x: F.struct(x.alias("term"), F.lit(small).alias("small"))
    runs = docs.select(_found(F.col("text"), RUN).alias("runs"))
    terms = F.filter(F.array_distinct(F.transform("runs", _lower)), passes)
    small = F.filter("runs", lambda x: x.rlike(r"^\p{Ll}") & (x == _lower(x)) & passes(x))
    held = runs.select(F.explode(F.concat(F.transform(terms, row(False)), F.transform(small, row(True)))).alias("x")).select("x.*")
    held = held.groupBy("term").agg(F.count_if(~F.col("small")).alias("n_t"), F.count_if(F.col("small")).alias("n_small"))  # before the join, so that rows are few
    told = pairs.join(held, "term").where(enough(F.col("n_t")) & (F.col("often") | (F.col("n_small") == 0)))
    return save(told.select("term").distinct(), at, "told")


def _sieve(rows: DataFrame, key: str) -> Callable[[Column], Column] | None:
    """A test that the values of ``key`` pass, and a few others, which share their place in the filter. None: no rows."""
    slot = F.pmod(F.xxhash64(key), F.lit(BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64L) AS int))")
    held = dict(rows.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit)).collect())  # at most BITS / 64 of them
    if not held:
        return None
    words = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(BITS // 64))), ",").cast("array<bigint>")

    def passes(x: Column) -> Column:
        at = F.pmod(F.xxhash64(x), F.lit(BITS))
        return F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1

    return passes


def term_spans(docs: DataFrame, told: DataFrame) -> DataFrame | None:
    """doc_id, kind, start, end of each mention of the terms ``told``; None where there are none. Lengths are shuffled, not texts."""
    passes = _sieve(told, "term")
    if passes is None:
        return None
    bound = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.col("term"), F.lit(r"(?![\p{L}\p{N}])"))
    text = F.translate("text", UPPER, LOWER)
    held = docs.select("doc_id", "text", F.explode(F.filter(_terms(F.col("text")), passes)).alias("term"))
    gaps = held.select("doc_id", "term", F.posexplode(F.transform(F.split(text, bound, -1), F.length)).alias("i", "gap"))
    gaps = gaps.join(told, "term", "left_semi")
    size = F.length("term").cast("long")
    until = F.sum(F.col("gap") + size).over(W.partitionBy("doc_id", "term").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    last = F.max("i").over(W.partitionBy("doc_id", "term"))
    rows = gaps.select("doc_id", "term", "i", until.alias("end"), last.alias("last"), size.alias("size")).where("i < last")
    return rows.select("doc_id", F.lit("term").alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


def spans(docs: DataFrame, *, support: int = 3, disclosure: float = 0.9) -> DataFrame:
    """doc_id, spans: array of (start, end, kind, order), by start and then by kind as listed; a row a document that has any."""
    at = work(docs.sparkSession)
    docs = one_per_id(docs, "doc_id", "text")
    base = save(base_spans(docs), at, "base")
    rows = base.select("doc_id", "kind", "start", "end")
    told = disclosing_terms(docs, base, at, support=support, disclosure=disclosure)
    if told is not None and (more := term_spans(docs, told)) is not None:
        rows = rows.unionByName(more)
    order = F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), F.col("kind")).cast("int")
    one = F.struct(F.col("start"), order.alias("order"), F.col("end"), F.col("kind"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """doc_id, spans: one row for each document; no span: an empty array."""
    found = spans(docs, **how)
    none = F.from_json(F.lit("[]"), found.schema["spans"].dataType)
    return one_per_id(docs, "doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text: entities generalised to ``[KIND]``, disclosing terms removed. A span that begins within an
    earlier one goes with that one."""
    docs = one_per_id(docs, "doc_id", "text")
    marked = docs.join(spans(docs, **how), "doc_id", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        put = F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        gap = F.substring("text", (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        new = F.struct(F.concat(acc["out"], gap, put).alias("out"), x["end"].alias("at"))
        return F.when(x["start"] >= acc["at"], new).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at")))

    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    return marked.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(text).alias("text"))
