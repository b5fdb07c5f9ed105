"""Personal data: base patterns, and terms that disclose the protected entities by how they occur with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, checkpoint, whole
from .spans import match_spans, no_spans

# The base patterns. Possessive repetition and the look-behinds keep matching linear; what is matched is
# the same, as nothing that follows could take back what was given.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What a text must contain for a pattern to be tried.
MAY = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
KINDS = ("email", "ip", "card", "phone", "term")
#: A number of at most 255, leading zeros allowed.
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Characters on either side of an entity by which its contexts are told apart (near copies share them).
CONTEXT_CHARS = 60
#: Candidate terms up to which they are broadcast as hashes (about 32 bytes each); beyond, a shuffle join.
BROADCAST_TERMS = 1_000_000
#: Entities with terms up to which they are broadcast with them; beyond, a shuffle join, which adaptive execution splits.
BROADCAST_ENTITIES = 50_000
WORD_SPLIT = r"[^\p{L}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, less 9 if that exceeds 9; the sum ends in 0."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(places, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, value>> of the base patterns, by start, then kind."""
    return F.array_sort(F.concat(*(_kind_spans(text, rank, kind) for rank, kind in enumerate(KINDS[:-1]))))


def _kind_spans(text: Column, rank: int, kind: str) -> Column:
    found = F.when(text.rlike(MAY[kind]), match_spans(text, PATTERNS[kind])).otherwise(no_spans())
    return F.transform(F.filter(found, lambda s: _passes(kind, s["value"])), lambda s: _marked(s, rank, kind))


def _marked(s: Column, rank: int, kind: str) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_SPLIT), lambda w: F.length(w) > 2)


def _entity(kind: Column, value: Column) -> Column:
    """Spellings of one entity: emails without case, numbers by their digits."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def disclosing_terms(docs: DataFrame, texts: DataFrame, share: float = 0.9, least: int = 3, context_chars: int = CONTEXT_CHARS, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(entity, term) where the term tells the entity: PMI(entity; term) >= share * IC(entity).

    docs has (text, spans) of documents with base spans, texts has every document's text. Terms are looked for in whole
    texts. Copies are one piece of evidence: equal texts are one text, and of texts in which an entity stands in the
    same context (the characters around it) one speaks for the others. With N distinct texts, n(e) texts that speak
    for the entity, n(e,t) of them with the term, and n(t) distinct texts with the term, less the entity's texts for
    which others speak, IC = ln(N / n(e)) and PMI = ln(n(e,t) N / (n(e) n(t))). A term must stand in ``least`` of the
    texts that speak for the entity.
    """
    total = texts.select(F.xxhash64("text").alias("h")).distinct().count()
    once = checkpoint(docs.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.first("spans").alias("spans")))
    around = once.select("h", "text", F.explode("spans").alias("s")).select(
        "h",
        _entity(F.col("s.kind"), F.col("s.value")).alias("entity"),
        F.xxhash64(
            F.substring("text", F.greatest(F.lit(1), F.col("s.start") + 1 - context_chars), F.least(F.lit(context_chars), F.col("s.start"))),
            F.substring("text", F.col("s.end") + 1, F.lit(context_chars)),
        ).alias("context"),
    )
    speaks = checkpoint(around.groupBy("entity", "context").agg(F.min("h").alias("h")).select("entity", "h").distinct())
    entities = checkpoint(speaks.groupBy("entity").agg(F.count("*").alias("ne")).where((F.col("ne") >= least) & (F.col("ne") < total)))
    of_texts = by_key(around.select("entity", "h").distinct(), entities, "entity", "ne")
    pairs = of_texts.join(speaks.withColumn("speaks", F.lit(1)), ["entity", "h"], "left").groupBy("h").agg(F.collect_list(F.struct("entity", "ne", F.coalesce("speaks", F.lit(0)).alias("speaks"))).alias("entities"))
    # an entity is counted for a term once a text; a text's entities and words lie in one row
    told = once.select("h", F.array_distinct(_words(F.col("text"))).alias("words")).join(pairs, "h")
    words = told.select("h", "entities", F.explode("words").alias("term"))
    joint = (
        words.select("term", F.explode("entities").alias("e")).groupBy("e.entity", "term")
        .agg(F.first("e.ne").alias("ne"), F.sum("e.speaks").alias("net"), F.count("*").alias("both")).where(F.col("net") >= least)
    )
    # PMI >= share * IC is n(t) <= n(e,t) * (N / n(e))^(1 - share); texts with entities alone show most words to be more frequent
    spoken = F.col("both") - F.col("net")
    most = F.col("net") * F.pow(F.lit(float(total)) / F.col("ne"), F.lit(1 - share)) * (1 + 1e-9)
    shown = words.groupBy("term").agg(F.count("*").alias("shown"))
    joint = checkpoint(joint.join(shown, "term").where(F.col("shown") - spoken <= most))
    terms = checkpoint(joint.select(F.xxhash64("term").alias("t")).distinct())
    n_terms = terms.count()
    if not n_terms:
        return joint.select("entity", "term")
    # how many of all distinct texts hold each candidate
    held = texts.select(F.xxhash64("text").alias("h"), F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).select("h", F.xxhash64("term").alias("t"))
    frequency = held.join(F.broadcast(terms) if n_terms <= broadcast_terms else terms, "t", "left_semi").distinct().groupBy("t").agg(F.count("*").alias("nt"))
    return joint.withColumn("t", F.xxhash64("term")).join(frequency, "t").where(F.col("nt") - spoken <= most).select("entity", "term")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.9, least: int = 3, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Base spans come from the patterns; failing matches are dropped without another try. In a document that holds an
    entity, words that disclose it (disclosing_terms) become spans of kind ``term``; they never replace or overlap
    base ones. A null text is empty; repeated rows and null ids pass through; an empty table gives no rows. DataFrame
    functions only. What is kept between passes is narrow, but for texts that hold personal data.
    """
    every = find_spans(docs, id_col, text_col, share, least, context_chars)
    count = lambda rank: F.size(F.filter("every", lambda s: s["rank"] == rank)).cast("long")
    return every.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:-1])),
        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"),
        count(4).alias("n_term"),
    )


def find_spans(docs: DataFrame, id_col: str, text_col: str, share: float, least: int, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """doc_id, text (null where nothing is found), spans (base ones), every (with terms)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    marked = texts.withColumn("spans", base_spans(F.col("text"))).withColumn("at", F.monotonically_increasing_id())
    found = checkpoint(marked.select("doc_id", "at", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")))
    some = found.where(F.size("spans") > 0)
    # an entity's terms are few: each stands in nearly no text without it
    terms = checkpoint(disclosing_terms(some.select("text", "spans"), texts, share, least, context_chars).groupBy("entity").agg(F.collect_set("term").alias("of")))
    entities = some.select("at", F.explode(F.array_distinct(F.transform("spans", lambda s: _entity(s["kind"], s["value"])))).alias("entity"))
    known = F.broadcast(terms) if terms.count() <= BROADCAST_ENTITIES else terms
    of_docs = entities.join(known, "entity").groupBy("at").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("of")))).alias("terms"))
    quoted = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))
    extra = F.when(F.col("terms").isNotNull(), match_spans(F.col("text"), pattern)).otherwise(no_spans())
    outside = F.filter(extra, lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    added = F.transform(outside, lambda t: _marked(t, 4, "term"))
    return found.join(of_docs, "at", "left").withColumn("every", F.array_sort(F.concat("spans", added)))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.9, least: int = 3, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """doc_id and text with base spans generalised to <KIND> and disclosing terms removed, for documents that hold any;
    other documents keep their text and are not returned."""
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.when(s["rank"] == 4, F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))))).otherwise(a["out"]).alias("out"),
    )
    some = find_spans(docs, id_col, text_col, share, least, context_chars).where(F.size("every") > 0)
    done = F.aggregate("every", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    return some.withColumn("done", done).select("doc_id", F.concat(F.array_join("done.out", ""), F.substring("text", F.col("done.at") + 1, F.length("text"))).alias("text"))
