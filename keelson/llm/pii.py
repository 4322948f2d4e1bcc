"""Information-theoretic sanitisation of personal data.

Protected entities are found by pattern. How strongly a term discloses one is estimated from the corpus: with p over
documents, PMI(entity; term) / -log p(entity) is 1 where the term is in no document without the entity and 0 where the
two are independent. p(entity | term) is smoothed towards p(entity), so an entity of a single text counts, too, and
more texts count for more. Terms whose strength for any entity exceeds a threshold are removed, those above a lower one
generalised, wherever they stand, also in texts without the entity. A term generalises to the class of all terms that
begin alike, with the longest beginning of which one term is in so many texts, and so the class too, that it can't
disclose the entities any more.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import let, whole_text, written
from keelson.llm.spans import before, placed_matches

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Quantifiers are possessive where the next part can't start with what they take; a match
#: starts at the first of a run of its characters, or where the match before it ended, so that long runs stay linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't match.
MARKS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{3,}"
#: Weight of the prior in texts: one text in which a word met nowhere else stands with an entity met nowhere else gives
#: p(entity | term) = 1 / 1.5, a strength over GENERALISE from 58 documents on.
PRIOR = 0.5
GENERALISE, REMOVE = 0.9, 0.98
#: Letters of the beginnings that classes of terms are taken by; a term that no class hides becomes [TERM].
BEGINNINGS = (1, 2, 3, 4)
#: Terms with their marks that are broadcast at most: some 30 MB.
BROADCAST_TERMS = 400_000


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "phone":
        return n.between(9, 15)
    if kind == "card":
        # Luhn: from the right, every second digit is doubled and 9 taken off where that makes two digits.
        digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
        weighed = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
        luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + weighed(i)) % 10 == 0
        return F.when(n.between(13, 19), luhn).otherwise(False)
    return F.lit(True)


def _passing(kind: str):
    return lambda h: _passes(kind, h["value"])


_HIT = "array<struct<start:bigint,end:bigint,value:string>>"


def with_hits(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column of hits for each of KINDS: start, end (code points) and value."""
    whole = whole_text(text)
    return docs.withColumns({kind: _hits(whole, kind) for kind in KINDS})


def _hits(whole: Column, kind: str) -> Column:
    none = F.array().cast(_HIT)

    def hit(v: Column, start: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))

    def placed(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.filter(let(F.split(whole, PATTERNS[kind], -1), lambda g: placed_matches(v, g, hit)), _passing(kind))).otherwise(none)

    found = let(F.regexp_extract_all(whole, F.lit(PATTERNS[kind]), F.lit(0)), placed)
    return F.when(F.contains(whole, F.lit(MARKS[kind])), found).otherwise(none) if MARKS[kind] else found


def _at(text: str, a: Column, b: Column) -> Column:
    return F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


def _rebuilt(spans: Column, piece, text: str = "text") -> Column:
    """The text with piece(span, where the spans before it end) for each of the sorted spans and what is before it."""
    ends = F.transform(spans, lambda s: s["end"])
    rest = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.length(text))
    return let(before(ends, 0, lambda a, b: F.greatest(a, b)), lambda done: F.concat(F.array_join(F.zip_with(spans, done, piece), ""), rest))


def _outside(text: str = "text") -> Column:
    """The text with blanks for its entities, so that places stay and an entity's own words aren't terms."""
    spans = F.array_sort(F.concat(*[F.transform(k, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))) for k in KINDS]))
    blanks = lambda s, d: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], d), F.lit(0)).cast("int"))
    return let(spans, lambda x: F.when(F.size(x) > 0, _rebuilt(x, lambda s, d: F.concat(_at(text, d, s["start"]), blanks(s, d)), text)).otherwise(F.col(text)))


def _terms(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    # Words hold letters only, so together they are lower-cased as each would be.
    return F.array_remove(F.array_distinct(F.split(F.lower(F.array_join(words, " ")), " ")), "")


def _entities() -> Column:
    def named(kind: str):
        return lambda h: F.concat(F.lit(f"{kind}:"), F.lower(h["value"]))

    return F.array_distinct(F.concat(*[F.transform(k, named(k)) for k in KINDS]))


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n_term): in how many documents each word is. What goes to the shuffle is a partial count for each term and
    task."""
    return written(texts.select(F.explode(_terms(_outside())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "pii-terms")


def disclosing_terms(texts: DataFrame, n_term: DataFrame, least: float = GENERALISE) -> DataFrame:
    """(term, strength, most) for terms whose strength is ``least`` or more for any entity; strength: the greatest;
    most: a term in more documents can't disclose any of these entities.

    texts: one row a document, its text_hash, text and hits. Probabilities are over all documents and co-occurrence is
    that of whole texts; the prior weighs as much as PRIOR of the different texts, or a few copies would make any word
    look like a secret. Entities of the same texts are counted as one, so a text full of addresses isn't multiplied by
    its words.
    """
    held = texts.select("text_hash", _entities().alias("entities"), _outside().alias("text")).where(F.size("entities") > 0)
    held = written(held.select("text_hash", "entities", _terms(F.col("text")).alias("terms")), "pii-held")
    members = written(held.select("text_hash", F.explode("entities").alias("entity")).groupBy("entity", "text_hash").agg(F.count(F.lit(1)).alias("n")), "pii-members")
    group = ["n_entity", "set_a", "set_b"]
    sets = members.groupBy("entity").agg(F.sum("n").alias("n_entity"), *(F.bit_xor(F.xxhash64("text_hash", F.lit(x))).alias(f"set_{x}") for x in "ab"))
    n_docs = float(texts.count())
    p_entity = F.col("n_entity") / F.greatest(F.lit(n_docs), F.col("n_entity") + 1.0)
    # A term in more documents can't reach ``least``, even if it is in all of the entity's.
    most = F.col("n_entity") * F.pow(p_entity, F.lit(least - 1)) * (1 + 1e-9)
    within = members.join(sets, "entity").select("text_hash", *group).distinct().withColumn("most", most)
    words = held.select("text_hash", F.explode("terms").alias("term")).groupBy("text_hash", "term").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.join(n_term, "term").join(within, "text_hash").where(F.col("n_term") <= F.col("most"))
    pairs = pairs.groupBy(*group, "most", "term", "n_term").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("texts"))
    prior = PRIOR * F.col("together") / F.col("texts")
    given = F.least(F.lit(1.0), (F.col("together") + prior * p_entity) / (F.col("n_term") + prior))
    strength = 1 - F.log(given) / F.log(p_entity)
    strong = pairs.select("term", "most", strength.alias("strength")).where(F.col("strength") >= least)
    return strong.groupBy("term").agg(F.max("strength").alias("strength"), F.max("most").alias("most"))


def _beginnings(term: Column) -> Column:
    return F.array_distinct(F.array(*(F.substring(term, 1, n) for n in BEGINNINGS)))


def generalised(n_term: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(term, mark): what stands for each disclosing term, nothing for one that is removed."""
    classes = n_term.select(F.explode(_beginnings(F.col("term"))).alias("beginning"), "n_term").groupBy("beginning").agg(F.max("n_term").alias("n"))
    options = disclosing.where(F.col("strength") < REMOVE).select("term", "most", F.explode(_beginnings(F.col("term"))).alias("beginning")).where("beginning <> term")
    hidden = options.join(classes, "beginning").where("n > most").groupBy("term").agg(F.max_by("beginning", F.length("beginning")).alias("beginning"))
    mark = F.when(F.col("strength") >= REMOVE, "").when(F.col("beginning").isNull(), "[TERM]").otherwise(F.concat(F.lit("["), "beginning", F.lit("*]")))
    return disclosing.join(hidden, "term", "left").select("term", mark.alias("mark"))


def told_terms(texts: DataFrame) -> DataFrame:
    """(text_hash, told): the disclosing terms (term, mark) of every different text that has any."""
    n_term = term_counts(texts)
    marks = written(generalised(n_term, written(disclosing_terms(texts, n_term), "pii-disclosing")), "pii-marks", (n_term,))
    # Every word of every text meets the marks; so few of them go to all tasks, more are joined by a shuffle of the words.
    few = marks.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    each = texts.select("text_hash", F.explode(_terms(_outside())).alias("term")).join(F.broadcast(marks) if few else marks, "term")
    each = each.groupBy("text_hash", "term").agg(F.min("mark").alias("mark"))
    return each.groupBy("text_hash").agg(F.collect_list(F.struct("term", "mark")).alias("told"))


def _with_terms(texts: DataFrame, told: DataFrame) -> DataFrame:
    """texts with the column terms: the spans (start, end, mark) of all occurrences of their disclosing terms."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,mark:string>>")

    def spans(text: Column, known: Column, pattern: Column) -> Column:
        span = lambda v, start: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), known[F.lower(v)].alias("mark"))
        every = lambda v: F.when(F.size(v) > 0, F.filter(let(F.split(text, pattern, -1), lambda g: placed_matches(v, g, span)), lambda s: s["mark"].isNotNull())).otherwise(none)
        return let(F.regexp_extract_all(text, pattern, F.lit(0)), every)

    # The terms told, as whole words; a text with a letter that changes its length in lower case has all its words tried.
    told_words = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(F.transform("told", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    found = let(_outside(), lambda text: let(F.map_from_entries("told"), lambda known: let(F.when(F.contains(text, F.lit("\u0130")), F.lit(TERM)).otherwise(told_words), lambda pattern: spans(text, known, pattern))))
    return texts.join(told, "text_hash", "left").withColumn("terms", F.when(F.col("told").isNull(), none).otherwise(found)).drop("told")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, email, ip, card, phone, terms): the spans of every row, by start; a term's say what stands for it, nothing if it is removed.

    A null text is the empty text. Repeated rows and null keys keep their rows. Other columns are not read. An empty
    table gives an empty one. Spans of different kinds may overlap.
    """
    texts = _hashed(docs.select(F.col(key).alias("key"), whole_text(text).alias("text")))
    rows = _with_terms(texts, written(told_terms(texts), "pii-told"))
    bare = {k: F.transform(k, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))) for k in KINDS}
    return rows.withColumns(bare).select(F.col("key").alias(key), *KINDS, "terms")


def _hashed(texts: DataFrame) -> DataFrame:
    return with_hits(texts).withColumn("text_hash", F.xxhash64("text"))


def joined_spans(*kinds: str) -> Column:
    """kind:start:end by kind as listed, then start."""

    def spelled(kind: str):
        return lambda s: F.concat(F.lit("term:" if kind == "terms" else f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))

    return F.array_join(F.concat(*[F.transform(k, spelled(k)) for k in kinds]), ",")


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text sanitised, columns unchanged: entities become a mark of their kind, terms their class or nothing.

    Rows without a span keep their text, null included. Texts are read a few times and never shuffled unless the table
    of the terms told outgrows a broadcast.
    """
    told = written(told_terms(_hashed(docs.select(whole_text(text).alias("text")))), "pii-told")
    inner = docs.select(whole_text(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    rows = _with_terms(_hashed(inner), told)

    def mark(kind: str):
        return lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark"))

    marked = [F.transform(k, mark(k)) for k in KINDS]
    marked.append(F.transform("terms", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["mark"].alias("mark"))))
    piece = lambda s, d: F.when(s["start"] >= d, F.concat(_at("text", d, s["start"]), s["mark"])).otherwise(F.lit(""))
    clean = let(F.array_sort(F.concat(*marked)), lambda spans: F.when(F.size(spans) > 0, _rebuilt(spans, piece)).otherwise(F.col("_all")[text]))
    return rows.select(*[(clean if c == text else F.col("_all")[c]).alias(c) for c in docs.columns])
